from pyspark.sql import functions as F

from vetra.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


def test_lines(spark):
    for text, want in {"": [], "a": ["a"], "a\n": ["a"], "a\r\n\r\nb\r": ["a", "", "b"], "\n": [""], "a\n\n": ["a", ""], "a\r\r\n": ["a\r"]}.items():
        assert one(spark, text, T.lines_of) == want, text
    assert one(spark, None, T.lines_of) is None


def test_white_space_of_all_scripts(spark):
    assert one(spark, " \xa0 a 　 b\x85", T.normalized_line) == "a b"
    assert one(spark, " \xa0", T.normalized_line) is None and one(spark, "  // x", T.normalized_line) is None


def test_assignments_and_strings(spark):
    assert tuple(one(spark, "a = b := c", T.assignment)) == ("a = b ", " c")
    assert tuple(one(spark, "x = y == z", T.assignment)) == ("x ", " y == z")
    assert one(spark, "a >= b", T.assignment) is None
    assert one(spark, "f('x', \"open", T.without_strings) == "f( ,  "


def test_versions_and_ids(spark):
    assert tuple(one(spark, "v1.2.3-rc1", T.version_triple)) == (1, 2, 3) and tuple(one(spark, "1.2", T.version_triple)) == (1, 2, 0)
    assert one(spark, "1.2.3.4", T.version_triple) is None
    assert one(spark, "unit tests", T.check_rule_id) == "FG-CHECK-UNIT-TESTS"
    assert one(spark, "URL: https://h/", T.normalized_resource) == "url:https://h" and one(spark, "nothing", T.normalized_resource) is None
    assert one(spark, "env A=1 test cargo run", T.first_command_token) == "cargo"
