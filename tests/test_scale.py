"""How work is dealt out, on small tables."""

from pyspark.sql import functions as F

from vetra.operators import rules
from vetra.operators.closure import cut
from vetra.plans import code_catalog
from vetra.sources import syntax

SF = "/root/testdata/sf0.001"


def mapped(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")


def test_files_of_one_task_are_parsed_in_several(spark):
    files = spark.range(200).coalesce(1).select(F.concat(F.col("id"), F.lit(".py")).alias("path"), F.concat(F.lit("f("), "id", F.lit(")\n")).alias("content"))
    for made in (syntax.nodes(files), rules.symbols(files.withColumn("content", F.concat(F.lit("import a"), "content")))):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_functions_are_parsed_once(spark):
    assert mapped(code_catalog._functions(spark, SF)) == 0


def test_flows_take_calls_from_the_node_table(spark):
    text = "def f(a, b):\n    v = a\n    eval(v)\ndef g():\n    eval(x)\n    eval('1')\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "f(1)\n"), ("c.js", "el.innerHTML = location.search;\n")], "path string, content string")
    nodes = cut(syntax.nodes(files), "nodes")
    made = rules.flows(files, nodes=nodes)
    assert mapped(made) == 1
    want = [("a.py", "command", False), ("a.py", "command", True), ("c.js", "html", True)]
    assert sorted((r.path, r.sink, r.reached) for r in made.collect()) == want == sorted((r.path, r.sink, r.reached) for r in rules.flows(files).collect())


def test_pairs_are_made_at_their_shortest_distance(spark, monkeypatch):
    from vetra.operators import closure

    edges = [(i, i + 1) for i in range(20)] + [(5, 9), (20, 18), (30, 31), (31, 30), (40, 40), (2, 12)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = {}
    for a in after:
        front, n = after[a], 1
        while front:
            want.update({(a, b): n for b in front})
            front, n = {c for b in front for c in after.get(b, ()) if (a, c) not in want}, n + 1
    kept = []
    plain = closure.cut
    monkeypatch.setattr(closure, "cut", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    got = closure.reach(spark.createDataFrame(edges, "src long, dst long"))
    assert got.columns == ["src", "dst"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert {(r.src, r.dst): r.n for r in kept[-1].collect()} == want
