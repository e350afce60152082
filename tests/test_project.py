import pytest

from vetra.sources import files, project


def write(root, tree):
    for path, text in tree.items():
        to = root / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(text if isinstance(text, bytes) else (text or "x = 1\n").encode())


def paths(df):
    return sorted(r.path for r in df.collect())


IGNORED = [  # rules, path, whether a folder, what they say
    ("*.py", "a/b.py", False, True), ("/*.py", "a/b.py", False, None), ("/*.py", "b.py", False, True), ("a/", "a", True, True), ("a/", "a", False, None), ("a/b", "c/a/b", True, None), ("**/a/b", "c/a/b", True, True),
    ("a/**/b", "a/b", False, True), ("a/**/b", "a/x/y/b", False, True), ("a/**", "a", True, None), ("a/**", "a/x", False, True), ("*\n!b.py", "b.py", False, False), ("!b.py\n*", "b.py", False, True), ("a[!0-9].py", "ax.py", False, True),
    ("a[!0-9].py", "a1.py", False, None), ("\\#x", "#x", False, True), ("\\!x", "!x", False, True), ("# x", "x", False, None), ("x ", "x", False, True), ("?.py", "a.py", False, True), ("?.py", "ab.py", False, None), ("**", "a/b", False, True), ("a.b", "axb", False, None),
]


@pytest.mark.parametrize(("rules", "path", "folder", "says"), IGNORED)
def test_rules_are_matched_part_by_part(rules, path, folder, says):
    states, got = project.begun(project.rules_of(rules, 1, 0)), None
    parts = path.split("/")
    for i, part in enumerate(parts):
        states, got = project.stepped(states, part, folder or i + 1 < len(parts))
        if got and i + 1 < len(parts):
            break  # nothing below an ignored folder is looked at
    assert got is says


TREE = {
    ".gitignore": "*.gen.py\n/only/\n!keep.gen.py\n", ".git/info/exclude": "local*.py\nkeep.gen.py\n", "pkg/.gitignore": "!local.py\nz.py\n", "pkg/.ignore": "!z.py\nw.py\n", "a.gen.py": "", "keep.gen.py": "", "only/b.py": "", "pkg/only/c.py": "",
    "pkg/local.py": "", "local.py": "", "pkg/z.py": "", "pkg/w.py": "", "__init__.py": "", "_x/.y/d.js": "", ".env.local": "K=1", "node_modules/e.js": "", "tests/f.py": "", "g_test.go": "", "big.py": "#" * 99, "bad.py": b"\xff", "shared.log.yaml": "", "none.bin": "", "deep/er/h.py": "", "vendored/i.py": "",
}
COUNT = [".env.local", "__init__.py", "_x/.y/d.js", "deep/er/h.py", "keep.gen.py", "pkg/local.py", "pkg/only/c.py", "pkg/z.py"]


@pytest.mark.parametrize("parts", [1, 4, 100])
def test_however_it_is_dealt_out_the_same_files_count(spark, tmp_path, parts):
    write(tmp_path, TREE)
    got = project.load(spark, str(tmp_path), project.Wanted(90, extra_excludes=("vendored",)), "shared.log.yaml\n", parts)
    assert paths(got) == COUNT
    assert got.where("path = '_x/.y/d.js'").first().content == "x = 1\n"
    assert got.rdd.getNumPartitions() == {1: 1, 4: 5, 100: 8}[parts]


def test_tests_on_demand(spark, tmp_path):
    write(tmp_path, TREE)
    assert set(paths(files.scan(spark, str(tmp_path), 90, include_tests=True))) - set(COUNT) == {"tests/f.py", "g_test.go", "vendored/i.py", "shared.log.yaml"}


def test_given_paths_are_read_whatever_ignore_files_say(spark, tmp_path):
    write(tmp_path, TREE)
    asked = spark.createDataFrame([("only/b.py",), (f"{tmp_path}/a.gen.py",), ("node_modules/e.js",), ("tests/f.py",), ("missing.py",), ("none.bin",), ("bad.py",), ("deep/er",), ("only/b.py",), (None,)], "path string")
    got = files.scan(spark, str(tmp_path), paths=asked)
    assert paths(got) == ["a.gen.py", "only/b.py"]
    assert files.scan(spark, str(tmp_path), paths=asked.where("false")).count() == 0


def test_filters_reach_the_walk(spark, tmp_path):
    write(tmp_path, TREE)
    reader = project.ProjectReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, LessThanOrEqual, StringStartsWith

    rest = list(reader.pushFilters([LessThanOrEqual(("length",), 6), StringStartsWith(("path",), "pkg/"), EqualTo(("path",), "x")]))
    assert rest == [EqualTo(("path",), "x")]
    assert reader.wanted.max_bytes == 6 and [p.folder for p in reader.partitions() if p.folder] == ["pkg", "pkg/only"]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.column("path").to_pylist()]
    assert sorted(found) == ["pkg/local.py", "pkg/only/c.py", "pkg/z.py"]


def test_an_empty_project(spark, tmp_path):
    assert files.scan(spark, str(tmp_path)).count() == 0


def test_files_are_saved_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i % 3}/_f{i}.py", f"x = {i}\n") for i in range(20)], "path string, content string").repartition(3)
    assert project.save(df, str(tmp_path)) == 20
    assert {(r.path, r.content) for r in files.scan(spark, str(tmp_path)).collect()} == {tuple(r) for r in df.collect()}
