import hashlib
import re

from cases import SF, awkward, frame

from vetra.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    table = {}
    for item, text in items:
        w = words(text)
        size = min(span, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            table.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(k) for k in table}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := table.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def key(rows):
    return sorted(map(str, rows))


def test_table(spark):
    got = [tuple(r) for r in decontaminate.op9_decontaminate(spark, SF).collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert key(got) == key(brute(docs, items))
    assert any(r[5] for r in got)


def test_awkward_in_one_block_and_in_many(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    items = [(1, docs[3][1]), (2, "ONE"), (3, None), (4, ""), (5, "zebra of"), (6, docs[5][1]), (6, docs[6][1]), (7, docs[3][1] + " more"), (None, "in the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = key((d, n, h, c, s) for d, n, h, c, s, _ in brute(docs, [i for i in items if i[0] is not None] , 10))
    bench_ids = bench.where("item_id IS NOT NULL")
    for limit in (1 << 20, 150):
        out = decontaminate.contamination(frame(spark), bench_ids, block_bytes=limit).collect()
        assert key((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in out) == want
    assert decontaminate.contamination(frame(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_columns_with_the_names_of_results(spark):
    docs = frame(spark).selectExpr("*", "1 AS n_words", "'x' AS n_hit", "true AS items", "0 AS spans", "7 AS vetra_row")
    bench = spark.createDataFrame([(1, awkward()[3][1])], "item_id long, text string")
    want = key((d, n, h) for d, n, h, *_ in brute([(r[0], r[1]) for r in awkward()], [(1, awkward()[3][1])]))
    for limit in (1 << 20, 1):
        got = decontaminate.contamination(docs, bench, block_bytes=limit).collect()
        assert key((r.doc_id, r.n_words, r.n_hit) for r in got) == want


def test_a_column_of_the_input_keeps_its_values_in_either_way(spark):
    docs = frame(spark).selectExpr("doc_id", "text", "7 AS vetra_row")
    bench = spark.createDataFrame([(1, awkward()[3][1])], "item_id long, text string")
    for limit in (1 << 20, 1):
        out = decontaminate.marked(docs, bench, block_bytes=limit)
        assert {r.vetra_row for r in out.collect()} == {7} and out.columns[:3] == ["doc_id", "text", "vetra_row"]


def test_a_window_of_very_many_items_and_documents_in_joins(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    items = [(i, f"{shared} x{i}") for i in range(120)]
    docs = [(i, f"a{i} {shared} b{i}") for i in range(150)] + [(1000, "nothing here")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=1).collect()
    assert key((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got) == key((d, w, h, n) for d, w, h, n, *_ in brute(docs, items))
