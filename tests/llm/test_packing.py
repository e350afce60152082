import zlib

import numpy as np
from cases import SF, frame

from vetra.llm import packing


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, window):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(tokens(t))
    assert pieces.keys() == want.keys()
    for d, own in pieces.items():
        if len(want[d]) > 1:
            assert sum(r.length for r in own) == sum(map(len, want[d]))
            continue
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = want[d][0][at : at + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d][0])
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want[d][0])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].fill <= window
    return sum(window - own[0].fill for own in sequences.values()) / max(1, sum(own[0].fill for own in sequences.values()))


def test_awkward(spark):
    docs = frame(spark)
    check(packing.pack(docs, window=64, open_windows=3).collect(), [(r.doc_id, r.text) for r in docs.collect()], 64)


def test_table_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check(packing.op1_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024) < 0.01


def test_empty(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_equal_to_the_tokenizer():
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path(packing.TOKENIZER))
    for t in ["", "Hello  world\n\n x", "don't 12345 ééé", "a" * 5000, "x   y", "日本語 \U0001f600", "a\x85b\x1fc", "<|endoftext|>", " \t\r\n  z"]:
        assert [*encode(t), 0] == tokens(t), t
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
