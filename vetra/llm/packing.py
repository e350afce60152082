"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .frames import table, texts, written

WINDOW = 1024
OPEN_WINDOWS = 64
#: Scan partitions whose leftovers are merged by one task.
MERGE_WIDTH = 8
END = 0
TOKENIZER = "byte_bpe_50k.json"

_SCHEMA = "grp int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, fill long, ids binary"
_RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, fill long"
#: Characters of which both encoders have the same idea, whatever their Unicode version.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]")


def encoder(path: str):
    """Texts -> id arrays, equal to the tokenizer file's ``encode`` without special tokens.

    The ranks of the same vocabulary drive a faster merge loop; a text with a
    character outside :data:`_PLAIN`, or with an added token spelled out (which
    is one id), goes to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @cache
    def exact() -> Tokenizer:
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, added = model["model"]["vocab"], [t["content"] for t in model.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(shown[c] for c in word): i for word, i in vocab.items() if all(c in shown for c in word)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _PLAIN.search(text) or any(t in text for t in added):
            return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


class Packer:
    """Keeps at most ``space`` open windows; emits the fullest when none fits."""

    def __init__(self, size: int, space: int, first_sequence: int) -> None:
        self.size, self.space, self.sequence = size, space, first_sequence
        self.open: list[tuple[int, int]] = []  # (room, slot), sorted: best fit is one bisection
        self.held: dict[int, list] = {}
        self.slots = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset, fill = 0, sum(p[2] for p in pieces)
        for doc, start, length, crc, total, _ in pieces:
            self.done.append((doc, start, length, crc, total, self.sequence, offset, fill))
            offset += length
        self.sequence += 1

    def place(self, piece: tuple) -> None:
        need = piece[2]
        at = bisect_left(self.open, (need, -1))
        if at < len(self.open):
            room, slot = self.open.pop(at)
        else:
            if len(self.open) >= self.space:
                self.emit(self.held.pop(self.open.pop(0)[1]))
            room, slot = self.size, self.slots
            self.slots += 1
            self.held[slot] = []
        self.held[slot].append(piece)
        if room == need:
            self.emit(self.held.pop(slot))
        else:
            insort(self.open, (room - need, slot))

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self.emit([(doc, start, self.size, _crc(ids[start : start + self.size]), total, None)])
        if whole < total:
            self.place((doc, whole, total - whole, _crc(ids[whole:]), total, ids[whole:].tobytes()))

    def leftovers(self) -> list[tuple]:
        out = [p for _, slot in self.open for p in self.held[slot]]
        self.open, self.held = [], {}
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) & 0xFFFFFFFF


def merge(pieces: list[tuple], size: int, first_sequence: int) -> list[tuple]:
    """Leftover pieces of several partitions: best fit by falling length, then cut to fill.

    Windows that stay under 15/16 after the best-fit pass are filled by
    cutting, so only the last window of a merge group can be short.
    """
    out = Packer(size, 1 << 30, first_sequence)
    for p in sorted(pieces, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
        out.place(p)
    rest: list[tuple] = []
    for room, slot in out.open:
        if room * 16 <= size:
            out.emit(out.held[slot])
        else:
            rest += out.held[slot]
    window: list[tuple] = []
    room = size
    for doc, start, _, _, total, raw in rest:
        ids = np.frombuffer(raw, np.uint32)
        while len(ids):
            cut = ids[:room]
            window.append((doc, start, len(cut), _crc(cut), total, None))
            start, ids, room = start + len(cut), ids[len(cut) :], room - len(cut)
            if not room:
                out.emit(window)
                window, room = [], size
    if window:
        out.emit(window)
    return out.done


def _rows(grp: int, done: list[tuple], left: list[tuple]) -> pa.RecordBatch:
    done = [(*d, None) for d in done] + [(*p[:5], None, None, None, p[5]) for p in left]
    cols = list(zip(*done)) if done else [()] * 9
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fill", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([grp] * len(done), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["grp", *names])


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows of at most ``window`` tokens.

    Each document is its token ids and then ``end_id``; a null or empty text
    is that one id.  A null doc_id is kept as null.  Repeated rows are packed
    once each.  An empty table gives no rows.  Every scan partition keeps
    ``open_windows`` windows; what it leaves open is merged by groups of
    :data:`MERGE_WIDTH` partitions, so no task holds more than their leftovers;
    finished pieces are not shuffled.
    ``fill`` is the number of tokens in the piece's sequence.
    """
    docs = texts(docs)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    tail = np.array([end_id], np.uint32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, part << 32)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), tail]))
            if packer.done:
                yield _rows(part // MERGE_WIDTH, packer.done, [])
                packer.done = []
        yield _rows(part // MERGE_WIDTH, packer.done, packer.leftovers())

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        pieces = list(zip(*(group[c].to_pylist() for c in ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])))
        done = merge(pieces, window, (1 << 62) | (key[0].as_py() << 32))
        cols = list(zip(*done)) if done else [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    placed = written(docs.mapInArrow(place, _SCHEMA), "placed")
    names = [f.name for f in placed.schema.fields[1:-1]]
    return placed.where("ids IS NULL").select(names).unionAll(placed.where("ids IS NOT NULL").groupBy("grp").applyInArrow(finish, _RESULT))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
