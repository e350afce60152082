"""A project's files as a data source: directories are listed and files read where tasks run.

The driver lists names of the upper directories only, until there are enough
parts to deal out; a task walks its part, leaves out directories before it
enters them and opens only what passes.  Names that begin with a dot or an
underscore are files like others.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from . import files as names

SCHEMA = "path string, length long, content string"
#: Rules of a later kind give way to those of an earlier one, wherever they stand (fixed values).
KINDS = [".ignore", ".gitignore", ".git/info/exclude", "global"]
#: Bytes of content and files in one batch.
BATCH_BYTES, BATCH_FILES = 8 << 20, 512
#: Directories that the driver lists at most to find parts.
LISTED = 2000


# ---- ignore rules, one step for each part of a path ------------------------------------


class Rule(NamedTuple):
    """A pattern by parts of a path (None stands for any number of them), and its place among all rules: the greatest that matches counts."""

    parts: tuple
    keep: bool
    folders: bool
    place: tuple


@cache
def _part(glob: str) -> re.Pattern:
    """The pattern of one part of a path."""
    out = ""
    for piece in re.findall(r"\*+|\?|\[!?\]?[^\]]*\]|\\.|.", glob, re.S):
        if piece[0] == "*":
            out += ".*"
        elif piece == "?":
            out += "."
        elif piece[0] == "[" and len(piece) > 1:
            out += "[" + ("^" if piece[1] == "!" else "") + re.sub(r"([\\\[\]])", r"\\\1", piece[1:-1].removeprefix("!")) + "]"
        else:
            out += re.escape(piece[-1])
    return re.compile(out, re.S)


def rules_of(text: str, kind: int, depth: int) -> list[Rule]:
    """The rules of an ignore file of one of KINDS that lies ``depth`` directories below the root."""
    out = []
    for at, line in enumerate(text.splitlines()):
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        glob = line[keep:]
        folders = glob.endswith("/")
        glob = glob.rstrip("/")
        parts = [None if p == "**" else p for p in glob.removeprefix("/").split("/")]
        if "/" not in glob and parts != [None]:
            parts.insert(0, None)
        if any(p for p in parts) or parts == [None]:
            out.append(Rule(tuple(parts), keep, folders, (-kind, depth, at)))
    return out


def begun(rules: list[Rule]) -> list[tuple[Rule, int]]:
    return [(r, 0) for r in rules]


def stepped(states: list[tuple[Rule, int]], name: str, folder: bool) -> tuple[list[tuple[Rule, int]], bool | None]:
    """What the rules in these states have left to match after one more part of a path, and whether that path is ignored (None: no rule says)."""
    after: dict[tuple[Rule, int], None] = {}
    hit: Rule | None = None
    for rule, at in states:
        todo = [at]
        while todo:
            k = todo.pop()
            last = k + 1 == len(rule.parts)
            if rule.parts[k] is None:
                after[rule, k] = None
                if not last:
                    todo.append(k + 1)
            elif _part(rule.parts[k]).fullmatch(name):
                if not last:
                    after[rule, k + 1] = None
            else:
                continue
            if last and (folder or not rule.folders) and (hit is None or rule.place > hit.place):
                hit = rule
    return list(after), None if hit is None else not hit.keep


# ---- walking --------------------------------------------------------------------------


class Wanted(NamedTuple):
    """Which files of a project count: the same for a walk and for given paths."""

    max_bytes: int = 1_000_000
    include_tests: bool = False
    extra_excludes: tuple[str, ...] = ()
    prefix: str = ""

    def enters(self, path: str) -> bool:
        """Whether a directory, or the directories of a file, may hold what counts."""
        parts = path.split("/")
        if set(parts) & set(names.EXCLUDED_DIRS) or any(x in path for x in self.extra_excludes):
            return False
        if not self.include_tests and {p.lower() for p in parts} & {"test", "tests", "__tests__"}:
            return False
        return path.startswith(self.prefix) or self.prefix.startswith(f"{path}/")

    def takes(self, path: str) -> bool:
        name = path.rpartition("/")[2]
        low = name.lower()
        ext = name.rpartition(".")[2] if "." in name[1:] else ""
        known = ext in names.SOURCE_EXTENSIONS or low == "dockerfile" or low.startswith(".env") or ext.lower() in names.CONFIG_EXTENSIONS
        test = not self.include_tests and re.search(r"(_test\.go|_test\.rs)$|\.test\.|\.spec\.", name)
        return known and not test and path.startswith(self.prefix) and self.enters(path)


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root) if root.startswith("file:") else root)


def _text(fs: pafs.FileSystem, path: str) -> str | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def _join(*parts: str) -> str:
    return "/".join(p for p in parts if p)


def _rules_here(fs: pafs.FileSystem, base: str, folder: str, shared: str, there: set[str] | None = None) -> list[Rule]:
    """The rules that a directory adds; ``there``: the names in it, if they are known."""
    depth = folder.count("/") + 1 if folder else 0
    out = []
    for kind, name in enumerate(KINDS[:2] + (KINDS[2:3] if not folder else [])):
        if there is None or name.partition("/")[0] in there:
            out += rules_of(_text(fs, _join(base, folder, name)) or "", kind, depth)
    return out + (rules_of(shared, 3, 0) if not folder else [])


def walked(fs: pafs.FileSystem, base: str, folder: str, deep: bool, wanted: Wanted, shared: str) -> Iterator[tuple[str, int]]:
    """(path below the root, size) of the files that count in a directory and, with ``deep``, below it."""
    states, above = [], ""
    for part in folder.split("/") if folder else []:
        states += begun(_rules_here(fs, base, above, shared))
        states, ignored = stepped(states, part, True)
        if ignored:
            return
        above = _join(above, part)
    todo = [(folder, states)]
    while todo:
        here, states = todo.pop()
        infos = fs.get_file_info(pafs.FileSelector(_join(base, here)))
        states = states + begun(_rules_here(fs, base, here, shared, {i.base_name for i in infos}))
        for info in infos:
            path = _join(here, info.base_name)
            inside = info.type == pafs.FileType.Directory
            if inside and not (deep and wanted.enters(path)) or not inside and not (wanted.takes(path) and info.size <= wanted.max_bytes):
                continue
            further, ignored = stepped(states, info.base_name, inside)
            if ignored:
                continue
            if inside:
                todo.append((path, further))
            else:
                yield path, info.size


def batches(fs: pafs.FileSystem, base: str, found: Iterator[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Paths with their texts; what is no UTF-8 is left out."""
    rows: list[tuple[str, int, str]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["path", "length", "content"])

    for path, size in found:
        with fs.open_input_stream(_join(base, path)) as f:
            raw = f.read()
        try:
            rows.append((path, size, raw.decode()))
        except UnicodeDecodeError:
            continue
        held += size
        if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
            yield batch()
            rows, held = [], 0
    yield batch()


# ---- Spark -----------------------------------------------------------------------------


class Part(InputPartition):
    """A directory, with all below it or without."""

    def __init__(self, folder: str, deep: bool) -> None:
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class ProjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.parts = int(options.get("parts", "64"))
        self.shared = options.get("ignore", "")
        self.wanted = Wanted(int(options.get("maxbytes", "1000000")), options.get("includetests", "false").lower() == "true", tuple(json.loads(options.get("extraexcludes", "[]"))))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Sizes and path prefixes decide before a file is opened; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("length",):
                self.wanted = self.wanted._replace(max_bytes=min(self.wanted.max_bytes, f.value - isinstance(f, LessThan)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.wanted.prefix:
                self.wanted = self.wanted._replace(prefix=f.value)
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Upper directories by breadth until there are ``parts`` of them; a listed one is a part without what is below."""
        fs, base = opened(self.root)
        whole, flat = deque([""]), []
        while whole and len(whole) + len(flat) < self.parts and len(flat) < LISTED:
            folder = whole.popleft()
            flat.append(folder)
            for info in sorted(fs.get_file_info(pafs.FileSelector(_join(base, folder))), key=lambda x: x.path):
                if info.type == pafs.FileType.Directory and self.wanted.enters(_join(folder, info.base_name)):
                    whole.append(_join(folder, info.base_name))
        return [Part(f, False) for f in flat] + [Part(f, True) for f in whole]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.root)
        return batches(fs, base, walked(fs, base, partition.folder, partition.deep, self.wanted, self.shared))


class ProjectSource(DataSource):
    """``spark.read.format("vetra_project")``: path, length, content of a project's files.

    Options: maxBytes, includeTests, extraExcludes (a JSON list of what no path
    may hold), ignore (rules of all projects, as text), parts (least number of
    tasks, if there are so many directories).
    """

    @classmethod
    def name(cls) -> str:
        return "vetra_project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        return ProjectReader({k.lower(): v for k, v in self.options.items()})


def load(spark: SparkSession, root: str, wanted: Wanted = Wanted(), ignore: str = "", parts: int | None = None) -> DataFrame:
    """(path, length, content) of the files below ``root`` that count and no ignore file names."""
    spark.dataSource.register(ProjectSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters, which Spark refuses without it
    options = {"maxBytes": wanted.max_bytes, "includeTests": wanted.include_tests, "extraExcludes": json.dumps(list(wanted.extra_excludes)), "ignore": ignore, "parts": parts or max(64, 4 * spark.sparkContext.defaultParallelism)}
    return spark.read.format("vetra_project").options(**{k: str(v) for k, v in options.items()}).load(root)


def load_paths(root: str, paths: DataFrame, wanted: Wanted = Wanted()) -> DataFrame:
    """(path, length, content) of the given paths (path, below ``root``) that exist and count; ignore files have no say here."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root.rstrip("/"))

        def found() -> Iterator[tuple[str, int]]:
            for batch in rows:
                asked = [p for p in batch.column(0).to_pylist() if p and wanted.takes(p)]
                for path, info in zip(asked, fs.get_file_info([_join(base, p) for p in asked])):
                    if info.type == pafs.FileType.File and info.size <= wanted.max_bytes:
                        yield path, info.size

        yield from batches(fs, base, found())

    return paths.select("path").distinct().mapInArrow(run, SCHEMA)


def save(files: DataFrame, root: str) -> int:
    """Writes (path, content) as files below ``root`` where the tasks run; the number of files."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root.rstrip("/"))
        n = 0
        for batch in rows:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to = _join(base, path)
                fs.create_dir(to.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(to) as f:
                    f.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
