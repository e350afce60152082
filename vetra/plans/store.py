"""Baselines and reports on storage."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.closure import shared_folder
from ..operators.policy import baseline_of, checked_baseline
from ..schema import BASELINE, RULES
from ..sources.project import opened
from .report import sarif_checks, sarif_results

VERSION = 2
_HEAD = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": '
#: Bytes that are copied at once.
COPY_BYTES = 8 << 20


def write_baseline(findings: DataFrame, path: str, force: bool = False) -> None:
    """The bag of known findings, one JSON row a key; an old one is replaced only if forced."""
    rows = baseline_of(findings).withColumn("path", T.portable_path(F.col("path"))).withColumn("version", F.lit(VERSION))
    rows.orderBy("rule_id", "path", "evidence").write.mode("overwrite" if force else "errorifexists").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A written bag; unknown versions and counts under one are errors."""
    rows = spark.read.schema(f"{BASELINE}, version int").json(path)
    known = rows.where(F.assert_true(F.col("version").isin(1, 2), F.lit("unsupported baseline version")).isNull())
    return checked_baseline(known.drop("version"), VERSION)


def baseline_total(baseline: DataFrame) -> int:
    return baseline.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


class StateLog:
    """The last row of each session, as a log of sorted-out runs on shared storage.

    A commit writes a run and then a manifest that names all live runs; the
    manifest with the largest number counts, and it appears by a rename, so a
    reader sees all of a commit or nothing.  A batch whose number is in the
    manifest already is skipped: replaying it changes nothing.  Runs are merged
    so that each is at least twice as large as all newer ones together: there
    are log(sessions) of them, with at most twice the rows of the live sessions,
    and a row is rewritten log(sessions) times.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "session", order: str = "seq") -> None:
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """number, batch (the last one committed) and runs (name, rows), oldest first."""
        if not self._fs.exists(self._at("")):
            return {"number": 0, "batch": -1, "runs": []}
        numbers = [int(x.getPath().getName().removeprefix("manifest-")) for x in self._fs.listStatus(self._at("")) if x.getPath().getName().startswith("manifest-")]
        if not numbers:
            return {"number": 0, "batch": -1, "runs": []}
        stream = self._fs.open(self._at(f"manifest-{max(numbers)}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        new = self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        to = self._at(f"manifest-{manifest['number']}")
        if self._fs.exists(to) or not self._fs.rename(new, to):
            raise RuntimeError("another writer has committed meanwhile")

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), self.order).alias("x")).select("x.*")

    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{r['name']}" for r in runs))

    def _write(self, rows: DataFrame) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return {"name": name, "rows": self._read([{"name": name}]).count()}

    def commit(self, rows: DataFrame, batch: int) -> bool:
        """Adds the rows of a batch, at most once; whether it was new."""
        now = self.manifest()
        if batch <= now["batch"]:
            return False
        columns = self.spark.createDataFrame([], self.schema).columns
        run = self._write(self._last(rows.select(columns)))
        runs = [*now["runs"], run] if run["rows"] else now["runs"]
        self._swap({"number": now["number"] + 1, "batch": batch, "runs": self._compacted(runs)})
        return True

    def _compacted(self, runs: list[dict]) -> list[dict]:
        at = len(runs) - 1
        newer = runs[-1]["rows"] if runs else 0
        while at > 0 and runs[at - 1]["rows"] < 2 * newer:
            at -= 1
            newer += runs[at]["rows"]
        return runs if at >= len(runs) - 1 else [*runs[:at], self._write(self._last(self._read(runs[at:])))]

    def read(self) -> DataFrame:
        """The last row of each session."""
        return self._last(self._read(self.manifest()["runs"]))

    def clean(self) -> int:
        """Removes runs and manifests that the present manifest doesn't need; how many. Readers of older ones must be done."""
        now = self.manifest()
        live = {r["name"] for r in now["runs"]} | {f"manifest-{now['number']}"}
        gone = [x.getPath() for x in self._fs.listStatus(self._at("")) if x.getPath().getName() not in live]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def keep_states(results: DataFrame, path: str, state: str, key: str = "session", order: str = "seq"):
    """Starts a stream that keeps the last row of each session in a :class:`StateLog`; a repeated batch changes nothing."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results.schema.fields)

    def keep(batch: DataFrame, number: int) -> None:
        StateLog(batch.sparkSession, path, schema, key, order).commit(batch, number)

    return results.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


def kept_states(spark: SparkSession, path: str, schema: str, key: str = "session", order: str = "seq") -> DataFrame:
    """The last row of each session that :func:`keep_states` wrote."""
    return StateLog(spark, path, schema, key, order).read()


def write_report(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def sarif(findings: DataFrame, checks: DataFrame, tool: str = "vetra", limit: int = 25_000) -> str:
    """One SARIF 2.1.0 document, for the hosts that read no larger one than ``limit`` results.

    Larger sets go through :func:`write_sarif`.
    """
    results = [json.loads(r.result) for r in sarif_results(findings).orderBy("path", "line", "rule_id").limit(limit + 1).collect()]
    failed = sarif_checks(checks).orderBy("name").limit(limit + 1 - len(results)).collect() if len(results) <= limit else []
    if len(results) + len(failed) > limit:
        raise ValueError(f"more than {limit} results; use write_sarif()")
    results += [json.loads(r.result) for r in failed]
    rules = [_rule(*r) for r in RULES]
    rules += [json.loads(r.rule) for r in sarif_check_rules(checks).orderBy("name").collect()]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


def _rule(i: str, severity: str, confidence: str, title: str) -> dict:
    level = {"error": "error", "warning": "warning", "info": "note"}[severity]
    return {"id": i, "name": title, "shortDescription": {"text": title}, "defaultConfiguration": {"level": level}, "properties": {"confidence": confidence}}


def sarif_check_rules(checks: DataFrame) -> DataFrame:
    """(name, rule): the rule of each failed check, as JSON."""
    level = F.struct(F.when(F.col("required"), "error").otherwise("warning").alias("level"))
    rule = F.struct(T.check_rule_id(F.col("name")).alias("id"), F.concat(F.lit("Failed check: "), "name").alias("name"), F.struct(F.concat(F.lit("Check "), "name", F.lit(" failed")).alias("text")).alias("shortDescription"), level.alias("defaultConfiguration"))
    return checks.where("NOT success").select("name", F.to_json(rule).alias("rule"))


def _in_order(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """(value, rule): all results in the order of reports, each failed check with its own rule."""
    found = sarif_results(findings).select(F.lit(0).alias("kind"), "path", "line", "rule_id", F.col("result").alias("value"), F.lit(None).cast("string").alias("rule"))
    own = sarif_check_rules(checks).distinct().groupBy("name").agg(F.array_sort(F.collect_list("rule")).alias("rules"))  # at most two: required or not
    failed = sarif_checks(checks).join(own, "name", "left").select(F.lit(1).alias("kind"), F.col("name").alias("path"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("rule_id"), F.col("result").alias("value"), F.array_join("rules", ",\n").alias("rule"))
    return found.unionByName(failed).orderBy("kind", "path", "line", "rule_id", "value").select("value", "rule")


def write_sarif_documents(findings: DataFrame, checks: DataFrame, path: str, tool: str = "vetra", limit: int = 25_000) -> None:
    """All results as SARIF 2.1.0 documents of at most ``limit`` results, files of the folder ``path`` whose names are in the order of reports.

    Results are sorted by ranges and each task makes the documents of its range,
    so no task has more than its part; a document has the rules of its own results.
    """
    spark = findings.sparkSession
    known = [json.dumps(_rule(*r)) for r in RULES]

    def document(results: list[str], rules: list[str]) -> pa.RecordBatch:
        text = _HEAD + json.dumps(tool) + ', "rules": [\n' + ",\n".join([*known, *dict.fromkeys(rules)]) + "\n]}}, \"results\": [\n" + ",\n".join(results) + "\n]}]}"
        return pa.RecordBatch.from_arrays([pa.array([text], pa.large_string()).cast(pa.string())], names=["value"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results, rules = [], []
        for batch in batches:
            for value, rule in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                results.append(value)
                if rule is not None:
                    rules.append(rule)
                if len(results) == limit:
                    yield document(results, rules)
                    results, rules = [], []
        if results:
            yield document(results, rules)

    _in_order(findings, checks).mapInArrow(made, "value string").write.option("maxRecordsPerFile", 1).text(path)
    if spark.read.text(path).isEmpty():
        spark.createDataFrame([(document([], []).column(0)[0].as_py(),)], "value string").write.mode("append").text(path)


def write_sarif(findings: DataFrame, checks: DataFrame, path: str, tool: str = "vetra") -> int:
    """One SARIF 2.1.0 file of any number of results, in the order of reports; its number of bytes.

    Results are sorted by ranges and written in parts; a single task then
    copies the parts into one file piece by piece, with the head, the separators
    and the foot.  Nothing of them is held as a whole or passes the driver.
    """
    spark = findings.sparkSession
    parts = f"{shared_folder(spark)}/vetra-sarif-{uuid.uuid4().hex}"
    found = sarif_results(findings).select(F.lit(0).alias("kind"), "path", "line", "rule_id", F.col("result").alias("value"))
    failed = sarif_checks(checks).select(F.lit(1).alias("kind"), F.col("name").alias("path"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("rule_id"), F.col("result").alias("value"))
    found.unionByName(failed).orderBy("kind", "path", "line", "rule_id", "value").select("value").write.text(f"{parts}/results")
    sarif_check_rules(checks).orderBy("name").select(F.col("rule").alias("value")).write.text(f"{parts}/rules")
    known = ",\n".join(json.dumps(_rule(*r)) for r in RULES)
    sections = [
        (_HEAD + json.dumps(tool) + ', "rules": [\n' + known, "rules", True),
        ("\n]}}, \"results\": [\n", "results", False),
        ("\n]}]}\n", None, False),
    ]

    def join(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = opened(parts)
        target, to = opened(path)
        with target.open_output_stream(to) as out:
            for head, folder, more in sections:
                out.write(head.encode())
                names = sorted(i.path for i in source.get_file_info(pafs.FileSelector(f"{base}/{folder}")) if i.base_name.startswith("part-")) if folder else []
                for name in names:
                    with source.open_input_stream(name) as f:
                        pending = b""
                        while block := f.read(COPY_BYTES):
                            *lines, pending = (pending + block).split(b"\n")
                            for line in lines:
                                out.write((b",\n" if more else b"") + line)
                                more = True
            size = out.tell()
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["bytes"])

    return spark.range(1).repartition(1).mapInArrow(join, "bytes long").first()[0]
