"""Tables that appear whole or not at all: files written once, commits of several tables, appends that happen once.

Data is written by Spark under a name of the attempt; what makes it count is one small file, written once, that names
it. A run that dies before that file leaves nothing that a reader sees, and a second run writes its own attempt.
Names live in any folder that Spark's own file systems reach.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Something of that name is there already, with other content."""


class Folder:
    """Small driver-side files of a shared folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies below ``name``, hidden names left out."""
        if not self.exists(name):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(self._at(name))]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_once(self, name: str, content: bytes) -> str:
        """Writes a file under a name that must not be there: the same content again is fine, other content is an error. Returns its digest."""
        digest = hashlib.sha256(content).hexdigest()
        if not self._put(name, content) and hashlib.sha256(self.read(name)).hexdigest() != digest:
            raise Conflict(f"{name} is there with other content")
        return digest

    def _put(self, name: str, content: bytes) -> bool:
        """Writes aside, then renames; False where the name is taken."""
        if self.exists(name):
            return False
        aside = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/"))
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        strict = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, self._at(name), strict)
        except Exception:
            self._fs.delete(aside, False)
            if self.exists(name):
                return False
            raise
        return True


def canonical_json(value) -> bytes:
    return (json.dumps(value, sort_keys=True, separators=(",", ":")) + "\n").encode()


def table_digest(df: DataFrame) -> str:
    """A digest of the bag of rows, whatever their order and partitions; equal rows count as often as they are there.

    Each row's SHA-256 is cut into five numbers of 13 hex digits (a bit over 256 bits with the last), which are summed and counted: one
    aggregate that combines before the shuffle. It tells changed, lost and repeated rows; it isn't meant against someone who may choose rows.
    """
    row = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("d"))
    words = [F.coalesce(F.sum(F.conv(F.substring("d", k, 13), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"s{k}") for k in range(1, 65, 13)]
    return hashlib.sha256(":".join(map(str, row.agg(F.count("*").cast("string").alias("n"), *words).first())).encode()).hexdigest()


class Commit:
    """Several outputs that count together: written under an attempt's name, named by a manifest that is written last.

    ``run`` is the commit's name within ``folder``. Readers ask ``manifest``; without one there is nothing.
    """

    MANIFEST = "manifest.json"

    def __init__(self, spark: SparkSession, folder: str, run: str):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
            raise ValueError("a run's name has letters, digits, dots and dashes only")
        self.spark, self.files, self.attempt, self.outputs = spark, Folder(spark, f"{folder.rstrip('/')}/{run}"), f"attempt-{uuid.uuid4().hex}", {}

    def manifest(self) -> dict | None:
        return json.loads(self.files.read(self.MANIFEST)) if self.files.exists(self.MANIFEST) else None

    def table(self, name: str, df: DataFrame, kind: str = "parquet") -> DataFrame:
        """Writes a table and returns it as it was read back; its digest is of what was read."""
        path = f"{self.attempt}/{name}"
        writer = df.write.mode("errorifexists")
        (writer.text if kind == "text" else writer.parquet)(f"{self.files.path}/{path}")
        read = self._read(path, kind, df.schema)
        self.outputs[name] = {"path": path, "kind": kind, "schema": read.schema.jsonValue(), "sha256": table_digest(read), "rows": read.count()}
        return read

    def file(self, name: str, content: bytes) -> None:
        path = f"{self.attempt}/{name}"
        self.outputs[name] = {"path": path, "kind": "file", "sha256": self.files.write_once(path, content), "size": len(content)}

    def also(self, name: str, as_name: str) -> None:
        """A second name for an output that is written already."""
        self.outputs[name] = self.outputs[as_name]

    def finish(self, facts: dict) -> dict:
        """Writes the manifest. Where another attempt was first, its content must be the same, and its files count."""
        manifest = facts | {"outputs": self.outputs}
        same = lambda m: {k: v for k, v in m.items() if k != "outputs"} | {n: {k: v for k, v in o.items() if k != "path"} for n, o in m["outputs"].items()}
        if not self.files._put(self.MANIFEST, canonical_json(manifest)):
            there = self.manifest()
            if same(there) != same(manifest):
                raise Conflict("the run was finished with other content")
            return there
        return manifest

    def _read(self, path: str, kind: str, schema: StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return (reader.text if kind == "text" else reader.parquet)(f"{self.files.path}/{path}")

    def read(self, name: str) -> DataFrame | bytes:
        out = (self.manifest() or {"outputs": {}})["outputs"][name]
        return self.files.read(out["path"]) if out["kind"] == "file" else self._read(out["path"], out["kind"], StructType.fromJson(out["schema"]))

    def verified(self) -> dict | None:
        """The manifest, once every output was read again and has its digest; None where the run isn't finished."""
        if (manifest := self.manifest()) is None:
            return None
        for name, out in manifest["outputs"].items():
            try:
                held = self.read(name)
                digest = hashlib.sha256(held).hexdigest() if isinstance(held, bytes) else table_digest(held)
            except Exception as e:
                raise Conflict(f"output {name} can't be read") from e
            if digest != out["sha256"]:
                raise Conflict(f"output {name} isn't what the manifest says")
        return manifest


class Ledger:
    """A table that grows by whole inputs, each appended once.

    An append is in two phases: a pending entry (digest of the input, digest of the content, rows), the data under its attempt's name, then the
    committed entry, which names the attempt. Readers see committed attempts only. A rerun of a committed input does
    nothing; a rerun after a crash goes on from the pending entry: data that is whole counts, other data is written anew. While an input
    is pending, no other one is let in.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Folder(spark, folder)

    def _entries(self, kind: str) -> dict[str, dict]:
        return {n.removesuffix(".json"): json.loads(self.files.read(f"{kind}/{n}")) for n in self.files.names(kind)}

    def committed(self) -> dict[str, dict]:
        return self._entries("committed")

    def pending(self) -> dict[str, dict]:
        done = set(self.files.names("committed"))
        return {k: v for k, v in self._entries("pending").items() if f"{k}.json" not in done}

    def append_once(self, df: DataFrame, input_digest: str, step: Callable[[str], None] = lambda _: None) -> bool:
        """Appends ``df`` unless its input is there; True where it was. ``step`` is told each phase (tests stop there)."""
        content = table_digest(df)
        pending, name = self.pending(), f"{input_digest}.json"
        if set(pending) - {input_digest}:
            raise Conflict("another input was interrupted and must be appended first")
        if self.files.exists(f"committed/{name}"):
            if json.loads(self.files.read(f"committed/{name}"))["content"] != content:
                raise Conflict("the input was appended with other content")
            return True
        if input_digest in pending and pending[input_digest]["content"] != content:
            raise Conflict("the input is pending with other content")
        self.files.write_once(f"pending/{name}", canonical_json({"content": content}))
        step("pending")
        attempt = self._whole_attempt(input_digest, content)
        if attempt is None:
            attempt = f"data/{input_digest}/attempt-{uuid.uuid4().hex}"
            df.write.mode("errorifexists").parquet(f"{self.files.path}/{attempt}")
        step("written")
        read = self.spark.read.parquet(f"{self.files.path}/{attempt}")
        order = len(self.files.names("committed"))
        self.files._put(f"committed/{name}", canonical_json({"content": content, "attempt": attempt, "rows": read.count(), "order": order}))
        # of two writers at once the first one's entry counts
        if json.loads(self.files.read(f"committed/{name}"))["content"] != content:
            raise Conflict("the input was appended with other content")
        step("committed")
        return False

    def _whole_attempt(self, input_digest: str, content: str) -> str | None:
        for name in self.files.names(f"data/{input_digest}"):
            path = f"data/{input_digest}/{name}"
            if self.files.exists(f"{path}/_SUCCESS") and table_digest(self.spark.read.parquet(f"{self.files.path}/{path}")) == content:
                return path
        return None

    def read(self, at: int | None = None) -> DataFrame | None:
        """Rows of all committed inputs, or of the first ``at`` of them (a snapshot); None where there is none."""
        entries = sorted(self.committed().values(), key=lambda e: (e["order"], e["attempt"]))[:at]
        return self.spark.read.parquet(*(f"{self.files.path}/{e['attempt']}" for e in entries)) if entries else None

    def rows_of(self, input_digest: str) -> DataFrame:
        """The rows of one committed input."""
        return self.spark.read.parquet(f"{self.files.path}/{self.committed()[input_digest]['attempt']}")

    def sink(self, digest_of: Callable[[DataFrame, int], str] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a micro-batch that comes again after a crash is appended once."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.append_once(batch, digest_of(batch, batch_id) if digest_of else f"batch-{batch_id:012d}")

        return each


class AnalysisLedger:
    """Results of analysis runs, kept apart from observations: runs once each, results by id, reads by version.

    ``record`` takes rows (analysis_id, analysis_run_id, event_id, input_digest, schema_version, versions, executed_at,
    result). A run that is known stays as it was first recorded; an analysis_id that is known, or comes twice, fails the whole batch.
    """

    COLUMNS = ("analysis_id", "analysis_run_id", "event_id", "input_digest", "schema_version", "versions", "executed_at", "result")

    def __init__(self, spark: SparkSession, folder: str):
        self.runs_ledger, self.results_ledger = Ledger(spark, f"{folder.rstrip('/')}/runs"), Ledger(spark, f"{folder.rstrip('/')}/results")

    def record(self, results: DataFrame, batch: str) -> bool:
        """True where the batch was recorded before."""
        results = results.select(*self.COLUMNS)
        if batch in self.results_ledger.committed():
            return self.results_ledger.append_once(results.drop("versions", "schema_version"), batch)
        # worked out once; all that follows reads these files, which no reader of the ledger sees
        staged = f"{self.results_ledger.files.path}/staged/attempt-{uuid.uuid4().hex}"
        results.write.mode("errorifexists").parquet(staged)
        results = results.sparkSession.read.schema(results.schema).parquet(staged)
        known = self.results_ledger.read()
        twice = results.groupBy("analysis_id").agg(F.count("*").alias("n")).where("n > 1").select("analysis_id")
        if known is not None:
            twice = twice.unionByName(results.join(known.select("analysis_id"), "analysis_id", "left_semi").select("analysis_id"))
        if not twice.isEmpty():
            raise Conflict("an analysis id was recorded before")
        # the first of a run names it: by time, then by id
        runs = results.groupBy("analysis_run_id").agg(F.min_by(F.struct("schema_version", "versions", "executed_at"), F.struct("executed_at", "analysis_id")).alias("r")).select("analysis_run_id", "r.*")
        if (old := self.runs_ledger.read()) is not None:
            runs = runs.join(old.select("analysis_run_id"), "analysis_run_id", "left_anti")
        if batch not in self.runs_ledger.committed():
            self.runs_ledger.append_once(runs, batch)
        return self.results_ledger.append_once(results.drop("versions", "schema_version"), batch)

    def runs(self, at: int | None = None) -> DataFrame | None:
        return self.runs_ledger.read(at)

    def results(self, at: int | None = None) -> DataFrame | None:
        return self.results_ledger.read(at)
