"""JSON-lines sources and sinks, canonical text, write-once files."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TECHNIQUE = T.StructType([T.StructField(n, T.StringType()) for n in ("technique_id", "name", "tactic", "confidence", "rationale")])
DECODED = T.StructType(
    [
        T.StructField("valid", T.BooleanType()),
        *(T.StructField(n, T.StringType()) for n in ("operation", "error", "function_name", "cotp_pdu_type", "u_function", "frame_type", "signature", "message")),
        *(T.StructField(n, T.IntegerType()) for n in ("transaction_id", "protocol_id", "declared_length", "unit_id", "function_code", "address", "value_or_quantity", "tpkt_length", "rosctr", "parameter_length", "s7_function", "apdu_length", "type_id")),
        T.StructField("write_values", T.ArrayType(T.IntegerType())),
    ]
)
EVENT = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("event_id", "session_id", "sensor_id", "observed_at", "protocol", "event_type", "source_ip", "source_id", "source_network", "raw_payload_hex", "severity", "source_country", "source_country_code", "source_asn", "configuration_version", "data_notice")),
        *(T.StructField(n, T.IntegerType()) for n in ("source_port", "destination_port", "byte_count")),
        T.StructField("decoded", DECODED),
        T.StructField("techniques", T.ArrayType(TECHNIQUE)),
        T.StructField("tags", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.BooleanType()) for n in ("is_demo", "sanitized", "transport_authenticated")),
        *(T.StructField(n, T.DoubleType()) for n in ("source_latitude", "source_longitude")),
    ]
)


def not_blank(column: str):
    """Is there anything but white space?"""
    return F.length(F.btrim(column, F.lit(" \t\r\n\x0b\x0c"))) > 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines are numbered from 1 in each file, in however many splits it is read.

    A split knows where in its file it starts, so a line's number is its place in the split and the lines of
    the splits before it: running sums over a table of one row for each split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # a row for each split, of which the driver holds a list anyway: the lines stay where they are
    return lines.join(F.broadcast(splits), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def file_facts(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """(file, size, sha256, ends_with_newline, newlines) of raw files of any size, files without a byte included.

    Spark lists the files without reading them; a task streams a file through the digest, a chunk at a time. A digest
    is sequential, so a file is one task's work; its lines are read in splits beside it.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")

    def facts(batches):
        from pyarrow import fs

        for pdf in batches:
            out = []
            for file in pdf["file"]:
                store, at = fs.FileSystem.from_uri(file)
                digest, size, newlines, last = hashlib.sha256(), 0, 0, b""
                with store.open_input_stream(at) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                        size, newlines, last = size + len(data), newlines + data.count(b"\n"), data[-1:]
                out.append((file, size, digest.hexdigest(), last == b"\n", newlines))
            yield pd.DataFrame(out, columns=["file", "size", "sha256", "ends_with_newline", "newlines"])

    read = files.repartition("file").mapInPandas(facts, "file string, size long, sha256 string, ends_with_newline boolean, newlines long")
    empty = [(file, 0, hashlib.sha256().hexdigest(), False, 0) for file in _empty_files(spark, path)]
    return read.unionByName(spark.createDataFrame(empty, read.schema)) if empty else read


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte, which Spark's readers leave out of their listing; asked of the file system in pages."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in store.globStatus(root) or []:
        below = store.listFiles(top.getPath(), True)
        while below.hasNext():
            f = below.next()
            name = f.getPath().getName()
            if f.getLen() == 0 and not name.startswith(("_", ".")):
                uri = f.getPath().toUri().toString()
                found.append(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return found


def read_public(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of files whose records may all be published; the first ten findings are an error otherwise."""
    from gridlark.operators.walk import require_public

    return require_public(read_lines(spark, path))


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Typed events with the raw text beside them. Blank lines are skipped; a bad line is an error, with its number, when ``strict``."""
    bad = F.try_parse_json("value").isNull() | F.json_object_keys("value").isNull()
    if strict:
        lines = read_lines(spark, path).where(not_blank("value"))
        where = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.substring_index("file", "/", -1), F.lit(" is not a JSON object"))
        lines = lines.where(F.when(bad, F.raise_error(where).cast("boolean")).otherwise(True))
    else:
        lines = spark.read.option("lineSep", "\n").text(path).where(not_blank("value") & ~bad)
    return lines.select(F.from_json("value", EVENT).alias("e"), F.col("value").alias("raw")).select("e.*", "raw")


def canonical(record: dict) -> str:
    """Sorted keys, no spaces, ASCII alone."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), default=str)


@F.pandas_udf(T.StringType())
def canonical_text(values):
    """Byte-exact canonical form of JSON text (number and escape rules are beyond SQL functions); null where it doesn't parse."""

    def one(text):
        try:
            return canonical(json.loads(text))
        except (TypeError, ValueError):
            return None

    return values.map(one)


def canonical_digest(value):
    return F.sha2(canonical_text(value), 256)


def write_events(events: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines with sorted keys; an existing target is an error."""
    columns = sorted(c for c in events.columns if c != partition_by)
    text = events.select(*([partition_by] if partition_by else []), F.to_json(F.struct(*columns)).alias("value"))
    writer = text.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).text(path)


def write_once(path: str, content: bytes) -> str:
    """Write a small driver-side file; a rerun with the same content is fine, other content is an error."""
    import os
    import tempfile

    digest = hashlib.sha256(content).hexdigest()
    if os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != digest:
                raise FileExistsError(f"{path} has other content")
        return digest
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(content)
    os.replace(f.name, path)
    return digest


#: Fixed columns of the public export, in order.
POINT_COLUMNS = ("source", "country", "latitude", "longitude", "protocol", "events", "sessions", "first_seen", "last_seen", "max_severity", "control_attempts", "techniques")


def public_points(points: DataFrame) -> DataFrame:
    """The allowed columns of map points alone; one that isn't there is null."""
    return points.select(*(F.col(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in POINT_COLUMNS))


def map_points_csv(points: DataFrame, path: str) -> None:
    public_points(points).write.mode("errorifexists").csv(path, header=True)
