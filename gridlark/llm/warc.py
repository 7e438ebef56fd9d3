"""Operator 9: WARC archives, and a normaliser for archives that are one gzip stream.

Writing: each partition of pages becomes one WARC file that is compressed as a whole (the kind of
file that has no random access). Normalising: each file is inflated once as a stream, every record
is rewritten as a gzip member of its own, and a sidecar index lists offset, length and identity of
each member. Reading back goes by the index, member by member.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is
the response and the others are revisits that refer to it; they store no payload, but the HTTP
header's Content-Length and the payload digest of the original.

Defined results: null html is an empty payload. A payload whose page ids are all null has responses
only; rows that share the largest page_id are all responses. Repeated rows get a record each. Pages
with null URL get an empty target. An empty table writes no archive. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import ship, shared_dir, slices, spark_to_arrow, table, written
from gridlark.llm.token_files import open_store

_FILE = "path string,n_records long"
_OUT = "page_id long,payload_bytes long,payload_digest string,record_type string,refers_to long"
_DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 18
SALTS = 32


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record must start with WARC/")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(stream):
    """Pieces of what a gzip stream holds, one or many members, in one pass."""
    z = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            if out := z.decompress(data, 1 << 20):
                yield out
            data = z.unconsumed_tail or z.unused_data
    if not z.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces):
    """Whole records, from their own Content-Length, out of a stream of bytes."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            size = end + 8 - at + int(parse_head(bytes(held[at:end]))["content-length"])
            if len(held) - at < size:
                break
            yield bytes(held[at : at + size])
            at += size
        del held[:at]
    if held:
        raise ValueError("a record ends early")


def normalise(source, sink, index) -> int:
    """Rewrite each record of a gzip stream as its own member; a JSON line for each goes to ``index``."""
    at = n = 0
    for record in records(inflate(source)):
        head = parse_head(record[: record.index(b"\r\n\r\n")])
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        sink.write(member)
        index.write(json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"], "digest": head["warc-payload-digest"]}).encode() + b"\n")
        at += len(member)
        n += 1
    return n


def with_revisits(pages: DataFrame, min_bytes: int = 0, max_broadcast: int = 32 << 20) -> DataFrame:
    """Adds ``refers_to`` (null: a response).

    Payloads that occur again are broadcast up to ``max_broadcast`` bytes, checked; beyond that pages meet
    them by payload and a salt, so equal pages, however many, lie in many tasks.
    """
    ship(pages.sparkSession)
    coded = pages.select("page_id", "url", "html").withColumn("payload", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))
    keyed = coded.select("page_id", "url", "html", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    # only payloads that occur twice or more need a partner; counts are summed before the shuffle
    repeated = keyed.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1 and newest is not null").select("sha", "newest")
    repeated = written(repeated, "repeated")
    if 64 * repeated.count() <= max_broadcast:
        both = keyed.join(F.broadcast(repeated), "sha", "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    return both.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> list[dict]:
    """One gzip stream for each partition; returns the files that succeeded."""
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = open_store(folder)
        name = f"{top}/whole-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n, z = None, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch in batches:
            for part in slices(batch, "html"):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    out.write(z.compress(build_record(page_id, url, payload, payload_digest(payload), refers_to)))
                    n += 1
        if out is None:
            return
        out.write(z.flush())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], schema=spark_to_arrow(_FILE))

    return [r.asDict() for r in with_revisits(pages, min_bytes).mapInArrow(write, _FILE).collect()]


def _file_rows(spark: SparkSession, files: list[dict]) -> DataFrame:
    rows = spark.createDataFrame([(f["path"], f["n_records"]) for f in files], "path string, n_records long")
    return rows.repartition(max(1, len(files)), "path")


def normalise_archives(spark: SparkSession, files: list[dict], folder: str) -> list[dict]:
    """A Spark job over the files: each is inflated once and rewritten, with its index beside it."""
    ship(spark)

    def rewrite(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = open_store(folder)
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                name = f"{top}/members-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.warc.gz"
                # members are small, so the streams are buffered; no codec by file name
                with store.open_input_stream(row["path"], compression=None) as source, store.open_output_stream(name, compression=None, buffer_size=1 << 20) as sink, store.open_output_stream(f"{name}.idx", buffer_size=1 << 18) as index:
                    n = normalise(source, sink, index)
                if n != row["n_records"]:
                    raise ValueError(f"{n} records instead of {row['n_records']}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], schema=spark_to_arrow(_FILE))

    return [r.asDict() for r in _file_rows(spark, files).mapInArrow(rewrite, _FILE).collect()]


def read_member(data: bytes) -> dict:
    """What one gzip member says of its page."""
    record = zlib.decompress(data, 31)
    end = record.index(b"\r\n\r\n")
    head = parse_head(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {"page_id": page_of(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": page_of(head.get("warc-refers-to")), "payload": None if revisit else payload, "url": head["warc-target-uri"]}


def read_archives(spark: SparkSession, files: list[dict], folder: str) -> DataFrame:
    """Per record what the archives hold, fetched member by member through the index."""
    ship(spark)
    target = spark_to_arrow(_OUT)

    def read(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{row['path']}.idx") as f, store.open_input_file(row["path"]) as data:
                    rest, rows = b"", []  # of a record only what is returned is held, never its payload
                    while chunk := f.read(_CHUNK):
                        *lines, rest = (rest + chunk).split(b"\n")
                        for line in lines:
                            at = json.loads(line)
                            data.seek(at["offset"])
                            member = read_member(data.read(at["length"]))
                            rows.append({k: member[k] for k in target.names})
                            del member
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows = []

    return _file_rows(spark, files).mapInArrow(read, _OUT)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    return read_archives(spark, normalise_archives(spark, write_archives(pages, folder, min_bytes), folder), folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))
