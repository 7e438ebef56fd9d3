"""Operator 6: token-id files with Elias-Fano document boundaries.

Documents are dealt into shards by ranges of doc_id, sorted, encoded, and each shard is streamed to
the shared folder as four files:

``ids``     all ids end to end, u16 while the vocabulary allows, else u32, little-endian
``bounds``  Elias-Fano: where each document ends in ``ids``
``docs``    Elias-Fano: each doc_id less the shard's smallest
``nulls``   (in the manifest) how many documents at the shard's start have no doc_id

A task attempt writes files of its own name; the manifest names those of attempts that succeeded,
so a lost executor or a second attempt leaves the result as it is. The manifest has one row for
each shard, with the ids before it. Reading goes by shard and by blocks of documents, with offsets
from the select structures.

Defined results: null and empty texts have the end id alone; a null doc_id sorts first; rows with
the same doc_id lie side by side, by text; an empty table makes no files. Other columns aren't read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import held, release, ship, shared_dir, slices, spark_to_arrow, table
from gridlark.llm.elias_fano import EliasFano, encode
from gridlark.llm.tokens import ENTRY, BytePairFile, pieces

END_ID = 2
_SHARD = "shard long,path string,n_docs long,n_null long,base_id long,n_ids long,wide boolean"
_OUT = "doc_id long,start long,n_tokens long,ids_crc32 long"


def open_store(uri: str):
    """(file system, path) of a folder that all executors share: file, hdfs, s3, gs, ..."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Pieces(dict):
    """Piece to its ids as bytes; what is missing is encoded by the library's model.

    Two generations of ``bound`` bytes: a full dictionary becomes the old one, and what is asked for again moves on.
    """

    def __init__(self, encoder: Encoder, space: bool, bound: int):
        super().__init__()
        self.encoder, self.space, self.old = encoder, space, {}
        self.bound, self.held = bound, 0

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            e = self.encoder
            split = e.file.pre_tokens(piece, self.space)
            # a pre-token with its space is a piece of its own
            out = e.token_bytes(split[0]) if len(split) == 1 else b"".join([e.tail[t[1:]] if t[0] == " " and len(t) > 1 else e.head[t] for t in split])
        self.held += ENTRY + len(piece) + len(out)
        if self.held > self.bound:
            self.old, self.held = dict(self), 0
            self.clear()
        self[piece] = out
        return out


class Encoder:
    """Texts to id bytes with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.file = BytePairFile(path)
        self.model = self.file.library.model
        self.dtype = np.dtype("<u2" if self.file.size <= 1 << 16 else "<u4")
        self.head, self.tail = _Pieces(self, False, 4 << 20), _Pieces(self, True, 48 << 20)
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def token_bytes(self, pre_token: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(self.file.spelled(pre_token))]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str) -> bytes:
        sections, special = self.file.sections(text)
        out = []
        for k, section in enumerate(sections):
            if k:
                out.append(np.array([special[k - 1]], self.dtype).tobytes())
            head, *tail = pieces(section)
            out.append(self.head[head])
            out.append(b"".join(map(self.tail.__getitem__, tail)))
        return b"".join(out)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> list[dict]:
    """Write the shards under ``folder`` and return the manifest, in order, with ``base``: ids before each shard."""
    spark = docs.sparkSession
    ship(spark)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = open_store(folder)
        encoder = held(f"encoder:{path}", lambda: Encoder(path))
        end = np.array([end_id], encoder.dtype).tobytes()
        name = f"{top}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        n, total, null, ends, docs_in = 0, 0, 0, [], []
        out = None
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, texts = part.column(0), part.column(1).to_pylist()
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{name}.ids")
                size = np.zeros(len(texts), np.int64)
                for k, text in enumerate(texts):
                    coded = encoder.encode(text or "")
                    out.write(coded)
                    out.write(end)
                    size[k] = len(coded) // encoder.dtype.itemsize + 1
                ends.append(total + np.cumsum(size))
                total = int(ends[-1][-1])
                null += ids.null_count
                n += len(texts)
                docs_in.append(ids.drop_null().to_numpy())
        if out is None:
            return
        out.close()
        own = np.concatenate(docs_in).astype(np.int64)
        base = int(own[0]) if len(own) else 0
        for kind, values in (("bounds", np.concatenate(ends)), ("docs", own - base)):
            with store.open_output_stream(f"{name}.{kind}") as f:
                f.write(encode(values))
        row = (task.partitionId(), name, n, null, base, total, encoder.dtype.itemsize == 4)
        target = spark_to_arrow(_SHARD)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # one row for each shard comes back, however large the corpus is
    manifest = [r.asDict() for r in dealt.mapInArrow(write, _SHARD).collect()]
    manifest.sort(key=lambda r: r["shard"])
    base = 0
    for row in manifest:
        row["base"] = base
        base += row["n_ids"]
    if manifest:
        store, top = open_store(folder)
        with store.open_output_stream(f"{top}/manifest.json") as f:
            f.write(json.dumps(manifest).encode())
    return manifest


def read_shard(folder: str, row, block: int = 2048):
    """(doc ids, starts in the corpus, sizes, ids) of a shard, a block of documents at a time."""
    store, _ = open_store(folder)
    load = lambda kind: EliasFano(store.open_input_stream(f"{row['path']}.{kind}").readall())
    bounds, docs = load("bounds"), load("docs")
    dtype = np.dtype("<u4" if row["wide"] else "<u2")
    with store.open_input_file(f"{row['path']}.ids") as f:
        at = 0
        for a in range(0, len(bounds), block):
            b = min(a + block, len(bounds))
            ends = bounds.values(a, b)
            f.seek(at * dtype.itemsize)
            ids = np.frombuffer(f.read((int(ends[-1]) - at) * dtype.itemsize), dtype)
            starts = np.append(at, ends[:-1])
            null = row["n_null"]
            own = [None] * max(0, min(b, null) - a) + (docs.values(max(a, null) - null, b - null) + row["base_id"]).tolist() if b > null else [None] * (b - a)
            yield own, starts + row["base"], ends - starts, ids
            at = int(ends[-1])


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Per document what the files hold: where it starts, how many ids, and their checksum."""
    ship(spark)
    schema = f"{_SHARD},base long".replace(",", ", ")
    rows = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in manifest], schema)
    target = spark_to_arrow(_OUT)

    def read(batches):
        release()
        for batch in batches:
            for row in batch.to_pylist():
                for own, starts, sizes, ids in read_shard(folder, row):
                    wide = ids.astype("<u4")
                    cut = np.append(0, np.cumsum(sizes)).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((own, starts, sizes, crc), target)], schema=target)

    return rows.repartition(max(1, len(manifest)), "shard").mapInArrow(read, _OUT)


def token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_dir(spark)
    return read_token_files(spark, folder, write_token_files(docs, path, folder, end_id))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
