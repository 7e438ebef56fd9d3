"""What the corpus operators share: batch scans, one cache for each Python worker, the shared work folder."""

from __future__ import annotations

import os
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(key: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept in the Python worker for later tasks that ask for the same ``key``.

    A worker serves many stages, so it keeps one thing at a time: another key, or ``release``, lets the last one go.
    """
    store = sys.modules.setdefault("_gridlark_worker_store", types.ModuleType("_gridlark_worker_store"))
    if getattr(store, "key", None) != key:
        release()
        store.value, store.key = build(), key
    return store.value


def release() -> None:
    """Forget what ``held`` keeps; called where a task starts that needs none of it."""
    if (store := sys.modules.get("_gridlark_worker_store")) is not None and getattr(store, "key", None) is not None:
        store.key = store.value = None
        pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, text_col: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text at most (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text_col))
    if batch.num_rows <= 1 or col.nbytes <= limit:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), text_col, limit)
    yield from slices(batch.slice(half), text_col, limit)


def scan(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict | None], schema: str, text_col: str = "text", limit: int = 16 << 20, holds: bool = False) -> DataFrame:
    """One narrow pass: only ``columns`` are read; ``fn`` gets batches and returns columns in the order of ``schema``.

    ``holds``: ``fn`` uses ``held``; else what the worker still keeps is let go.
    """
    ship(df.sparkSession)
    target = spark_to_arrow(schema)

    def run(batches):
        if not holds:
            release()
        for batch in batches:
            for part in slices(batch, text_col, limit):
                if part.num_rows and (out := fn(part)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def spark_to_arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.strip().split(" ") for field in schema.split(","))])


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, local runs (tests) take a local folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/gridlark-shared-{os.getpid()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def outside(spans: list[tuple], held: list[tuple]) -> list[tuple]:
    """Those of ``spans`` (start, end, ...; in order, apart from each other) that overlap none of ``held``."""
    if not held:
        return spans
    others = sorted(h[:2] for h in held)
    out, k, end = [], 0, 0  # ``end``: how far the others that start before a span's end reach
    for span in spans:
        while k < len(others) and others[k][0] < span[1]:
            end = max(end, others[k][1])
            k += 1
        if end <= span[0]:
            out.append(span)
    return out


def sampled(df: DataFrame, key: str, limit: int) -> DataFrame:
    """A bounded, repeatable sample: the ``limit`` rows with the smallest hash of ``key``."""
    return df.orderBy(F.xxhash64(key), key).limit(limit)
