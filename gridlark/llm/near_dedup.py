"""Operator 4: near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

A document is its set of distinct word shingles. Steps:

1. One scan makes, for each document, the size and digest of its set and the band keys of its
   SuperMinHash signature. An element's value in slot ``pi(j)`` is ``j + r``: ranks of one random
   permutation, so slots are hit evenly and signatures vary less than with independent hashes. All
   elements of a batch take step j together; a document leaves once every slot holds a value
   below j, as later steps can't lower it. Long documents leave after a step or two.
2. Documents with equal sets are one class, named by its smallest doc_id; from here on only class
   representatives count, so a group of exact copies costs one row.
3. Band keys that several representatives share make candidates: first each against the bucket's
   smallest member; then, for buckets that still hold several components, pairs across components
   that a prefix filter lets through. Pairs inside a component need no test: they can't change it.
   So near copies of one text cost about one test each.
4. Candidates are confirmed on full sets, recomputed from whole texts of documents with candidates.
5. Links are grouped by union-find, in rounds of joins (``components``).

With 30 bands of 6 slots a pair at similarity 0.85 is missed once in a million.

Defined results: null texts and texts without words have an empty set, link with nothing, and are
their own component. Rows that share a doc_id count as one document for grouping, and each gets a
row. A null doc_id is its own component (null) and stays. Other columns are not read;
``keep_representatives`` returns all columns as they were.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import release, scan, shared_dir, ship, table, written
from gridlark.llm.components import components

BANDS, ROWS = 30, 6
SLOTS = BANDS * ROWS
HISTOGRAM = 1 << 18
MAX_BROADCAST = 1_000_000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (A-Z lower-cased, words cut at ASCII white space)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _C1 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each."""
    n_docs = len(sets)
    value = np.full((n_docs, slots), np.inf)
    flat = value.reshape(-1)
    item = np.concatenate(sets) if n_docs else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n_docs), [len(s) for s in sets])
    perm = None
    for j in range(slots):
        if j:
            done = value.max(axis=1) < j
            keep = ~done[doc]
            if not keep.any():
                break
            if not keep.all():
                item, doc = item[keep], doc[keep]
                perm = perm[keep] if j > 1 else perm
                first = first[keep] if j == 1 else None  # noqa: F821
        bits = mix(item + np.uint64((j + 1) * int(_C1) % 2**64))
        r = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        # the draw of the slot takes other bits than the fraction
        k = j + ((mix(bits) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            first = slot = k
        else:
            row = np.arange(len(item))
            if j == 1:  # Fisher-Yates so far: places 0 and first were swapped
                perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(item), slots)).copy()
                perm[row, first] = 0
                perm[:, 0] = first
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(flat, doc * slots + slot, r + j)
    return value


def band_keys(value: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, signed."""
    bits = value.view(np.uint64).reshape(len(value), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C2, bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * _C1 + bits[:, :, k])
    return key.view(np.int64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, one byte of each slot."""

    def run(batch):
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        value = signatures([s for s in sets if len(s)])
        bands, short = iter(band_keys(value)), iter(mix(value.view(np.uint64)).astype(np.uint8))
        return {
            "doc_id": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "bands": [next(bands) if len(s) else [] for s in sets],
            "short": [next(short).tobytes() if len(s) else None for s in sets],
        }

    return scan(docs, ["doc_id", "text"], run, "doc_id long,n_shingles long,digest binary,bands array<long>,short binary", limit=1 << 20)


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the documents named by ``ids``, from whole texts. Ids are broadcast behind a check of their number."""
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    one = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")

    def sets(batch):
        return {"doc_id": batch.column(0), "shingles": [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]}

    return scan(one, ["doc_id", "text"], sets, "doc_id long,shingles binary", limit=4 << 20)


def _pairs_where(pairs: DataFrame, values: DataFrame, good) -> DataFrame:
    """The pairs (a, b) for which ``good(value of a, value of b)``, on NumPy-ready buffers."""
    ship(pairs.sparkSession)
    name = values.columns[1]
    joined = pairs.join(values.select(F.col("doc_id").alias("a"), F.col(name).alias("va")), "a").join(values.select(F.col("doc_id").alias("b"), F.col(name).alias("vb")), "b")

    def check(batches):
        release()
        for batch in batches:
            keep = [good(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "va", "vb").mapInArrow(check, "a long, b long").distinct()


def likely(pairs: DataFrame, shorts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree often enough: six standard deviations below the threshold, so a link is lost once in 10^9."""
    p = percent / 100
    least = SLOTS * (p - 6 * (p * (1 - p) / SLOTS) ** 0.5)

    def good(x, y):
        return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= least

    return _pairs_where(pairs, shorts, good)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def good(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        # the larger set bounds the union
        if 100 * len(x) < percent * len(y):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    return _pairs_where(pairs, sets, good)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, class_id."""
    folder = shared_dir(docs.sparkSession)
    known = written(sketch(docs, size), "sketch", folder)
    classes = written(known.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes", folder)
    reps = known.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").where("digest is not null")
    entries = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top")).where("pivot < top").select("key", "pivot")
    members = written(entries.join(buckets, "key").distinct(), "members", folder)
    ids = written(members.select("doc_id").distinct(), "member-ids", folder)
    sets = written(shingle_sets(docs, ids, size), "sets", folder)
    shorts = reps.select("doc_id", "short")

    stars = members.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = written(likely(stars, shorts, percent), "stars", folder)
    links = written(verified(stars, sets, percent), "star-links", folder)
    found = components(links)

    more = written(likely(_across(members, found, sets, percent, folder).join(stars, ["a", "b"], "left_anti"), shorts, percent), "across", folder)
    links = links.union(written(verified(more, sets, percent), "across-links", folder))
    found = written(components(links), "components", folder)

    named = known.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "class_id"), "digest", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = named.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    component = F.coalesce("component", "class_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class_id")


def _across(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """Candidates between components that share a bucket.

    They are found without loss by prefix filtering: with shingles in one order, two sets that are
    similar enough share one of the first ``n - ceil(n * percent / 100) + 1`` of each. The order is
    from rare to frequent by a histogram of ``HISTOGRAM`` hash cells (its size doesn't grow), so a
    bucket's stragglers mostly have their own shingles there and meet nobody.
    """
    own = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    mixed = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    ids = written(own.join(mixed, "key", "left_semi").select("doc_id", "c").distinct(), "open", folder)
    held = sets.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "doc_id").select("doc_id", "c", "shingles")

    def cells(batch):
        n = np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]) & np.uint64(HISTOGRAM - 1), minlength=HISTOGRAM)
        at = np.flatnonzero(n)
        return {"cell": at, "held": n[at]}

    counted = scan(held, ["doc_id", "c", "shingles"], cells, "cell long,held long", text_col="shingles").groupBy("cell").agg(F.sum("held").alias("held"))
    often = np.zeros(HISTOGRAM, np.int64)
    for row in counted.toLocalIterator():  # HISTOGRAM rows at most
        often[row["cell"]] = row["held"]
    shared = held.sparkSession.sparkContext.broadcast(often)

    def first(batch):
        out = {k: [] for k in ("shingle", "doc_id", "c", "n", "i")}
        for doc_id, c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            n = len(x)
            seen = shared.value[x & np.uint64(HISTOGRAM - 1)]
            order = np.lexsort((x, seen))[: n * (100 - percent) // 100 + 1]
            # a cell held once is a shingle held once
            i = np.flatnonzero(seen[order] > 1)
            out["shingle"] += x[order[i]].view(np.int64).tolist()
            out["i"] += (i + 1).tolist()
            for name, value in (("doc_id", doc_id), ("c", c), ("n", n)):
                out[name] += [value] * len(i)
        return out

    prefix = written(scan(held, ["doc_id", "c", "shingles"], first, "shingle long,doc_id long,c long,n long,i long", text_col="shingles", limit=4 << 20), "prefix", folder)
    parts = prefix.groupBy("shingle", "c").agg(F.count("*").alias("size"))
    main = parts.groupBy("shingle").agg(F.max(F.struct("size", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("shingle", F.col("most.c").alias("main"))
    both = prefix.join(main, "shingle")
    x, y = (both.select("shingle", "main", *(F.col(c).alias(f"{c}{side}") for c in ("doc_id", "c", "n", "i"))) for side in ("x", "y"))
    # pairs are made by those outside a shingle's largest component; the rest of both sets bounds what they can share
    fits = (F.col("cx") != F.col("cy")) & ((100 + percent) * (1 + F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))) >= percent * (F.col("nx") + F.col("ny")))
    pairs = x.where("cx <> main").drop("main").join(y.drop("main"), "shingle").where(fits)
    return pairs.select(F.greatest("doc_idx", "doc_idy").alias("a"), F.least("doc_idx", "doc_idy").alias("b")).where("a <> b").distinct()


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns as they were; rows with a null doc_id stay."""
    drop = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
