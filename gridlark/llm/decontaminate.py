"""Operator 10: benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words and cut into windows of ``window`` consecutive words; an
item with fewer words is one window. All windows go into one automaton. Every text is normalised
once to `` word word ... `` and scanned once; a match always starts and ends at a word border, so
its words are known by counting borders, and word numbers lead back to code-point offsets in the
original text.

Windows are cut in tasks. The automaton is built from a broadcast list of them. Its size is checked:
beyond ``max_block_bytes`` of window text and item ids the windows are dealt by hash into blocks, which
come to the driver one at a time; every block is scanned in a pass of its own against all rows, which
have keys of their own then, and the hits are merged by that key.

Defined results: a null or empty text, or one without a word, has zero words and no hit. Null or
word-less items give no window. Repeated items all count. Null ``item_id`` counts as an item and
is left out of the id list. Null or repeated ``doc_id`` rows are judged row by row. Empty
tables give no rows. Only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import held, scan, shared_dir, ship, slices, table, written

#: ASCII letters are lower-cased, other ASCII but digits separates words, bytes of non-ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Window text of a block. An automaton takes some 36 times its text, in each Python worker: about 300 MB.
MAX_BLOCK_BYTES = 8 << 20
_SCHEMA = "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean,items string,spans string"


def norm_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(items: list[tuple], window: int) -> list[tuple[str, tuple]]:
    """(pattern, item ids) for each distinct window; patterns are Latin-1 views of UTF-8 bytes."""
    found: dict[str, set] = {}
    for item_id, text in items:
        words = norm_words(text)
        for i in range(max(len(words) - window + 1, 1) if words else 0):
            found.setdefault((b" " + b" ".join(words[i : i + window]) + b" ").decode("latin-1"), set()).add(item_id)
    return [(p, tuple(ids)) for p, ids in found.items()]


def _automaton(windows, token: str):
    """Built once in each Python worker for a broadcast list."""

    def build():
        import ahocorasick

        built = ahocorasick.Automaton()
        for pattern, ids in windows:
            built.add_word(pattern, (pattern.count(" ") - 1, len(pattern), ids))
        if len(built):
            built.make_automaton()
        return built

    return held(f"automaton:{token}", build)


def scan_text(text: str | None, automaton) -> tuple[int, set, list[tuple[int, int]]]:
    """(number of words, ids of items found, runs of hit words as [first, end) word numbers)."""
    line = b" ".join(norm_words(text))
    if not line:
        return 0, set(), []
    line = f" {line.decode('latin-1')} "
    n_words = line.count(" ") - 1
    ids: set = set()
    runs: list[list[int]] = []
    if len(automaton):
        at = seen = 0  # words before position ``at``
        for end, (width, size, own) in automaton.iter(line):
            ids.update(own)
            seen += line.count(" ", at, end)
            at = end
            first = seen - width
            # an outer match may end later and start earlier than one found before it
            while runs and first <= runs[-1][0]:
                runs.pop()
            if runs and first <= runs[-1][1]:
                runs[-1][1] = seen
            else:
                runs.append([first, seen])
    return n_words, ids, [tuple(r) for r in runs]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets of word runs in the text as it was."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _digest(ids) -> tuple[str, str]:
    joined = ",".join(sorted(str(x) for x in ids if x is not None))
    return hashlib.sha256(joined.encode()).hexdigest(), joined


def _windows(benchmark: DataFrame, window: int, folder: str) -> DataFrame:
    """(window, items, size) for each distinct window, cut in tasks; item ids are strings, null among them."""
    ship(benchmark.sparkSession)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found, at = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    own = windows_of([(None, text)], window)
                    found += [p.encode("latin-1") for p, _ in own]
                    at += [k] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column(0).take(pa.array(at, pa.int64()))], names=["window", "item"])

    # a struct, as sets leave out plain nulls
    cuts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "window binary, item string")
    sets = cuts.groupBy("window").agg(F.collect_set(F.struct("item")).alias("found")).select("window", F.col("found.item").alias("items"))
    return written(sets.withColumn("size", F.length("window") + 16 * F.size("items")), "windows", folder)


def _blocks(windows: DataFrame, max_bytes: int) -> list[DataFrame]:
    """The windows in blocks of ``max_bytes`` at most (one window at least): packed buckets of a hash."""
    total = windows.agg(F.sum("size")).first()[0] or 0
    if total <= max_bytes:
        return [windows]
    dealt = windows.withColumn("bucket", F.pmod(F.xxhash64("window"), F.lit(16 * total // max_bytes)))
    ends, held = [], 0
    sizes = dealt.groupBy("bucket").agg(F.sum("size")).orderBy("bucket").collect()
    for bucket, size in sizes:
        if not ends or held + size > max_bytes:
            ends.append([bucket, bucket])
            held = 0
        ends[-1][1] = bucket
        held += size
    return [dealt.where(F.col("bucket").between(*e)) for e in ends]


def _shared(spark: SparkSession, block: DataFrame):
    """One block's windows in a broadcast, and its token."""
    shared = spark.sparkContext.broadcast([(bytes(r[0]).decode("latin-1"), tuple(r[1])) for r in block.select("window", "items").toLocalIterator()])
    return shared, f"{spark.sparkContext.applicationId}:{shared._jbroadcast.id() if shared._jbroadcast else id(shared)}"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Per document: word counts, items found, digest, and spans (``start:end``, code points) of the overlap."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    blocks = _blocks(_windows(benchmark, window, folder), max_block_bytes)
    if len(blocks) > 1:
        keyed = _keyed(docs.select("doc_id", "text"), folder)
        return _merged(keyed, _hits(keyed, blocks, folder))
    shared, token = _shared(spark, blocks[0])

    def judge(batch):
        automaton = _automaton(shared.value, token)
        return _verdicts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lambda k, text: scan_text(text, automaton))

    return scan(docs, ["doc_id", "text"], judge, _SCHEMA, holds=True)


def _verdicts(doc_ids: list, texts: list, found) -> dict:
    """Columns of _SCHEMA; ``found(k, text)`` is what scan_text gives for the k-th row."""
    out = {k.split(" ")[0]: [] for k in _SCHEMA.split(",")}
    for k, (doc_id, text) in enumerate(zip(doc_ids, texts)):
        n_words, ids, runs = found(k, text)
        sha, joined = _digest(ids)
        spans = original_spans(text, runs) if runs else []
        for key, value in zip(out, (doc_id, n_words, sum(b - a for a, b in runs), len(ids), sha, bool(runs), joined, ",".join(f"{a}:{b}" for a, b in spans))):
            out[key].append(value)
    return out


def _keyed(docs: DataFrame, folder: str) -> DataFrame:
    """The rows with a key of their own, ``__row``, written so that it stays."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "docs", folder)


def _hits(keyed: DataFrame, blocks: list[DataFrame], folder: str) -> DataFrame:
    """(row, items, runs) of rows with hits, block by block; runs are word numbers, end to end. One block is held at a time."""
    spark = keyed.sparkSession
    for n, block in enumerate(blocks):
        shared, token = _shared(spark, block)

        def judge(batch, shared=shared, token=token):
            automaton = _automaton(shared.value, token)
            out = {"row": [], "items": [], "runs": []}
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, ids, runs = scan_text(text, automaton)
                if runs:
                    for key, value in zip(out, (row, list(ids), [x for run in runs for x in run])):
                        out[key].append(value)
            return out

        hits = written(scan(keyed, ["__row", "text"], judge, "row long,items array<string>,runs array<long>", holds=True), f"hits-{n}", folder)
        shared.destroy()
    return spark.read.schema(hits.schema).parquet(*(f"{folder}/hits-{n}" for n in range(len(blocks))))


def _merged(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """Verdicts of all rows from the hits of several blocks."""
    by = hits.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))

    def merge(batch):
        doc_ids, texts, items, flat = (c.to_pylist() for c in batch.columns)

        def found(k, text):
            runs: list[list[int]] = []
            for first, end in sorted(zip((flat[k] or [])[::2], (flat[k] or [])[1::2])):
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(end, runs[-1][1])
                else:
                    runs.append([first, end])
            return len(norm_words(text)), set(items[k] or ()), [tuple(r) for r in runs]

        return _verdicts(doc_ids, texts, found)

    return scan(keyed.join(by, F.col("__row") == F.col("row"), "left"), ["doc_id", "text", "items", "runs"], merge, _SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, all columns as they were."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    blocks = _blocks(_windows(benchmark, window, folder), max_block_bytes)
    if len(blocks) > 1:
        keyed = _keyed(docs, folder)
        return keyed.join(_hits(keyed, blocks, folder).select(F.col("row").alias("__row")), "__row", "left_anti").select(*docs.columns)
    return _without_hits(docs, *_shared(spark, blocks[0]))


def _without_hits(docs: DataFrame, shared, token: str) -> DataFrame:
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        automaton = _automaton(shared.value, token)
        for batch in batches:
            for part in slices(batch, "text"):
                clean = [not scan_text(t, automaton)[2] for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
