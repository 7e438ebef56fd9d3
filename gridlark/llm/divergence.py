"""Operator 12: how far the term use of each source lies from its language's other sources.

Terms are counted in tasks, over the bytes of whole texts. A term of up to 8 bytes is one uint64, of up to 16 two; such words are
radix-sorted (stable passes over 16-bit digits) and their runs counted, in numpy. Longer terms lie in a
bucket for each byte length and are sorted as bytes. As the sorts are stable and documents come by group, a run of a term falls into its groups and
documents by itself. A text is looked at in pieces that end between terms; a document's pieces are merged before its
terms count as one document.

What tasks counted is summed by (language, source, term), then looked at by (language, term); shares are exact whole
numbers. Pairs of sources: kept terms are dealt into buckets of bounded size (terms by sources); each bucket adds up all
pairs of its sources in numpy, and the sums of buckets are added. Pairs are of sources, not rows, and each is part of the result.

Defined results: null text, language and source are empty strings. A row is a document, whatever its doc_id. A language
without kept terms has its pairs at 0; a source alone in its language has none; an empty table gives no rows. Ties rank
by the item's bytes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import release, ship, slices, spark_to_arrow, table, written

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
_COUNTS = "lang string,source string,term string,n long,docs long"
#: Byte to lower-case letter; 0 where no term goes on.
_LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by uint64 ``words`` (most significant first), in passes over 16-bit digits."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


class TermCounts:
    """Counts of (term, document) of one batch: ``add`` bytes piece by piece, then ``groups``."""

    def __init__(self, most: int = 1 << 21):
        self.most = most
        #: number of words or byte length -> columns of (words or bytes, document, count), each run once
        self.parts: dict[int, list[tuple]] = {}
        self.size = 0

    @staticmethod
    def _runs(width: int, key, doc: np.ndarray, n: np.ndarray | None) -> tuple:
        """Sorted by key and document, with each pair once. ``key``: list of word columns, or one bytes column."""
        if width <= 2:
            order = np.argsort(doc, kind="stable")
            order = order[radix_order([w[order] for w in key])]
            key, doc = [w[order] for w in key], doc[order]
            new = np.zeros(len(doc), bool)
            for w in key:
                new[1:] |= w[1:] != w[:-1]
        else:
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.append(False, key[1:] != key[:-1])
        new[1:] |= doc[1:] != doc[:-1]
        new[:1] = True
        at = np.flatnonzero(new)
        total = np.diff(np.append(at, len(doc))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
        return ([w[at] for w in key] if width <= 2 else key[at]), doc[at], total

    def add(self, data: np.ndarray, ends: np.ndarray, first_doc: int) -> None:
        """``data``: bytes of consecutive documents, which end at ``ends`` and are numbered from ``first_doc``."""
        low = _LETTER[data]
        letter = low != 0
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        inner = ends[(ends > 0) & (ends < len(data))]
        begin[inner] = letter[inner]
        start = np.flatnonzero(begin)
        if not len(start):
            return
        # a term ends where the letters do, or where the next one starts
        stop = np.minimum(self._next_gap(letter)[start], np.append(start[1:], len(data)))
        size = stop - start
        doc = np.searchsorted(ends, start, side="right").astype(np.int32) + first_doc
        padded = np.append(low, np.zeros(16, np.uint8))
        for width in (1, 2):
            own = (size > 8 * width - 8) & (size <= 8 * width)
            if own.any():
                at = start[own]
                matrix = padded[at[:, None] + np.arange(8 * width)]
                matrix[np.arange(8 * width) >= size[own, None]] = 0
                words = matrix.view(">u8").astype(np.uint64)
                self._keep(width, self._runs(width, [words[:, k] for k in range(width)], doc[own], None))
        for length in np.unique(size[size > 16]).tolist():
            own = size == length
            matrix = low[start[own][:, None] + np.arange(length)]
            self._keep(length, self._runs(length, np.ascontiguousarray(matrix).view(f"S{length}")[:, 0], doc[own], None))

    @staticmethod
    def _next_gap(letter: np.ndarray) -> np.ndarray:
        """For each byte the place of the first non-letter at or after it."""
        gap = np.where(letter, len(letter), np.arange(len(letter)))
        return np.minimum.accumulate(gap[::-1])[::-1]

    def _keep(self, width: int, part: tuple) -> None:
        self.parts.setdefault(width, []).append(part)
        self.size += len(part[1]) * (width if width <= 2 else width // 8)
        if self.size > self.most:  # terms of a long document meet again and again
            for w in self.parts:
                self.parts[w] = [self._merged(w)]
            self.size = sum(len(p[0][1]) * (w if w <= 2 else w // 8) for w, p in self.parts.items())
            self.most = max(self.most, 2 * self.size)

    def _merged(self, width: int) -> tuple:
        parts = self.parts[width]
        if len(parts) == 1:
            return parts[0]
        key = [np.concatenate([p[0][k] for p in parts]) for k in range(width)] if width <= 2 else np.concatenate([p[0] for p in parts])
        return self._runs(width, key, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))

    def groups(self, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(terms, groups, occurrences, documents); ``group`` ascends with the documents' numbers."""
        for width in list(self.parts):
            key, doc, n = self._merged(width)
            own = group[doc]
            new = np.append(True, own[1:] != own[:-1])
            for w in key if width <= 2 else [key]:
                new[1:] |= w[1:] != w[:-1]
            at = np.flatnonzero(new)
            raw = np.stack([w[at] for w in key], 1).astype(">u8").view(np.uint8) if width <= 2 else key[at].view(np.uint8).reshape(len(at), -1)
            real = raw != 0
            offsets = np.append(0, np.cumsum(real.sum(1))).astype(np.int64)
            terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw[real]))
            yield terms, own[at], np.add.reduceat(n, at), np.diff(np.append(at, len(doc)))
            del self.parts[width]


def _text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each row in them) of a string column without nulls."""
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _pieces(data: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, ends, number of the first document): pieces of some ``limit`` bytes that end between terms."""
    at = 0
    while at < len(data):
        to = min(at + limit, len(data))
        while to < len(data):
            step = data[to : to + limit]
            gap = np.flatnonzero(_LETTER[step] == 0)
            if len(gap):
                to += int(gap[0])
                break
            to += len(step)
        first = int(np.searchsorted(ends, at, side="right"))
        last = int(np.searchsorted(ends, to, side="left"))
        yield data[at:to], np.minimum(ends[first : last + 1], to) - at, first
        at = to


def term_counts(docs: DataFrame, piece: int = 2 << 20) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, one row or more for each; the term '' stands for the group itself."""
    ship(docs.sparkSession)
    target = spark_to_arrow(_COUNTS)

    def run(batches):
        release()
        for whole in batches:
            for part in slices(whole, "text", 8 << 20):
                if not part.num_rows:
                    continue
                lang, source, text = (pa.compute.fill_null(part.column(k), "") for k in range(3))
                pairs = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
                codes: dict = {}
                code = np.array([codes.setdefault((x["lang"], x["source"]), len(codes)) for x in pairs.to_pylist()])
                order = np.argsort(code, kind="stable")
                data, ends = _text_bytes(text.take(pa.array(order)))
                counts = TermCounts()
                for bytes_, own_ends, first in _pieces(data, ends, piece):
                    counts.add(bytes_, own_ends, first)
                langs, sources = (pa.array([k[i] for k in codes], pa.string()) for i in range(2))
                yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(codes)), pa.array([0] * len(codes), pa.int64()), pa.array([0] * len(codes), pa.int64())], schema=target)
                for terms, group, n, in_docs in counts.groups(code[order]):
                    for a in range(0, len(terms), 1 << 16):
                        cut = slice(a, a + (1 << 16))
                        own = pa.array(group[cut])
                        yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), terms[cut].cast(pa.string()), pa.array(n[cut], pa.int64()), pa.array(in_docs[cut], pa.int64())], schema=target)

    return docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total), by long division in steps of a thousand: exact while total < 9e15."""
    out, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, total), rest % total
    return out + 1


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = 1 << 19) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of a language's sources, and each source's ``top`` terms over its language."""
    summed = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("own"))
    kept = written(by_term.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "kept")
    real = F.col("term") != ""
    langs = kept.groupBy("lang").agg(F.count_if(real).alias("kinds"), F.sum("total").alias("lang_n"), F.max(F.when(~real, F.size("own"))).alias("sources"))
    langs = langs.select("lang", "sources", (F.col("lang_n") + 2 * F.col("kinds")).alias("lang_size"), "kinds", F.ceil(F.greatest(F.col("kinds") * F.col("sources"), F.lit(1)) / cells).cast("int").alias("buckets"))
    flat = kept.select("lang", "term", "total", F.explode("own").alias("o")).select("lang", "term", "total", "o.source", "o.n")
    groups = flat.groupBy("lang", "source").agg(F.sum("n").alias("own_n")).join(langs, "lang")
    # one row for each source: languages have their own numbering
    groups = groups.select("*", (F.col("own_n") + 2 * F.col("kinds")).alias("size"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"))
    groups = written(groups, "groups")
    shares = flat.where(real).join(groups, ["lang", "source"]).select("lang", "source", "term", "place", "buckets", _share(F.col("n") + 2, F.col("size")).alias("p"), _share(F.col("total") + 2, F.col("lang_size")).alias("q"))
    p, q = F.col("p"), F.col("q")
    excess = shares.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = excess.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = groups.select("lang", "place", "source")
    pairs = _pair_sums(shares, groups).join(names.withColumnsRenamed({"place": "a", "source": "source_a"}), ["lang", "a"]).join(names.withColumnsRenamed({"place": "b", "source": "source_b"}), ["lang", "b"])
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return terms.unionByName(pairs.withColumn("rank", F.row_number().over(order)))


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for the places a < b of a language's sources: each bucket of terms adds up its own part."""
    left = shares.select("lang", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), "term", "place", "p")
    absent = F.when(F.col("kinds") > 0, _share(F.lit(2).cast("long"), F.col("size"))).otherwise(0)
    right = groups.toDF(*groups.columns).where("sources > 1").select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "place", absent.alias("p"))
    schema = "lang string,a int,b int,value long"

    def sums(key, terms: pa.Table, sources: pa.Table) -> pa.Table:
        # a language with one source has no pairs; its terms come without sources
        n = len(sources)
        none = np.empty(n, np.int64)
        none[sources["place"].to_numpy()] = sources["p"].to_numpy()
        code = terms["term"].combine_chunks().dictionary_encode()
        share = np.tile(none, (len(code.dictionary) if n else 0, 1))
        if n and len(terms):
            share[code.indices.to_numpy(), terms["place"].to_numpy()] = terms["p"].to_numpy()
        share = np.ascontiguousarray(share.T)
        value = [((share[k] - share[k + 1 :]) ** 2 // (share[k] + share[k + 1 :])).sum(1) for k in range(n - 1)]
        a, b = np.triu_indices(n, 1)
        value = np.concatenate(value) if value else np.empty(0, np.int64)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})

    dealt = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(sums, schema)
    return dealt.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), t AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= {MIN_DOCS}
), v AS (SELECT d.lang, coalesce(any_value(x.kinds), 0) AS kinds, coalesce(any_value(x.total), 0) AS total FROM d LEFT JOIN (SELECT lang, count(*) AS kinds, sum(total) AS total FROM k GROUP BY lang) x ON d.lang = x.lang GROUP BY d.lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term
), s AS (SELECT lang, source, sum(n) AS own FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + {SCALE}::hugeint * (coalesce(c.n, 0) + 2) // (coalesce(s.own, 0) + 2 * v.kinds) AS bigint) AS p, CAST(1 + {SCALE}::hugeint * (k.total + 2) // (v.total + 2 * v.kinds) AS bigint) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS bigint) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) x
  ON a.lang = x.lang AND a.source = x.source AND b.source = x.item
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs)
)
SELECT lang, source, part, item, CAST(value AS bigint) AS value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
