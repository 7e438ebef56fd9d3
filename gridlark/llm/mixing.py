"""Operator 3: mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times its documents must be repeated to bring the source to
its target share of the corpus (in characters, one more for each document's end). Every document
draws its number of copies by inverting the Poisson distribution with that mean at a uniform number
hashed from the seed and the document, so a draw depends on nothing but the document, the seed and
the rate. Copies are exploded and dealt by a hash of (seed, document, copy), and each partition is
put in the order of that hash: a global shuffle that a second run repeats.

Weights come as a table (source, weight), or by default as ``size ** alpha``. The rates table has a
row for each source; it is broadcast up to ``max_broadcast`` sources, checked, and joined beyond
that by source and a salt, so a source with a third of all rows meets its rate in many tasks.

Defined results: a null source is a source of its own. Null texts have no characters. Sources
without a weight get none of the corpus. A null doc_id draws by its text. Rows that share a doc_id
draw alike. An empty table gives no rows. ``mix`` keeps the columns as they are; its own names start
with ``__mix``.

A rare source can have any rate. Up to ``TABLE_RATE`` the cumulative probabilities are a table, summed
from 0 copies up; beyond it, where exp(-rate) would end up as zero, each document sums them over the
counts within 12 standard deviations (and 30) of the rate, with probabilities by Stirling's series. Both
invert the same distribution at the same uniform.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import table, written

SEED, ALPHA, SALTS, TABLE_RATE = 17, 0.5, 64, 500.0
#: Copies that are exploded from one array at most.
RUN = 4096
_BITS = 2.0**-52


def _hex(text, digits: int):
    """A hash of a string as a whole number of ``digits`` hex digits."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate, cdf): the cumulative Poisson probabilities of 0, 1, 2, ... copies, null beyond TABLE_RATE."""
    stats = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("size"))
    if weights is None:
        stats = stats.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        w = weights.groupBy(F.col("source").alias("__of")).agg(F.sum("weight").alias("weight"))
        stats = stats.join(w, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = stats.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(epochs) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    rated = stats.join(F.broadcast(total)).withColumn("rate", rate)
    terms = F.sequence(F.lit(1), (F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    p0 = F.exp(-F.col("rate"))

    def step(acc, k):
        p = acc["p"] * F.col("rate") / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    cdf = F.aggregate(terms, F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf")), step)["cdf"]
    return rated.select("source", "size", "rate", F.when(F.col("rate") <= TABLE_RATE, cdf).alias("cdf"))


def _many(rate, u):
    """The inversion for a rate over TABLE_RATE: no count is less than 200 here, so the series is exact to rounding."""
    wide = 12 * F.sqrt(rate) + 30
    low = F.floor(rate - wide)

    def step(acc, k):
        k = k.cast("double")
        x = (rate - k) / k
        p = F.exp(k * (F.log1p(x) - x) - F.log(k * (2 * math.pi)) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))
        c = acc["c"] + p
        return F.struct(c.alias("c"), (acc["n"] + (c <= u).cast("long")).alias("n"))

    return F.aggregate(F.sequence(low, F.floor(rate + wide)), F.struct(F.lit(0.0).alias("c"), low.alias("n")), step)["n"]


def replicated(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED, max_broadcast: int = 10_000) -> DataFrame:
    """All columns of ``docs`` and ``__mix_copies``, ``__mix_replica`` (from 0), ``__mix_key``; shuffled."""
    rates = written(source_rates(docs, weights, alpha, epochs).select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("cdf").alias("__mix_cdf")), "rates")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn("__mix_own", own)
    same = F.col("source").eqNullSafe(F.col("__mix_source"))
    if rates.limit(max_broadcast + 1).count() <= max_broadcast:
        drawn = keyed.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = keyed.withColumn("__mix_row", F.pmod(F.xxhash64("__mix_own"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__mix_row") == F.col("__mix_salt")))
    u = _hex(F.concat(F.lit(f"{seed}:copies:"), F.col("__mix_own")), 13) * F.lit(_BITS)
    few = F.size(F.filter("__mix_cdf", lambda c: c <= u))
    drawn = drawn.withColumn("__mix_copies", F.when(F.col("__mix_rate") <= TABLE_RATE, few).otherwise(_many(F.col("__mix_rate"), u).cast("int"))).where("__mix_copies > 0")
    # in runs: the copies of one document need not fit one array
    runs = drawn.withColumn("__mix_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__mix_copies") - 1) / RUN).cast("int"))))
    last = F.least(F.col("__mix_copies") - 1, F.col("__mix_run") * RUN + (RUN - 1))
    copies = runs.withColumn("__mix_replica", F.explode(F.sequence(F.col("__mix_run") * RUN, last)))
    key = _hex(F.concat(F.lit(f"{seed}:order:"), F.col("__mix_own"), F.lit(":"), F.col("__mix_replica").cast("string")), 15)
    kept = copies.withColumn("__mix_key", key).select(*docs.columns, "__mix_copies", "__mix_replica", "__mix_key")
    return kept.repartition("__mix_key").sortWithinPartitions("__mix_key")


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document is there as often as it was drawn."""
    return replicated(docs, weights, alpha, epochs, seed).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return replicated(docs).withColumnsRenamed({"__mix_copies": "copies", "__mix_replica": "replica", "__mix_key": "mix_key"})


MIX_SQL = f"""
WITH RECURSIVE stats AS (
  SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS bigint) AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, pow(CAST(size AS double), {ALPHA}) AS weight FROM stats
), rates AS (
  SELECT source, 1.0::double * (SELECT sum(size) FROM weighed)::double * weight / (SELECT sum(weight) FROM weighed) / size AS rate FROM weighed
), terms(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < CAST(floor(rate + 12 * sqrt(rate) + 30) AS int)
), cdfs AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM terms GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, coalesce(CAST(d.doc_id AS varchar), 'text:' || md5(coalesce(d.text, ''))) AS own, cdf
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source
), counted AS (
  SELECT *, len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5('{SEED}:copies:' || own), 1, 13)) AS bigint) * 2.220446049250313e-16::double)) AS copies FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, CAST(copies AS int) AS copies, CAST(replica AS int) AS replica,
  CAST(('0x' || substr(md5('{SEED}:order:' || own || ':' || CAST(replica AS varchar)), 1, 15)) AS bigint) AS mix_key
FROM (SELECT *, unnest(range(copies)) AS replica FROM counted WHERE copies > 0)
"""
