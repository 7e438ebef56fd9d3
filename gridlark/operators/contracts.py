"""Versioned contracts: what a record must hold is declared once and compiled to column expressions.

Observations are evidence alone, analyses are interpretation. Mixed records of before are split into both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import crypto
from gridlark.sources.commits import Commit
from gridlark.sources.jsonl import canonical_digest

#: Fields that are conclusions, not evidence.
ANALYTIC_FIELDS = ("techniques", "severity", "triage", "detection_results")
CLASSES = ("raw_private", "sanitized_private", "synthetic")
NAMESPACE = "f203c17f-eb79-5e94-9db5-ef8739117371"


@dataclass(frozen=True)
class Contract:
    """``texts`` must be filled strings, ``objects`` and ``lists`` of their kind, ``values`` one of a list; ``absent`` may not be there."""

    version: str
    texts: tuple[str, ...]
    objects: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    #: Objects that may be missing without being a missing field (their kind is checked all the same).
    late: tuple[str, ...] = ()
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    absent: tuple[str, ...] = ()

    def violation(self, v: Column) -> Column:
        """The first rule that a variant breaks, null where all hold: version, presence, texts, objects, lists, values, absence."""
        return self.broken(self.kinds(_fields(v)), self.said(_fields(v)))

    def kinds(self, fields: Column) -> Column:
        """Kinds of a record's fields by name, of those that the rules look at."""
        names = ("schema_version", *self.texts, *self.objects, *self.lists, *self.values, *self.absent)
        return F.transform_values(F.map_filter(fields, lambda k, _: k.isin(*names)), lambda _, x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")))

    def said(self, fields: Column) -> Column:
        """Texts of a record's fields by name; null where a field is no string."""
        names = ("schema_version", *self.texts, *self.values)
        return F.transform_values(F.map_filter(fields, lambda k, _: k.isin(*names)), lambda _, x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))

    def broken(self, kinds: Column, said: Column) -> Column:
        """The first broken rule by the columns ``kinds`` and ``said``: the rules look names up in two small maps, so that their code stays small enough to be compiled."""
        kind = lambda name: F.coalesce(F.try_element_at(kinds, name), F.lit("MISSING"))
        text = lambda name: F.try_element_at(said, name)
        # over an array of names, so that a rule is one small expression however many fields it has
        any_of = lambda names, bad: F.exists(F.array(*map(F.lit, names)), bad) if names else F.lit(False)
        needed = ("schema_version", *self.texts, *(n for n in self.objects + self.lists if n not in self.late))
        rules = [
            (~F.coalesce(text(F.lit("schema_version")) == self.version, F.lit(False)), "unsupported_schema"), (any_of(needed, lambda n: kind(n) == "MISSING"), "missing_fields"), (any_of(self.texts, lambda n: F.coalesce(text(n), F.lit("")) == ""), "empty_text"),
            (any_of(self.objects, lambda n: ~kind(n).startswith("OBJECT")), "not_an_object"), (any_of(self.lists, lambda n: ~kind(n).startswith("ARRAY")), "not_a_list"),
            *((~F.coalesce(text(F.lit(n)).isin(*allowed), F.lit(False)), "bad_value") for n, allowed in self.values.items()), (any_of(self.absent, lambda n: kind(n) != "MISSING"), "forbidden_field"),
        ]
        return F.coalesce(*(F.when(bad, code) for bad, code in rules))


OBSERVATION = Contract("gridlark.observation/v1", ("event_id", "session_id", "sensor_id", "observed_at", "protocol", "event_type"), objects=("capture",), late=("capture",), values={"data_classification": CLASSES}, absent=ANALYTIC_FIELDS)
ANALYSIS = Contract("gridlark.analysis/v1", ("analysis_id", "analysis_run_id", "event_id", "input_digest", "executed_at"), objects=("versions",), lists=("attack_hypotheses", "detection_results"))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _with(fields: Column, added: dict[str, Column]) -> Column:
    """A map of variants with fields set; the new ones win."""
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*added))
    return F.map_concat(rest, F.create_map(*(x for name, value in added.items() for x in (F.lit(name), value))))


def _text(c: Column) -> Column:
    """Text as a variant."""
    return F.try_variant_get(F.to_variant_object(F.create_map(F.lit("x"), c)), "$.x", "variant")


def _json(text: str) -> Column:
    return F.parse_json(F.lit(text))


def classification(v: Column) -> Column:
    """Synthetic before sanitised before raw; only true itself counts."""
    true = lambda name: F.coalesce((F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN") & F.try_variant_get(v, f"$.{name}", "boolean"), F.lit(False))
    return F.when(true("is_demo"), "synthetic").when(true("sanitized"), "sanitized_private").otherwise("raw_private")


def observation_of(v: Column, sensor_version: str, legacy: bool = False) -> Column:
    """The evidence of a mixed record, as a variant."""
    return F.to_variant_object(_evidence(_fields(v), v, sensor_version, legacy))


def _evidence(fields: Column, v: Column, sensor_version: str, legacy: bool) -> Column:
    """The evidence of a mixed record, as a map of variants."""
    capture = f'{{"legacy_import":true,"sensor_version":"{sensor_version}"}}' if legacy else f'{{"sensor_version":"{sensor_version}"}}'
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*ANALYTIC_FIELDS))
    klass = F.when(classification(v) == "synthetic", _json('"synthetic"')).when(classification(v) == "sanitized_private", _json('"sanitized_private"')).otherwise(_json('"raw_private"'))
    return _with(kept, {"schema_version": _json(f'"{OBSERVATION.version}"'), "data_classification": klass, "capture": _json(capture)})


LEGACY = "legacy-v0"


def migrated(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> (line_no, observation, analysis, error): JSON text of each, blank lines passed over.

    Records of a version go through as they are. Of others the observation is split off, and an analysis where a field of
    one is there; its digest is of the observation's canonical text. ``error`` is the first broken rule; such a line has neither.
    """
    one = lines.where(F.length(F.btrim("value", F.lit(" \t\r\n\x0b\x0c"))) > 0).select("line_no", "value", F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    schema = F.try_variant_get("v", "$.schema_version", "string")
    kind = F.when(F.col("v").isNull(), "malformed_json").when(~is_object, "record_not_object").when(schema == OBSERVATION.version, "observation").when(schema == ANALYSIS.version, "analysis").otherwise("legacy")
    one = one.withColumn("kind", kind)
    legacy = F.col("kind") == "legacy"
    # each step is a column that several others read, so that it is worked out once
    one = one.withColumn("fields", F.when(legacy, _fields(F.col("v"))))
    one = one.withColumn("o", _evidence(F.col("fields"), F.col("v"), LEGACY, legacy=True))
    one = one.withColumns({"kinds": OBSERVATION.kinds(F.col("o")), "said": OBSERVATION.said(F.col("o"))})
    one = one.withColumn("error", F.when(legacy, OBSERVATION.broken(F.col("kinds"), F.col("said"))).when(F.col("kind").isin("malformed_json", "record_not_object"), F.col("kind")))
    one = one.withColumn("o_text", F.when(F.col("error").isNull(), F.to_json(F.to_variant_object("o"))))
    held = F.arrays_overlap(F.map_keys("fields"), F.array(*map(F.lit, ANALYTIC_FIELDS)))
    get = lambda name, other: F.coalesce(F.try_element_at("fields", F.lit(name)), _json(other))
    event_id = F.try_element_at("said", F.lit("event_id"))
    analysis = F.create_map(
        *(
            x for name, value in {
                "schema_version": _json(f'"{ANALYSIS.version}"'), "analysis_id": _text(F.concat(F.lit("legacy-"), event_id)), "analysis_run_id": _json('"legacy-import-v0"'), "event_id": F.try_element_at("o", F.lit("event_id")), "input_digest": _text(F.col("digest")),
                "executed_at": F.try_element_at("o", F.lit("observed_at")), "versions": _json(f'{{"mapper":"{LEGACY}","triage":"{LEGACY}","rule_catalog":"{LEGACY}"}}'), "attack_hypotheses": get("techniques", "[]"), "severity": get("severity", '"info"'),
                "triage": get("triage", "{}"), "detection_results": get("detection_results", "[]"), "evidence_completeness": _json("{}"),
            }.items() for x in (F.lit(name), value)
        )
    )
    one = one.withColumn("digest", canonical_digest(F.col("o_text")))
    one = one.withColumn("a", F.when(legacy & F.col("error").isNull() & held, analysis))
    one = one.withColumns({"kinds": ANALYSIS.kinds(F.col("a")), "said": ANALYSIS.said(F.col("a"))})
    error = F.coalesce("error", F.when(F.col("a").isNotNull(), ANALYSIS.broken(F.col("kinds"), F.col("said"))))
    one = one.select("line_no", "value", "kind", "o_text", "a", error.alias("error"))
    fine = F.col("error").isNull()
    return one.select(
        "line_no", F.when(fine, F.when(F.col("kind") == "observation", F.col("value")).otherwise(F.col("o_text"))).alias("observation"),
        F.when(fine, F.when(F.col("kind") == "analysis", F.col("value")).otherwise(F.to_json(F.to_variant_object("a")))).alias("analysis"), "error",
    )


class ContractError(ValueError):
    """Records that can't be migrated; ``errors`` are the first lines of them."""


def migrate(spark: SparkSession, lines: DataFrame, folder: str | None, run: str = "migration") -> dict[str, int]:
    """Writes observations and analyses as JSON lines that count together, and returns their numbers; without ``folder`` only counts them."""
    done = migrated(lines)
    bad = done.where("error is not null").orderBy("line_no").limit(10).collect()
    if bad:
        raise ContractError("; ".join(f"line {r.line_no}: {r.error}" for r in bad))
    counts = done.agg(F.count("observation").alias("observations"), F.count("analysis").alias("analyses")).first().asDict()
    if folder is not None:
        commit = Commit(spark, folder, run)
        for name in ("observation", "analysis"):
            commit.table(f"{name}s" if name == "observation" else "analyses", done.where(f"{name} is not null").select(F.col(name).alias("value")), kind="text")
        commit.finish(counts)
    return counts


def analyses_of(observations: DataFrame, run_id: str, executed_at: str) -> DataFrame:
    """Rows of the analysis ledger: (event_id, value: an observation's JSON, techniques, severity, triage) -> one interpretation each.

    Ids are name-based over run and event, so that a run can be repeated; ``triage`` is JSON text.
    """
    one = observations.withColumn("input_digest", canonical_digest(F.col("value")))
    result = F.to_json(
        F.struct(
            F.col("techniques").alias("attack_hypotheses"), F.array().cast("array<string>").alias("detection_results"), F.col("event_id"), F.col("severity"), F.parse_json("triage").alias("triage"),
        )
    )
    analysis_id = crypto.uuid5(NAMESPACE, F.concat(F.lit(f"{run_id}|"), F.col("event_id")))
    return one.select(
        analysis_id.alias("analysis_id"), F.lit(run_id).alias("analysis_run_id"), "event_id", "input_digest", F.lit(ANALYSIS.version).alias("schema_version"), F.lit('{"mapper":"v1","rule_catalog":"not-run","triage":"v1"}').alias("versions"), F.lit(executed_at).alias("executed_at"), result.alias("result"),
    )
