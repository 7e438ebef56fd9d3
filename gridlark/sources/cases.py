"""Labelled cases, rule fixtures, alert settings: small inputs that are checked whole before they are used."""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import detection
from gridlark.sources.jsonl import not_blank, read_lines

ENGINES = ("sigma", "wazuh", "suricata")
#: Event fields that fixtures may set, with their types.
EVENT_FIELDS = "sensor_id string, event_type string, protocol string, decoded struct<operation:string,function_code:int,signature:string>"


def _array_of_texts(path: str):
    return F.from_json(F.get_json_object("value", path), "array<string>")


def load_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, event, expected_technique_ids) of JSON lines; one without the labels is an error that names its line."""
    lines = read_lines(spark, path).where(not_blank("value"))
    missing = F.get_json_object("value", "$.expected_technique_ids").isNull()
    said = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" has no expected_technique_ids"))
    checked = lines.where(F.when(missing, F.raise_error(said).cast("boolean")).otherwise(True))
    return checked.select("file", "line_no", F.get_json_object("value", "$.event").alias("event"), _array_of_texts("$.expected_technique_ids").alias("expected_technique_ids"))


def fixture_errors(lines: DataFrame) -> DataFrame:
    """(line_no, code, case_id) of everything that is wrong with fixtures (file, line_no, value)."""
    held = lines.where(not_blank("value")).select("line_no", F.try_parse_json("value").alias("v"))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("MISSING"))
    case_id = F.when(kind("$.case_id") == "STRING", F.nullif(F.try_variant_get("v", "$.case_id", "string"), F.lit("")))
    keys = F.map_keys(F.try_variant_get("v", "$.expected", "map<string,variant>"))
    all_three = F.coalesce(F.array_sort(keys) == F.array(*map(F.lit, sorted(ENGINES))), F.lit(False))
    one = held.select("line_no", case_id.alias("case_id"), F.col("v").isNull().alias("broken"), (~kind("$.event").startswith("OBJECT")).alias("no_event"), (~all_three).alias("engines"))
    first = one.where("case_id is not null").groupBy("case_id").agg(F.min("line_no").alias("first_line"))
    one = one.join(first, "case_id", "left")
    rules = F.array_compact(F.array(F.when(F.col("case_id").isNull(), "case_id_missing"), F.when(F.col("line_no") > F.col("first_line"), "duplicate_case_id"), F.when(F.col("no_event"), "event_not_object"), F.when(F.col("engines"), "expected_engines")))
    return one.select("line_no", F.explode(F.when(F.col("broken"), F.array(F.lit("invalid_json"))).otherwise(rules)).alias("code"), "case_id")


def fixtures(lines: DataFrame) -> DataFrame:
    """Fixture cases as events with their expected rule names by engine; those without an event or expectations fall out."""
    e = lines.where(not_blank("value")).select(F.get_json_object("value", "$.case_id").alias("event_id"), F.from_json(F.get_json_object("value", "$.event"), EVENT_FIELDS).alias("e"), *(F.coalesce(_array_of_texts(f"$.expected.{x}"), F.array().cast("array<string>")).alias(f"expected_{x}") for x in ENGINES))
    return e.where("e is not null").select("event_id", "e.sensor_id", "e.event_type", "e.protocol", "e.decoded.operation", "e.decoded.function_code", "e.decoded.signature", *(f"expected_{x}" for x in ENGINES))


def rule_names(pack) -> dict[str, list[str]]:
    """Names of the rules that can fire, by engine."""
    selections, field_rules, network = pack
    return {"sigma": sorted(r.name for r in selections), "wazuh": sorted(str(r.rule_id) for r in field_rules if r.level > 0), "suricata": sorted(str(r.sid) for r in network)}


def pack_findings(lines: DataFrame, pack) -> DataFrame:
    """(code, subject) of everything wrong with a rule pack and its fixtures: fixture faults, mismatches, unknown and uncovered rules, too few negative cases."""
    cases = fixtures(lines)
    spark = lines.sparkSession
    faults = fixture_errors(lines).select("code", F.coalesce("case_id", F.concat(F.lit("line "), F.col("line_no").cast("string"))).alias("subject"))
    mismatches = detection.pack_errors(cases, pack).select(F.lit("mismatch").alias("code"), F.concat_ws(" ", "event_id", "engine").alias("subject"))
    names = spark.createDataFrame([(f"{engine} {name}",) for engine, own in rule_names(pack).items() for name in own], "subject string")

    def named(engine: str):
        return F.transform(f"expected_{engine}", lambda name: F.concat(F.lit(f"{engine} "), name))

    expected = cases.select(F.explode(F.flatten(F.array(*map(named, ENGINES)))).alias("subject")).distinct()
    unknown, uncovered = (a.join(b, "subject", "left_anti").select(F.lit(code).alias("code"), "subject") for a, b, code in ((expected, names, "unknown_rule"), (names, expected, "no_positive_case")))
    silent = F.size(F.flatten(F.array(*(f"expected_{x}" for x in ENGINES)))) == 0
    total = cases.agg(F.count("*").alias("n"), F.count_if(silent).alias("negative"))
    few = total.select(F.explode(F.array_compact(F.array(F.when(F.col("n") == 0, "no_fixtures"), F.when(F.col("negative") < 2, "too_few_negative_cases")))).alias("code")).withColumn("subject", F.lit(""))
    return faults.unionByName(mismatches).unionByName(unknown).unionByName(uncovered).unionByName(few)


def pack_summary(lines: DataFrame, pack) -> dict[str, int]:
    own = rule_names(pack)
    silent = F.size(F.flatten(F.array(*(f"expected_{x}" for x in ENGINES)))) == 0
    n = fixtures(lines).agg(F.count("*").alias("fixtures"), F.count_if(silent).alias("negative_cases")).first().asDict()
    return {"sigma_rules": len(own["sigma"]), "wazuh_alert_rules": len(own["wazuh"]), "suricata_rules": len(own["suricata"])} | n


MAX_SETTINGS_BYTES = 64 * 1024


@dataclass(frozen=True)
class AlertSettings:
    enabled: bool = False
    webhook_url: str = ""
    secret_env: str = "OT_ALERT_SECRET"
    queue_size: int = 100
    timeout_seconds: float = 5.0


def alert_settings(content: bytes) -> AlertSettings:
    """Settings from JSON; anything outside the allowed names and ranges is an error. Plain HTTP is for loopback alone."""
    if len(content) > MAX_SETTINGS_BYTES:
        raise ValueError("the settings are larger than 64 KiB")
    data = json.loads(content)
    if not isinstance(data, dict):
        raise TypeError("the settings must be an object")
    if extra := set(data) - set(AlertSettings.__dataclass_fields__):
        raise ValueError(f"settings that are not supported: {', '.join(sorted(extra))}")
    s = AlertSettings(**data)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not isinstance(s.enabled, bool):
        raise TypeError("enabled must be true or false")
    if not str(s.secret_env).isidentifier() or not str(s.secret_env).startswith("OT_"):
        raise ValueError("secret_env must name an OT_ variable")
    if not number(s.queue_size) or s.queue_size != int(s.queue_size) or not 1 <= s.queue_size <= 1000:
        raise ValueError("queue_size must lie in 1 to 1000")
    if not number(s.timeout_seconds) or not 1 <= s.timeout_seconds <= 15:
        raise ValueError("timeout_seconds must lie in 1 to 15")
    if s.enabled:
        url = urlparse(s.webhook_url)
        if url.scheme != "https" and not (url.scheme == "http" and url.hostname in ("127.0.0.1", "localhost", "::1")):
            raise ValueError("an enabled webhook needs an HTTPS address")
    return s


def verified_alerts(eve: DataFrame, expected: list[int], port: int = 502) -> DataFrame:
    """(signature_id, alerts, misdirected) of EVE JSON lines for each expected signature, at zero too; an alert on another port is misdirected."""
    sid = F.get_json_object("value", "$.alert.signature_id").try_cast("long")
    to = F.get_json_object("value", "$.dest_port").try_cast("int")
    alerts = eve.where(F.get_json_object("value", "$.event_type") == "alert").select(sid.alias("signature_id"), F.coalesce(to != port, F.lit(True)).alias("wrong")).where(F.col("signature_id").isin(*expected))
    zero = eve.sparkSession.createDataFrame([(s,) for s in expected], "signature_id long").select("signature_id", F.lit(None).cast("boolean").alias("wrong"))
    return alerts.unionByName(zero).groupBy("signature_id").agg(F.count("wrong").alias("alerts"), F.count_if(F.coalesce("wrong", F.lit(False))).alias("misdirected"))
