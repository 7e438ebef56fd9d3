"""Quality and privacy gates: preflight of JSON lines, publication rules, health findings.

Reports carry codes and places, never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import catalog as C

#: Fixed values of the handoff format.
REQUIRED = ("event_id", "session_id", "sensor_id", "observed_at", "protocol", "event_type", "decoded", "techniques", "tags", "severity", "is_demo")
OPTIONAL = (
    "source_ip", "source_id", "source_network", "source_port", "destination_port", "byte_count", "raw_payload_hex", "source_country", "source_country_code", "source_latitude", "source_longitude", "source_asn", "sanitized",
    "transport_authenticated", "configuration_version", "data_notice",
)
EVENT_TYPES = ("connection", "protocol_request", "session_error", "known_exploit_probe")
MAX_RECORD_BYTES = 64 * 1024
CREDENTIAL_NAMES = ("api_key", "access_key", "auth_header", "authorization", "bearer", "cookie", "credential", "password", "passwd", "private_key", "secret", "token", "username")
CREDENTIAL_PARTS = ("credential", "password", "passwd", "secret", "token", "username")
PRIVATE_NAMES = ("source_ip", "raw_payload_hex", "payload", "payload_bin")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def credential_like(key: Column) -> Column:
    """Could a field of this name hold authentication material?"""
    name = F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return name.isin(*CREDENTIAL_NAMES) | F.arrays_overlap(F.split(name, "_"), _strings(CREDENTIAL_PARTS))


def private_key(key: Column) -> Column:
    return F.lower(key).isin(*PRIVATE_NAMES) | credential_like(key)


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


#: An address must fill its run of hex digits, colons and dots, but for colons and dots around it.
_V4 = rf"(?<![0-9A-Fa-f:.])[.:]*{_OCTET}(?:\.{_OCTET}){{3}}(?:[.:]*(?![0-9A-Fa-f:./])|[.:]*/(?![0-9])|/(?:3[0-2]|[12]?[0-9])(?![0-9]))"
_V6_RUN = r"(?<![0-9A-Fa-f:.])([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)"


def ipv4_literal(text: Column) -> Column:
    """Does the text hold an IPv4 address or network?"""
    return F.coalesce(text.rlike(_V4), F.lit(False))


def _ipv6(run: Column) -> Column:
    """Is a run of hex digits, colons and dots an IPv6 address, once colons and dots around it are gone?"""
    run = F.regexp_replace(run, r"^[.:]+|[.:]+$", "")
    # an IPv4 tail stands for two groups
    run = F.regexp_replace(run, rf":{_OCTET}(\.{_OCTET}){{3}}$", ":0:0")
    groups = F.size(F.filter(F.split(run, ":"), lambda g: g != ""))
    hexes = r"[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*"
    return (run.rlike(f"^{hexes}$") & (groups == 8)) | (run.rlike(f"^{hexes}::{hexes}$") & (groups <= 7))


def address_literal(text: Column) -> Column:
    """Does the text hold an address or network, version 4 or 6? A run is looked at as version 6 only where it has two colons."""
    six = F.when(text.like("%:%:%"), F.exists(F.regexp_extract_all(text, F.lit(_V6_RUN), F.lit(1)), _ipv6)).otherwise(F.lit(False))
    return F.coalesce(ipv4_literal(text) | six, F.lit(False))


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("MISSING"))


#: Fields that the rules look at, by what they need: the text, or the kind alone.
_TEXTS = ("event_id", "session_id", "sensor_id", "severity", "protocol", "event_type", "observed_at", "source_id", "source_ip", "raw_payload_hex")
_KINDS = ("is_demo", "decoded", "techniques", "tags", "sanitized")


def with_fields(records: DataFrame) -> DataFrame:
    """Adds for the fields of the variant ``v`` their kinds and texts (null unless a string) by name, as two small maps: code for each field by itself grows too large to be compiled."""
    held = records.select("*", F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: k.isin(*_TEXTS, *_KINDS)).alias("x"))
    kinds = held.withColumn("kinds", F.transform_values("x", lambda _, x: F.schema_of_variant(x)))
    texts = F.transform_values(F.map_filter("x", lambda k, _: k.isin(*_TEXTS)), lambda k, x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    flag = lambda name: F.when(_at("kinds", name) == "BOOLEAN", F.try_variant_get(_at("x", name), "$", "boolean")).alias(f"b_{name}")
    return kinds.withColumn("texts", texts).select("*", flag("is_demo"), flag("sanitized")).drop("x")


def _at(fields: str, name: str) -> Column:
    return F.try_element_at(F.col(fields), F.lit(name))


def record_errors(keys: Column) -> Column:
    """Sorted distinct error codes of one record as one text with commas, on the columns of ``with_fields`` and its top-level keys.

    Text, not an array without its nulls: what is inside of a higher-order function isn't compiled.
    """
    text, kind = (lambda name: _at("texts", name)), (lambda name: F.coalesce(_at("kinds", name), F.lit("MISSING")))
    blank = lambda name: F.length(F.trim(F.coalesce(text(name), F.lit("")))) == 0
    observed = text("observed_at")
    # a time without an offset is rejected
    timed = observed.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & observed.try_cast("timestamp").isNotNull()
    sanitized = kind("sanitized")
    clean = F.coalesce(F.col("b_sanitized"), F.lit(False))
    has = lambda name: F.array_contains(keys, name)
    payload, hexed = kind("raw_payload_hex"), text("raw_payload_hex")
    rules = {
        "missing_required_fields": F.size(F.array_except(_strings(REQUIRED), keys)) > 0,
        "unexpected_top_level_fields": F.exists(keys, lambda k: ~k.isin(*REQUIRED, *OPTIONAL)),
        **{f"invalid_{name}": blank(name) for name in ("event_id", "session_id", "sensor_id", "severity")},
        "unsupported_protocol": ~F.coalesce(text("protocol").isin(*C.PROTOCOLS), F.lit(False)),
        "unsupported_event_type": ~F.coalesce(text("event_type").isin(*EVENT_TYPES), F.lit(False)),
        "invalid_timestamp": ~F.coalesce(timed, F.lit(False)),
        "invalid_classification": kind("is_demo") != "BOOLEAN",
        "invalid_decoded_object": ~kind("decoded").startswith("OBJECT"),
        "invalid_techniques_list": ~kind("techniques").startswith("ARRAY"),
        "invalid_tags_list": ~kind("tags").startswith("ARRAY"),
        "invalid_sanitized_flag": ~sanitized.isin("MISSING", "VOID") & ~clean,
        "missing_sanitized_source_id": clean & blank("source_id"),
        "private_fields_in_sanitized_record": clean & (has("source_ip") | has("raw_payload_hex")),
        "missing_private_source_ip": ~clean & blank("source_ip"),
        "invalid_raw_payload": ~payload.isin("MISSING", "VOID") & ~((payload == "STRING") & F.coalesce((F.length(hexed) <= 1024) & hexed.rlike("^([0-9a-fA-F]{2})*$"), F.lit(False))),
    }
    return F.concat_ws(",", *(F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in sorted(rules.items())))


def inspect_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> event_id, error codes and classification of each line; blank lines are passed over.

    Lines may name their ``file`` (ids then repeat within a file), and say by ``newline`` whether they end with one. The text ``null`` is
    no record and no error.
    """
    files = [c for c in ("file",) if c in lines.columns]
    ended = F.col("newline") if "newline" in lines.columns else F.lit(True)
    held = lines.where(F.length(F.btrim("value", F.lit(" \t\r\n\x0b\x0c"))) > 0)
    size = F.octet_length("value") + F.when(ended, 1).otherwise(0)
    fine_text = F.is_valid_utf8("value")
    one = with_fields(held.select(*files, "line_no", size.alias("size"), ended.alias("ended"), F.when(fine_text, F.try_parse_json("value")).alias("v"), F.when(fine_text, F.json_object_keys("value")).alias("keys")).withColumn("kind", F.schema_of_variant("v")))
    state = F.when(F.col("size") > MAX_RECORD_BYTES, "oversized_record").when(F.col("v").isNull(), "malformed_json").when(F.col("kind") == "VOID", "null").when(~F.col("kind").startswith("OBJECT"), "record_not_object")
    one = one.withColumn("state", state)
    fine = F.col("state").isNull()
    only = lambda c: F.when(fine, F.col(c))
    one = one.select("*", F.when(fine, _at("texts", "event_id")).alias("event_id"), only("b_is_demo").alias("is_demo"), F.when(fine, F.coalesce("b_sanitized", F.lit(False))).alias("sanitized"))
    # duplicates are found by the first line of each id: counts combine before the shuffle, no sort of a hot id's rows
    # (the key is never null, so no test of it is moved below the parsing, which would parse a line anew for each place that names it)
    one = one.withColumn("id_key", F.struct("event_id", F.when(F.col("event_id").isNull(), F.col("line_no")).alias("alone")))
    first = one.groupBy(*files, "id_key").agg(F.min("line_no").alias("first_line"), F.count("event_id").alias("n")).where("n > 1").drop("n")
    one = one.withColumn("found", F.when(fine, record_errors(F.col("keys"))))
    own = F.when(F.col("found") == "", F.array().cast("array<string>")).when(fine, F.split("found", ",")).when(F.col("state") == "null", F.array().cast("array<string>")).otherwise(F.array("state"))
    said = [F.when(fine, _at("texts", c)).alias(c) for c in ("observed_at", "protocol", "event_type")]
    one = one.select(*files, "line_no", "event_id", "id_key", own.alias("own"), "ended", "is_demo", "sanitized", *said).join(first, [*files, "id_key"], "left")
    more = F.array_compact(F.array(F.when(F.col("line_no") > F.col("first_line"), "duplicate_event_id"), F.when(~F.col("ended"), "incomplete_final_line")))
    codes = F.when(F.size(more) == 0, F.col("own")).otherwise(F.array_sort(F.concat("own", more)))
    return one.select(*files, "line_no", "event_id", codes.alias("codes"), "is_demo", "sanitized", "observed_at", "protocol", "event_type")


def preflight_report(inspected: DataFrame) -> DataFrame:
    """One row about the whole file: totals, classification, mixed states."""
    return inspected.agg(
        F.count("*").alias("records"), F.count_if(F.size("codes") == 0).alias("valid_records"), F.count_if(F.array_contains("codes", "duplicate_event_id")).alias("duplicate_ids"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("errors"),
        F.when(F.count("is_demo") == 0, "unknown").when(F.bool_and("is_demo"), "synthetic").when(~F.bool_or("is_demo"), "observed").otherwise("mixed").alias("classification"),
        F.coalesce(F.bool_or("sanitized") & ~F.bool_and("sanitized"), F.lit(False)).alias("mixed_privacy_state"), (F.count("*") == 0).alias("empty_file"),
    )


def error_counts(inspected: DataFrame) -> DataFrame:
    return inspected.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def public_errors(lines: DataFrame) -> DataFrame:
    """Publication rules on JSON text (line_no, value): (line_no, code, place), blank lines passed over.

    Names are looked at in objects at any depth and strings at any depth for addresses: in canonical JSON a
    string that a colon follows is a name, and escapes are spelled out. ``place`` is the name; values stay inside.
    """
    one = lines.where(F.length(F.trim("value")) > 0).select("line_no", F.try_parse_json("value").alias("v"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    one = one.select("line_no", "v", kind.alias("kind"), F.when(kind.startswith("OBJECT"), F.to_json("v")).alias("text"))
    tokens = F.regexp_extract_all("text", F.lit(r'("(?:[^"\\]|\\.)*"\s*:?)'), F.lit(1))
    one = one.select("line_no", "v", "kind", tokens.alias("tokens"))
    plain = lambda t: F.regexp_replace(t, r'^"|"\s*:?$', "")
    names = F.array_distinct(F.transform(F.filter("tokens", lambda t: t.endswith(":")), plain))
    strings = F.transform(F.filter("tokens", lambda t: ~t.endswith(":")), plain)
    one = one.select("line_no", "v", "kind", names.alias("names"), F.exists(strings, address_literal).alias("addressed"))
    source = F.when(_kind(F.col("v"), "source_id") == "STRING", F.try_variant_get("v", "$.source_id", "string"))
    true = (_kind(F.col("v"), "sanitized") == "BOOLEAN") & F.coalesce(F.try_variant_get("v", "$.sanitized", "boolean"), F.lit(False))
    error = lambda bad, code, place: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(place).alias("place")))
    flat = F.array_compact(
        F.array(
            error(~true, "not_sanitized", "sanitized"), error(_kind(F.col("v"), "is_demo") != "BOOLEAN", "no_classification", "is_demo"), error(F.length(F.trim(F.coalesce(source, F.lit("")))) == 0, "no_source_id", "source_id"),
            error(address_literal(source), "source_id_is_address", "source_id"), error(F.col("addressed"), "address_found", ""),
        )
    )
    named = F.transform(F.filter("names", private_key), lambda n: F.struct(F.lit("forbidden_field").alias("code"), n.alias("place")))
    found = F.when(F.col("v").isNull(), F.array(error(F.lit(True), "malformed_json", ""))).when(~F.col("kind").startswith("OBJECT"), F.array(error(F.lit(True), "record_not_object", ""))).otherwise(F.concat(flat, named))
    return one.select("line_no", F.explode(found).alias("e")).select("line_no", "e.code", "e.place")


def public_report(lines: DataFrame) -> DataFrame:
    """One row about a whole dataset: records, records with errors, whether it is empty or mixes classes, and whether it may be published."""
    one = lines.where(F.length(F.trim("value")) > 0).select("line_no", F.try_parse_json("value").alias("v"))
    demo = F.when(_kind(F.col("v"), "is_demo") == "BOOLEAN", F.try_variant_get("v", "$.is_demo", "boolean"))
    total = one.agg(F.count("*").alias("records"), F.coalesce(F.bool_or(demo) & ~F.bool_and(demo), F.lit(False)).alias("mixed_classification"))
    bad = public_errors(lines).agg(F.countDistinct("line_no").alias("bad_records"))
    both = total.join(F.broadcast(bad))  # a row each
    return both.select("records", "bad_records", "mixed_classification", (F.col("records") == 0).alias("empty"), ((F.col("records") > 0) & (F.col("bad_records") == 0) & ~F.col("mixed_classification")).alias("publishable"))


#: Fixed values of health reports.
GENERATED_MAX_AGE, EVENT_MAX_AGE = 120, 900
DISK_WARNING, DISK_CRITICAL = 10.0, 5.0
QUEUE_DROPS = ("alert_queue_drops", "collector_queue_drops", "spool_queue_drops")


def _count(name: str) -> Column:
    """A counter of a snapshot: anything but a positive whole number counts as 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint")))


def health_findings(s: DataFrame, now: Column) -> DataFrame:
    """Ordered findings (``code=severity``) and the worst status of health snapshots, one row each.

    A missing time is a finding of its own, never a fresh one. Columns: snapshot_id, process_running, status,
    generated_epoch, last_event_epoch, expect_traffic, disk_free_percent, the queue drops, delivery_failures,
    rejected_sessions, storage_ready (null: not reported).
    """
    old = lambda c, limit: F.col(c).isNull() | (F.greatest(F.lit(0), now - F.col(c)) > limit)
    finding = lambda cond, code, level: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(2 if level == "critical" else 1).alias("level"), F.lit(f"{code}={level}").alias("text")))
    free = F.col("disk_free_percent")
    drops = F.lit(False)
    for name in QUEUE_DROPS:
        drops |= _count(name) > 0
    found = F.array_compact(
        F.array(
            finding(~F.coalesce(F.col("process_running") & (F.col("status") == "ok"), F.lit(False)), "process", "critical"), finding(old("generated_epoch", GENERATED_MAX_AGE), "snapshot_freshness", "critical"),
            finding(F.col("expect_traffic") & old("last_event_epoch", EVENT_MAX_AGE), "event_freshness", "warning"), finding(free < DISK_CRITICAL, "disk", "critical"), finding((free >= DISK_CRITICAL) & (free < DISK_WARNING), "disk", "warning"),
            finding(drops, "queue_drops", "warning"), finding(_count("delivery_failures") > 0, "delivery", "warning"), finding(_count("rejected_sessions") > 0, "session_capacity", "warning"),
            finding(~F.col("storage_ready"), "collector_storage", "critical"), finding(F.col("storage_ready").isNull(), "collector_storage", "warning"),
        )
    )
    one = s.select("snapshot_id", found.alias("found"))
    worst = F.coalesce(F.array_max(F.transform("found", lambda f: f["level"])), F.lit(0))
    return one.select("snapshot_id", F.array_join(F.transform("found", lambda f: f["text"]), ", ").alias("findings"), F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("ok").alias("status"), worst.alias("exit_code"))


def operator_assurance(s: DataFrame) -> DataFrame:
    """Allow-listed counters of a snapshot as states. The texts are fixed values."""
    said = lambda bad, yes, no: F.when(bad, yes).otherwise(no)
    return s.select(
        "snapshot_id", said(F.coalesce(F.col("status") == "ok", F.lit(False)), "reported healthy", "reported unhealthy").alias("state"), "generated_epoch", "last_event_epoch", _count("total_events").alias("total_events"),
        said(_count("alert_queue_drops") + _count("collector_queue_drops") > 0, "attention needed", "no drops reported").alias("queue_state"), said(_count("delivery_failures") > 0, "attention needed", "no failures reported").alias("delivery_state"),
        said(_count("rejected_sessions") > 0, "sessions rejected", "no rejections reported").alias("capacity_state"), F.when(F.col("storage_ready"), "ready").when(~F.col("storage_ready"), "not writable").otherwise("not reported").alias("storage_state"),
    )
