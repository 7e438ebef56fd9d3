"""The whole exported bundle: every object as JSON text, each once.

The public profile names sources by reserved domain names and lets allow-listed fields through alone; the private one
keeps addresses, and payloads as content-addressed artifacts. Groupings are by session and day, in blocks of bounded
size, so no object refers to more than a block of events, however long a session is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.operators.stix import PRIVATE, PRODUCER, PROJECT_NAMESPACE, PUBLIC, object_id, quoted
from gridlark.session import staged, work_dir
from gridlark.sources.commits import table_digest

#: Decoded fields that may leave, and when objects of the catalog were made.
PUBLIC_DECODED = (
    "address", "apdu_length", "cotp_pdu_type", "declared_length", "error", "frame_type", "function_code", "function_name", "operation", "parameter_length", "protocol_id", "rosctr", "s7_function", "tpkt_length", "transaction_id", "type_id", "u_function", "unit_id", "valid", "value_or_quantity",
)
CATALOG_CREATED = "2026-01-01T00:00:00.000Z"
SPEC = "2.1"
#: Events below one grouping.
GROUP = 4096
_TECHNIQUE_URL = "https://attack.mitre.org/techniques/"
_OWN = "x_gridlark_"
_MATCHES = "array<struct<technique_id:string,name:string,tactic:string,confidence:string,rationale:string>>"


def stamp(c: Column) -> Column:
    """A time as UTC text with milliseconds; no or bad time is an error."""
    time = c.try_cast("timestamp")
    return F.when(time.isNull(), F.raise_error(F.lit("an event has no valid time")).cast("string")).otherwise(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def technique_url(technique_id: Column) -> Column:
    """The address of a technique's page: a sub-technique is a part of its own."""
    return F.concat(F.lit(_TECHNIQUE_URL), F.replace(technique_id, F.lit("."), F.lit("/")), F.lit("/"))


def _has(events: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)


def _filled(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def _positive(c: Column) -> Column:
    return F.when(c != 0, c)


def prepared(events: DataFrame, profile: str) -> DataFrame:
    """Events with the ids of what they refer to, and what of them may be exported."""
    if profile not in (PUBLIC, PRIVATE):
        raise ValueError("the profile is public or private")
    get = lambda name, kind="string": _has(events, name, kind)
    missing = F.raise_error(F.lit("an event has no source")).cast("string")
    value = F.concat(F.lower(F.coalesce(_filled(get("source_id")), missing)), F.lit(".invalid")) if profile == PUBLIC else F.coalesce(_filled(F.trim(get("source_ip"))), missing)
    decoded = F.lit(None).cast("string")
    if "decoded" in events.columns:
        names = [f.name for f in events.schema["decoded"].dataType.fields]
        shown = [n for n in sorted(names) if profile == PRIVATE or n in PUBLIC_DECODED]
        decoded = F.when(F.col("decoded").isNotNull(), F.to_json(F.struct(*(F.col(f"decoded.{n}").alias(n) for n in shown))))
    e = events.select(
        "event_id", get("session_id").alias("session_id"), get("sensor_id").alias("sensor_id"), stamp(get("observed_at")).alias("at"), F.coalesce(get("protocol"), F.lit("unknown")).alias("protocol"), F.coalesce(get("event_type"), F.lit("")).alias("event_type"), F.coalesce(get("severity"), F.lit("info")).alias("severity"),
        F.coalesce(get("is_demo", "boolean"), F.lit(False)).alias("is_demo"), value.alias("source_value"), _positive(get("source_port", "long")).alias("src_port"), _positive(get("destination_port", "long")).alias("dst_port"), _positive(get("byte_count", "long")).alias("src_byte_count"),
        (_filled(get("raw_payload_hex")) if profile == PRIVATE else F.lit(None).cast("string")).alias("payload_hex"), decoded.alias("decoded"), F.coalesce(get("techniques", _MATCHES), F.array().cast(_MATCHES)).alias("techniques"),
        *(_filled(get(name)).alias(name) for name in ("source_id", "source_country", "source_country_code", "source_asn", "data_notice")), (F.when(F.size("tags") > 0, F.col("tags")) if "tags" in events.columns else F.lit(None).cast("array<string>")).alias("tags"),
    )
    six = F.col("source_value").contains(":")
    e = e.withColumn("source_type", F.lit("domain-name") if profile == PUBLIC else F.when(six, "ipv6-addr").otherwise("ipv4-addr"))
    named = F.concat(F.lit('{"value":'), quoted(F.col("source_value")), F.lit("}"))
    source = object_id("domain-name", named, True) if profile == PUBLIC else F.when(six, object_id("ipv6-addr", named, True)).otherwise(object_id("ipv4-addr", named, True))
    payload = F.unhex("payload_hex")
    bad = F.raise_error(F.lit("a payload is not hexadecimal")).cast("binary")
    e = e.withColumn("source_ref", source).withColumn("payload", F.when(F.col("payload_hex").isNotNull(), F.coalesce(payload, bad))).withColumn("payload_bin", F.replace(F.replace(F.base64("payload"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))
    e = e.withColumn("artifact_ref", F.when(F.col("payload_bin").isNotNull(), object_id("artifact", F.concat(F.lit('{"payload_bin":"'), F.col("payload_bin"), F.lit('"}')), True)))
    part = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    traffic = F.concat(
        F.lit("{"), F.concat_ws(",", part("dst_port", F.col("dst_port").cast("string")), F.lit('"protocols":["tcp"]'), part("src_byte_count", F.col("src_byte_count").cast("string")), part("src_payload_ref", quoted(F.col("artifact_ref"))), part("src_port", F.col("src_port").cast("string")), part("src_ref", quoted(F.col("source_ref")))), F.lit("}"),
    )
    known = F.transform("techniques", lambda t: t)
    if profile == PUBLIC:  # unknown ids stay inside; texts are the catalog's
        known = F.filter("techniques", lambda t: t["technique_id"].isin(*C.TECHNIQUES))
    e = e.withColumn("traffic_ref", object_id("network-traffic", traffic, True)).withColumn("observed_ref", object_id("observed-data", F.concat(F.lit(f'["{profile}",'), quoted(F.col("event_id")), F.lit("]"))))
    return e.withColumn("techniques", F.filter(known, lambda t: F.length(F.trim(F.coalesce(t["technique_id"], F.lit("")))) > 0))


def _object(kind: Column | str, oid: Column, **fields: Column) -> Column:
    """(type, id, value): the object's JSON with null fields left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), oid.alias("id"), F.to_json(F.struct(kind.alias("type"), F.lit(SPEC).alias("spec_version"), oid.alias("id"), *(c.alias(n) for n, c in fields.items()))).alias("value"))


def _pattern_id(technique_id: Column) -> Column:
    return object_id("attack-pattern", F.concat(F.lit('["mitre-attack-ics",'), quoted(technique_id), F.lit("]")))


def identity_id() -> Column:
    return object_id("identity", F.lit(f'"{PRODUCER}"'))


def bundle_objects(events: DataFrame, profile: str = PUBLIC, folder: str | None = None) -> DataFrame:
    """(number, type, id, value) of every object, numbered from 0 by type and id. No event is an error of the caller: the bundle then holds the producer alone.

    Objects are written to ``folder`` (else a new one) once, before they are counted and placed.
    """
    folder = folder or work_dir(events.sparkSession)
    return _numbered(staged(bundle_parts(events, profile, folder), f"{folder}/parts"))


def bundle_parts(events: DataFrame, profile: str = PUBLIC, folder: str | None = None) -> DataFrame:
    """(type, id, value) of every object, each once, without an order. All kinds are made of one table in ``folder`` (else a new one), so an event's ids are worked out once."""
    e = staged(prepared(events, profile).drop("payload", "payload_hex"), f"{folder or work_dir(events.sparkSession)}/prepared")
    lit, col = F.lit, F.col
    label = F.when(col("is_demo"), "synthetic").otherwise("live")
    # what many events share is made distinct by its fields, which its id stands for; texts are made of the few that are left
    sources = e.select("source_type", "source_ref", "source_value").distinct().select(_object(col("source_type"), col("source_ref"), value=col("source_value")).alias("o"))
    artifacts = e.where("artifact_ref is not null").select("artifact_ref", "payload_bin").distinct()
    artifacts = artifacts.select(_object("artifact", col("artifact_ref"), mime_type=lit("application/octet-stream"), payload_bin=col("payload_bin"), hashes=F.struct(F.sha2(F.unbase64("payload_bin"), 256).alias("SHA-256"))).alias("o"))
    traffic = e.select("traffic_ref", "src_port", "dst_port", "src_byte_count", "source_ref", "artifact_ref").distinct()
    traffic = traffic.select(_object("network-traffic", col("traffic_ref"), protocols=F.array(lit("tcp")), src_port=col("src_port"), dst_port=col("dst_port"), src_byte_count=col("src_byte_count"), src_ref=col("source_ref"), src_payload_ref=col("artifact_ref")).alias("o"))
    shared = sources.unionByName(artifacts).unionByName(traffic).select("o.*")
    observation = _object(
        "observed-data", col("observed_ref"), created_by_ref=identity_id(), created=col("at"), modified=col("at"), first_observed=col("at"), last_observed=col("at"), number_observed=lit(1), object_refs=F.array_compact(F.array("source_ref", "artifact_ref", "traffic_ref")),
        labels=F.array(lit("ot-honeypot"), F.when(col("is_demo"), "synthetic").otherwise("live-observation")),
        **{_OWN + n: c for n, c in {"profile": lit(profile), "data_classification": label, "event_id": col("event_id"), "event_type": col("event_type"), "protocol": col("protocol"), "severity": col("severity"), "session_id": _filled(col("session_id")), "sensor_id": _filled(col("sensor_id")), "decoded": F.parse_json(F.when(col("decoded") != "{}", col("decoded"))), "source_id": col("source_id"), "source_country": col("source_country"), "source_country_code": col("source_country_code"), "source_asn": col("source_asn"), "data_notice": col("data_notice"), "tags": col("tags")}.items()},
    )
    observed = e.select(observation.alias("o")).select("o.*").groupBy("type", "id").agg(F.max("value").alias("value"))
    mapped = e.select("observed_ref", "at", F.explode("techniques").alias("t")).select("observed_ref", "at", col("t.technique_id").alias("technique_id"), F.lower(F.coalesce(col("t.confidence"), lit("low"))).alias("confidence"), col("t.name").alias("name"), col("t.tactic").alias("tactic"), col("t.rationale").alias("rationale"))
    catalog = lambda k: F.element_at(F.create_map(*(x for t, v in C.TECHNIQUES.items() for x in (lit(t), lit(v[k])))), col("technique_id"))
    if profile == PUBLIC:
        mapped = mapped.withColumns({"name": catalog(0), "tactic": catalog(1), "confidence": F.when(col("confidence").isin(*C.STIX_CONFIDENCE), col("confidence")).otherwise("low"), "rationale": lit("Mapped from allow-listed protocol evidence.")})
    else:
        mapped = mapped.withColumns({"name": F.coalesce("name", catalog(0), "technique_id"), "tactic": F.coalesce("tactic", catalog(1), lit("Unknown")), "rationale": F.coalesce("rationale", lit("Local evidence-based mapping."))})
    mapped = mapped.withColumn("pattern_ref", _pattern_id(col("technique_id")))
    mapped = mapped.withColumn("relation_ref", object_id("relationship", F.concat(lit("["), quoted(col("observed_ref")), lit(","), quoted(col("pattern_ref")), lit(","), quoted(col("technique_id")), lit("]"))))
    patterns = mapped.groupBy("technique_id").agg(F.min(F.struct("name", "tactic")).alias("x"), F.first("pattern_ref").alias("ref"))
    reference = F.array(F.struct(lit("mitre-attack-ics").alias("source_name"), col("technique_id").alias("external_id"), technique_url(col("technique_id")).alias("url")))
    phase = F.array(F.struct(lit("mitre-attack-ics").alias("kill_chain_name"), F.replace(F.lower("x.tactic"), lit(" "), lit("-")).alias("phase_name")))
    patterns = patterns.select(_object("attack-pattern", col("ref"), created_by_ref=identity_id(), created=lit(CATALOG_CREATED), modified=lit(CATALOG_CREATED), name=col("x.name"), description=lit("A technique that observations may hint at; no proof of compromise."), external_references=reference, kill_chain_phases=phase).alias("o")).select("o.*")
    score = F.coalesce(F.element_at(F.create_map(*(x for k, v in C.STIX_CONFIDENCE.items() for x in (lit(k), lit(v)))), col("confidence")), lit(25))
    relation = _object("relationship", col("relation_ref"), created_by_ref=identity_id(), created=col("at"), modified=col("at"), relationship_type=lit("related-to"), source_ref=col("observed_ref"), target_ref=col("pattern_ref"), description=col("rationale"), confidence=score, **{f"{_OWN}confidence_label": col("confidence"), f"{_OWN}mapping_status": lit("evidence-based-hypothesis")})
    relations = mapped.select(relation.alias("o")).select("o.*").groupBy("type", "id").agg(F.max("value").alias("value"))
    producer = events.sparkSession.range(1).select(_object("identity", identity_id(), created=lit(CATALOG_CREATED), modified=lit(CATALOG_CREATED), name=lit(PRODUCER), identity_class=lit("system")).alias("o")).select("o.*")
    return shared.unionByName(observed).unionByName(patterns).unionByName(relations).unionByName(_groupings(e, profile)).unionByName(producer)


def groupings(events: DataFrame, profile: str = PUBLIC) -> DataFrame:
    """(type, id, value) of the bundle's groupings alone."""
    return _groupings(prepared(events, profile), profile)


def _groupings(e: DataFrame, profile: str) -> DataFrame:
    """One grouping for each session, UTC day and block of events, with the time of the first and last of them."""
    day = F.substring("at", 1, 10)
    refs = F.concat(F.array("observed_ref"), F.flatten(F.transform("techniques", lambda t: F.array(_pattern_id(t["technique_id"]), object_id("relationship", F.concat(F.lit("["), quoted(F.col("observed_ref")), F.lit(","), quoted(_pattern_id(t["technique_id"])), F.lit(","), quoted(t["technique_id"]), F.lit("]")))))))
    one = e.select(F.coalesce("session_id", F.lit("")).alias("session"), day.alias("day"), "event_id", "at", "is_demo", refs.alias("refs"))
    blocks = one.groupBy("session", "day").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    one = one.join(blocks, ["session", "day"]).withColumn("block", F.pmod(F.xxhash64("event_id"), F.col("blocks")).cast("int"))
    by = one.groupBy("session", "day", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), F.bool_or("is_demo").alias("some"), F.bool_and("is_demo").alias("every"))
    klass = F.when(F.col("every"), "synthetic").when(F.col("some"), "mixed").otherwise("live")
    oid = object_id("grouping", F.concat(F.lit(f'["{profile}",'), quoted(F.col("session")), F.lit(',"'), F.col("day"), F.lit('",'), F.col("block").cast("string"), F.lit("]")))
    text = F.when(klass == "synthetic", "Synthetic telemetry; nothing of it was observed.").otherwise("Observations of decoys; techniques are hypotheses.")
    o = _object("grouping", oid, created_by_ref=identity_id(), created=F.col("first"), modified=F.col("last"), name=F.lit(f"{PRODUCER} {profile} export"), description=text, context=F.lit("suspicious-activity"), object_refs=F.col("refs"), **{f"{_OWN}export_profile": F.lit(profile), f"{_OWN}data_classification": klass})
    return by.select(o.alias("o")).select("o.*")


def _numbered(objects: DataFrame) -> DataFrame:
    """Adds ``number`` by type and id: places in id blocks, after the objects of earlier blocks."""
    block = F.concat(F.col("type"), F.lit(":"), F.substring(F.substring_index("id", "--", -1), 1, 3))
    marked = objects.withColumn("block", block)
    counts = marked.groupBy("type", "block").agg(F.count("*").alias("n"))  # 4096 blocks of each type at most
    before = counts.select("block", F.coalesce(F.sum("n").over(Window.orderBy("type", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
    return marked.withColumn("place", place).join(before, "block").select((F.col("before") + F.col("place")).alias("number"), "type", "id", "value")


def bundle_id(objects: DataFrame, profile: str = PUBLIC) -> str:
    """A name-based id over the bag of the objects' ids; only a digest comes to the driver."""
    return f"bundle--{uuid.uuid5(uuid.UUID(PROJECT_NAMESPACE), f'{profile}:{table_digest(objects.select('id'))}')}"

