"""A portable graph of observed data: nodes and edges as DataFrames, and the bundle as JSON text.

Ids are name-based (version 5) over canonical JSON of [type, material]; nothing depends on run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.functions import crypto

#: The namespace of cyber-observables is the standard's (a fixed value), the other one our own.
SCO_NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
PROJECT_NAMESPACE = "f203c17f-eb79-5e94-9db5-ef8739117371"
PRODUCER = "gridlark"
PUBLIC, PRIVATE = "public", "private"


def quoted(text: Column) -> Column:
    """A JSON string of text without control characters."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def object_id(kind: str, material: Column, sco: bool = False) -> Column:
    """``material`` is canonical JSON text."""
    return F.concat(F.lit(f"{kind}--"), crypto.uuid5(SCO_NAMESPACE if sco else PROJECT_NAMESPACE, _name(F.lit(kind), material)))


def _name(kind: Column, material: Column) -> Column:
    return F.concat(F.lit('["'), kind, F.lit('",'), material, F.lit("]"))


def _digest(kind: Column, material: Column, sco: Column) -> Column:
    hexes = F.when(sco, SCO_NAMESPACE.replace("-", "")).otherwise(PROJECT_NAMESPACE.replace("-", ""))
    return crypto.uuid5_digest(hexes, _name(kind, material))


def _id(kind: Column, digest: str) -> Column:
    return F.concat(kind, F.lit("--"), crypto.uuid5_of(F.col(digest)))


def _observed(profile: str, event_id: Column) -> Column:
    return F.concat(F.lit(f'["{profile}",'), quoted(event_id), F.lit("]"))


def _pattern(technique_id: Column) -> Column:
    return F.concat(F.lit('["mitre-attack-ics",'), quoted(technique_id), F.lit("]"))


def graph_nodes(events: DataFrame, profile: str = PUBLIC) -> DataFrame:
    """(id, type, label): the producer, sources, traffic, observed data and techniques, each once.

    A source is a reserved name in the public profile, an address in the private one. Rows are made distinct
    by what they stand for; ids are worked out after that, a digest column at a time.
    """
    value = F.concat(F.lower("source_id"), F.lit(".invalid")) if profile == PUBLIC else F.col("source_ip")
    kind = "domain-name" if profile == PUBLIC else "ipv4-addr"
    row = lambda t, key, protocol=None: F.struct(F.lit(t).alias("type"), key.alias("key"), (F.lit(None).cast("string") if protocol is None else protocol).alias("protocol"))
    own = [row(kind, F.col("source")), row("network-traffic", F.col("source"), F.col("protocol")), row("observed-data", F.col("event_id"))]
    things = events.select("event_id", "protocol", "technique_ids", value.alias("source"))
    things = things.select(F.explode(F.concat(F.array(*own), F.transform("technique_ids", lambda t: row("attack-pattern", t)))).alias("n")).select("n.*").distinct()
    of_source = F.col("type").isin(kind, "network-traffic")
    things = things.withColumn("d", F.when(of_source, _digest(F.lit(kind), F.concat(F.lit('{"value":'), quoted(F.col("key")), F.lit("}")), F.lit(True))))
    things = things.withColumn("source", F.when(of_source, _id(F.lit(kind), "d")))
    port = F.element_at(F.create_map(*(x for p, n in C.PORTS.items() for x in (F.lit(p), F.lit(n)))), F.col("protocol"))
    traffic = F.concat(F.lit('{"dst_port":'), port.cast("string"), F.lit(',"protocols":["tcp"],"src_ref":'), quoted(F.col("source")), F.lit("}"))
    is_traffic = F.col("type") == "network-traffic"
    material = F.when(is_traffic, traffic).when(F.col("type") == "observed-data", _observed(profile, F.col("key"))).otherwise(_pattern(F.col("key")))
    things = things.withColumn("e", F.when(F.col("type") != kind, _digest(F.col("type"), material, is_traffic)))
    nodes = things.select(F.when(F.col("type") == kind, F.col("source")).otherwise(_id(F.col("type"), "e")).alias("id"), "type", F.when(is_traffic, F.concat("protocol", F.lit("/tcp"))).otherwise(F.col("key")).alias("label"))
    producer = events.sparkSession.range(1).select(object_id("identity", F.lit(f'"{PRODUCER}"')).alias("id"), F.lit("identity").alias("type"), F.lit(PRODUCER).alias("label"))
    return nodes.unionByName(producer)


def graph_edges(events: DataFrame, profile: str = PUBLIC) -> DataFrame:
    """(id, source_ref, target_ref, confidence) of every mapped technique of every event."""
    observed, pattern, relation = F.lit("observed-data"), F.lit("attack-pattern"), F.lit("relationship")
    one = events.select("event_id", "techniques", _digest(observed, _observed(profile, F.col("event_id")), F.lit(False)).alias("o"))
    one = one.select(_id(observed, "o").alias("source_ref"), F.explode("techniques").alias("t")).select("source_ref", F.col("t.technique_id").alias("technique_id"), F.col("t.confidence").alias("label"))
    one = one.withColumn("p", _digest(pattern, _pattern(F.col("technique_id")), F.lit(False))).withColumn("target_ref", _id(pattern, "p"))
    material = F.concat(F.lit("["), quoted(F.col("source_ref")), F.lit(","), quoted(F.col("target_ref")), F.lit(","), quoted(F.col("technique_id")), F.lit("]"))
    confidence = F.coalesce(F.element_at(F.create_map(*(x for k, v in C.STIX_CONFIDENCE.items() for x in (F.lit(k), F.lit(v)))), F.col("label")), F.lit(25))
    one = one.withColumn("r", _digest(relation, material, F.lit(False)))
    return one.select(_id(relation, "r").alias("id"), "source_ref", "target_ref", confidence.alias("confidence"))


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Objects as JSON lines, in the order of (type, id): a stream that any size of graph fits."""
    objects = nodes.select("type", "id", F.to_json(F.struct("type", "id", F.lit("2.1").alias("spec_version"), F.col("label").alias("name"))).alias("value"))
    links = edges.select(F.lit("relationship").alias("type"), "id", F.to_json(F.struct(F.lit("relationship").alias("type"), "id", F.lit("2.1").alias("spec_version"), F.lit("related-to").alias("relationship_type"), "source_ref", "target_ref", "confidence")).alias("value"))
    objects.unionByName(links).orderBy("type", "id").select("value").write.mode("errorifexists").text(path)
