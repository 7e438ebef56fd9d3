"""Logs of other decoys in the event schema, contracts, sanitising."""

from __future__ import annotations

import ipaddress
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions import crypto, enrich
from gridlark.operators.gates import CREDENTIAL_NAMES, CREDENTIAL_PARTS

#: Fixed values of events that come from a foreign log.
NO_ADDRESS, FOREIGN_TAG = "0.0.0.0", "conpot"
ANALYTIC = ("techniques", "severity", "threat_score", "threat_priority")


def normalise_foreign(lines: DataFrame, sensor_id: str) -> DataFrame:
    """Foreign JSON lines (column value) to events. ``remote`` may be a list, ip:port or ip; a lone IPv6 text stays whole.

    Empty fields count as missing: then the next name is asked, and at last the address is 0.0.0.0 and the time now.
    """
    held = lambda n: F.nullif(F.get_json_object("value", f"$.{n}"), F.lit(""))
    get = lambda *names: F.coalesce(*map(held, names))
    remote = F.coalesce(F.when(held("remote") != "[]", held("remote")), held("src_ip"), F.lit(NO_ADDRESS))
    listed = remote.startswith("[")
    paired = F.length(remote) - F.length(F.replace(remote, F.lit(":"))) == 1
    parts = F.split(remote, ":")
    ip = F.when(listed, F.get_json_object("value", "$.remote[0]")).when(paired, parts[0]).otherwise(remote)
    port = F.when(listed, F.get_json_object("value", "$.remote[1]")).when(paired, parts[1]).otherwise(get("src_port"))
    decoded = get("decoded", "request")
    is_object = F.json_object_keys(decoded).isNotNull()
    message = F.when(~is_object, F.substring(decoded, 1, 256))
    field = lambda name: F.when(is_object, F.get_json_object(decoded, f"$.{name}"))
    has_request = F.coalesce(F.length(decoded) > 0, F.lit(False)) & ~decoded.isin("{}", "null", "[]", "0", "false")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    e = lines.select(
        F.coalesce(get("event_id"), F.sha2("value", 256)).alias("event_id"), F.lit(sensor_id).alias("sensor_id"), F.coalesce(get("timestamp", "observed_at"), now).alias("observed_at"), F.lower(F.coalesce(get("protocol", "data_type"), F.lit("unknown"))).alias("protocol"),
        F.when(has_request, "protocol_request").otherwise("connection").alias("event_type"), ip.alias("source_ip"), F.coalesce(port.try_cast("int"), F.lit(0)).alias("source_port"), F.coalesce(get("dst_port", "port").try_cast("int"), F.lit(0)).alias("destination_port"),
        F.coalesce(get("bytes", "byte_count").try_cast("int"), F.lit(0)).alias("byte_count"), F.substring(F.coalesce(get("raw_payload_hex"), F.lit("")), 1, 1024).alias("raw_payload_hex"), field("operation").alias("operation"), field("function_code").try_cast("int").alias("function_code"),
        field("signature").alias("signature"), message.alias("message"),
    )
    e = e.withColumn("session_id", crypto.session_key(F.col("sensor_id"), F.col("source_ip"), F.col("source_port").cast("string"), F.col("observed_at"))).withColumn("tags", F.array(F.lit(FOREIGN_TAG)))
    e = e.withColumn("techniques", enrich.map_techniques(*map(F.col, ("protocol", "event_type", "operation", "function_code", "signature"))))
    return e.withColumn("severity", enrich.severity(F.col("techniques")))


def classification(is_demo: Column, sanitized: Column) -> Column:
    return F.when(F.coalesce(is_demo, F.lit(False)), "synthetic").when(F.coalesce(sanitized, F.lit(False)), "sanitized_private").otherwise("raw_private")


def split_contracts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations (evidence alone) and analyses (interpretation) of events; rows without analytic values give no analysis."""
    held = [c for c in ANALYTIC if c in events.columns]
    demo = F.col("is_demo") if "is_demo" in events.columns else F.lit(False)
    clean = F.col("sanitized") if "sanitized" in events.columns else F.lit(False)
    observations = events.drop(*held).withColumn("schema_version", F.lit("observation-1")).withColumn("data_classification", classification(demo, clean))
    any_held = F.lit(False)
    for c in held:
        any_held |= F.col(c).isNotNull()
    analyses = events.where(any_held).select("event_id", F.lit("analysis-1").alias("schema_version"), *held)
    return observations, analyses


def sanitise(events: DataFrame, salt: str) -> DataFrame:
    """Pseudonyms for addresses, no payloads; a row without an address is an error. JSON text columns lose credential-like fields."""
    need = F.when(F.col("source_ip").isNull(), F.raise_error(F.lit("an event has no source address")).cast("string")).otherwise(F.col("source_ip"))
    out = events.withColumn("source_id", crypto.pseudonym(need, salt)).drop("source_ip", "source_network", "raw_payload_hex").withColumn("sanitized", F.lit(True))
    return out.withColumn("decoded_json", strip_credentials("decoded_json")) if "decoded_json" in out.columns else out


#: Names once everything but letters and digits is an underscore.
_AUTH = re.compile(rf"_(?:{'|'.join(CREDENTIAL_PARTS)})_|^_+(?:{'|'.join(CREDENTIAL_NAMES)})_+$")


def _without_auth(pairs: list[tuple]) -> dict:
    return {k: v for k, v in pairs if not _AUTH.search(f"_{re.sub('[^a-z0-9]+', '_', k.lower())}_")}


@F.pandas_udf(T.StringType())
def strip_credentials(values):
    """JSON text without credential-like fields at any depth; null where it doesn't parse (depth has no bound, so this is an Arrow UDF)."""

    def one(text):
        try:
            return json.dumps(json.loads(text, object_pairs_hook=_without_auth), sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return values.map(one)


@F.pandas_udf(T.StringType())
def network_of(values):
    """/24 or /48 of an address; null for other text."""

    def one(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        return str(ipaddress.ip_network(f"{ip}/{24 if ip.version == 4 else 48}", strict=False))

    return values.map(one)
