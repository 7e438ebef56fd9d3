"""Queries of the exported graph."""

from __future__ import annotations

from gridlark.operators import stix
from gridlark.plans.evidence import uuid5_sql
from gridlark.plans.registry import query
from gridlark.plans.telemetry import TELEMETRY_SQL, telemetry

T = TELEMETRY_SQL


def _id(kind: str, material: str, sco: bool = False) -> str:
    inner = f"""'["{kind}",' || {material} || ']'"""
    return f"""'{kind}--' || {uuid5_sql(stix.SCO_NAMESPACE if sco else stix.PROJECT_NAMESPACE, f"({inner})")}"""


_SOURCE = _id("domain-name", """'{"value":"' || source_id || '.invalid"}'""", True)
_OBSERVED = _id("observed-data", """'["public","' || event_id || '"]'""")
_PATTERN = _id("attack-pattern", """'["mitre-attack-ics","' || tid || '"]'""")
_PORT = "CASE protocol WHEN 'modbus' THEN '502' WHEN 's7' THEN '102' ELSE '2404' END"
_TRAFFIC = _id("network-traffic", f"""'{{"dst_port":' || {_PORT} || ',"protocols":["tcp"],"src_ref":"' || src || '"}}'""", True)


@query(
    "stix_nodes",
    T + f""", s AS (SELECT event_id, protocol, technique_ids, source_id, {_SOURCE} AS src FROM tel)
SELECT DISTINCT src AS id, 'domain-name' AS type, source_id || '.invalid' AS label FROM s UNION ALL SELECT DISTINCT {_TRAFFIC}, 'network-traffic', protocol || '/tcp' FROM s
UNION ALL SELECT {_OBSERVED}, 'observed-data', event_id FROM s UNION ALL SELECT DISTINCT {_PATTERN}, 'attack-pattern', tid FROM (SELECT unnest(technique_ids) AS tid FROM s) UNION ALL SELECT {_id("identity", "'" + '"' + stix.PRODUCER + '"' + "'")}, 'identity', '{stix.PRODUCER}'""",
)
def stix_nodes(spark, sf_dir):
    return stix.graph_nodes(telemetry(spark, sf_dir))


_EDGE = _id("relationship", """'["' || o || '","' || p || '","' || tid || '"]'""")


@query(
    "stix_edges",
    T + f""", x AS (SELECT event_id, unnest(technique_ids) AS tid FROM tel), e AS (SELECT tid, {_OBSERVED} AS o, {_PATTERN} AS p FROM x)
SELECT {_EDGE} AS id, o AS source_ref, p AS target_ref, CAST(CASE tid WHEN 'T0877' THEN 25 WHEN 'T0846.001' THEN 50 WHEN 'T0836' THEN 50 ELSE 75 END AS int) AS confidence FROM e""",
)
def stix_edges(spark, sf_dir):
    return stix.graph_edges(telemetry(spark, sf_dir))
