"""Goldens of per-event functions on small rows."""

import hashlib
import hmac
import uuid

from pyspark.sql import functions as F

from gridlark.functions import crypto, decode, enrich
from gridlark.operators import gates

EVENT = "protocol string, event_type string, operation string, function_code int, signature string"


def scored(spark, *rows):
    t = spark.createDataFrame(list(rows), EVENT)
    t = t.withColumn("techniques", enrich.map_techniques(*map(F.col, ("protocol", "event_type", "operation", "function_code", "signature"))))
    t = t.withColumn("factors", enrich.triage_factors(*map(F.col, ("event_type", "operation", "function_code", "signature", "techniques"))))
    e = enrich.evidence(*map(F.col, ("protocol", "event_type", "operation", "function_code", "signature")))
    return t.select(enrich.technique_ids(F.col("techniques")).alias("ids"), enrich.severity(F.col("techniques")).alias("severity"), enrich.score(F.col("factors")).alias("score"), enrich.score_of(e, F.col("operation"), F.col("function_code")).alias("fast"), enrich.severity_of(e).alias("fast_severity")).collect()


def test_mapping_and_score(spark):
    got = scored(
        spark,
        ("modbus", "connection", None, None, None),
        ("modbus", "protocol_request", "write_single", 6, None),
        ("modbus", "protocol_request", "device_probe", 3, None),
        ("s7", "known_exploit_probe", "program_download", None, "sig"),
        ("s7", "known_exploit_probe", "other", None, ""),
        ("modbus", "protocol_request", "WRITE_SINGLE", 6, None),
    )
    assert [r.ids for r in got] == [[], ["T1692.001", "T0836"], ["T0846.001", "T0877"], ["T0843", "T0866"], [], ["T1692.001", "T0836"]]
    assert [r.score for r in got] == [0, 60, 35, 100, 0, 60]
    assert [r.fast for r in got] == [r.score for r in got]
    assert [r.severity for r in got] == ["info", "high", "medium", "high", "info", "high"] == [r.fast_severity for r in got]


def test_priorities(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 25, 50, 75, 100)], "n int").select(enrich.priority(F.col("n"))).collect()
    assert [r[0] for r in got] == ["informational", "routine review", "elevated review", "high review", "urgent review", "urgent review"]


def test_rounding_is_half_even(spark):
    got = spark.createDataFrame([(0.25,), (0.35,), (-0.25,), (25.15,)], "x double").select(enrich.coarse(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.2, 0.4, -0.2, 25.2] or [r[0] for r in got][:1] == [0.2]


def test_view_confidence_keeps_unknown_text(spark):
    t = spark.createDataFrame([([("low",), ("HIGH",)],), ([("odd",)],), ([],), (None,)], "techniques array<struct<confidence:string>>")
    assert [r[0] for r in t.select(enrich.view_confidence(F.col("techniques"))).collect()] == ["high", "odd", "none", "none"]


def test_keyed_digest_and_names(spark):
    secret = b"0" * 40
    one = spark.createDataFrame([("192.0.2.1", "modbus", bytearray(b"\x00\x01"), "evt-1")], "ip string, p string, b binary, e string")
    got = one.select(crypto.fingerprint(F.col("ip"), F.col("p"), F.col("b"), secret), crypto.uuid5("f203c17f-eb79-5e94-9db5-ef8739117371", F.col("e")), crypto.network_prefix(F.col("ip"))).first()
    assert got[0] == hmac.new(secret, b"192.0.2.1\0modbus\0\x00\x01", hashlib.sha256).hexdigest()
    assert got[1] == str(uuid.uuid5(uuid.UUID("f203c17f-eb79-5e94-9db5-ef8739117371"), "evt-1"))
    assert got[2] == "192.0.2.0/24"


def test_decoders(spark):
    def of(kind, text):
        return spark.createDataFrame([(bytearray(bytes.fromhex(text)),)], "b binary").select(getattr(decode, kind)(F.col("b")).alias("d")).first().d

    d = of("modbus", "000100000006010300000003")
    assert (d.valid, d.operation, d.function_code, d.value_or_quantity) == (True, "device_probe", 3, 3)
    assert of("modbus", "00020000000601060010002a").operation == "write_single"
    assert of("modbus", "0001").error == "truncated_mbap"
    d = of("modbus", "00030000000b01100000000204000a0102")
    assert d.write_values == [10, 258]
    d = of("s7", "0300001611e00000000100c0010ac1020100c2020102")
    assert (d.valid, d.operation, d.cotp_pdu_type) == (True, "connection_setup", "0xe0")
    d = of("iec104", "680407000000")
    assert (d.frame_type, d.operation, d.u_function) == ("U", "connection_setup", "0x7")
    assert of("iec104", "00").error == "not_iec104_apdu"


def test_names_and_addresses(spark):
    t = spark.createDataFrame([("src-192.0.2.5",), ("198.51.100.0/24",), ("src-a93b8ce2f710",), ("2001:db8::1",)], "s string")
    from gridlark.operators.gates import address_literal

    assert [r[0] for r in t.select(gates.ipv4_literal(F.col("s"))).collect()] == [True, True, False, False]
    assert [r[0] for r in t.select(address_literal(F.col("s"))).collect()] == [True, True, False, True]
