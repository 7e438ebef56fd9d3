"""Protocol requests from payload bytes, as column expressions over hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(hexed: Column, k: int) -> Column:
    return F.conv(F.substring(hexed, 2 * k + 1, 2), 16, 10).cast("int")


def _word(hexed: Column, k: int) -> Column:
    return F.conv(F.substring(hexed, 2 * k + 1, 4), 16, 10).cast("int")


def modbus(payload: Column) -> Column:
    """Fields of a Modbus/TCP request; anything under 8 bytes is truncated."""
    h = F.hex(payload)
    n = F.length(h) / 2
    fc = _byte(h, 7)
    operation = F.when(fc.isin(5, 6), "write_single").when(fc.isin(15, 16, 22, 23), "write_multiple").otherwise("device_probe")
    bytes_in = F.least(_byte(h, 12), (n - 13).cast("int"))
    room = F.least(bytes_in, 2 * F.least(_word(h, 10), F.lit(123)))
    count = F.greatest(F.lit(0), (room / 2).cast("int"))
    values = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(h, 27 + 4 * i, F.lit(4)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
    whole = n >= 8
    return F.struct(
        (whole & (_word(h, 2) == 0)).alias("valid"),
        F.when(whole, operation).otherwise("device_probe").alias("operation"),
        F.when(~whole, "truncated_mbap").alias("error"),
        *(F.when(whole, v).alias(name) for v, name in ((_word(h, 0), "transaction_id"), (_word(h, 2), "protocol_id"), (_word(h, 4), "declared_length"), (_byte(h, 6), "unit_id"), (fc, "function_code"))),
        *(F.when(n >= 12, v).alias(name) for v, name in ((_word(h, 8), "address"), (_word(h, 10), "value_or_quantity"))),
        F.when((fc == 16) & (n >= 13), values).alias("write_values"),
    )


def s7(payload: Column) -> Column:
    """Fields of an S7 request. The marker is the first 0x32 byte anywhere, transport header included."""
    h = F.hex(payload)
    n = F.length(h) / 2
    tpkt = (n >= 4) & (_byte(h, 0) == 3)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (n - 1).cast("int"))), lambda i: F.substring(h, 2 * i + 1, F.lit(2)))
    at = F.array_position(pairs, "32") - 1
    byte = lambda k: F.conv(F.substring(h, (2 * (at + k) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    marked = tpkt & (at >= 0) & (n > at + 10)
    function = F.when(marked, byte(10))
    program = F.coalesce(function.between(0x1A, 0x1D), F.lit(False))
    return F.struct(
        F.coalesce(tpkt, F.lit(False)).alias("valid"),
        F.when(program, "program_download").otherwise("connection_setup").alias("operation"),
        F.when(~tpkt, "not_tpkt").alias("error"),
        F.when(tpkt, _word(h, 2)).alias("tpkt_length"),
        F.when(tpkt & (n > 5), F.concat(F.lit("0x"), F.lower(F.conv(_byte(h, 5).bitwiseAND(0xF0).cast("string"), 10, 16)))).alias("cotp_pdu_type"),
        F.when(marked, byte(1)).alias("rosctr"),
        F.when(marked, byte(6) * 256 + byte(7)).alias("parameter_length"),
        function.alias("s7_function"),
    )


IEC_SINGLE = (45, 46, 47, 58, 59, 60)


def iec104(payload: Column) -> Column:
    """Fields of an IEC 60870-5-104 frame: I, S or U by the control bits."""
    h = F.hex(payload)
    n = F.length(h) / 2
    ok = (n >= 6) & (_byte(h, 0) == 0x68)
    c0 = _byte(h, 2)
    kind = F.when(c0.bitwiseAND(1) == 0, "I").when(c0.bitwiseAND(3) == 1, "S").otherwise("U")
    type_id = F.when(ok & (kind == "I") & (n > 6), _byte(h, 6))
    command = type_id.between(45, 51) | type_id.between(58, 64)
    operation = F.when(command & type_id.isin(*IEC_SINGLE), "single_command").when(command, "setpoint_command").when(ok & (kind == "U"), "connection_setup").otherwise("interrogation")
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("valid"),
        operation.alias("operation"),
        F.when(~ok, "not_iec104_apdu").alias("error"),
        F.when(ok, _byte(h, 1)).alias("apdu_length"),
        F.when(ok, kind).alias("frame_type"),
        type_id.alias("type_id"),
        F.when(ok & (kind == "U"), F.concat(F.lit("0x"), F.lower(F.conv(c0.cast("string"), 10, 16)))).alias("u_function"),
    )
