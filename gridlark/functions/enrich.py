"""Per-event enrichment as column expressions: mapping, severity, triage, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions import catalog as C


def technique(technique_id: str, confidence: str) -> Column:
    name, tactic = C.TECHNIQUES[technique_id]
    return F.struct(
        F.lit(technique_id).alias("technique_id"), F.lit(name).alias("name"), F.lit(tactic).alias("tactic"), F.lit(confidence).alias("confidence"), F.lit(C.RATIONALES[technique_id]).alias("rationale")
    )


def evidence(protocol: Column, event_type: Column, operation: Column, function_code: Column, signature: Column) -> dict[str, Column]:
    """What a request gives evidence of, as plain booleans: they stay in generated code and push down as filters."""
    op = F.lower(F.coalesce(operation, F.lit("")))
    counts = event_type.isin(*C.EVIDENCE_EVENTS)
    return {
        "probe": counts & op.isin(*C.PROBES),
        "read": counts & (protocol == "modbus") & F.coalesce(function_code.isin(*C.READ_FUNCTIONS), F.lit(False)),
        "command": counts & op.isin(*C.COMMANDS),
        "program": counts & op.isin(*C.PROGRAM_TRANSFERS),
        "exploit": (event_type == "known_exploit_probe") & (F.length(F.coalesce(signature, F.lit(""))) > 0),
    }


#: Order of hypotheses: which evidence gives which technique at which confidence.
HYPOTHESES = (("probe", "T0846.001", "medium"), ("read", "T0877", "low"), ("command", "T1692.001", "high"), ("command", "T0836", "medium"), ("program", "T0843", "high"), ("exploit", "T0866", "high"))


def techniques_of(e: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(e[name], technique(t, confidence)) for name, t, confidence in HYPOTHESES)))


def technique_ids_of(e: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(e[name], t) for name, t, _ in HYPOTHESES)))


def severity_of(e: dict[str, Column]) -> Column:
    return F.when(e["command"] | e["program"] | e["exploit"], "high").when(e["read"], "medium").otherwise("info")


def confidence_of(e: dict[str, Column]) -> Column:
    return F.when(e["command"] | e["program"] | e["exploit"], "high").when(e["probe"], "medium").when(e["read"], "low").otherwise("none")


def score_of(e: dict[str, Column], operation: Column, function_code: Column, repeats: Column | None = None, novel: Column | None = None) -> Column:
    """``score(triage_factors(...))`` of mapped events as arithmetic."""
    op = F.lower(F.coalesce(operation, F.lit("")))
    read = op.isin(*C.READS) | F.coalesce(function_code.isin(*C.READ_FUNCTIONS), F.lit(False))
    points = F.when(op.isin(*C.COMMANDS), 40).when(op.isin(*C.PROGRAM_TRANSFERS), 45).otherwise(F.when(read, 15).otherwise(0) + F.when(op.isin(*C.PROBES), 10).otherwise(0))
    points = points + F.when(e["exploit"], 35).otherwise(0)
    points = points + F.when(e["command"] | e["program"] | e["exploit"], 20).when(e["probe"], 10).when(e["read"], 5).otherwise(0)
    if repeats is not None:
        points = points + F.when(repeats >= 5, 15).when(repeats > 1, 10).otherwise(0)
    if novel is not None:
        points = points + F.when(novel, 5).otherwise(0)
    return F.least(F.lit(100), points)


def map_techniques(protocol: Column, event_type: Column, operation: Column, function_code: Column, signature: Column) -> Column:
    """Evidence-qualified hypotheses in a fixed order; a connection alone maps to nothing."""
    return techniques_of(evidence(protocol, event_type, operation, function_code, signature))


def technique_ids(techniques: Column) -> Column:
    return F.transform(techniques, lambda t: t["technique_id"])


def severity(techniques: Column) -> Column:
    ids = technique_ids(techniques)
    has = lambda wanted: F.arrays_overlap(ids, F.array(*map(F.lit, wanted)))
    return F.when(has(C.HIGH_SEVERITY), "high").when(has(C.MEDIUM_SEVERITY), "medium").otherwise("info")


def rank(value: Column, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, place in reversed(ranks.items()):
        out = F.when(value == name, place).otherwise(out)
    return out


def triage_confidence(techniques: Column) -> Column:
    """The strongest known confidence, '' without one."""
    best = F.array_max(F.transform(techniques, lambda t: rank(F.lower(t["confidence"]), C.CONFIDENCE_RANK, 0)))
    return F.when(best == 3, "high").when(best == 2, "medium").when(best == 1, "low").otherwise("")


def view_confidence(techniques: Column) -> Column:
    """The strongest confidence for tables: 'none' without techniques; unknown text ranks last, first of equals wins."""
    ranked = F.transform(techniques, lambda t, i: F.struct(rank(F.lower(t["confidence"]), {k: v - 1 for k, v in C.CONFIDENCE_RANK.items()}, -1).alias("r"), (-i).alias("i"), F.lower(t["confidence"]).alias("c")))
    return F.when(F.coalesce(F.size(techniques), F.lit(0)) > 0, F.array_max(ranked)["c"]).otherwise("none")


def triage_factors(event_type: Column, operation: Column, function_code: Column, signature: Column, techniques: Column, repeats: Column | None = None, novel: Column | None = None) -> Column:
    """Array of (code, points). A command outranks a program transfer, which outranks reads and probes."""
    op = F.lower(F.coalesce(operation, F.lit("")))
    repeats = F.lit(1) if repeats is None else repeats
    novel = F.lit(False) if novel is None else novel
    factor = lambda code, points: F.struct(F.lit(code).alias("code"), F.lit(points).cast("int").alias("points"))
    command, program = op.isin(*C.COMMANDS), op.isin(*C.PROGRAM_TRANSFERS)
    quiet = ~command & ~program
    read = op.isin(*C.READS) | F.coalesce(function_code.isin(*C.READ_FUNCTIONS), F.lit(False))
    confidence = triage_confidence(techniques)
    return F.array_compact(
        F.array(
            F.when(command, factor("control_command", 40)),
            F.when(program, factor("program_transfer", 45)),
            F.when(quiet & read, factor("process_read", 15)),
            F.when(quiet & op.isin(*C.PROBES), factor("protocol_probe", 10)),
            F.when((F.lower(event_type) == "known_exploit_probe") & (F.length(F.coalesce(signature, F.lit(""))) > 0), factor("exploit_signature", 35)),
            *(F.when(confidence == name, factor("mapped_evidence", points)) for name, points in C.CONFIDENCE_POINTS.items()),
            F.when(repeats >= 5, factor("repeat_source", 15)).when(repeats > 1, factor("repeat_source", 10)),
            F.when(novel, factor("novel_payload", 5)),
        )
    )


def score(factors: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(factors, F.lit(0), lambda acc, f: acc + f["points"]))


def priority(points: Column) -> Column:
    """The review queue of a score; a score outside 0..100 is an error."""
    return F.when((points < 0) | (points > 100), F.raise_error(F.lit("a score lies between 0 and 100")).cast("string")).otherwise(priority_of(points))


def priority_of(points: Column) -> Column:
    """``priority`` for scores that are in range by construction."""
    out = F.when(points >= C.PRIORITY_FLOORS[0], C.PRIORITIES[0])
    for name, floor in zip(C.PRIORITIES[1:-1], C.PRIORITY_FLOORS[1:]):
        out = out.when(points >= floor, name)
    return out.otherwise(C.PRIORITIES[-1])


def factor_summary(factors: Column) -> Column:
    text = F.array_join(F.transform(factors, lambda f: F.format_string("%s (+%d)", f["code"], f["points"])), "; ")
    return F.when(F.size(factors) > 0, text).otherwise("No scored protocol evidence.")


COMPLETENESS_CHECKS = ("valid decoded request", "bounded session identifier", "coarse public location", "evidence-qualified mapping")


def completeness(decoded_present: Column, valid: Column, session_id: Column, country_code: Column, latitude: Column, longitude: Column, techniques: Column) -> Column:
    """(label, met, missing). The caller passes columns whose keys are present; null text counts as text."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    filled = lambda c: c.isNull() | (F.length(F.trim(c)) > 0)
    checks = [
        decoded_present & F.coalesce(valid, F.lit(True)),
        filled(session_id),
        (F.upper(F.coalesce(country_code, F.lit("none"))) != "ZZ") & finite(latitude) & finite(longitude),
        F.coalesce(F.exists(techniques, lambda t: filled(t["confidence"]) & filled(t["rationale"])), F.lit(False)),
    ]
    missing = F.array_compact(F.array(*(F.when(~c, name) for c, name in zip(checks, COMPLETENESS_CHECKS))))
    met = len(checks) - F.size(missing)
    return F.struct(F.when(met == len(checks), "complete fields").when(met <= 1, "limited fields").otherwise("partial fields").alias("label"), met.alias("met"), missing.alias("missing"))


def coarse(value: Column) -> Column:
    """One decimal, half to even."""
    return F.rint(value * 10) / 10


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def next_step(priority: Column) -> Column:
    """What to do with an event of a priority; a fallback for an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in C.NEXT_STEPS.items() for x in pair)), priority), F.lit(C.OTHER_STEP))


def analyst_note(priority: Column) -> Column:
    """A short note for a queue; an unknown priority is an error."""
    note = F.element_at(F.create_map(*(F.lit(x) for pair in C.NOTES.items() for x in pair)), priority)
    return F.coalesce(note, F.raise_error(F.lit("a priority is unknown")).cast("string"))
