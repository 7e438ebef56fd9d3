"""Rule objects compiled to column predicates, and what they find: no shuffle, no Python per event.

Events have flat columns; ``PATHS`` says which column a rule's dotted path means. A missing field
is a null column.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.sources.rules import FieldRule, NetworkRule, Selection

PATHS = {"sensor_id": "sensor_id", "event_type": "event_type", "protocol": "protocol", "decoded.operation": "operation", "decoded.function_code": "function_code", "decoded.signature": "signature", "decoded.type_id": "type_id", "decoded.s7_function": "s7_function"}


def _all(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(and_, conditions, F.lit(True)), F.lit(False))


def _field(path: str, known: set[str]) -> Column:
    name = PATHS.get(path)
    return F.col(name) if name in known else F.lit(None).cast("string")


def compile_selection(rule: Selection, known: set[str]) -> Column:
    out = []
    for path, modifier, values in rule.conditions:
        field = _field(path, known)
        out.append((field.isNotNull() if values == (True,) else field.isNull()) if modifier == "exists" else field.cast("string").isin(*map(str, values)))
    return _all(out)


def compile_field_rules(rules: list[FieldRule], known: set[str]) -> dict[int, Column]:
    """Predicates of alerting rules; a parent's predicate is part of its children's. Level 0 never alerts."""
    by_id = {r.rule_id: r for r in rules}
    done: dict[int, Column] = {}

    def build(number: int, above: tuple[int, ...]) -> Column:
        if number in above or number not in by_id:
            return F.lit(False)
        if number not in done:
            rule = by_id[number]
            own = [_field(path, known).cast("string").rlike(pattern) for path, pattern in rule.fields]
            done[number] = _all([build(rule.parent, (*above, number)), *own] if rule.parent else own)
        return done[number]

    return {r.rule_id: build(r.rule_id, ()) for r in rules if r.level > 0}


def with_modbus_view(events: DataFrame) -> DataFrame:
    """What a network engine would see of a Modbus event. Unit 0 becomes 1, as an absent unit does."""
    modbus = F.col("protocol") == "modbus"
    function = F.coalesce(F.col("function_code"), F.lit(0))
    unit = F.coalesce(F.nullif(F.col("unit_id"), F.lit(0)), F.lit(1)) if "unit_id" in events.columns else F.lit(1)
    return events.select(
        "*", F.when(modbus, unit).alias("modbus_unit"), F.when(modbus, function).alias("modbus_function"), F.when(modbus, F.when(function > 64, "unassigned").otherwise("assigned")).alias("modbus_class"),
        F.when(modbus, F.when(F.coalesce("operation", F.lit("")).startswith("write_"), "write").otherwise("read")).alias("modbus_access"),
    )


def compile_network(rule: NetworkRule) -> Column:
    out = [F.col("protocol") == "modbus"]
    for key, value in rule.clauses:
        if key == "unit":
            out.append(F.col("modbus_unit") == int(value))
        elif key == "access":
            out.append(F.col("modbus_access") == value)
        elif key == "function":
            out.append(F.col("modbus_function") == int(value) if value.isdigit() else F.col("modbus_class") == value)
        else:
            out.append(F.lit(False))
    return _all(out)


def _level(level: int) -> str:
    return "high" if level >= 12 else "medium" if level >= 7 else "low"


def predictions(events: DataFrame, pack, engines: tuple[str, ...] = ("Sigma", "Wazuh", "Suricata")) -> DataFrame:
    """One row for each event and rule that matches it."""
    selections, field_rules, network = pack
    seen = with_modbus_view(events)
    known = set(seen.columns)
    hits = []

    def hit(predicate: Column, engine: str, rule_id: str, title: str, severity: str, techniques: tuple[str, ...]) -> Column:
        text = {"engine": engine, "rule_id": rule_id, "title": title, "severity": severity, "technique": ", ".join(techniques) or "not mapped"}
        return F.when(predicate, F.struct(*(F.lit(v).alias(k) for k, v in text.items())))

    if "Sigma" in engines:
        hits += [hit(compile_selection(r, known), "Sigma", r.name, r.title, r.level, r.techniques) for r in selections]
    if "Wazuh" in engines:
        by_id = {r.rule_id: r for r in field_rules}
        hits += [hit(p, "Wazuh", str(n), by_id[n].title, _level(by_id[n].level), by_id[n].techniques) for n, p in compile_field_rules(field_rules, known).items()]
    if "Suricata" in engines:
        hits += [hit(compile_network(r), "Suricata", str(r.sid), r.title, r.severity, r.techniques) for r in network]
    reason = F.concat(F.lit("Rule conditions matched event_type="), F.coalesce("event_type", F.lit("unknown")), F.lit(", protocol="), F.coalesce("protocol", F.lit("unknown")), F.lit(", operation="), F.coalesce("operation", F.lit("unknown")), F.lit("."))
    found = seen.select("event_id", "protocol", reason.alias("reason"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select("event_id", "protocol", "reason", "hit.*")


def coverage(found: DataFrame) -> DataFrame:
    by = found.groupBy("protocol").agg(F.count("*").alias("predictions"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("technique").alias("techniques"))
    return by.orderBy(F.desc("predictions"), "protocol")


def uncovered_techniques(events: DataFrame, found: DataFrame) -> DataFrame:
    """Mapped ids that no rule names. A rule with several techniques names their joined text, not its members."""
    mapped = events.select(F.explode("technique_ids").alias("technique")).distinct()
    return mapped.join(found.select("technique").distinct(), "technique", "left_anti")


STATUS = ("mapping review", "rule opportunity", "fixture follow-up", "covered in pack")


def coverage_backlog(events: DataFrame, found: DataFrame, fixtures: list[tuple[str, str]]) -> DataFrame:
    """Observed behaviours with their techniques, engines and what is missing. ``fixtures`` is a short list."""
    engines = found.groupBy("event_id").agg(F.collect_set("engine").alias("engines"))
    both = events.select("event_id", "protocol", F.coalesce("operation", F.lit("unknown")).alias("operation"), "technique_ids").join(engines, "event_id", "left")
    by = both.groupBy("protocol", "operation").agg(F.count("*").alias("observed_events"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("technique_ids")))).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines")))).alias("e"))
    covered = F.concat_ws("|", "protocol", "operation").isin(*(f"{p}|{o}" for p, o in fixtures))
    status = F.when(F.size("t") == 0, STATUS[0]).when(F.size("e") == 0, STATUS[1]).when(~covered, STATUS[2]).otherwise(STATUS[3])
    text = lambda c, empty: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(empty)
    return by.select("protocol", "operation", "observed_events", text("t", "not mapped").alias("mapped_techniques"), text("e", "none").alias("rule_engines"), F.when(covered, "synthetic fixture present").otherwise("no matching fixture").alias("fixture_coverage"), status.alias("status"))


def pack_errors(cases: DataFrame, pack) -> DataFrame:
    """Fixture cases whose matches differ from what they expect: (case_id, engine, expected, found).

    ``cases`` has the event columns, ``case_id`` as ``event_id``, and expected_<engine> arrays.
    """
    found = predictions(cases, pack).groupBy("event_id").pivot("engine", ["Sigma", "Wazuh", "Suricata"]).agg(F.array_sort(F.collect_set("rule_id")))
    both = cases.join(found, "event_id", "left")
    sides = F.explode(F.array(*(F.struct(F.lit(e).alias("engine"), F.array_sort(F.col(f"expected_{e.lower()}")).alias("expected"), F.coalesce(F.col(e), F.array().cast("array<string>")).alias("found")) for e in ("Sigma", "Wazuh", "Suricata"))))
    return both.select("event_id", sides.alias("s")).select("event_id", "s.*").where("expected <> found")
