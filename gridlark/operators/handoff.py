"""The batch handoff: files of records are checked, sanitised, indexed and exported, and all of it counts at once.

Nothing is published here: outputs lie under the name of a run, and a manifest of digests, written last, makes them count.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import crypto
from gridlark.operators import bundle, gates, index, report, stix, walk
from gridlark.operators.gates import address_literal
from gridlark.sources import jsonl
from gridlark.sources.commits import Commit, Folder, Ledger, canonical_json, table_digest
from gridlark.sources.foreign import strip_credentials

VERSION = "gridlark-handoff-1.0"
#: Lines named in a report, in order.
MOST_ERRORS = 100
#: Texts of a report on a whole file.
_INCOMPLETE, _EMPTY = "file does not end with a complete newline-terminated record", "file contains no event records"
_MIXED, _PRIVACY = "synthetic and observed records are mixed", "raw and sanitized records are mixed"


def read_numbered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines with file, line_no, value and whether a newline ends them; facts of the files)."""
    facts = jsonl.file_facts(spark, path)
    lines = jsonl.read_lines(spark, path).join(F.broadcast(facts.select("file", "newlines")), "file")
    return lines.select("file", "line_no", "value", (F.col("line_no") <= F.col("newlines")).alias("newline")), facts


def _iso(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def preflight(inspected: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each file: digest, totals, times, counters as JSON text, the first ``MOST_ERRORS`` findings; never a value of a record.

    Counters are summed by (file, counter, name) before they meet in a row.
    """
    time = F.when(F.col("observed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("observed_at").try_cast("timestamp"))
    bad = F.size("codes") > 0
    # one pass for totals and counters: a record is counted under its file, under each of its names and under each of its codes
    named = [F.struct(F.lit(c).alias("counter"), n.alias("name")) for c, n in (("file", F.lit("")), *((c, F.col(c)) for c in ("protocol", "event_type")))]
    names = inspected.select(
        "file", "is_demo", "sanitized", time.alias("time"), bad.alias("bad"), F.array_contains("codes", "duplicate_event_id").alias("again"),
        F.explode(F.concat(F.array(*named), F.transform("codes", lambda x: F.struct(F.lit("code").alias("counter"), x.alias("name"))))).alias("x"),
    ).select("*", "x.*").where("name is not null")
    sums = names.groupBy("file", "counter", "name").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("invalid_records"), F.count_if("again").alias("duplicate_event_ids"), F.min("time").alias("low"), F.max("time").alias("high"),
        F.bool_or("is_demo").alias("any_demo"), F.bool_and("is_demo").alias("all_demo"), F.bool_or("sanitized").alias("any_clean"), F.bool_and("sanitized").alias("all_clean"),
    )
    of_whole = lambda c: F.max(F.when(F.col("counter") == "file", F.col(c)))
    totals = sums.groupBy("file").agg(
        of_whole("n").alias("total_records"), _iso(of_whole("low")).alias("earliest_timestamp"), _iso(of_whole("high")).alias("latest_timestamp"), *(of_whole(c).alias(c) for c in ("invalid_records", "duplicate_event_ids", "any_demo", "all_demo", "any_clean", "all_clean")),
        *(F.sort_array(F.collect_list(F.when(F.col("counter") == c, F.struct("name", "n")))).alias(c) for c in ("protocol", "event_type", "code")),
    )
    order = Window.partitionBy("file").orderBy("line_no")
    said = inspected.where(bad).select("file", "line_no", F.concat(F.lit("record "), F.col("line_no").cast("string"), F.lit(" failed: "), F.array_join("codes", ", ")).alias("text"))
    said = said.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_ERRORS).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("said"))
    r = facts.join(totals, "file", "left").join(said, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    empty, mixed, private = zero("total_records") == 0, F.coalesce(F.col("any_demo") & ~F.col("all_demo"), F.lit(False)), F.coalesce(F.col("any_clean") & ~F.col("all_clean"), F.lit(False))
    of_file = F.array_compact(F.array(F.when(empty, F.struct(F.lit("empty_file").alias("name"), F.lit(1).cast("long").alias("n"))), F.when(mixed, F.struct(F.lit("mixed_classification").alias("name"), F.lit(1).cast("long").alias("n"))), F.when(private, F.struct(F.lit("mixed_privacy_state").alias("name"), F.lit(1).cast("long").alias("n")))))
    no_counts = F.array().cast("array<struct<name:string,n:bigint>>")
    codes = F.array_sort(F.concat(F.coalesce("code", no_counts), of_file))
    counter = lambda c: F.to_json(F.map_from_entries(F.coalesce(c, no_counts)))
    partial = ~F.col("ends_with_newline") & (F.col("size") > 0)
    messages = F.concat(F.array_compact(F.array(F.when(partial, _INCOMPLETE))), F.coalesce(F.transform("said", lambda x: x["text"]), F.array().cast("array<string>")), F.array_compact(F.array(F.when(empty, _EMPTY), F.when(mixed, _MIXED), F.when(private, _PRIVACY))))
    return r.select(
        "file", F.lit(VERSION).alias("schema_version"), "sha256", F.col("size").alias("file_size_bytes"), zero("total_records").alias("total_records"), (zero("total_records") - zero("invalid_records")).alias("valid_records"), zero("invalid_records").alias("invalid_records"), zero("duplicate_event_ids").alias("duplicate_event_ids"),
        "earliest_timestamp", "latest_timestamp", counter(F.col("protocol")).alias("protocols"), counter(F.col("event_type")).alias("event_types"), F.when(F.col("any_demo").isNull(), "unknown").when(F.col("all_demo"), "synthetic").when(~F.col("any_demo"), "observed").otherwise("mixed").alias("data_classification"),
        F.when(~private, F.col("any_clean")).alias("sanitized_input"), (F.size(codes) > 0).alias("incomplete_or_malformed"), counter(codes).alias("error_codes"), F.slice(messages, 1, MOST_ERRORS).alias("safe_errors"), (F.size(codes) == 0).alias("valid"),
    )


class PreflightError(ValueError):
    """Files that fail; ``reports`` are their rows, which hold codes and line numbers but no values."""

    def __init__(self, reports: list[dict]):
        self.reports = reports
        super().__init__("; ".join(f"{r['file'].rpartition('/')[2]}: {r['error_codes']}" for r in reports))


def input_facts(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The checked lines of one or more files and what a manifest says of them; files that fail raise (the first ten are named)."""
    lines, facts = read_numbered(spark, path)
    # a row for each file, which is asked several times
    reports = preflight(gates.inspect_lines(lines), facts).persist()
    try:
        return lines, _whole_input(reports)
    finally:
        reports.unpersist()


def _whole_input(reports: DataFrame) -> dict:
    """What a manifest says of all files together."""
    failed = reports.where(~F.col("valid")).orderBy("file").limit(10).collect()
    if failed:
        raise PreflightError([r.asDict() for r in failed])
    mixed = reports.agg(F.countDistinct("data_classification").alias("classes"), F.countDistinct("sanitized_input").alias("states"), F.count("*").alias("files")).first()
    if not mixed.files:
        raise ValueError("there is no input file")
    if mixed.classes > 1 or mixed.states > 1:
        raise ValueError("the files differ in classification or privacy state")
    total = reports.agg(F.sum("total_records").alias("record_count"), F.sum("file_size_bytes").alias("file_size_bytes"), F.min("earliest_timestamp").alias("earliest_timestamp"), F.max("latest_timestamp").alias("latest_timestamp"), F.first("data_classification").alias("classification"), F.first("sanitized_input").alias("sanitized_on_input"), F.min("sha256").alias("sha256")).first().asDict()
    if mixed.files > 1:
        total["sha256"] = table_digest(reports.select("sha256"))
    return total


def sanitised_text(value: Column, salt: str) -> Column:
    """A record's canonical text without address, payload and credentials: a pseudonym stands for the source. No address is an error."""
    v = F.parse_json(strip_credentials(value))
    ip = F.trim(F.coalesce(F.get_json_object(value, "$.source_ip"), F.lit("")))
    checked = F.when(address_literal(ip) & ~ip.rlike(r"[^0-9A-Fa-f:.]"), ip).otherwise(F.raise_error(F.lit("a record has no source address")).cast("string"))
    kept = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin("source_ip", "source_network", "raw_payload_hex", "source_id", "sanitized"))
    own = F.to_variant_object(F.create_map(F.lit("source_id"), crypto.pseudonym(checked, salt)))
    added = F.create_map(F.lit("source_id"), F.try_variant_get(own, "$.source_id", "variant"), F.lit("sanitized"), F.parse_json(F.lit("true")))
    return jsonl.canonical_text(F.to_json(F.to_variant_object(F.map_concat(kept, added))))


def events_of(lines: DataFrame) -> DataFrame:
    """Typed events of checked lines, with what the index needs: arrival (seq), time, and the material of its fingerprint."""
    # a sanitised record holds no payload: source, protocol, kind and what was decoded stand for it, as canonical JSON
    part = lambda name: F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "variant")), F.lit("null"))
    material = jsonl.canonical_text(F.concat(F.lit("["), F.concat_ws(",", *map(part, ("source_id", "protocol", "event_type", "decoded"))), F.lit("]")))
    e = lines.select("line_no", F.from_json("value", jsonl.EVENT).alias("e"), material.alias("material")).select(F.col("line_no").alias("seq"), "material", "e.*")
    e = e.withColumn("observed_epoch", F.col("observed_at").cast("timestamp").cast("long"))
    return e.withColumn("technique_ids", F.transform("techniques", lambda t: t["technique_id"]))


def observation_index(events: DataFrame, secret: str) -> DataFrame:
    """Merged observations by the keyed digest of what each record says."""
    keyed = events.withColumn("fingerprint", crypto.hmac_sha256(F.encode("material", "UTF-8"), crypto.require_secret(secret).encode()))
    return index.merged_observations(keyed, 1800, ["fingerprint", "source_id", "protocol", "is_demo"])


STAGES = ("integrity_preflight", "sanitized_candidate", "privacy_validation", "observation_index", "staged_lines", "private_weekly_report", "private_navigator_layer")
PUBLIC_STAGES = ("aggregate_summary_candidate", "public_graph_candidate")


def finalize(spark: SparkSession, path: str, folder: str, *, fingerprint_secret: str, privacy_salt: str, dry_run: bool = False, approve_public: bool = False, step=lambda _: None) -> dict:
    """Checks the files at ``path`` and writes one run of outputs below ``folder``; returns its manifest, or the plan with ``dry_run``.

    The run is named by the input's digest. A finished run is read again and verified, not written again. ``step`` is told each stage.
    """
    lines, facts = input_facts(spark, path)
    for secret in (fingerprint_secret, privacy_salt):
        crypto.require_secret(secret)
    run = f"{facts['sha256'][:16]}-{'reviewed-candidates' if approve_public else 'private-only'}"
    stages = [*STAGES, *(PUBLIC_STAGES if approve_public else ()), "processing_manifest"]
    plan = {"schema_version": VERSION, "input": facts, "stages": stages, "approval": {"public_candidate_creation": approve_public, "publication": False}, "publication_performed": False}
    if dry_run:
        return plan | {"dry_run": True}
    commit = Commit(spark, folder, run)
    if (done := commit.verified()) is not None:
        if done["input"] != facts:
            raise ValueError("the finished run is of another input")
        return done | {"rerun_status": "already_complete_and_verified"}
    step("preflight")
    text = jsonl.canonical_text("value") if facts["sanitized_on_input"] else sanitised_text(F.col("value"), privacy_salt)
    # records of several files are numbered by file and line
    numbered = _in_order(lines.where(jsonl.not_blank("value")))
    clean = commit.table("sanitized_candidate", numbered.select("seq", text.alias("value")))
    step("sanitized")
    walk.require_public(clean.select(F.col("seq").alias("line_no"), "value"))
    commit.also("staged_lines", "sanitized_candidate")
    events = events_of(clean.select(F.col("seq").alias("line_no"), "value"))
    idx = commit.table("observation_index", observation_index(events, fingerprint_secret))
    step("indexed")
    as_of = datetime.fromisoformat(facts["latest_timestamp"]).astimezone(UTC) + timedelta(seconds=1)
    commit.file("private_weekly_report.md", (report.weekly_text(idx, as_of, 90) + "\n").encode())
    layer = canonical_json(report.layer(idx))
    if found := [r.message for r in walk.layer_findings(spark.createDataFrame([("layer", layer.decode())], "layer_id string, value string")).orderBy("place_no").collect()]:
        raise ValueError("; ".join(found))
    commit.file("private_navigator_layer.json", layer)
    if approve_public:
        # what isn't named in the manifest counts for no reader
        working = f"{commit.files.path}/{commit.attempt}/working"
        commit.file("aggregate_summary_candidate.json", canonical_json(report.summary(events)))
        objects = commit.table("public_graph_candidate", bundle.bundle_objects(events, stix.PUBLIC, f"{working}/bundle"))
        found = walk.bundle_findings(objects.select("number", "value"), f"{working}/bundle").orderBy("number", "place").limit(10).collect()
        if found:
            raise walk.PublicationError([r.message for r in found])
    step("exported")
    return commit.finish(plan | {"event_schema": VERSION, "data_classification": "synthetic_demo" if facts["classification"] == "synthetic" else "sanitized_observed_private", "manual_review_still_required": True})


def last_run(spark: SparkSession, folder: str) -> Commit:
    """The one finished run below ``folder``; more or fewer is an error."""
    done = [c for name in Folder(spark, folder).names() if (c := Commit(spark, folder, name)).manifest() is not None]
    if len(done) != 1:
        raise ValueError(f"there are {len(done)} finished runs")
    return done[0]


def _in_order(lines: DataFrame) -> DataFrame:
    """Adds ``seq``: lines in order of file and number, from running totals over files."""
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    return lines.join(before, "file").withColumn("seq", F.col("line_no") + F.col("before"))


def stage(spark: SparkSession, path: str, folder: str, *, approved: bool, step=lambda _: None) -> dict:
    """Appends the sanitised records at ``path`` once to the ledger table below ``folder``, and writes the input's manifest.

    Needs explicit approval; files that fail the preflight, and records that may not be published, are refused.
    """
    if not approved:
        raise ValueError("explicit approval of the local ingestion is required")
    lines, facts = input_facts(spark, path)
    walk.require_public(lines)
    content = _in_order(lines.where(jsonl.not_blank("value"))).select("seq", jsonl.canonical_text("value").alias("value"))
    ledger = Ledger(spark, folder)
    already = ledger.append_once(content, facts["sha256"], step)
    manifest = {"schema_version": VERSION, "data_classification": facts["classification"], "input_sha256": facts["sha256"], "staged_sha256": ledger.committed()[facts["sha256"]]["content"], "record_count": facts["record_count"], "sanitized": True, "local_ingestion_approved": True, "published": False}
    ledger.files.write_once(f"manifest-{facts['sha256'][:16]}.json", canonical_json(manifest))
    return manifest | {"already_staged": already}
