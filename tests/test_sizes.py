"""What large inputs need: names in order, keys by bucket, documents that aren't opened."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from gridlark.operators import bundle, contracts, gates, index, walk
from gridlark.plans import gates as plan_gates
from gridlark.plans import workspace
from gridlark.plans.streams import telemetry_stream
from gridlark.plans.telemetry import telemetry
from gridlark.sources.commits import AnalysisLedger, table_digest
from gridlark.sources.files import in_files
from gridlark.sources.jsonl import read_lines
from gridlark.streaming import keyed


def test_files_are_in_order_by_name(spark, tmp_path):
    lines = spark.range(25).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("value"))
    read = read_lines(spark, in_files(lines, f"file://{tmp_path}/in", "seq", 2))
    assert [int(r.value) for r in read.orderBy("file", "line_no").collect()] == list(range(25))


def test_a_bucket_holds_its_keys_apart():
    until = {}
    rows = pd.DataFrame({"key": ["a", "b", "a", "a", "a", "b"], "sensor_id": "s", "event_id": "e", "seq": range(6), "kind": ["reserve", "reserve", "reserve", "release", "reserve", "reserve"], "epoch": [0, 5, 10, 20, 30, 905]})
    out = keyed.ReplayKeys(900).fold(rows, until)
    assert list(zip(out["seq"], out["accepted"])) == [(0, True), (1, True), (2, False), (4, True), (5, True)] and until == {"a": 930, "b": 1805}
    sent = keyed.Suppression(600).fold(pd.DataFrame({"alert_key": ["a", "b", "a", "a"], "seq": range(4), "epoch": [0, 1, 599, 600]}), {})
    assert sent["sent"].tolist() == [True, True, False, True]


def test_a_stream_has_its_ranges_in_order(spark, tmp_path):
    for name in ("nation",):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id in (0, 1, 7)").write.parquet(f"file://{tmp_path}/events.parquet")
    seen = []
    stream = telemetry_stream(spark, f"file://{tmp_path}", ["seq"], batches=8)
    stream.writeStream.foreachBatch(lambda b, k: seen.append([r.seq for r in b.collect()])).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [s for s in seen if s] == [[0], [1], [7]]


def test_every_private_name_and_address_is_worth_a_walk(spark):
    names = [*gates.CREDENTIAL_NAMES, *gates.PRIVATE_NAMES, *(f"x {p}-y" for p in gates.CREDENTIAL_PARTS), "API\\nKEY", "private\\u00e9key", "Auth..Header"]
    texts = ["192.0.2.5", "at 10.0.0.1.", "2001:db8::1", "fe80:0:0:0:1:2:3:4", "1:2:3:4:5:6:192.0.2.1", "::ffff:192.0.2.1"]
    bad = [f'{{"a":[{{"{n}":1}}]}}' for n in names] + [f'{{"a":["{t}"]}}' for t in texts]
    good = ['{"type":"x","id":"x--00abedb4-aa42-466c-9c01-fed23315a9b7","created":"2024-01-05T10:00:00.000Z","kind":"private"}']
    one = spark.createDataFrame([(k, v) for k, v in enumerate(bad + good)], "line_no long, value string").withColumn("v", F.parse_json("value")).withColumn("text", F.to_json("v"))
    got = {r.line_no: (r.w, r.n) for r in walk.walked(one).select("line_no", walk.may_be_found(F.col("text")).alias("w"), F.size(walk._field_findings("entries", "")).alias("n")).collect()}
    assert all(w for w, n in got.values() if n) and not got[len(bad)][0]
    closed = walk.walked(one, worth=walk.may_be_found).where(f"line_no = {len(bad)}").first()
    assert closed.entries == []


def test_nesting_of_shallow_and_deep(spark):
    deep = lambda n: '{"a":[' * n + '"]}\\\\[{"' + "]}" * n
    docs = spark.createDataFrame([(n, deep(n)) for n in (1, 3, 4, 5, 24, 40)] + [(0, '{"a":[[],{},[{}]],"b":{}}'), (-1, '"x"')], "n int, t string")
    got = {r.n: r.d for r in docs.select("n", walk.nesting(F.col("t")).alias("d")).collect()}
    assert got == {n: 2 * n for n in (1, 3, 4, 5, 24, 40)} | {0: 4, -1: 0}


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_heavy_rows_are_dealt_to_all_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert plan_gates.lines(spark, SF).rdd.getNumPartitions() == 7
        assert telemetry(spark, SF, spread=True).rdd.getNumPartitions() == 7
        assert len(spark.read.text(plan_gates.written_lines(spark, SF)).inputFiles()) == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_keys_of_merged_observations_stay_in_a_number_of_tasks(spark):
    t = spark.createDataFrame([("a", k, 100 * k, str(k)) for k in range(5)], "fingerprint string, seq long, observed_epoch long, event_id string")
    merged = index.merged_observations(t, 1800)
    assert "REPARTITION_BY_NUM" in merged._jdf.queryExecution().executedPlan().toString()
    many = index.merged_observations(t, 1800, events=10 * index.EVENTS_OF_TASK - 1)
    assert ", 10), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once_for_its_codes_and_once_for_its_id(spark):
    rows = [(1, '{"event_id":"a"}'), (2, "{"), (3, '{"event_id":"a"}'), (4, "{"), (5, '{"event_id":""}'), (6, '{"event_id":""}')]
    found = gates.inspect_lines(spark.createDataFrame(rows, "line_no long, value string"))
    assert plan_of(found).count("parseJson") == 2
    assert [r.line_no for r in found.where(F.array_contains("codes", "duplicate_event_id")).orderBy("line_no").collect()] == [3, 6]


def test_fixtures_are_made_once(spark):
    assert all("/fixtures/" in f for f in workspace.pack_findings(spark, SF).inputFiles())


def test_results_of_a_run_are_worked_out_once(spark, tmp_path):
    name = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    rows = spark.range(3).select(*(F.col("id").cast("string").alias(c) for c in AnalysisLedger.COLUMNS[:-1]), name().alias("result"))
    ledger = AnalysisLedger(spark, f"file://{tmp_path}/ledger")
    ledger.record(rows, "b1")
    assert table_digest(ledger.results()) == ledger.results_ledger.committed()["b1"]["content"]


def test_steps_of_a_migration_are_worked_out_once(spark):
    lines = spark.createDataFrame([(1, '{"event_id":"a"}')], "line_no long, value string")
    # a field of the rules' record isn't taken from the whole record anew for each rule
    assert plan_of(contracts.migrated(lines)).count("variant_get") < 20


def test_an_event_is_prepared_once_for_all_objects(spark):
    events = telemetry(spark, SF).withColumns({"observed_at": F.timestamp_seconds("observed_epoch"), "is_demo": F.lit(True)})
    plan = plan_of(bundle.bundle_parts(events))
    # all kinds of objects are made of the written table, and the numbered ones of written objects
    assert "get_json_object" not in plan
    assert "to_json" not in plan_of(bundle.bundle_objects(events))


def test_only_unclear_objects_are_walked(spark, tmp_path):
    clean = [f'{{"type":"x","n":[{k}]}}' for k in range(50)]
    odd = ['{"type":"x","a":"10.0.0.1"}', '{"type":"x","\\u0070ayload":1}', '{"typ":1,"a":{}}', "[]", "{", '{"type":"x","a":' + "[" * 60 + "]" * 60 + "}", '{"type":"x","Api":{"KEY":1},"api key":2}', '{"type":"x","a":"\\u0031\\u0030.0.0.1"}', None]
    objects = spark.createDataFrame(list(enumerate([*odd, *clean])), "number long, value string")
    found = {(r.number, r.code) for r in walk.bundle_findings(objects, f"file://{tmp_path}/gate").collect()}
    assert found == {(0, "address_found"), (1, "forbidden_field"), (2, "not_an_object"), (3, "not_an_object"), (4, "not_an_object"), (5, "nested_too_deep"), (6, "forbidden_field"), (7, "address_found"), (8, "not_an_object")}
    assert spark.read.parquet(f"file://{tmp_path}/gate/unclear").count() == len(odd)
