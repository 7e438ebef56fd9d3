"""Files written once, commits of several outputs, appends that happen once, the analysis ledger."""

import json

import pytest
from pyspark.sql import functions as F

from gridlark.sources.commits import AnalysisLedger, Commit, Conflict, Folder, Ledger, table_digest


class Killed(Exception):
    pass


def killed_at(phase):
    def step(now):
        if now == phase:
            raise Killed(now)

    return step


def test_files_are_written_once(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/new folder")
    assert folder.names() == [] and not folder.exists("a/b.json")
    assert folder.write_once("a/b.json", b"\x00one") == folder.write_once("a/b.json", b"\x00one")
    with pytest.raises(Conflict):
        folder.write_once("a/b.json", b"two")
    assert folder.read("a/b.json") == b"\x00one" and folder.names("a") == ["b.json"]


def test_digest_of_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "é")], "n int, s string")
    d = table_digest(t)
    assert d == table_digest(t.repartition(3).orderBy(F.desc("n")).select("s", "n"))
    assert len({d, table_digest(t.distinct()), table_digest(t.limit(0)), table_digest(t.withColumn("s", F.lit("a"))), table_digest(t.union(t))}) == 5


@pytest.mark.parametrize("phase", ["pending", "written", "committed"])
def test_append_survives_a_crash_at_each_step(spark, tmp_path, phase):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    one = spark.range(100).withColumn("text", F.lit("x"))
    assert ledger.read() is None and ledger.append_once(one, "in-0") is False
    two = spark.range(5).withColumn("text", F.lit(None).cast("string"))
    with pytest.raises(Killed):
        ledger.append_once(two, "in-1", killed_at(phase))
    if phase != "committed":
        assert ledger.read().count() == 100
        with pytest.raises(Conflict, match="interrupted"):
            ledger.append_once(one, "in-2")
        with pytest.raises(Conflict, match="pending with other content"):
            ledger.append_once(one, "in-1")
    again = Ledger(spark, f"file://{tmp_path}/ledger")
    assert again.append_once(two, "in-1") is (phase == "committed")
    assert again.append_once(two, "in-1") is True
    assert again.read().count() == 105 and again.read(at=1).count() == 100
    with pytest.raises(Conflict, match="appended with other content"):
        again.append_once(one, "in-1")
    # data that was whole at the crash is used, not written again
    assert len(again.files.names("data/in-1")) == 1


def test_stream_appends_each_batch_once(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    schema = "n long, s string"
    spark.createDataFrame([(k, "a") for k in range(30)], schema).repartition(3).write.parquet(f"file://{tmp_path}/in")

    def run(each):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()

    sink, seen = ledger.sink(), []

    def dies_after_append(batch, batch_id):
        sink(batch, batch_id)
        seen.append(batch_id)
        if len(seen) == 2:
            raise Killed("after the append, before the stream knows")

    with pytest.raises(Exception, match="before the stream knows"):
        run(dies_after_append).awaitTermination()
    run(sink).awaitTermination()
    assert ledger.read().count() == 30 and len(ledger.committed()) == 3


def test_commit_counts_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    rows = spark.createDataFrame([(2, "b"), (1, None)], "n int, s string")

    def attempt(content, stop=None):
        run = Commit(spark, folder, "run-1")
        run.table("rows", rows)
        if stop == "rows":
            raise Killed
        run.table("lines", rows.select(F.coalesce("s", F.lit("")).alias("value")), kind="text")
        run.file("note.txt", content)
        run.also("copy", "rows")
        if stop == "file":
            raise Killed
        return run.finish({"input": "x"})

    for stop in ("rows", "file"):
        with pytest.raises(Killed):
            attempt(b"note", stop)
        assert Commit(spark, folder, "run-1").manifest() is None
    first = attempt(b"note")
    assert attempt(b"note") == first  # a rerun makes the same bytes; the first attempt's files count
    with pytest.raises(Conflict):
        attempt(b"other")
    run = Commit(spark, folder, "run-1")
    assert run.verified() == first and run.read("note.txt") == b"note" and sorted(run.read("copy").collect(), key=str) == sorted(rows.collect(), key=str)
    assert json.dumps(first, sort_keys=True).count("sha256") == 4
    for part in (tmp_path / "runs" / "run-1" / first["outputs"]["lines"]["path"]).glob("part-*"):
        part.write_text("changed\n")
    with pytest.raises(Conflict, match="lines"):
        run.verified()
    with pytest.raises(ValueError):
        Commit(spark, folder, "../x")


def test_analysis_ledger(spark, tmp_path):
    ledger = AnalysisLedger(spark, f"file://{tmp_path}/analysis")
    schema = "analysis_id string, analysis_run_id string, event_id string, input_digest string, schema_version string, versions string, executed_at string, result string, other int"
    row = lambda k, run, at, versions="{}": (f"a{k}", run, f"e{k}", "d", "v1", versions, at, "{}", 1)
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert ledger.results() is None
    assert ledger.record(make(row(1, "r1", "2024-01-02", "later"), row(2, "r1", "2024-01-01", "first")), "b1") is False
    assert ledger.record(make(row(1, "r1", "2024-01-02", "later"), row(2, "r1", "2024-01-01", "first")), "b1") is True
    with pytest.raises(Conflict, match="recorded before"):
        ledger.record(make(row(2, "r2", "2024-01-03")), "b2")
    with pytest.raises(Conflict, match="recorded before"):
        ledger.record(make(row(5, "r2", "2024-01-03"), row(5, "r2", "2024-01-03")), "b2")
    assert ledger.record(make(row(3, "r1", "2024-01-03", "ignored"), row(4, "r2", "2024-01-03")), "b3") is False
    assert {r.analysis_run_id: r.versions for r in ledger.runs().collect()} == {"r1": "first", "r2": "{}"}
    assert {r.analysis_id for r in ledger.results().collect()} == {"a1", "a2", "a3", "a4"}
    assert {r.analysis_id for r in ledger.results(at=1).collect()} == {"a1", "a2"}
