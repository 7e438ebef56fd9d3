"""Queries that run a stream to its end over the events table, and their batch equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridlark.plans.registry import query
from gridlark.functions import crypto
from gridlark.plans.telemetry import TELEMETRY_SQL, raw_telemetry, telemetry
from gridlark.session import work_dir
from gridlark.streaming import fanout, keyed, state

T = TELEMETRY_SQL
SECRETS = {"sensor-01": b"synthetic-envelope-secret-000001"}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def telemetry_stream(spark: SparkSession, sf_dir: str, columns: list[str], batches: int = 4) -> DataFrame:
    """Enriched telemetry as a stream of several micro-batches in order of arrival: ranges of seq are written one after another, as a source would."""
    folder, t = f"{work_dir(spark)}/in", telemetry(spark, sf_dir).select(*columns)
    top = (t.agg(F.max("seq")).first()[0] or 0) + 1
    batches = max(batches, -(-top >> 20))  # a file of a million at most
    # one pass over the table, by all tasks; then a range after another is copied
    batch = F.expr(f"(seq * {batches} + {batches - 1}) div {top}")
    t.withColumn("batch", F.least(batch, F.lit(batches - 1))).repartition(batches, "batch").write.partitionBy("batch").parquet(f"{folder}-ranges")
    ranges = spark.read.schema(StructType([*t.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}-ranges")
    for k in range(batches):
        ranges.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream: DataFrame, mode: str = "append", keyed_state: bool = False) -> DataFrame:
    """Runs the stream over all that is there and reads what it wrote; sinks and checkpoints are in the shared folder."""
    if keyed_state and stream.sparkSession.conf.get(keyed.PROVIDER, None) != keyed.ROCKS:
        stream.sparkSession.conf.set(keyed.PROVIDER, keyed.ROCKS)  # keyed processors need it; other streams take it too
    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        # a repeated batch overwrites its own folder: the sink stays exact
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("ordinal_stream", T + "SELECT event_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS ordinal FROM tel WHERE seq % 2 = 1 OR seq < 1000 QUALIFY seq >= 1000")
def ordinal_stream(spark, sf_dir):
    """Ordinals of a source's odd events over micro-batches; what came before the stream is its first state."""
    known = telemetry(spark, sf_dir).where("seq < 1000").groupBy("source_id").agg(F.count("*").alias("n"))
    out = keyed.ordinals(telemetry_stream(spark, sf_dir, ["source_id", "event_id", "seq"]).where("seq >= 1000 and seq % 2 = 1"), "source_id", known)
    return drained(out, keyed_state=True).select("event_id", "ordinal")


@query("novelty_stream", T + "SELECT event_id, row_number() OVER (PARTITION BY protocol, operation, source_id ORDER BY seq) = 1 AS novel FROM tel")
def novelty_stream(spark, sf_dir):
    """The first event of each source and operation, over micro-batches."""
    t = telemetry_stream(spark, sf_dir, ["event_id", "seq", "protocol", "operation", "source_id"])
    out = keyed.ordinals(t.withColumn("thing", F.concat_ws("|", "protocol", "operation", "source_id")), "thing")
    return drained(out, keyed_state=True).select("event_id", (F.col("ordinal") == 1).alias("novel"))


@query("reservation_stream", (T + """, r AS (SELECT 'sensor-' || k % 5 AS sensor_id, 'evt-' || (seq // 6) AS event_id, seq, observed_epoch AS epoch, CASE WHEN seq % 6 = 3 THEN 'release' ELSE 'reserve' END AS kind FROM tel),
n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, event_id ORDER BY seq) AS i FROM r),
f AS (SELECT *, CASE WHEN kind = 'reserve' THEN epoch + 900 END AS until, true AS accepted FROM n WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN n.kind = 'release' THEN NULL WHEN f.until IS NULL OR f.until <= n.epoch THEN n.epoch + 900 ELSE f.until END, f.until IS NULL OR f.until <= n.epoch FROM f JOIN n ON n.sensor_id = f.sensor_id AND n.event_id = f.event_id AND n.i = f.i + 1)
SELECT sensor_id, event_id, seq, accepted FROM f WHERE kind = 'reserve'""").replace("WITH raw0", "WITH RECURSIVE raw0"))
def reservation_stream(spark, sf_dir):
    """Replay keys are reserved, released and reserved again, over micro-batches."""
    t = telemetry_stream(spark, sf_dir, ["seq", "k", "observed_epoch"])
    r = t.select(F.concat(F.lit("sensor-"), (F.col("k") % 5).cast("string")).alias("sensor_id"), F.concat(F.lit("evt-"), F.floor(F.col("seq") / 6).cast("string")).alias("event_id"), "seq", F.when(F.col("seq") % 6 == 3, "release").otherwise("reserve").alias("kind"), F.col("observed_epoch").alias("epoch"), F.timestamp_seconds("observed_epoch").alias("at"))
    return drained(keyed.reservations(r), keyed_state=True).select("sensor_id", "event_id", "seq", "accepted")


@query("fanout_health", T + """SELECT count(*) AS total_events, (SELECT '{' || string_agg('"' || protocol || '":' || n, ',' ORDER BY protocol) || '}' FROM (SELECT protocol, count(*) AS n FROM raw GROUP BY 1)) AS protocol_events, count(*) FILTER (event_type = 'connection') AS connections, 1::bigint AS delivery_failures, '{"alerts": 0, "connections": 0}' AS behind FROM raw""")
def fanout_health(spark, sf_dir):
    """A stream fans out to evidence, alerts and connections; the connection sink fails once and catches up; health is counted once."""
    failed = []

    def connections(rows):
        if not failed:
            failed.append(True)
            raise OSError("the first try fails")
        return rows.where("event_type = 'connection'").select("event_id")

    t = telemetry_stream(spark, sf_dir, ["event_id", "seq", "event_type", "protocol", "observed_at", "severity", "session_id", "technique_ids", "source_ip"])
    folder = work_dir(spark)
    fan = fanout.FanOut(spark, folder, {"alerts": lambda rows: state.alert_payloads(rows, SECRETS["sensor-01"]), "connections": connections})
    # a micro-batch is one file here: its rows are dealt to all tasks
    t.repartition(spark.sparkContext.defaultParallelism).writeStream.foreachBatch(fan.each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    n = fan.sinks["connections"][0].read().agg(F.count("*").alias("connections"))
    return fan.health().join(F.broadcast(n)).select("total_events", "protocol_events", "connections", "delivery_failures", "behind")


@query("alert_payloads", T + f"""SELECT event_id, severity, protocol, array_to_string(technique_ids, ',') AS ids, substr(sha256(unhex('{crypto.hmac_pads(SECRETS["sensor-01"])[1]}') || unhex(sha256(unhex('{crypto.hmac_pads(SECRETS["sensor-01"])[0]}') || encode(source_ip)))), 1, 24) AS source_hash FROM tel WHERE severity = 'high'""")
def alert_payloads(spark, sf_dir):
    """What leaves of an alert: no address, no session, a keyed hash of the source."""
    p = state.alert_payloads(telemetry(spark, sf_dir), SECRETS["sensor-01"])
    get = lambda path: F.get_json_object("payload", path)
    ids = F.array_join(F.from_json(get("$.technique_ids"), "array<string>"), ",")
    return p.select("event_id", get("$.severity").alias("severity"), get("$.protocol").alias("protocol"), ids.alias("ids"), get("$.source_hash").alias("source_hash"))


@query("replay_dedup_stream", "SELECT sensor_id, event_id FROM (SELECT DISTINCT 'sensor-' || user_id AS sensor_id, 'evt-' || event_id // 2 AS event_id FROM events)")
def replay_dedup_stream(spark, sf_dir):
    """Every event id comes from its sensor twice at most, close together; one stays."""
    e = event_stream(spark, sf_dir)
    e = e.select(F.concat(F.lit("sensor-"), F.col("user_id").cast("string")).alias("sensor_id"), F.concat(F.lit("evt-"), F.floor(F.col("event_id") / 2).cast("string")).alias("event_id"), F.col("ts").cast("timestamp").alias("received_at"))
    return drained(state.without_replays(e)).select("sensor_id", "event_id")


@query("session_dedup_stream", "WITH g AS (SELECT user_id % 20 AS s, event_type, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id % 20, event_type ORDER BY ts) AS gap FROM events), i AS (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY s, event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS island FROM g), w AS (SELECT s || '-' || event_type AS fingerprint, min(ts) AS a, max(ts) AS b, count(*) AS repeat_count FROM i GROUP BY s, event_type, island) SELECT fingerprint, CAST(floor(epoch(a)) AS bigint) AS first_seen, CAST(floor(epoch(b)) AS bigint) AS last_seen, repeat_count FROM w WHERE epoch(b) + 1800 <= (SELECT max(epoch(ts)) FROM events) - 3600")
def session_dedup_stream(spark, sf_dir):
    """Session windows of a stream that the watermark has closed; state of closed windows goes."""
    e = event_stream(spark, sf_dir).select(F.concat((F.col("user_id") % 20).cast("string"), F.lit("-"), F.col("event_type")).alias("fingerprint"), F.col("ts").cast("timestamp").alias("observed_at"))
    out = drained(state.merged_sessions(e))
    return out.select("fingerprint", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "repeat_count")


_SUPPRESSED = (
    (T + """, a AS (SELECT session_id || '|' || array_to_string(technique_ids, ',') AS alert_key, seq, observed_epoch AS epoch FROM tel WHERE severity = 'high'),
n AS (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY seq) AS i FROM a),
f AS (SELECT alert_key, seq, epoch, i, epoch AS accepted, true AS sent FROM n WHERE i = 1
  UNION ALL SELECT n.alert_key, n.seq, n.epoch, n.i, CASE WHEN n.epoch - f.accepted >= 600 THEN n.epoch ELSE f.accepted END, n.epoch - f.accepted >= 600 FROM f JOIN n ON n.alert_key = f.alert_key AND n.i = f.i + 1)
SELECT alert_key, seq, epoch, sent FROM f""").replace("WITH raw0", "WITH RECURSIVE raw0")
)


@query("suppression_stream", _SUPPRESSED)
def suppression_stream(spark, sf_dir):
    """The same alerts over micro-batches, with the time last sent as keyed state that timers clear."""
    t = telemetry_stream(spark, sf_dir, ["seq", "severity", "session_id", "technique_ids", "observed_epoch"]).where("severity = 'high'")
    alerts = t.select(F.concat_ws("|", "session_id", F.array_join("technique_ids", ",")).alias("alert_key"), "seq", F.col("observed_epoch").alias("epoch"), F.timestamp_seconds("observed_epoch").alias("at"))
    return drained(keyed.suppressed(alerts), keyed_state=True).select("alert_key", "seq", "epoch", "sent")


@query("alert_suppression", _SUPPRESSED)
def alert_suppression(spark, sf_dir):
    """High-severity alerts by session and techniques; accepted ones silence their key for 600 s."""
    t = telemetry(spark, sf_dir).where("severity = 'high'")
    return state.suppressed_alerts(t.select(F.concat_ws("|", "session_id", F.array_join("technique_ids", ",")).alias("alert_key"), "seq", F.col("observed_epoch").alias("epoch")))


@query("envelope_verification", T + "SELECT event_id, CASE WHEN k % 7 = 0 THEN 'unknown_sensor' WHEN k % 7 = 1 THEN 'invalid_timestamp' WHEN k % 7 = 2 THEN 'timestamp_out_of_range' WHEN k % 7 = 3 THEN 'invalid_signature' WHEN k % 7 = 4 THEN 'unsupported_schema' END AS reject_reason FROM raw")
def envelope_verification(spark, sf_dir):
    from gridlark.functions import crypto

    k = F.col("k") % 7
    t = raw_telemetry(spark, sf_dir)
    body = F.to_json(F.struct(F.struct("event_id", "session_id", "protocol", "event_type", F.col("observed_epoch").cast("string").alias("observed_at")).alias("event"), F.when(k == 4, "old").otherwise("envelope-1").alias("schema"), F.when(k == 0, "sensor-99").otherwise("sensor-01").alias("sensor_id")))
    t = t.select("event_id", "k", F.when(k == 0, "sensor-99").otherwise("sensor-01").alias("sensor_id"), F.when(k == 1, "soon").when(k == 2, "5000").otherwise("10000").alias("timestamp"), body.alias("body"))
    stamped = F.concat(F.encode("timestamp", "UTF-8"), F.encode(F.lit("\n"), "UTF-8"), F.encode("body", "UTF-8"))
    t = t.withColumn("signature", F.when(k == 3, "00").otherwise(crypto.hmac_sha256(stamped, SECRETS["sensor-01"])))
    return t.select("event_id", state.envelope_verdict(SECRETS, F.lit(10_100)).alias("reject_reason"))


@query("register_updates")
def register_updates(spark, sf_dir):
    """Ordered writes to simulated registers, by source. Order-dependent state: tests hold it against a fold."""
    t = raw_telemetry(spark, sf_dir).where("protocol = 'modbus' and operation like 'write%'")
    return state.register_updates(t.select(F.col("source_id").alias("sensor_id"), "seq", (F.col("k") * 2).cast("int").alias("address"), (F.col("seq") % 70000).cast("int").alias("value")))
