"""Streams in several batches against the batch operators."""

from pyspark.sql import functions as F

from fleetspan.operators import metrics
from fleetspan.streaming import alerts

from .test_fleet import scores


def test_alerts_carry_state_over_batches(spark, tmp_path):
    s = scores(spark).filter("vehicle_id > 5")
    src = f"file://{tmp_path}/scores"
    schema = s.select("vehicle_id", "cut_odo", "score", "time_to_event_km").schema
    want = sorted((r["vehicle_id"], r["alert_odo"]) for r in metrics.first_alerts(s, 0.4, 2).collect())
    for lo, hi in ((0, 3), (3, 7), (7, 99)):  # a batch a range of cuts
        s.filter((F.col("cut_odo") >= lo) & (F.col("cut_odo") < hi)).select(*schema.names).coalesce(1).write.mode("append").parquet(src)
        out = alerts.run_to_end(alerts.first_alerts(spark.readStream.schema(schema).parquet(src), 0.4, 2), f"file://{tmp_path}/out")
    assert sorted((r["vehicle_id"], r["alert_odo"]) for r in out.collect()) == want


def late_run(spark, tmp_path, deliveries, tau, k, late):
    src, schema = f"file://{tmp_path}/late", "vehicle_id long, cut_odo double, score double, time_to_event_km double, scored_at timestamp"
    for rows in deliveries:
        x = rows if not isinstance(rows, list) else spark.createDataFrame(rows, schema.replace("scored_at timestamp", "day double")).select("vehicle_id", "cut_odo", "score", "time_to_event_km", F.timestamp_micros((F.col("day") * 86_400_000_000).cast("long")).alias("scored_at"))
        x.coalesce(1).write.mode("append").parquet(src)
        out = alerts.run_to_end(alerts.ordered_alerts(spark.readStream.schema(schema).parquet(src), tau, k, late), f"file://{tmp_path}/alerts")
    return sorted(tuple(r) for r in out.collect())


def test_late_and_repeated_cuts_give_the_alerts_of_the_batch(spark, tmp_path):
    s = scores(spark).filter("vehicle_id > 5").select("vehicle_id", "cut_odo", "score", "time_to_event_km")
    s = s.withColumn("scored_at", F.timestamp_micros(((F.col("cut_odo") + 24) * 3_600_000_000).cast("long")))  # an hour a km; at 0, the first watermark, a row would be late
    arrived = F.col("cut_odo") + F.pmod(F.xxhash64("vehicle_id", "cut_odo"), F.lit(4))
    parts = [(arrived >= lo) & (arrived < hi) for lo, hi in ((0, 4), (4, 8), (8, 999))]
    deliveries = [s.filter(parts[0]), s.filter(parts[1] | (parts[0] & (F.col("cut_odo") % 3 == 0))), s.filter(parts[2])]
    got = late_run(spark, tmp_path, deliveries, 0.4, 2, "4 hours")
    last = s.agg(F.max("scored_at")).first()[0]
    want = metrics.first_alerts(s.filter(F.col("scored_at") <= F.lit(last) - F.expr("interval 4 hours")).withColumn("label", F.lit(0)), 0.4, 2)
    assert got and [(r[0], r[1]) for r in got] == sorted((r["vehicle_id"], r["alert_odo"]) for r in want.collect())


def test_cuts_wait_for_those_before_them(spark, tmp_path):
    end = (99, 1.0, 0.0, None)
    first = [(1, 3.0, 0.9, 7.0, 3.0), (1, 1.0, 0.9, 9.0, 1.0), (2, 1.0, 0.9, None, 1.0), (2, 3.0, 0.9, None, 3.0), (3, 1.0, 0.9, 5.0, 1.0), (3, 2.0, None, 4.0, 2.0), (3, 3.0, 0.9, 3.0, 3.0), (4, 1.0, 0.2, 1.0, 1.0), (4, 1.0, 0.9, 1.5, 1.5), (4, 2.0, 0.9, 1.0, 2.0), (None, 1.0, 0.9, 1.0, 1.0), (5, None, 0.9, 1.0, 1.0), (5, 1.0, 0.9, 1.0, None)]
    second = [(1, 2.0, 0.1, 8.0, 2.0), (2, 2.0, 0.9, 8.0, 2.0), (1, 4.0, 0.9, 6.0, 4.0), (*end, 20.0)]
    third = [(1, 5.0, 0.9, 5.0, 5.0), (3, 4.0, 0.9, 2.0, 30.0), (3, 2.5, 0.9, 2.5, 30.0), (2, 9.0, 0.9, 1.0, 30.0), (2, 10.0, 0.9, 1.0, 31.0), (*end, 60.0)]
    got = late_run(spark, tmp_path, [first, second, third], 0.5, 2, "10 days")
    # 1: the low cut of the second delivery breaks the pair 1-3, so 3-4 alerts, once; 2: the cut that came last joins 1 and 3; 3: the null breaks the run, and 2.5 comes after 3 was passed;
    # 4: of repeats the later one counts
    assert got == [(1, 3.0, 7.0), (2, 1.0, None), (3, 3.0, 3.0), (4, 1.0, 1.5)]


def test_daily_activity_waits_for_the_watermark(spark, tmp_path):
    t = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5.0), (2, "2024-01-01 23:00:00", 1.0), (1, "2024-01-05 01:00:00", 2.0)], "vehicle_id long, t string, trip_km double").select("vehicle_id", F.col("t").cast("timestamp").alias("t_start"), "trip_km")
    t.coalesce(1).write.parquet(f"file://{tmp_path}/trips")
    out = alerts.run_to_end(alerts.daily_activity(spark.readStream.schema(t.schema).parquet(f"file://{tmp_path}/trips")), f"file://{tmp_path}/days")
    assert [(str(r["day"]), r["n_trips"], r["km"]) for r in out.collect()] == [("2024-01-01", 2, 6.0)]
