"""Queries of scans, derivations' sources, de-duplication and set operations (S, U)."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedupe
from ..sources import tables
from ..sources.fleet import Fleet
from ..sources.layout import KeyedStore
from .registry import query

CLONES = "SELECT * FROM trips UNION ALL SELECT vehicle_id+1000000 AS vehicle_id, * EXCLUDE (vehicle_id) FROM trips WHERE vehicle_id%10=0"
COLS = ["vehicle_id", "event_id", "message", "value", "level_end"]


def raw_events(fleet):
    """Events as untyped text columns, as a delivery would come."""
    e = fleet.table("events")
    return e.select(F.col("user_id").cast("string").alias("VehicleCode"), F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "event_type")


def with_clones(fleet):
    t = fleet.trips.select(*COLS)
    return t.unionByName(t.filter("vehicle_id % 10 = 0").withColumn("vehicle_id", F.col("vehicle_id") + 1_000_000))


def aliases(fleet):
    ids = fleet.trips.select("vehicle_id").distinct().filter("vehicle_id % 10 = 0")
    return ids.select((F.col("vehicle_id") + 1_000_000).alias("alias"), "vehicle_id")


def second_delivery(fleet):
    return fleet.trips.filter("event_id % 50 <> 0")


@query("s01_multi_part_scan", "SELECT c_mktsegment AS cohort, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_mktsegment IN ('MACHINERY','FURNITURE') GROUP BY 1")
def s01(f):
    c = f.table("customer")
    parts = [tables.Part(c.filter(F.col("c_mktsegment") == m), m) for m in ("MACHINERY", "FURNITURE")]
    return tables.load_table(parts).groupBy("cohort").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("s02_text_and_parquet_readers", "SELECT n_nationkey AS nation, n_name AS name, n_regionkey AS region, unnest(['csv','tsv','parquet']) AS kind FROM nation")
def s02(f):
    base = f.spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    base = f"{base}/readers-{f.spark.sparkContext.applicationId}"
    n, out = f.table("nation"), None
    for kind in ("csv", "tsv", "parquet"):
        w = n.write.mode("overwrite")
        w.parquet(f"{base}/n.parquet") if kind == "parquet" else w.option("header", True).option("sep", tables.READERS[kind]).csv(f"{base}/n.{kind}")
        x = tables.read_file(f.spark, f"{base}/n.{kind}").select(F.col("n_nationkey").cast("int").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"), F.lit(kind).alias("kind"))
        out = x if out is None else out.unionByName(x)
    return out


@query("s03_pruned_scan_with_cut", "SELECT user_id AS vehicle_id, count(*) AS n, round(sum(value),2) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def s03(f):
    x = tables.load_table([tables.Part(f.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "all")], columns=["user_id", "value"], cut=("ts", "2024-01-20"))
    return x.groupBy(F.col("user_id").alias("vehicle_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("s04_rename_to_contract", "SELECT user_id AS vehicle_id, event_type AS message, count(*) AS n FROM events GROUP BY ALL")
def s04(f):
    x = tables.load_table([tables.Part(f.table("events"), "a", rename={"user_id": "vehicle_id", "event_type": "message"})])
    return x.groupBy("vehicle_id", "message").agg(F.count("*").alias("n"))


@query("s05_part_offsets", "SELECT vehicle_id, CASE WHEN cohort='failed' THEN event_day-538 ELSE event_day END AS event_day, cohort FROM vehicles")
def s05(f):
    v = f.vehicles.select("vehicle_id", "event_day", "cohort")
    parts = [tables.Part(v.filter(F.col("cohort") == "failed").drop("cohort"), "failed", offsets={"event_day": -538}), tables.Part(v.filter(F.col("cohort") == "healthy").drop("cohort"), "healthy")]
    return tables.load_table(parts)


@query("s06_lenient_cast", "SELECT event_id, try_cast(event_type AS DOUBLE) AS bad, try_cast(CAST(value AS VARCHAR) AS DOUBLE) AS good FROM events")
def s06(f):
    x = tables.load_table([tables.Part(raw_events(f), "a")], types={"event_type": "double", "value": "double", "event_id": "bigint"})
    return x.select("event_id", F.col("event_type").alias("bad"), F.col("value").alias("good"))


@query("s07_mixed_timestamps", "SELECT event_id, CASE WHEN event_id%7=0 THEN NULL WHEN event_id%2=0 THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events")
def s07(f):
    ts = F.col("ts")
    e = f.table("events").select("event_id", F.when(F.col("event_id") % 7 == 0, "not a time").when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return tables.load_table([tables.Part(e, "a")], dates=["t"]).select("event_id", F.unix_micros("t").alias("us"))


@query("s08_extraction_cut", "SELECT vehicle_id, count(*) AS n FROM (SELECT user_id AS vehicle_id, CASE WHEN event_id%11=0 THEN NULL ELSE ts END AS t FROM events) WHERE t IS NULL OR NOT t > TIMESTAMP '2024-01-14' GROUP BY 1")
def s08(f):
    e = f.table("events").select(F.col("user_id").alias("vehicle_id"), F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp")).alias("t"))
    return tables.truncate(e, "t", "2024-01-14").groupBy("vehicle_id").agg(F.count("*").alias("n"))


@query("s09_schema_report", """SELECT * FROM (SELECT unnest(['user_id','event_type','level','ts_end']) AS "column", n AS n_rows, unnest([0.0::DOUBLE, 0.0::DOUBLE, round(l,6), NULL]) AS null_share, unnest(['ok','ok','extra','missing']) AS status
  FROM (SELECT count(*) AS n, avg(CASE WHEN event_type='view' THEN 1.0::DOUBLE ELSE 0 END) AS l FROM events))""")
def s09(f):
    e = f.table("events").select("user_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("level"))
    return tables.describe(e, ["user_id", "event_type", "ts_end"]).withColumn("null_share", F.round("null_share", 6))


@query("s10_subset_read", """SELECT vehicle_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT DISTINCT CASE WHEN c.vehicle_id>=1000000 THEN c.vehicle_id-1000000 ELSE c.vehicle_id END AS vehicle_id, event_id, message, value, level_end FROM (%s) c)
  WHERE vehicle_id IN (SELECT vehicle_id FROM vehicles WHERE cohort='failed') GROUP BY 1""" % CLONES)
def s10(f):
    x = tables.read_for_vehicles(with_clones(f), aliases(f), f.vehicles.filter("cohort = 'failed'"))
    return x.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s11_delivery_diff", "SELECT count(*) AS rows_old, count(*) FILTER (event_id%50<>0) AS rows_new, count(*)=count(*) FILTER (event_id%50<>0) AS equal, '' AS new_columns, '' AS missing_columns, 'second' AS what FROM trips UNION ALL SELECT count(*), count(*), true, '', '', 'same' FROM trips")
def s11(f):
    a, b = f.trips.select(*COLS), second_delivery(f).select(*COLS)
    return tables.delivery_diff(a, b).withColumn("what", F.lit("second")).union(tables.delivery_diff(a, a.repartition("event_id")).withColumn("what", F.lit("same")))


def _base(f):
    return f"{f.spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp()}/sinks-{f.spark.sparkContext.applicationId}"


@query("s12_panel_sink", "SELECT vehicle_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM cuts GROUP BY 1")
def s12(f):
    x = tables.write_panel(f.cuts, _base(f) + "/panel", {"window_km": "400"}, buckets=8)
    return x.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("s13_result_sinks", "SELECT vehicle_id, count(*) AS n FROM trips GROUP BY 1")
def s13(f):
    tables.write_csv(f.trips.groupBy("vehicle_id").agg(F.count("*").alias("n")), _base(f) + "/counts")
    return tables.read_file(f.spark, _base(f) + "/counts", "csv").select(F.col("vehicle_id").cast("bigint"), F.col("n").cast("bigint"))


@query("s14_materialised", "SELECT vehicle_id, max(odo_end) AS last_odo FROM trips GROUP BY 1")
def s14(f):
    m = tables.Materialised(f.spark, _base(f) + "/" + f.dir.rstrip("/").rsplit("/", 1)[-1])
    build = lambda: f.trips.groupBy("vehicle_id").agg(F.max("odo_end").alias("last_odo"))
    m.get("last", build)
    return m.get("last", build)


@query("s14b_trips_stored_by_vehicle", """SELECT t.*, source, round(event_odo,4) AS event_odo FROM (SELECT vehicle_id, count(*) AS n_trips, max(odo_end) AS last_odo, round(max(rest_s)/3600.0::DOUBLE,4) AS longest_rest_h
  FROM (SELECT *, epoch_us(t_start)/1e6::DOUBLE - lag(epoch_us(t_end)/1e6::DOUBLE) OVER (PARTITION BY vehicle_id ORDER BY t_start, event_id) AS rest_s FROM trips) GROUP BY 1) t LEFT JOIN event_odo USING (vehicle_id)""")
def s14b(f):
    """A window, a grouping and an as-of join over stored trips; nothing but the event dates is shuffled."""
    stored = Fleet(f.spark, f.dir, f.store or KeyedStore(f.spark, _base(f) + "/store", 8))
    rest = F.unix_micros("t_start") / 1e6 - F.lag(F.unix_micros("t_end") / 1e6).over(Window.partitionBy("vehicle_id").orderBy("t_start", "event_id"))
    t = stored.trips.withColumn("rest_s", rest).groupBy("vehicle_id").agg(F.count("*").alias("n_trips"), F.max("odo_end").alias("last_odo"), F.round(F.max("rest_s") / 3600, 4).alias("longest_rest_h"))
    return t.join(stored.event_odo.select("vehicle_id", "source", F.round("event_odo", 4).alias("event_odo")), "vehicle_id", "left")


@query("u01_collapse_clones", """SELECT CASE WHEN c.vehicle_id>=1000000 THEN c.vehicle_id-1000000 ELSE c.vehicle_id END AS vehicle_id, count(DISTINCT event_id) AS n, CASE WHEN max(CASE WHEN c.vehicle_id>=1000000 OR (c.vehicle_id%%3)=0 THEN 1 ELSE 0 END)=1 THEN 'failed' ELSE 'healthy' END AS cohort FROM (%s) c GROUP BY 1""" % CLONES)
def u01(f):
    x = with_clones(f).withColumn("cohort", F.when((F.col("vehicle_id") >= 1_000_000) | (F.col("vehicle_id") % 3 == 0), "failed").otherwise("healthy"))
    return dedupe.collapse_clones(x, aliases(f)).groupBy("vehicle_id").agg(F.count("*").alias("n"), F.first("cohort").alias("cohort"))


@query("u02_one_row_per_vehicle", """SELECT vehicle_id, min(event_day) AS event_day, count(DISTINCT event_day) AS n_events_recorded FROM (SELECT vehicle_id, event_day FROM vehicles UNION ALL SELECT vehicle_id, event_day-5 FROM vehicles WHERE vehicle_id%2=0 UNION ALL SELECT vehicle_id, NULL FROM vehicles) GROUP BY 1""")
def u02(f):
    v = f.vehicles.select("vehicle_id", "event_day")
    x = v.union(v.filter("vehicle_id % 2 = 0").withColumn("event_day", F.col("event_day") - 5)).union(v.withColumn("event_day", F.lit(None).cast("bigint")))
    return dedupe.one_row_per_vehicle(x).select("vehicle_id", "event_day", F.col("n_events_recorded").cast("bigint"))


@query("u03_duplicate_accounting", """SELECT n_rows, dup_raw, dup_canonical, dup_canonical-dup_raw AS dup_clones FROM (SELECT count(*) AS n_rows, CAST(count(*)-count(DISTINCT (vehicle_id, event_id)) AS BIGINT) AS dup_raw,
  CAST(count(*)-count(DISTINCT (vehicle_id%1000000, event_id)) AS BIGINT) AS dup_canonical FROM (""" + CLONES + " UNION ALL SELECT * FROM trips WHERE event_id%20=0))")
def u03(f):
    x = with_clones(f)
    return dedupe.duplicate_report(x.union(f.trips.select(*COLS).filter("event_id % 20 = 0")), aliases(f))


@query("u04_history_clones", f"SELECT vehicle_id%1000000 AS first, max(vehicle_id) AS last, count(DISTINCT vehicle_id) AS n_vehicles, CAST(count(*)//2 AS BIGINT) AS n_rows FROM ({CLONES}) GROUP BY 1 HAVING count(DISTINCT vehicle_id)>1")
def u04(f):
    return dedupe.history_clones(with_clones(f), ["event_id", "message", "value"])


@query("u05_shared_trips", f"""WITH x AS (SELECT DISTINCT vehicle_id, date_trunc('second', t_start) AS s, round(odo_end,1) AS o FROM ({CLONES})), n AS (SELECT vehicle_id, count(*) AS n FROM x GROUP BY 1)
  SELECT p.*, n_shared/least(a.n,b.n)::DOUBLE AS share FROM (SELECT a.vehicle_id AS veh_a, b.vehicle_id AS veh_b, count(*) AS n_shared FROM x a JOIN x b USING (s,o) WHERE a.vehicle_id<b.vehicle_id GROUP BY ALL) p JOIN n a ON a.vehicle_id=veh_a JOIN n b ON b.vehicle_id=veh_b WHERE n_shared/least(a.n,b.n)::DOUBLE >= 0.5""")
def u05(f):
    t = f.trips.select("vehicle_id", F.date_trunc("second", "t_start").alias("s"), F.round("odo_end", 1).alias("o"))
    x = t.union(t.filter("vehicle_id % 10 = 0").withColumn("vehicle_id", F.col("vehicle_id") + 1_000_000))
    return dedupe.shared_rows(x, ["s", "o"])


@query("u06_delivery_key_sets", "SELECT count(*) FILTER (event_id%50<>0) AS in_both, count(*) FILTER (event_id%50=0) AS only_a, CAST(0 AS BIGINT) AS only_b FROM events")
def u06(f):
    return dedupe.key_sets(f.trips, second_delivery(f), ["vehicle_id", "event_id"])


@query("u07_join_coverage", """SELECT count(*) FILTER (t.v IS NOT NULL AND v.vehicle_id IS NOT NULL) AS in_both, count(*) FILTER (v.vehicle_id IS NULL) AS only_a, count(*) FILTER (t.v IS NULL) AS only_b FROM (SELECT DISTINCT vehicle_id AS v FROM trips) t FULL JOIN vehicles v ON v.vehicle_id=t.v""")
def u07(f):
    return dedupe.key_sets(f.trips, f.vehicles, ["vehicle_id"])


@query("u09_side_transitions", """SELECT coalesce(b.side,'absent') AS before, coalesce(a.side,'absent') AS after, count(*) AS n FROM (SELECT vehicle_id, CASE WHEN vehicle_id%5=0 THEN 'test' ELSE 'dev' END AS side FROM vehicles WHERE vehicle_id%7<>0) b
  FULL JOIN (SELECT vehicle_id, CASE WHEN vehicle_id%4=0 THEN 'test' ELSE 'dev' END AS side FROM vehicles WHERE vehicle_id%9<>0) a USING (vehicle_id) GROUP BY ALL""")
def u09(f):
    side = lambda k, gone: f.vehicles.filter(F.col("vehicle_id") % gone != 0).select("vehicle_id", F.when(F.col("vehicle_id") % k == 0, "test").otherwise("dev").alias("side"))
    return dedupe.transitions(side(5, 7), side(4, 9), "vehicle_id", "side")
