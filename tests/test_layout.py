"""Tables stored by key: same rows, no shuffle of them, and new copies when inputs change."""

import pytest
from pyspark.sql import functions as F

from fleetspan.queries import joins, panels
from fleetspan.queries.scan import s14b
from fleetspan.sources.fleet import Fleet
from fleetspan.sources.layout import MANIFEST, KeyedStore

SF = "/root/testdata/sf0.001"


def exchanged_scans(df):
    """Lines of the plan that scan a stored table below an exchange."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out, open_at = [], None
    for text in lines:
        depth = len(text) - len(text.lstrip(" :+-*"))
        if open_at is not None and depth <= open_at:
            open_at = None
        if "Exchange" in text and open_at is None:
            open_at = depth
        if "fleetspan_trips" in text and open_at is not None:
            out.append(text)
    assert any("fleetspan_trips" in x for x in lines)
    return out


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return Fleet(spark, SF, KeyedStore(spark, f"file://{tmp_path_factory.mktemp('store')}", 4))


@pytest.mark.parametrize("query", [joins.j05, joins.j07, panels.b02, s14b], ids=lambda q: q.__name__)
def test_stored_trips_are_not_shuffled(spark, stored, query):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = query(stored)
        assert exchanged_scans(got) == []
        assert rows(got) == rows(query(Fleet(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def make(spark, store, src, built, version="1"):
    def build():
        built.append(1)
        return spark.read.parquet(src).withColumn("twice", F.col("x") * 2)

    return store.get("t", build, "k", ["x"], [src], version)


def test_versions_follow_the_inputs(spark, tmp_path):
    src, store, built = f"file://{tmp_path}/in", KeyedStore(spark, f"file://{tmp_path}/store", 3), []
    frame = lambda n: spark.range(n).select((F.col("id") % 5).alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") % 7).alias("k"))
    frame(50).write.parquet(src)
    first = make(spark, store, src, built)
    assert first.columns == ["k", "x", "twice"] and first.count() == 50 and first.filter("k is null").count() == 8
    make(spark, store, src, built)
    assert len(built) == 1
    frame(20).write.mode("append").parquet(src)  # inputs grow
    assert make(spark, store, src, built).count() == 70 and len(built) == 2
    assert make(spark, store, src, built, "2").count() == 70 and len(built) == 3
    assert store.vacuum("t") == 2 and store.vacuum("none") == 0
    assert make(spark, store, src, built, "2").count() == 70 and len(built) == 3


def test_copies_of_lost_writers_are_ignored(spark, tmp_path):
    src, built = f"file://{tmp_path}/in", []
    store = KeyedStore(spark, f"file://{tmp_path}/store", 2)
    spark.range(9).select(F.col("id").alias("k"), F.col("id").alias("x")).write.parquet(src)
    make(spark, store, src, built)
    (version,) = (tmp_path / "store" / "t").iterdir()
    for name, text in (("0-lost", None), ("0-writing", '{"inp')):  # no manifest, half a manifest; both come first by name
        (version / name).mkdir()
        (version / name / "part-0.parquet").write_bytes(b"PAR1")
        if text:
            (version / name / MANIFEST).write_text(text)
    assert make(spark, store, src, built).count() == 9 and len(built) == 1


def test_empty_inputs_and_other_sessions(spark, tmp_path):
    src, built = f"file://{tmp_path}/in", []
    spark.createDataFrame([], "x long, k long").write.parquet(src)
    store = KeyedStore(spark, f"file://{tmp_path}/store", 2)
    assert make(spark, store, src, built).count() == 0
    for t in spark.catalog.listTables():
        if t.name.startswith("fleetspan_t_"):
            spark.sql(f"DROP TABLE {t.name}")
    assert make(spark, KeyedStore(spark, f"file://{tmp_path}/store", 2), src, built).count() == 0 and len(built) == 1
