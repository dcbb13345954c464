"""Writers, versions that are published whole, and the plans of a stored log."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import log
from tidelog.sources import store
from tidelog.sources.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"
ROWS = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def test_versions_are_published_whole(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.latest() is None and s.read("a", ROWS).collect() == []
    assert s.publish({"a": rows(spark, ("x", 1)), "b": rows(spark, ("y", 2))}, None, "first") == 0
    assert s.publish({"a": rows(spark, ("x", 3))}, 0) == 1
    assert s.read("a", ROWS).first().v == 3 and s.read("a", ROWS, 0).first().v == 1 and s.read("b", ROWS, 0).first().v == 2
    assert s.read("b", ROWS).collect() == [] and s.marker(0)["tag"] == "first"
    with pytest.raises(store.Conflict):  # another writer was first; nothing of the loser stays
        s.publish({"a": rows(spark, ("x", 9))}, 0)
    assert s.versions() == [0, 1] and s.read("a", ROWS).first().v == 3
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")]) == 2
    s.vacuum(keep=1)
    assert s.versions() == [1] and s.read("a", ROWS).first().v == 3


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.publish({"a": rows(spark, ("x", 1))}, None)
    bad = rows(spark, ("x", 1)).select("k", F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        s.publish({"a": rows(spark, ("x", 2)), "b": bad}, 0)
    assert s.latest() == 0 and s.read("a", ROWS).first().v == 1


def test_a_stored_log_skips_scopes_and_ranges(spark, tmp_path):
    t = Tables(spark, FOLDER)
    store.write_log(t.change_log, str(tmp_path / "log"))
    stored = store.read_log(spark, str(tmp_path / "log"))
    page = log.pull_page(stored, "inst:1", 100, 499, 50)
    plan = stored._jdf.sparkSession().sessionState().executePlan(page._jdf.queryExecution().analyzed(), page._jdf.queryExecution().mode()).executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope" in plan and "(scope" in plan and "= inst:1)" in plan
    assert "GreaterThan(seq,100)" in plan and "LessThanOrEqual(seq,499)" in plan
    assert sorted(map(str, page.collect())) == sorted(map(str, log.pull_page(t.change_log, "inst:1", 100, 499, 50).collect()))
    store.write_log(t.change_log.where("seq <= 5").withColumn("seq", F.col("seq") + 100_000), str(tmp_path / "log"))
    assert store.read_log(spark, str(tmp_path / "log")).count() == t.change_log.count() + 5


def test_appended_changes_get_the_next_numbers(spark):
    df = spark.createDataFrame([(p, f"c{p}") for p in (70_000, 5, 9, 200_000)], "position long, what string").repartition(3)
    got = {r.what: r.seq for r in store.sequenced(df, 41).collect()}
    assert got == {"c5": 42, "c9": 43, "c70000": 44, "c200000": 45}


def test_insert_and_upsert(spark):
    table = rows(spark, ("a", 1), ("b", 2))
    assert sorted(map(tuple, store.insert_absent(table, rows(spark, ("b", 9), ("c", 3)), "k").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    changes = spark.createDataFrame([("a", 5, False), ("b", None, True), ("d", 4, False), ("z", None, True)], "k string, v long, deleted boolean")
    assert sorted(map(tuple, store.upsert(table, changes, "k").collect())) == [("a", 5), ("d", 4)]


def test_plans_of_the_log(spark):
    """No hinted broadcasts, no product of devices and changes, no job while planning."""
    t = Tables(spark, FOLDER)
    text = log.rows_at(t.devices, t.change_log)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in text and text.count("Join Inner") <= 2 and "Window" in text
    changes, open_ = t.change_log, t.inflight
    spent = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    log.pull_page(changes, "inst:1", 100, log.watermark(changes, open_).scalar(), 50)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(spent)


def test_running_sums_over_ranges(spark):
    """Sums over groups whose orders span many ranges equal plain ones."""
    data = [(g, i * 30_000 + len(g), i) for g in ("a", "bb") for i in range(40)]
    df = spark.createDataFrame(data, "g string, at long, v long").repartition(5)
    got = {(r.g, r["at"]): (r.total, r.n) for r in log.running(df, "g", "at", total=F.col("v"), n=F.lit(1)).collect()}
    for g in ("a", "bb"):
        total = 0
        for n, (_, at, v) in enumerate((x for x in data if x[0] == g), 1):
            total += v
            assert got[g, at] == (total, n)
