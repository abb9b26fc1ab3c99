"""What a streamed table and its feed leave on the disks."""

import os

import pytest
from pyspark.sql import functions as F

from deskline.plans import q_streams
from deskline.session import scratch_dir
from deskline.sources import merge_table as M


def _path(p):
    return p.replace("file://", "", 1).replace("file:", "", 1)


@pytest.mark.parametrize("name", ["stream_units", "stream_time_entries", "stream_feed_counts"])
def test_only_the_last_version_and_no_feed_stay(spark, sf_dir, monkeypatch, name):
    made = []

    def noted(s, what):
        made.append(scratch_dir(s, what))
        return made[-1]

    monkeypatch.setattr(q_streams, "scratch_dir", noted)
    out = getattr(q_streams, name)(spark, sf_dir)
    base, = made
    table = f"{base}/table"
    assert len(M.versions(spark, table)) == 1 and not os.path.exists(_path(f"{base}/feed"))
    named = {_path(e.path) for e in M.entries(spark, table) if e.kind in ("base", "delta")}
    held = {f"{d}/{n}" for d, names, _ in os.walk(_path(table)) for n in names if n.startswith("_lo=")}
    assert held == named and out.count() > 0


def test_feeds_are_written_packed(spark, sf_dir):
    from deskline.sources.fixtures import view
    feed = f"{scratch_dir(spark, 't-packed')}/feed"
    q_streams.write_feed(view(spark, sf_dir, "time_entry_rows"), 2, feed, "hoursWorked")
    names = [n for n in os.listdir(_path(feed)) if n.startswith("part-")]
    assert len(names) == 2 and all(n.endswith(".gz") for n in names)


def test_rows_of_buckets_with_nothing_to_merge_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL_DELTA", 0)
    table = f"{scratch_dir(spark, 't-settled')}/t"
    rows = spark.range(400).select("id", F.lit(0).alias("seq"))
    M.apply_batch(spark, table, rows, ["id"], ["seq"], "s", 0, buckets=8)
    log = M.entries(spark, table)
    lo = min(e.lo for e in log if e.kind == "base")
    step = M.SLOTS // 8
    one = rows.filter((M.slot_of(["id"]) >= lo) & (M.slot_of(["id"]) < lo + step)).withColumn("seq", F.lit(1))
    monkeypatch.setattr(M, "LEAST_DELTA", 1e9)  # the delta stays beside its base
    M.apply_batch(spark, table, one, ["id"], ["seq"], "s", 1)
    got = M.read(spark, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Union") < plan.index("Window")
    assert {r["id"]: r["seq"] for r in got.collect()} == {i: 0 for i in range(400)} | {r["id"]: 1 for r in one.collect()}


def test_vacuum_takes_single_buckets(spark):
    table = f"{scratch_dir(spark, 't-single')}/t"
    M.apply_batch(spark, table, spark.range(4000).select("id", F.lit(0).alias("seq")), ["id"], ["seq"], "s", 0, buckets=8)
    for seq in (1, 2):
        M.apply_batch(spark, table, spark.range(1500).select("id", F.lit(seq).alias("seq")), ["id"], ["seq"], "s", seq)
    before = {tuple(r) for r in M.read(spark, table).collect()}
    M.vacuum(spark, table, keep=1)
    named = {_path(e.path) for e in M.entries(spark, table) if e.kind in ("base", "delta")}
    assert named == {f"{d}/{n}" for d, names, _ in os.walk(_path(table)) for n in names if n.startswith("_lo=")}
    assert {tuple(r) for r in M.read(spark, table).collect()} == before
