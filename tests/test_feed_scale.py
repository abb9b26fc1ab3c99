"""Feeds and streamed tables at size: one parse a record, keys of large deltas not broadcast, files side by side."""

from pyspark.sql import functions as F

from deskline.plans import q_streams
from deskline.session import scratch_dir
from deskline.sources import feeds, merge_table
from deskline.sources.schemas import CONTRACT_UNIT_FEED


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _parsed(spark, lines):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, _feed_line long")
    df = df.withColumn("_feed_time", F.lit(None).cast("timestamp")).withColumn("_feed_file", F.lit("f")).withColumn("_feed_block", F.lit(0).cast("long"))
    return feeds.parse_feed(df, CONTRACT_UNIT_FEED, feeds.has_id()), feeds.feed_outcomes(df, CONTRACT_UNIT_FEED, feeds.has_id())


def test_a_record_is_parsed_once(spark):
    feed, outcomes = _parsed(spark, ['{"id":1}'])
    for df in (*feed, outcomes):
        assert _plan(df).count("from_json") == 1


def test_the_short_check_rejects_what_the_full_one_does(spark):
    good = ['{"id":1}', ' {"id":2}\t', '{"id":3,"invoiceDescription":"a}b"}', '{"id":4,"more":[1]}', '{"id":5,"invoiceDescription":"it\'s NaN"}']
    half = ['{"id":1} x', '{"id":1},{"id":2}', '{"id":1},"w":{"id":2}', '{"id":1,"units":NaN}', '{"id":1,"units":"abc"}', '{"id":1}}']
    none = ['[{"id":1}]', "7", '{"id":"x"}', "{}", "null"]
    feed, outcomes = _parsed(spark, [*good, "", *half, *none])
    assert sorted(r["id"] for r in feed.rows.collect()) == [1, 2, 3, 4, 5]
    told = {r["record"]: ",".join(r["failed_rules"]) for r in feed.rejects.collect()}
    assert set(told) == {*half, *none} and all(told[r] == "parsed" for r in half)
    by = {r["outcome"]: r["rows"] for r in outcomes.collect()}
    assert by.pop("") == len(good) and sum(by.values()) == len(half) + len(none) and by["parsed"] == len(half)
    assert {r["valid"]: r["rows"] for r in feed.counts.collect()} == {True: len(good), False: len(half) + len(none)}


def test_keys_of_large_deltas_are_not_broadcast(spark, monkeypatch):
    table = f"{scratch_dir(spark, 't-large-delta')}/t"
    for seq, (lo, hi) in enumerate([(0, 300), (200, 500), (450, 460)]):
        rows = spark.range(lo, hi).select("id", F.lit(seq).alias("seq"))
        merge_table.apply_batch(spark, table, rows, ["id"], ["seq"], "s", seq, buckets=2)
    log = merge_table.entries(spark, table)
    assert {e.kind for e in log} >= {"base", "delta"}
    wanted = {i: 2 if 450 <= i < 460 else 1 if i >= 200 else 0 for i in range(500)}
    assert dict(map(tuple, merge_table.read(spark, table).collect())) == wanted
    monkeypatch.setattr(merge_table, "SMALL_DELTA", 0)
    merged = merge_table.read(spark, table)
    assert "Join" not in _plan(merged)
    assert dict(map(tuple, merged.collect())) == wanted


def test_a_part_of_a_feed_is_written_by_many_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(q_streams, "FILE_ROWS", 300)
    from deskline.sources.fixtures import ARRIVAL_COLS, view
    rows = view(spark, sf_dir, "contract_unit_rows")
    parts = q_streams.feed_parts(rows)
    assert len(parts) == 4 and sum(p.count() for p, _ in parts) == rows.count()
    last = [p.agg(F.min(ARRIVAL_COLS[0]), F.max(ARRIVAL_COLS[0])).first() for p, _ in parts]
    assert all(a[1] < b[0] for a, b in zip(last, last[1:]))
    feed = f"{scratch_dir(spark, 't-feed')}/feed"
    q_streams.write_feed(parts[0][0], 5, feed, "units")
    lines = spark.read.text(feed).select(F.get_json_object("value", "$.id").alias("id"), F.col("_metadata.file_path").alias("f"))
    lines = lines.filter("id IS NOT NULL")
    assert lines.select("f").distinct().count() == 5
    assert lines.groupBy("id").agg(F.count_distinct("f").alias("n")).filter("n > 1").isEmpty()
