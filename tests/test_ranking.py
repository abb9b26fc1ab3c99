"""Exact row numbers in groups: the same whatever the number of ranges, hot groups and ties included."""

import random

import pytest

from deskline.operators.devices import recommendation_prompts
from deskline.operators.ranking import dense_number


@pytest.mark.parametrize("ranges", [1, 3, 10])
def test_numbers_do_not_depend_on_ranges(spark, ranges):
    rnd = random.Random(4)
    rows = [(None if i % 3 == 0 else f"g{rnd.randint(0, 30)}", rnd.randint(0, 500), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = {r["i"]: (r["at"], r["n"]) for r in dense_number(df, ["g"], ["k", "i"], "at", size="n", ranges=ranges).collect()}
    groups = {}
    for g, k, i in rows:
        groups.setdefault(g, []).append((k, i))
    want = {i: (at, len(v)) for v in groups.values() for at, (_, i) in enumerate(sorted(v))}
    assert got == want


def test_equal_rows_are_split_over_ranges_and_numbered_once(spark):
    df = spark.createDataFrame([(1, "x")] * 3000 + [(2, "y")] * 5, "g long, k string")
    out = dense_number(df, ["g"], ["k"], "at", ranges=8).collect()
    assert sorted(r["at"] for r in out if r["g"] == 1) == list(range(3000))
    assert sorted(r["at"] for r in out if r["g"] == 2) == list(range(5))
    everything = dense_number(df, [], ["g"], "at", ranges=8).collect()
    assert sorted(r["at"] for r in everything) == list(range(3005))
    assert max(r["at"] for r in everything if r["g"] == 1) == 2999


def test_empty_table(spark):
    assert dense_number(spark.createDataFrame([], "g long, k long"), ["g"], ["k"], "at", size="n").collect() == []


def test_prompt_batches_follow_the_key_order(spark):
    rows = [("stale", f"S{i:04d}", f"D{i:04d}") for i in range(95)]
    random.Random(1).shuffle(rows)
    issues = spark.createDataFrame(rows, "issue_type string, serial_number string, device_name string")
    out = {r["batch"]: r["prompt"] for r in recommendation_prompts(issues, batch_size=10).collect()}
    assert len(out) == 10
    assert "['D0010', 'D0011'" in out[1] and "'D0019']" in out[1] and "'D0094']" in out[9]
