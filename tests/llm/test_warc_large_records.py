"""Records that take several reads to unpack, with others behind them in the archive."""

import gzip
import io
import random

from pyspark.sql import functions as F

from deskline.llm import warc


def test_members_of_several_reads_are_followed_by_others():
    rnd = random.Random(5)
    parts = [b"x" * (3 * warc.READ), b"short", rnd.randbytes(2 * warc.READ), b"ab" * (warc.READ + 1), b"", b"end"]
    src, got = warc._Unzipped(io.BytesIO(b"".join(map(gzip.compress, parts)))), b""
    while src.more():
        got, src.held = got + src.held, b""
    assert got == b"".join(parts)


def test_large_pages_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (60_000 if i % 3 else 200)) for i in range(12)],
                                  "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.plan_records(pages).coalesce(1), f"file://{tmp_path}/w")
    ends = {r["record_id"]: r for r in warc.read_archives(manifest).filter("last").drop("data").collect()}
    want = {f"<urn:page:{r['page_id']}>": r["d"] for r in pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("d")).collect()}
    assert {k: r["running_digest"] for k, r in ends.items()} == want


def test_many_revisits_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 1)
    pages = spark.createDataFrame([(i, "u", "y" * 2000) for i in range(4)], "page_id long, url string, html string")
    records = warc.plan_records(pages)
    assert "SortMergeJoin" in records._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["type"]) for r in records.collect()) == [(0, "revisit"), (1, "revisit"), (2, "revisit"), (3, "response")]
