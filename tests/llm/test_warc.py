"""WARC: an exact round trip, revisits, and an index in order."""

import gzip
import hashlib
import random

from specloom.llm import warc

BIG = "<p>" + "x" * 2000 + "é</p>"
ROWS = [(1, "http://b.example/2", BIG), (2, "http://a.example/1?q=1", BIG), (7, "https://u@WWW.a.example:80/z", BIG), (3, None, None), (4, "no url at all", ""), (5, "http://a.example/1\r\nX: y", "short"), (6, "http://a.example/1", "short"), (None, "http://n.example/", BIG), (7, "https://u@WWW.a.example:80/z", BIG), (8, "http://c.example/", "y" * 3_000_000)]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as archive").repartition(3)


def test_rows(spark):
    got = sorted((tuple(r) for r in warc.digest(warc.capture_history(pages(spark))).collect()), key=str)
    want = []
    for p, _, html in ROWS:
        data = (html or "").encode()
        same = [q for q, _, h in ROWS if (h or "") == (html or "") and q is not None]
        again = len(data) >= 1000 and p != max(same)
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert got == sorted(want, key=str)
    assert warc.capture_history(pages(spark).limit(0)).count() == 0


def test_history_is_in_order_over_many_runs(spark):
    rng = random.Random(2)
    rows = [(k, "http://hot.example/" if k % 3 == 0 else f"http://h{rng.randint(0, 50)}.example/{rng.randint(0, 9)}", f"text {k}") for k in range(3000)]
    old = warc.MERGE_ROWS
    try:
        warc.MERGE_ROWS = 400
        found = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    finally:
        warc.MERGE_ROWS = old
    keys = [(r["url_key"], r["time"], r["page_id"]) for r in found]
    assert keys == sorted(keys) and len(keys) == 3000


def test_exported_files_are_gzip_members(spark, tmp_path):
    archives = warc.write_archives(warc.plan_records(pages(spark)), archive_bytes=2000)
    assert warc.export(archives, str(tmp_path / "out")) == archives.count()
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "out").glob("*.warc.gz")))
    assert whole.count(b"WARC-Type: response") + whole.count(b"WARC-Type: revisit") == len(ROWS)


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_page_ids_near_the_limits(spark):
    ids = [(1 << 63) - 1, -(1 << 63), 1 << 40, -(1 << 40), 0]
    rows = spark.createDataFrame([(p, "http://a.example/", BIG) for p in ids], "page_id long, url string, html string")
    got = warc.capture_history(rows).collect()
    assert [r["page_id"] for r in got] == sorted(ids) and {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {max(ids)}


def test_members_take_time_in_proportion():
    import time

    def seconds(n):
        data = gzip.compress(bytes(900), 1) * n
        began = time.perf_counter()
        assert sum(1 for _ in warc.members(data)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000)


def test_a_common_page_is_spread(spark, monkeypatch):
    from specloom.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    rows = spark.createDataFrame([(k, f"http://h{k}.example/", BIG if k % 3 else f"<p>{k % 40}{'y' * 1000}</p>") for k in range(300)], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.capture_history(rows).collect()}
    keeper = {}
    for k in range(300):
        keeper["big" if k % 3 else k % 40] = k
    assert got == {k: None if keeper["big" if k % 3 else k % 40] == k else keeper["big" if k % 3 else k % 40] for k in range(300)}
