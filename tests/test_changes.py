"""The stream of listings over restarts, with rewritten, removed and returning files."""

import os

from fotolake.sources import files as FS
from fotolake.streaming import changes as CH


def test_listings_of_a_folder(spark, tmp_path):
    src, work = tmp_path / "in", str(tmp_path / "work")
    src.mkdir()

    def scan(n, **files):
        for old in os.listdir(src):
            if old.partition(".")[0] not in files:
                os.remove(src / old)
        for name, (data, at) in files.items():
            (src / f"{name}.png").write_bytes(data)
            os.utime(src / f"{name}.png", (at, at))
        CH.append_listing(FS.scan_files(spark, str(src)), work + "/listings", n)

    def run():
        CH.track(CH.listings(spark, work + "/listings"), work + "/events", work + "/state", 2).awaitTermination()
        rows = spark.read.schema(CH.EVENTS).parquet(work + "/events").collect()
        return sorted((r.scan, os.path.basename(r.path)[0], r.change, r.length) for r in rows)

    scan(1, a=(b"1", 100), b=(b"22", 100), c=(b"3", 100))
    first = [(1, "a", "new", 1), (1, "b", "new", 2), (1, "c", "new", 1)]
    assert run() == first
    scan(2, a=(b"1", 200), b=(b"22", 100))  # a rewritten, c removed
    second = first + [(2, "a", "changed", 1), (2, "c", "gone", 1)]
    assert run() == sorted(second)
    scan(3, a=(b"1", 200), c=(b"333", 300))  # c again, b removed
    scan(4, a=(b"1", 200), c=(b"333", 300))
    assert run() == sorted(second + [(3, "b", "gone", 2), (3, "c", "new", 3)])
    assert run() == sorted(second + [(3, "b", "gone", 2), (3, "c", "new", 3)])


def test_digests_repeats_and_missing_values(spark, tmp_path):
    work = str(tmp_path)
    one = spark.createDataFrame([("p", 1, None, "x"), ("p", 1, None, "x"), (None, 1, None, "x"), ("q", None, None, None)], "path string, length long, mtime timestamp, digest string")
    CH.append_listing(one, work + "/listings", 1)
    CH.append_listing(one.replace("x", "y", "digest"), work + "/listings", 2)
    CH.track(CH.listings(spark, work + "/listings"), work + "/events", work + "/state", 2).awaitTermination()
    rows = spark.read.schema(CH.EVENTS).parquet(work + "/events").collect()
    assert sorted((r.scan, r.path, r.change) for r in rows) == [(1, "p", "new"), (1, "q", "new"), (2, "p", "changed")]


def test_states_do_not_grow_with_paths(spark, tmp_path, monkeypatch):
    """Many paths share a state; those of a bucket that other paths keep busy are found gone all the same."""
    monkeypatch.setattr(CH, "BUCKETS", 3)
    work = str(tmp_path)
    listing = lambda at: spark.range(200).filter(f"id % 5 <> {at}").selectExpr("'p' || id AS path", "1L AS length", "timestamp'2024-01-01' AS mtime")
    for scan in (1, 2, 3):
        CH.append_listing(listing(scan).coalesce(1), work + "/listings", scan)
    query = CH.track(CH.listings(spark, work + "/listings", 1), work + "/events", work + "/state", 2)
    query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 3
    rows = spark.read.schema(CH.EVENTS).parquet(work + "/events").groupBy("scan", "change").count().collect()
    assert sorted(map(tuple, rows)) == [(1, "new", 160), (2, "gone", 40), (2, "new", 40), (3, "gone", 40), (3, "new", 40)]
