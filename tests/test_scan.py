import pytest
from pyspark.sql import functions as F

from palimpsest.functions.hashing import coordinate, murmur32, slice_hash
from palimpsest.operators import scan

NOW = 10


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("a", 1, "a1"), ("a", 2, "a2"), ("b", 3, "b1"), ("b", 4, None), ("c", 5, "c1")]
    return spark.createDataFrame(rows, "key string, time long, value string").cache()


def at(df):
    return [f"{r['key']}@{r['time']}" for r in df.orderBy("key", F.desc("time")).collect()]


@pytest.mark.parametrize("parameters, rows", [
    ({}, ["a@2", "c@5"]), ({"key": "b"}, ["c@5"]), ({"key": "c", "time": 5}, ["c@5"]), ({"end": "b"}, ["a@2"]), ({"end": "a"}, []), ({"since": 4}, ["c@5"]),
    ({"until": 4}, ["a@2"]), ({"pick": "between"}, ["a@2", "a@1", "b@4", "b@3", "c@5"]), ({"pick": "THROUGH", "since": 3}, ["a@2", "b@4", "b@3", "c@5"]),
])
def test_scan_parameters(cells, parameters, rows):
    assert at(scan.http_scan(cells, NOW, **parameters)) == rows


def test_slices_are_exact(cells, spark):
    assert [int(murmur32([coordinate(0xBE, k)])[0]) & 3 for k in (b"apple", b"grape")] == [3, 1]
    number = slice_hash(F.lit(1).cast("long"), F.col("key").cast("binary"))
    assert at(scan.http_scan(cells, NOW, index=0, count=2, slice_of=number)) == ["a@2"]
    parts = [at(scan.http_scan(cells, NOW, pick="between", index=i, count=4, slice_of=number)) for i in range(4)]
    assert sorted(x for p in parts for x in p) == sorted(at(cells))


@pytest.mark.parametrize("parameters", [{"since": 5, "until": 4}, {"pick": "newest"}, {"index": 0}, {"count": 2}, {"index": 2, "count": 2}, {"index": 0, "count": 3}])
def test_bad_requests(cells, parameters):
    with pytest.raises(ValueError):
        scan.http_scan(cells, NOW, **parameters)


def test_pages_cover_everything_once(cells):
    seen, rest = [], cells
    while True:
        rows = scan.page(rest, 2).orderBy("key", F.desc("time")).collect()
        seen += [f"{r['key']}@{r['time']}" for r in rows if not r["is_next"]]
        token = [r for r in rows if r["is_next"]]
        if not token:
            break
        rest = scan.from_start(cells, token[0]["key"], token[0]["time"])
    assert seen == at(cells)


def test_murmur_known_values():
    assert [int(x) for x in murmur32([b"", b"hello", b"hello, world"])] == [0, 0x248BFA47, 0x149BBB7F]


def test_key_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(100).selectExpr("id as key", "id * 10 as time", "cast(id as double) as value").write.parquet(path)
    plan = scan.http_scan(spark.read.parquet(path), 900, end=50, since=100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(key,50)" in plan and "GreaterThan(time,100)" in plan


@pytest.mark.parametrize("pick", ["latest", "between", "through"])
def test_start_keys_reach_the_files(spark, tmp_path, pick):
    path = str(tmp_path / "cells")
    spark.range(100).selectExpr("id as key", "id * 10 as time", "cast(id as double) as value").write.parquet(path)
    plan = scan.http_scan(spark.read.parquet(path), 900, pick=pick, key=40, time=500, since=100)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("GreaterThanOrEqual(key,40)" in line for line in scans)
