import pytest

from palimpsest.model import inclusive
from palimpsest.operators import windows
from palimpsest.plans import tables
from palimpsest.sources import log
from palimpsest.sources.cells import CellSource
from palimpsest.streaming import feeds


@pytest.fixture(scope="module")
def path(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("log") / "cells")
    log.append(tables.cells(spark, sf_dir), out)
    spark.dataSource.register(CellSource)
    return out


def rows(df):
    return sorted(map(tuple, df.select("key", "time", "value").collect()), key=str)


def test_slices_are_disjoint_and_complete(spark, sf_dir, path):
    one = rows(tables.cells(spark, sf_dir))
    for n in (1, 4, 8):
        df = spark.read.format("cells").option("path", path).option("nslices", n).load()
        assert rows(df) == one and df.rdd.getNumPartitions() == n


def test_bad_slices(spark, path):
    with pytest.raises(Exception, match="power of two"):
        spark.read.format("cells").option("path", path).option("nslices", 3).load().count()


def test_days_outside_the_window_are_not_read(spark, path):
    df = log.read(spark, path, tables.EARLIER, tables.LATER)
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df) == rows(windows.between(log.read(spark, path), inclusive(tables.LATER), windows.exclusive(tables.EARLIER)))


def test_appends_in_two_batches_are_read_as_one(spark, sf_dir, tmp_path):
    c, out = tables.cells(spark, sf_dir), str(tmp_path / "twice")
    log.append(c.where("key % 2 = 0"), out)
    log.append(c.where("key % 2 = 1"), out, by_key=4)
    assert rows(log.read(spark, out)) == rows(c)


def test_a_stream_of_the_source_ends_with_the_latest(spark, sf_dir, path, tmp_path):
    stream = spark.readStream.format("cells").option("path", path).option("nslices", 2).load()
    feeds.write_latest(stream, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "rows"))) == rows(windows.newest(tables.cells(spark, sf_dir)))


def test_running_latest_over_two_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, 5, 1.0), (1, 7, None), (2, 1, 2.0)], "key long, time long, value double").write.mode("append").parquet(source)

    def run():
        stream = feeds.running_latest(spark.readStream.schema("key long, time long, value double").parquet(source))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sorted(out, key=str) == [(1, 7, None), (2, 1, 2.0)]
    out.clear()
    spark.createDataFrame([(1, 6, 9.0), (2, 3, 3.0)], "key long, time long, value double").write.mode("append").parquet(source)
    run()
    assert out == [(2, 3, 3.0)]


def test_batches_split_the_log(spark, sf_dir):
    c = tables.cells(spark, sf_dir)
    every = feeds.batches_of(c, tables.START, 7 * tables.DAY, pick="between", tombstones=True)
    assert every.count() == c.count()
    last = feeds.batches_of(c, tables.START, 7 * tables.DAY, tombstones=True)
    assert last.groupBy("batch", "key").count().where("count > 1").count() == 0


def test_compaction_keeps_reads_from_the_limit_on(spark, path, tmp_path):
    out = str(tmp_path / "compacted")
    log.compact(spark, path, out, tables.EARLIER)
    for rt in (tables.EARLIER, tables.LATER):
        assert rows(windows.latest(log.read(spark, out), inclusive(rt))) == rows(windows.latest(log.read(spark, path), inclusive(rt)))


def test_json_keeps_tombstones(spark):
    c = spark.createDataFrame([(1, 2, None)], "key long, time long, value double")
    assert log.json_lines(c).first()["json"] == '{"key":1,"time":2,"value":null}'
