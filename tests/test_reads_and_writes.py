import pytest
from pyspark.sql import functions as F

from palimpsest.operators import asof, sets, stats, writes

CELL = "key long, time long, value double"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELL)


def test_reads_around_a_version(spark):
    c = cells(spark, [(1, 10, 1.0), (1, 20, 2.0), (2, 15, None)])
    ops = spark.createDataFrame([(0, 1, 9), (1, 1, 10), (2, 1, 19), (3, 1, 20), (4, 1, 21), (5, 2, 99), (6, 3, 99)], "op_index int, key long, rt long")
    got = {r["op_index"]: (r["value_time"], r["value"]) for r in asof.read_asof(ops, c).collect()}
    assert got == {0: (0, None), 1: (10, 1.0), 2: (10, 1.0), 3: (20, 2.0), 4: (20, 2.0), 5: (15, None), 6: (0, None)}
    assert asof.newest_time(asof.read_asof(ops, c)).first()["vt"] == 20


def test_read_status(spark):
    rows = spark.createDataFrame([(None, 5, 1), (1.0, 5, 4), (1.0, 5, 5), (1.0, 5, 6)], "v double, t long, c long")
    assert [r[0] for r in rows.select(asof.read_status(F.col("v"), F.col("t"), F.col("c"))).collect()] == [404, 200, 304, 304]


def ops(spark, rows):
    return spark.createDataFrame(rows, "op_index int, op string, key long, value double, ct long")


@pytest.mark.parametrize("op, ct, conflict", [
    ("create", 0, "collision"), ("create", 99, "collision"), ("hold", 9, "stale"), ("hold", 10, None), ("hold", 11, None), ("update", 9, "stale"), ("update", 10, None), ("delete", 9, "stale"), ("delete", 11, None),
])
def test_conditions(spark, op, ct, conflict):
    found = writes.conflicts(ops(spark, [(0, op, 1, 5.0, ct)]), cells(spark, [(1, 10, 1.0)])).collect()
    assert [r["conflict"] for r in found] == ([conflict] if conflict else [])


def test_create_after_a_delete_never_conflicts(spark):
    assert writes.conflicts(ops(spark, [(0, "create", 1, 5.0, 0)]), cells(spark, [(1, 10, 1.0), (1, 12, None)])).count() == 0


def test_batches_are_all_or_nothing(spark):
    c = cells(spark, [(1, 10, 1.0), (2, 30, 2.0)])
    bad = ops(spark, [(0, "update", 1, 9.0, 10), (1, "create", 2, 9.0, 0), (2, "update", 2, 9.0, 5)])
    assert writes.outcome(bad, c, 0).first().asDict() == {"status": "collision", "collisions": 1, "stale": 1, "stale_time": 30, "wt": None}
    assert writes.appended(bad, c, 0).count() == 0
    good = ops(spark, [(0, "update", 1, 9.0, 10), (1, "delete", 2, None, 30), (2, "hold", 3, None, 0), (3, "create", 4, 4.0, 0)])
    assert sorted(map(tuple, writes.appended(good, c, 7).collect())) == [(1, 31, 9.0), (2, 31, None), (4, 31, 4.0)]
    assert writes.outcome(good, c, 50).first()["wt"] == 51


def test_overlay_and_execute(spark):
    reads = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "key long, value double")
    changes = spark.createDataFrame([(3, "delete", None), (4, "create", 4.0), (1, "update", 7.0)], "key long, op string, value double")
    view = writes.overlay(reads, changes)
    assert sorted(map(tuple, view.collect())) == [(1, "updated", 7.0), (2, "not found", None), (3, "deleted", None), (4, "created", 4.0)]
    assert sorted(map(tuple, writes.executed(view).collect())) == [(1, "update", 7.0), (2, "hold", None), (3, "delete", None), (4, "create", 4.0)]


def test_batch_errors(spark):
    request = spark.createDataFrame([(0, "CREATE", "t", 1), (1, "hold", "t", 1), (2, "drop", "u", 2)], "op_index int, op string, table string, key long")
    found = {(r["error"], r["what"]) for r in writes.batch_errors(request, spark.createDataFrame([("t",)], "table string")).collect()}
    assert found == {("unknown op", "drop"), ("unknown table", "u"), ("row named twice", "t/1")}
    alone = spark.createDataFrame([(0, "hold", "t", 1)], "op_index int, op string, table string, key long")
    assert [r["error"] for r in writes.batch_errors(alone, spark.createDataFrame([("t",)], "table string")).collect()] == ["holds alone"]


def test_transfers_keep_the_total(spark):
    import random

    random.seed(5)
    balance, rows = dict.fromkeys(range(20), 1000.0), [(k, 1, 1000.0) for k in range(20)]
    for t in range(2, 120):
        a, b = random.sample(range(20), 2)
        n = float(random.randint(1, 100))
        balance[a] -= n
        balance[b] += n
        rows += [(a, t, balance[a]), (b, t, balance[b])]
    totals = {r["total"] for r in stats.history(cells(spark, rows), F.col("time")).collect()}
    assert totals == {20_000.0}


def test_chosen_tiers(spark):
    import random

    random.seed(2)
    for _ in range(6):
        sizes = [random.randint(1, 100) for _ in range(random.randint(1, 7))]
        tiers = spark.createDataFrame([(g, b) for g, b in enumerate(sizes)], "gen long, bytes long")
        total, oldest = 0, None
        for g in reversed(range(len(sizes))):
            if sizes[g] < total:
                oldest = g
            total += sizes[g]
        want = [] if oldest is None else list(range(oldest, len(sizes)))
        assert sorted(r["gen"] for r in stats.chosen_tiers(tiers).collect()) == want


def test_take_while_and_receive(spark):
    c = cells(spark, [(1, 3, 1.0), (1, 2, None), (1, 1, 1.0), (2, 1, None)])
    got = sets.take_while(c, "key", [F.desc("time")], F.col("value").isNotNull()).collect()
    assert sorted((r["key"], r["time"], r["stopped"]) for r in got) == [(1, 2, True), (1, 3, False), (2, 1, True)]
    known = cells(spark, [(1, 3, 9.0)])
    assert sorted((r["key"], r["time"], r["value"]) for r in sets.received(c, known).where("value is not null").collect()) == [(1, 1, 1.0), (1, 3, 9.0)]


def test_asof_equals_brute_force_over_buckets(spark):
    import random

    random.seed(4)
    versions = sorted({(random.choice((1, 1, 1, 2, 3)), random.randrange(400)) for _ in range(300)})
    c = cells(spark, [(k, t, None if t % 5 == 0 else float(t)) for k, t in versions])
    asked = [(i, random.choice((1, 2, 3, 4)), random.randrange(450)) for i in range(200)]
    o = spark.createDataFrame(asked, "op_index int, key long, rt long")
    want = {i: max((t for k2, t in versions if k2 == k and t <= rt), default=None) for i, k, rt in asked}
    for width in (7, 50, 10**6):
        got = {r["op_index"]: r["found"] and r["found"]["time"] for r in asof.newest_upto(o, c, ("key",), width=width).collect()}
        assert got == want
