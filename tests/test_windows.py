"""Every set of versions 1..4 of one key, and pairs of keys, against a direct model."""

from itertools import chain, combinations

import pytest

from palimpsest.model import exclusive, inclusive
from palimpsest.operators import windows

VERSIONS = (1, 2, 3, 4)
SETS = list(chain.from_iterable(combinations(VERSIONS, n) for n in range(5)))


@pytest.fixture(scope="module")
def cells(spark):
    """Two keys for each pair of sets: 10 * pair and 10 * pair + 1; version 2 is a tombstone."""
    rows = [(10 * p + k, t, None if t == 2 else float(t)) for p, pair in enumerate((a, b) for a in SETS for b in SETS) for k, s in enumerate(pair) for t in s]
    return spark.createDataFrame(rows, "key long, time long, value double").cache()


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append(r["time"])
    return {k: sorted(v, reverse=True) for k, v in out.items()}


def expected(keep):
    out = {}
    for p, pair in enumerate((a, b) for a in SETS for b in SETS):
        for k, s in enumerate(pair):
            if found := keep(set(s)):
                out[10 * p + k] = sorted(found, reverse=True)
    return out


def newest(s):
    return {max(s)} if s else set()


@pytest.mark.parametrize("later", [inclusive(3), exclusive(3), inclusive(None)])
@pytest.mark.parametrize("earlier", [inclusive(2), exclusive(2), inclusive(0)])
def test_latest_and_between(cells, later, earlier):
    def inside(s):
        hi = (lambda t: True) if later.value is None else (lambda t: t <= later.value if later.inclusive else t < later.value)
        return {t for t in s if hi(t) and (t >= earlier.value if earlier.inclusive else t > earlier.value)}

    assert by_key(windows.between(cells, later, earlier)) == expected(inside)
    assert by_key(windows.latest(cells, later, earlier)) == expected(lambda s: newest(inside(s)))


def test_through_and_retire(cells):
    assert by_key(windows.through(cells, inclusive(3), 2)) == expected(lambda s: {t for t in s if 2 < t <= 3} | newest({t for t in s if t <= 2}))
    assert by_key(windows.retire(cells, 3)) == expected(lambda s: {t for t in s if t >= 3} | newest({t for t in s if t < 3}))


def test_listed_rows_of_the_survey(spark):
    for present, latest, through in (((4, 3, 2, 1), [3], [3, 2]), ((4, 2, 1), [2], [2]), ((4, 1), [], [1]), ((4,), [], []), ((3, 2, 1), [3], [3, 2]), ((2,), [2], [2]), ((1,), [], [1])):
        c = spark.createDataFrame([(7, t, float(t)) for t in present], "key long, time long, value double")
        assert by_key(windows.latest(c, inclusive(3), inclusive(2))).get(7, []) == latest
        assert by_key(windows.through(c, inclusive(3), 2)).get(7, []) == through


def test_a_tombstone_hides_what_is_older(spark):
    c = spark.createDataFrame([(1, 1, 1.0), (1, 2, None)], "key long, time long, value double")
    assert windows.live(windows.latest(c, inclusive(2))).count() == 0
    assert windows.latest(windows.live(c), inclusive(2)).count() == 1


def test_windows_decompose_over_union(cells):
    def w(c):
        return windows.through(c, inclusive(3), 2)

    a, b = cells.where("time % 2 = 0"), cells.where("time % 2 = 1")
    assert by_key(w(w(a).unionByName(w(b)))) == by_key(w(cells))


def test_dedupe_takes_the_newest_tier(spark):
    c = spark.createDataFrame([(1, 5, 3.0, 0), (1, 5, 2.0, 1), (1, 5, 1.0, 2), (1, 4, 9.0, 2)], "key long, time long, value double, source_rank int")
    assert sorted((r["time"], r["value"]) for r in windows.dedupe(c, "source_rank").collect()) == [(4, 9.0), (5, 3.0)]


def test_overlap(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "first long, last long")
    def can(kind, later, earlier):
        return [r[0] for r in files.orderBy("first").select(windows.overlaps(kind, later, earlier, F.col("first"), F.col("last"))).collect()]
    assert can("latest", inclusive(3), inclusive(2)) == [True, True, True, False]
    assert can("latest", inclusive(3), exclusive(2)) == [False, True, True, False]
    assert can("between", exclusive(3), inclusive(2)) == [True, True, False, False]
    assert can("through", inclusive(3), exclusive(2)) == [True, True, True, False]


def test_latest_plan_combines_before_its_shuffle(cells):
    plan = windows.latest(cells, inclusive(3))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan
