import re

import numpy as np
import pytest
import xxhash

from palimpsest.llm import components as C
from palimpsest.llm import simhash_dedup as D


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.array([2**62 if i is None else i for i in ids])
    while True:
        new = np.where(near, label[None, :], 2**62).min(1)
        if (new == label).all():
            return [None if x == 2**62 else x for x in label.tolist()]
        label = new


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_groups_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = np.array([plain_print(t) for _, t in rows], np.uint64)
    want = sorted(zip([i for i, _ in rows], prints.view(np.int64).tolist(), plain_components(prints, [i for i, _ in rows]), strict=True), key=str)
    assert sorted(map(tuple, D.near_duplicates(docs).collect()), key=str) == want


@pytest.mark.parametrize("leaf, tile, views", [(1024, 4096, None), (16, 4096, None), (16, 4096, 0), (16, 8, 0), (16, 8, 1), (16, 4096, 2), (16, 4096, 3), (100000, 300, None)])
def test_trees_lose_no_link(spark, leaf, tile, views):
    rng = np.random.default_rng(3)
    points = set()
    for b in rng.integers(0, 2**63, 120, dtype=np.uint64):
        for _ in range(15):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(k)
            points.add(x)
    prints = np.array(sorted(points), np.uint64)
    signed = prints.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    root = {r["u"]: r["v"] for r in C.connected_components(D.fingerprint_links(df, len(prints), leaf, tile, None if views is None else D.CHOICES[views])).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = signed.copy()
    while True:
        new = np.where(near, label[None, :], 2**63 - 1).min(1)
        if (new == label).all():
            break
        label = new
    assert [root.get(int(x), int(x)) for x in signed] == label.tolist()


def test_queries_reach_every_leaf_within_the_views_radius():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    views = D.CHOICES[0]
    for view, mask in enumerate(views.masks):
        at, leaf, home = D.descend(fp, views, view, 6)
        reached = {(int(a), int(n)) for a, n in zip(at, leaf, strict=True)}
        assert home.sum() == len(fp) and views.radius == 1
        for k in (b for b in range(64) if mask >> b & 1):
            at2, other, other_home = D.descend(fp ^ np.uint64(1 << k), views, view, 6)
            for a, n in zip(at2[other_home], other[other_home], strict=True):
                assert (int(a), int(n)) in reached


def test_some_view_keeps_its_radius_for_any_link():
    rng = np.random.default_rng(6)
    for views in D.CHOICES:
        for _ in range(2000):
            changed = sum(1 << int(k) for k in rng.choice(64, D.RADIUS, replace=False))
            assert min((m & changed).bit_count() for m in views.masks) <= views.radius


def test_copies_of_a_fingerprint_grow_slowly():
    """Fewer than n to the power of 0.2 more copies from one size to the next, and a copy a view where the radius is zero."""
    def copies(n):
        depth = max(0, int(np.ceil(np.log2(n / D.LEAF_SIZE))))
        return D.views_for(depth).copies(depth)

    sizes = [10**k for k in range(6, 12)]
    assert [copies(n) for n in (10**6, 10**8, 10**9)] == [5, 15, 15] and copies(sizes[-1]) / copies(sizes[0]) < (sizes[-1] / sizes[0]) ** 0.2
    fp = np.random.default_rng(7).integers(0, 2**63, 3000, dtype=np.uint64)
    assert all(len(D.descend(fp, v, k, 10)[0]) == len(fp) for v in D.CHOICES[1:] for k in range(len(v.masks)))


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "u long, v long")
    got = {r["u"]: r["v"] for r in C.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_one_of_each_group_stays(documents, odd, nothing):
    for docs in (documents, odd):
        kept = D.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        groups = D.near_duplicates(docs)
        assert kept.count() == groups.select("component_id").distinct().count()
        assert kept.select("doc_id").subtract(groups.select("component_id")).count() == 0
    assert D.drop_near_duplicates(nothing).count() == 0 and D.near_duplicates(nothing).count() == 0


def test_no_text_is_shuffled_where_few_rows_go(documents):
    plan = D.drop_near_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
