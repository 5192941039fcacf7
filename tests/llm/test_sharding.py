import zlib

from pyspark.sql import functions as F

from palimpsest.llm import sharding as S


def placed(spark, root, n=4000):
    return {r[0]: r[1] for r in spark.range(n).select("id", S.descend(F.col("id"), root)).collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    root = S.cluster()
    for _ in range(3):
        more = S.grow(root)
        before, after = placed(spark, root), placed(spark, more)
        new = max(x.shard for x in S.leaves(more))
        moved = {k for k in before if before[k] != after[k]}
        assert moved and {after[k] for k in moved} == {new}
        root = more


def test_a_weight_moves_rows_only_in_or_out_of_its_subtrees(spark):
    root = S.cluster()
    heavy = S.reweigh(root, 5, 3.0)
    before, after = placed(spark, root), placed(spark, heavy)
    for k in before:
        if before[k] != after[k]:
            if before[k] // 4 != after[k] // 4:  # between regions: into the changed one
                assert after[k] // 4 == 1
            elif before[k] // 2 != after[k] // 2:  # between its racks: into the changed rack
                assert after[k] // 2 == 2
            else:
                assert after[k] == 5


def test_shards_follow_weights(spark):
    root = S.reweigh(S.cluster(), 0, 3.0)
    got = placed(spark, root, 20000)
    share = sum(s == 0 for s in got.values()) / len(got)
    assert abs(share - 0.3) < 0.02


def test_contract(spark, odd, nothing, documents):
    for docs in (odd, documents):
        rows = S.shard_documents(docs).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for (t,) in docs.select("text").collect())
        assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert S.shard_documents(nothing).count() == 0
