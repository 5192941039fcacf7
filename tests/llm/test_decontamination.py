import random
from collections import Counter

import numpy as np

from palimpsest.llm import decontamination as C


def test_all_documents_equal_brute_force(spark, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r["item_id"]: C.tokens(r["text"].encode()) for r in benchmark.collect()}
    want = {}
    for r in documents.collect():
        words = C.tokens((r["text"] or "").encode())
        own = Counter(zip(*(words[i:] for i in range(5)), strict=False))
        for k, item in items.items():
            shingles, n = C.shingles(item), min(len(item), len(words))
            if not own.keys() & shingles.keys():
                continue
            best = max(C.similarity(shingles, C.shingles(words[a : a + n])) for a in range(len(words) - n + 1))
            if best >= 0.8:
                want[r["doc_id"], k] = best
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in C.contaminated(documents, benchmark).collect()}
    assert want and got == want
    kept = C.drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == documents.count() - len({d for d, _ in want})


def test_edited_items_are_found_as_brute_force_says():
    random.seed(1)
    items = [(i, " ".join(random.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(random.randrange(9)) for _ in range(random.randint(12, 60)))) for i in range(30)]
    block = C.Benchmark(items)
    tried = 0
    for i, text in items:
        item = C.tokens(text.encode())
        shingles = C.shingles(item)
        for edits in (0, 1, 1, 2):
            own = list(item)
            for _ in range(edits):
                own[random.randrange(len(own))] = b"other"
            doc = [b"q%d" % random.randrange(99) for _ in range(30)] + own + [b"p%d" % random.randrange(99) for _ in range(30)]
            best = max(C.similarity(shingles, C.shingles(doc[a : a + len(item)])) for a in range(len(doc) - len(item) + 1))
            found = {m[0] for m in block.matches(b" ".join(doc))}
            tried += best >= 0.8
            assert (i in found) == (best >= 0.8)
    assert tried > 40


def test_indexed_shingles_are_few_and_miss_no_similar_window(spark):
    """Every window at the least similarity holds an indexed shingle; a window meets far fewer items than there are."""
    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choice(words) for _ in range(40))) for i in range(3000)]
    block = C.Benchmark(items)
    held = 0
    for i, text in random.sample(items, 100):
        own = C.tokens(text.encode())
        own[random.randrange(len(own))] = b"other"
        if C.similarity(C.shingles(C.tokens(text.encode())), C.shingles(own)) >= 0.8:
            found = block.starts(b" ".join([b"a"] * 20 + own + [b"b"] * 20))
            held += 1
            assert i in found and 20 in found[i].tolist() and len(found) < 20
    assert held > 15
    prose = [block.starts(" ".join(random.choice(words) for _ in range(400)).encode()) for _ in range(20)]
    assert sum(map(len, prose)) / 20 < 30


def test_a_great_benchmark_is_joined_and_gives_the_same(spark, documents, sf_dir, odd, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    tiny = spark.createDataFrame([(1, None), (2, ""), (3, "Two three, FOUR five six seven eight nine ten!"), (3, "Two three, FOUR five six seven eight nine ten!"), (4, "no id at"), (None, "a")], "item_id long, text string")
    for docs, items in ((documents, benchmark), (odd, tiny)):
        monkeypatch.setattr(C, "BLOCK_BYTES", 16 << 20)
        one = sorted(map(tuple, C.contaminated(docs, items).collect()), key=str)
        kept = sorted(str(r["doc_id"]) for r in C.drop_contaminated(docs, items).collect())
        monkeypatch.setattr(C, "BLOCK_BYTES", 0)
        assert sorted(map(tuple, C.contaminated(docs, items).collect()), key=str) == one and one
        assert sorted(str(r["doc_id"]) for r in C.drop_contaminated(docs, items).collect()) == kept


def test_odd_rows(spark, odd, nothing):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "Two three, FOUR five six seven eight nine ten!"), (3, "Two three, FOUR five six seven eight nine ten!"), (4, "no id at"), (None, "a")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in C.contaminated(odd, benchmark).collect())
    assert got == sorted([("4", "3"), ("4", "3"), ("5", "3"), ("None", "4"), ("8", "None")])
    assert C.contaminated(nothing, benchmark).count() == 0
    assert C.contaminated(odd, benchmark.where("false")).count() == 0 and C.drop_contaminated(odd, benchmark.where("false")).count() == odd.count()
