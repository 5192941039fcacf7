import zlib

import numpy as np
import pytest

from palimpsest.llm import quality_classifier as K
from palimpsest.llm import toxicity as X


def test_quality_on_held_out_rows(documents, labels):
    rows = K.score(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 10 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert K.drop_low_quality(documents, labels).columns == documents.columns


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.95
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= 0.9
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.02


@pytest.mark.parametrize("score", [K.score, X.score])
def test_odd_rows(spark, score, odd, nothing, documents, labels):
    rows = score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score(nothing, labels).count() == 0
    none = labels.where("false")
    assert score(odd, none).count() == odd.count()


def test_neighbours_equal_a_plain_vote():
    rng = np.random.default_rng(0)
    terms, labels = rng.random((300, K.TERMS)).astype(np.float32), rng.integers(0, 2, 300)
    model = K.fit(terms, labels)
    asked = rng.random((7, K.TERMS)).astype(np.float32)
    got = model.score(asked)
    for q, s in zip(model.project(asked), got, strict=True):
        cosines = model.vectors @ q
        near = sorted(range(300), key=lambda i: -cosines[i])[: K.NEIGHBOURS]
        weight = [max(float(cosines[i]), 0) ** K.SHARPNESS for i in near]
        assert abs(s - (sum(w * labels[i] for w, i in zip(weight, near, strict=True)) + 1e-3 * model.prior) / (sum(weight) + 1e-3)) < 1e-4


def test_whole_quality_scores_equal_a_plain_version(spark, documents, labels, odd):
    """Every row's score by a plain vote of the labelled texts, one text at a time."""
    for docs in (documents, odd):
        texts, marks = {}, {}
        for r in docs.collect():
            if r["doc_id"] is not None:
                texts.setdefault(r["doc_id"], []).append(r["text"])
        for r in labels.where("quality IS NOT NULL").collect():
            if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
                marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["quality"])
        ids = sorted(marks)
        terms = np.array([K.term_frequencies((texts[i][0] or "").encode()) for i in ids], np.float32).reshape(len(ids), K.TERMS)
        model = K.fit(terms, np.array([marks[i] for i in ids], np.int64))
        got = sorted((str(r["doc_id"]), round(r["score"], 3)) for r in K.score(docs, labels).collect())
        want = []
        for r in docs.collect():
            own = K.term_frequencies((r["text"] or "").encode())
            cosines = model.project(own[None])[0] @ model.vectors.T if len(ids) else np.zeros(0)
            near = np.argsort(-cosines)[: K.NEIGHBOURS]
            weight = np.clip(cosines[near], 0, 1).astype(np.float64) ** K.SHARPNESS
            s = (float(weight @ model.labels[near]) + 1e-3 * model.prior) / (weight.sum() + 1e-3) if len(ids) else model.prior
            want.append((str(r["doc_id"]), round(min(max(s, 0), 1), 3)))
        assert len(got) == len(want) and max(abs(a[1] - b[1]) for a, b in zip(got, sorted(want), strict=True)) <= 2e-3


def test_a_labelled_id_that_comes_often_is_learned_from_once(spark, documents, labels):
    one = labels.where("quality IS NOT NULL").where(K.may_learn()).limit(1)
    i = one.first()["doc_id"]
    often = documents.where(f"doc_id = {i}").unionByName(spark.range(500).selectExpr(f"{i}L AS doc_id", "concat('copy ', id) AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars"))
    assert len(K.train(often, one, K.may_learn()).labels) == 1


def test_hits_are_not_capped():
    lexicon = X.Lexicon({})
    place = X.FEATURES.index("hits")
    assert X.features(b"idiot " * 100, lexicon)[place] < X.features(b"idiot " * 1000, lexicon)[place]


def test_features():
    lexicon = X.Lexicon({"lowei-": 3.0})
    names = dict(zip(X.FEATURES, X.features(b"You are an IDIOT! Loweichen st*pid m0ron fine", lexicon), strict=True))
    assert names["insults"] > 0 and names["learned"] > 0 and names["disguised_insults"] >= 1 and names["obfuscated"] > 0 and names["near_you"] > 0
    assert X.features(b"", lexicon) == (0.0,) * len(X.FEATURES)
    hits, you = [(i, 0, "", 0) for i in range(0, 90, 3)], list(range(0, 90, 10))
    assert X._near(hits, you) == sum(any(abs(i - j) <= X.NEAR for j in you) for i, *_ in hits)
