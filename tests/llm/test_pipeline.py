"""The pipeline against plain versions of its stages' decisions."""

import os
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from palimpsest.llm import decontamination, quality_classifier


def test_stages_and_run(spark, sf_dir, documents, labels, tmp_path):
    docs, seen = documents, []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    assert all(d.columns == documents.columns for d in seen[:-1])
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}

    accepted = {r["doc_id"] for r in quality_classifier.score(documents, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in seen[0].collect()} == accepted

    # The stage's rule by itself: a document goes where an earlier one has five-word similarity 0.8 or more.
    ids, sets = sorted(accepted), {}
    for i in ids:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[i] or "").split(None)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    stay = {i for n, i in enumerate(ids) if not any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in ids[:n])}
    assert {r["doc_id"] for r in seen[1].collect()} == stay

    items = {k: decontamination.tokens(t.encode()) for k, t in ((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())}
    before = {r["doc_id"] for r in seen[1].collect()}
    held = set()
    for i in before:
        text = " " + " ".join(w.decode() for w in decontamination.tokens(rows[i].encode())) + " "
        held |= {i for item in items.values() if " " + " ".join(w.decode() for w in item) + " " in text}
    kept = {r["doc_id"] for r in seen[2].collect()}
    assert held and kept <= before - held and len(before - held - kept) <= 1

    masked = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert masked.keys() == kept
    for i, t in masked.items():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t)
        assert t == rows[i] or "[SECRET]" in t

    names = [c for c in seen[4].columns if c not in ("sequence_id", "offset", "ids")]
    run = P.run(spark, sf_dir)
    assert Counter(map(tuple, run.select(names).collect())) == Counter(map(tuple, seen[4].select(names).collect()))
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in run.collect())
    # What the stages wrote before the last one is gone.
    (folder,) = {os.path.dirname(f.removeprefix("file:").lstrip("/").join(["/", ""])).rsplit("/", 1)[0] for f in run.inputFiles()}
    assert os.listdir(folder) == ["4-best_fit_packing"]
    assert {r["doc_id"] for r in run.collect()} == kept and P.ORACLE_SQL is None


def test_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_take_odd_rows_and_none(spark, sf_dir, odd, nothing):
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, odd, sf_dir)
        assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()
        assert stage(spark, nothing, sf_dir).count() == 0
    assert P.packed(spark, odd, sf_dir).select("sequence_id", "offset").distinct().count() == P.packed(spark, odd, sf_dir).count()
