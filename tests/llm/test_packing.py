import bisect
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from palimpsest.llm import pack_plan, packing


def test_words_encode_as_whole_texts():
    whole = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["It's a test  don't　x", "é́ ́a", "<|endoftext|> a<|startoftext|>b", "\x1cfoo\x1dbar", "", "  ", "ΑΣ ΟΔΟΣ İx", "a\x85b 12 3.4", "!!?? C++ naïve-ish 日本語"]
    for t, got in zip(odd, packing.encode([t.encode() for t in odd], packing.default_tokenizer()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0]


def test_pieces_join_to_documents(documents, odd):
    whole = Tokenizer.from_file(packing.default_tokenizer())
    for docs in (documents, odd):
        texts = Counter()
        for r in docs.collect():
            ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            for k, a in enumerate(range(0, len(ids), 2048)):
                texts[r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
        rows = packing.pack(docs).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == texts
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_ids_come_along(documents):
    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in packing.pack(documents, with_ids=True).collect():
        ids = [*whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_most_sequences_come_from_patterns():
    rng = random.Random(2)
    h = Counter(min(2047, max(1, int(rng.lognormvariate(6.2, 0.9)))) for _ in range(10_000))
    stock = pack_plan._Stock(h)
    fitted = pack_plan.fitted_again(stock, 2048, pack_plan.UNITS)
    whole, bound = pack_plan.plan(h, 2048), sum(k * n for k, n in h.items()) / 2048
    assert all(0 <= 2048 - sum(p) <= pack_plan.MOST_SLACK for p, _ in fitted)
    assert sum(n for _, n in fitted) >= 0.8 * sum(n for _, n in whole) and sum(n for _, n in whole) <= 1.002 * bound + 1


def test_caches_hold_no_long_words():
    encoder = packing.WordEncoder(packing.default_tokenizer())
    encoder.encode([b"x" * 100_000 + b" word", "é".encode() * 50_000])
    assert all(len(w) <= packing.LONGEST_CACHED for w in encoder.words) and len(encoder.words) == 1


def best_fit_decreasing(h):
    """Each piece, the longest first, into the fullest sequence that has room."""
    rooms, n = [], 0
    for length in sorted((k for k, c in h.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else 2048
        n += room == 2048
        bisect.insort(rooms, room - length)
    return n


def test_plans_use_the_histogram_and_are_as_good_as_best_fit():
    random.seed(0)
    for trial in range(40):
        h = {random.randint(1, 2048): random.randint(1, 40) for _ in range(random.randint(1, 300))} | ({k: 20 for k in range(1, 60)} if trial % 2 else {})
        used = Counter()
        plan = pack_plan.plan(h, 2048)
        for lengths, n in plan:
            assert sum(lengths) <= 2048 and n > 0
            for x in lengths:
                used[x] += n
        assert used == h
        assert sum(n for _, n in plan) <= 1.01 * best_fit_decreasing(h) + 2
    assert pack_plan.plan({}, 2048) == []


def test_least_squares_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.random((12, 20)), rng.random(12)
        x = pack_plan.nonnegative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max(initial=0) < 1e-6


def test_no_rows(nothing):
    assert packing.pack(nothing).count() == 0


def test_batches_are_cut_by_their_bytes():
    import pyarrow as pa

    from palimpsest.llm import common

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 2000] * 5000 + ["y" * (3 << 20)] + [None] * 10})
    found = list(common.parts(iter([batch, batch.slice(0, 0)])))
    assert sum(p.num_rows for p in found) == batch.num_rows and pa.Table.from_batches(found).to_batches()[0].schema == batch.schema
    assert [x for p in found for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(p.num_rows for p in found) * 2000 <= common.BATCH_BYTES and len(found) > 10


def test_new_words_are_cut_side_by_side_as_the_tokenizer_does(monkeypatch):
    # Every character up to U+029F, in words learned a few at a time, odd ones between plain ones; each word is looked up once.
    rng = random.Random(4)
    letters = [chr(c) for c in range(33, 0x2A0) if c not in (0x85, 0xA0)] + ["'", "<|", "é"]
    batch = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(20)).encode() for _ in range(150)]
    monkeypatch.setattr(packing, "LEARNED_AT_ONCE", 7)
    whole, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer())
    for t, got in zip(batch, encoder.encode(batch), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*whole.encode(t.decode(), add_special_tokens=False).ids, 0]
    assert packing.BETWEEN not in b"".join(encoder.words.values())
