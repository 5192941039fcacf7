import math
import zlib
from collections import Counter

import numpy as np

from palimpsest.llm import gru
from palimpsest.llm import lm_scoring as M


def plain_base(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update([*(t or "").encode().lower().split(), b"\0"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), b"\0"]
        out.append((str(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    return sorted(out)


def test_base_scores_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        rows = M.score(docs).collect()
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
        assert got == plain_base([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


def test_rare_words_come_through_the_join(spark, documents, monkeypatch):
    monkeypatch.setattr(M.common_words, "__defaults__", (500,))
    rows = M.score(documents).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == plain_base([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_the_network_beats_the_base_by_a_tenth_on_held_out_rows(spark):
    rows = M.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


def network(classes, slots, hidden, kind=np.float32):
    rng = np.random.default_rng(3)
    net = gru.Network(classes, slots, hidden)
    wider = gru.Network.__new__(gru.Network)
    wider.classes, wider.slots, wider.hidden, wider.sizes = classes, slots, hidden, net.sizes
    wider.vector = rng.normal(0, 0.5, len(net.vector)).astype(kind)
    at = 0
    for name, size in zip(net.NAMES, net.sizes, strict=True):
        setattr(wider, name, wider.vector[at : at + size].reshape(getattr(net, name).shape))
        at += size
    return wider


def plain_log(net, document):
    """The log-probability of each token, step by step as the formulas say."""
    h, out = np.zeros(net.hidden), []
    H, squash = net.hidden, lambda x: 1 / (1 + np.exp(-x))
    for t in document:
        k, s = divmod(int(t), net.slots)
        of_class, of_slot = h @ net.to_class + net.class_bias, h @ net.to_slot[k] + net.slot_bias[k]
        out.append(of_class[k] - np.log(np.exp(of_class).sum()) + of_slot[s] - np.log(np.exp(of_slot).sum()))
        x, u = net.inputs[t] + net.gate_bias, h @ net.state
        z, r = squash(x[:H] + u[:H]), squash(x[H : 2 * H] + u[H : 2 * H])
        c = np.tanh(x[2 * H :] + r * u[2 * H :])
        h = z * h + (1 - z) * c
    return np.array(out)


def test_gradients():
    rng = np.random.default_rng(0)
    net = network(3, 4, 5, np.float64)
    docs = [rng.integers(0, 12, n) for n in (9, 6, 3, 1)]
    group = gru.Lanes(docs, 2)
    tokens, first, active = next(group.windows(32))
    streams = [group.flat[a : a + n] for a, n in zip(group.starts, group.lengths, strict=True)]
    begins = [group.first[a : a + n] for a, n in zip(group.starts, group.lengths, strict=True)]

    def loss():
        parts = [plain_log(net, p) for t, f in zip(streams, begins, strict=True) for p in np.split(t, np.flatnonzero(f[1:]) + 1)]
        return -np.concatenate(parts).mean()

    numeric = np.zeros(len(net.vector))
    for k in range(len(numeric)):
        for sign in (1, -1):
            net.vector[k] += sign * 1e-5
            numeric[k] += sign * loss() / 2e-5
            net.vector[k] -= sign * 1e-5
    got = gru.Trainer(net).gradients(tokens, first, active, np.zeros((2, 5)))
    assert abs(got - numeric).max() < 1e-7 and abs(numeric).max() > 0.01


def test_windows_do_not_change_a_documents_likelihood(monkeypatch):
    rng = np.random.default_rng(1)
    net = network(4, 3, 6)
    docs = [rng.integers(0, 12, n) for n in (100, 33, 64, 1, 5)]
    for at_once in (1, 40, 1 << 15):
        monkeypatch.setattr(gru, "PREDICTED_AT_ONCE", at_once)
        for d, got in zip(docs, gru.log10_likelihoods(net, docs, lanes=2), strict=True):
            assert abs(plain_log(net, d).sum() / np.log(10) - got) < 1e-3


def test_scores_equal_a_plain_pass_over_whole_documents(spark, odd, documents, monkeypatch):
    """Place by place and step by step, with the network that was trained."""
    kept = []
    trained = M.trained
    monkeypatch.setattr(M, "trained", lambda *a: kept.append(trained(*a)) or kept[-1])
    for docs in (documents.limit(60), odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        counts, ends = Counter(), 0
        for i, t in rows:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
                counts.update((t or "").encode().lower().split())
                ends += 1
        places = M.choose_places(sorted(counts.items(), key=lambda x: (-x[1], x[0])))
        totals = Counter()
        for w, c in counts.items():
            totals[places.of(w)] += c + 0.5
        got = sorted(((str(r["doc_id"]), r["score"]) for r in M.score(docs).collect()))
        want = []
        for i, t in rows:
            words = (t or "").encode().lower().split()
            own = [math.log10((counts[w] + 0.5) / (totals[places.of(w)] + 0.5)) for w in words if w not in places.words]
            want.append((str(i), plain_log(kept[-1], [*map(places.of, words), 0]).sum() / math.log(10) + sum(own)))
        for (i, a), (j, b) in zip(got, sorted(want), strict=True):
            assert i == j and abs(a - b) <= 1e-4 * max(1, abs(b))


def test_all_words_and_the_unseen_sum_to_one():
    """Class, slot and share, summed over every word of the vocabulary, one unseen word a shared slot, and the end."""
    rng = np.random.default_rng(5)
    common = sorted({bytes(rng.integers(97, 123, rng.integers(1, 7)).astype(np.uint8)): int(c) for c in rng.integers(1, 90, 4000)}.items(), key=lambda x: (-x[1], x[0]))
    places, masses = M.choose_places(common), {}
    for w, c in common:
        k = places.of(w)
        masses[k] = (masses.get(k, (0, 0))[0] + c, masses.get(k, (0, 0))[1] + 1)
    mass, log_totals = M.shares(masses, 100, set(places.words.values()))
    net = network(M.CLASSES, M.SLOTS, 4)
    h = rng.normal(0, 1, (1, 4)).astype(np.float32)
    at = np.exp(net.log_probabilities(np.repeat(h, M.TOKENS, 0), np.arange(M.TOKENS)).astype(np.float64))
    assert abs(at.sum() - 1) < 1e-4
    share = {k: 0.0 for k in range(M.TOKENS)}
    for w, c in common:
        share[places.of(w)] += (c + 0.5) / 10 ** log_totals[places.of(w)]
    share[0] = (100 + 0.5) / 10 ** log_totals[0]
    for k in range(M.TOKENS):
        if k % M.SLOTS >= M.OWN_SLOTS:
            share[k] += 0.5 / 10 ** log_totals[k]
    used = [k for k in share if share[k]]
    assert all(abs(share[k] - 1) < 1e-9 for k in used) and len(used) > 500
    assert all(k // M.SLOTS > 0 for k in map(places.of, (b"the", b"new", b"a", "é".encode(), b"x" * 10000)))


def test_the_network_is_the_same_whatever_the_files(spark, documents):
    one = {r["doc_id"]: r["score"] for r in M.score(documents.coalesce(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in M.score(documents.repartition(13)).collect()}
    assert all(abs(one[i] - many[i]) <= 1e-3 * max(1, abs(one[i])) for i in one)


def test_very_long_words(spark):
    docs = spark.createDataFrame([(i, "z" * 300_000 + " and a word") for i in range(8)], "doc_id long, text string")
    rows = M.score(docs).collect()
    assert all(r["n_tokens"] == r["n_known"] == 5 for r in rows)
    counts = M.corpus_counts(docs)
    assert all(len(w) <= M.LONGEST_COMMON for w, _ in M.common_words(counts))


def test_no_rows(nothing):
    assert M.score(nothing).count() == 0


def test_scoring_takes_logs_of_sums_without_probabilities():
    import numpy as np

    from palimpsest.llm import gru

    rng = np.random.default_rng(3)
    for scale in (1, 40):
        logits, targets = (scale * rng.normal(size=(200, 64))).astype(np.float32), rng.integers(0, 64, 200)
        capped = np.minimum(logits.astype(np.float64), 60)
        plain = capped[np.arange(200), targets] - np.log(np.exp(capped).sum(1))
        sums = logits.copy()
        found, total = gru.log_softmax(sums, targets)
        assert np.allclose(found, plain, atol=1e-3) and np.allclose(sums.sum(1), total, rtol=1e-3) and not np.allclose(total, 1)
        assert np.array_equal(gru.softmax(logits, targets), found) and np.allclose(logits.sum(1), 1, atol=1e-4)
    # Places are sorted as short numbers, in the same order as any.
    network, targets = gru.Network(64, 32), rng.integers(0, 2048, 5000)
    assert np.array_equal(network.by_class(targets)[0], np.argsort(targets, kind="stable"))
