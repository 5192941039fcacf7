import re
from collections import Counter

from palimpsest.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_counts_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        want = sorted((plain(r["text"])[:5] + (plain(r["text"])[5],) for r in docs.collect()))
        got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.judge(docs).collect())
        assert got == want


def test_whole_result_equals_sql(spark, documents, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
    names = ["doc_id", "n_words", "n_symbols", "base_failed", "kept"]
    want = c.sql(Q.oracle())
    assert sorted(tuple(r[n] for n in names) for r in Q.judge(documents).collect()) == sorted(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


def test_sketches_merge(documents):
    whole = Q.sketches(Q.measures(documents))
    parts = Q.sketches(Q.measures(documents.where("doc_id % 2 = 0"))).unionByName(Q.sketches(Q.measures(documents.where("doc_id % 2 = 1"))))
    order = ["lang", "source", "measure", "bucket", "n"]
    assert sorted(map(tuple, whole.select(order).collect())) == sorted(map(tuple, Q.merged(parts, "lang", "source").select(order).collect()))


def test_clean_stays_and_junk_goes(documents, labels):
    judged = Q.judge(documents).join(labels, "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() == 0
    assert judged.where("quality = 0 AND kept").count() == 0


def test_few_documents_draw_fences_to_the_languages_without_a_jump(spark):
    """A source's fence moves from its language's to its own as its documents become more, one step at a time."""
    text = lambda symbols, i: " ".join(f"word{i}x{k}" + "#" * (k < symbols) for k in range(200))
    many = [(i, text(0, i), "en", "plain", 0) for i in range(400)]
    fence = []
    for n in (1, 49, 50, 51, 400):
        rows = many + [(1000 + i, text(100, 1000 + i), "en", "marked", 0) for i in range(n)]
        found = Q.fences(Q.sketches(Q.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))))
        fence.append({r["source"]: r["symbols_high"] for r in found.collect()}["marked"])
    assert fence == sorted(fence) and fence[-1] > 300 + fence[0] and fence[3] - fence[1] < 10


def test_every_fence_can_reject(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(200)), "en", "a", 0) for i in range(100)]
    short, often = " ".join("a b c d e f g h i j k l m n o p q r s t u v w x y z".split()), " ".join([*(f"word{k}" for k in range(161)), *["one two three four five six seven eight nine ten eleven twelve thirteen"] * 3])
    rows = [*good, (200, short, "en", "a", 0), (201, often, "en", "a", 0)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[200] == (False, False) and got[201] == (False, False) and all(got[i] == (False, True) for i in range(100))


def test_no_rows(nothing):
    assert Q.judge(nothing).count() == 0
