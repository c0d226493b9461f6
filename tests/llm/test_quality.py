"""Quality: statistics against plain Python, outliers against a planted group, odd rows."""

import random
import re
from collections import Counter

import numpy as np
from test_pii import DOCS

from tessera.llm import quality


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_match_brute_force(spark):
    r = random.Random(5)
    bits = ["a", "b", "c", "the", "é日", "#", "a|b", "<x>", "\n", "\n\n", " ", "  ", "\t", "\x0b", "\x0c\r", "\x1c", "\xa0"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(120))) for _ in range(600)]
    texts += [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", " a b ", "x " * 30_000, "line\nline\nline\n \n \n"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = {x.doc_id: tuple(x[n] for n in names) for x in quality.statistics(docs).collect()}
    assert out == {i: expected(t) for i, t in enumerate(texts)}


def test_statistics_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: expected(r.text) for r in docs.collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {x.doc_id: tuple(x[n] for n in names) for x in quality.statistics(docs).collect()} == want


def test_outliers_are_rejected_and_ordinary_rows_kept(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    clean = [" ".join(word() for _ in range(r.randrange(60, 400))) for _ in range(200)]
    junk = [" ".join(word() + "###" for _ in range(100)) for _ in range(20)] + [" ".join(word() * 12 for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(clean + junk)], DOCS)
    out = {x.doc_id: x.kept for x in quality.judge(docs).collect()}
    assert all(out[i] for i in range(200)) and not any(out[i] for i in range(200, 240))


def test_odd_tables(spark):
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, None, None, 0), (1, long, None, None, 0), (None, None, None, "s", None)]
    out = quality.judge(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "key")).collect()
    assert sorted(x.kept for x in out) == [False, True, True]


def test_very_long_texts_have_exact_counts(spark):
    n = 5_000_000
    docs = spark.range(1).select(spark_words(n, n).alias("text"), *lit_columns())
    again = spark.range(1).select(spark_words(200_000, 100_000).alias("text"), *lit_columns())
    out = quality.statistics(docs.unionByName(again)).select("n_words", "n_repeat_words").collect()
    assert sorted(map(tuple, out)) == [(200_000, 200_000), (n, 0)]


def spark_words(n, different):
    from pyspark.sql import functions as F

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), (i % different).cast("string"))), " ")


def lit_columns():
    from pyspark.sql import functions as F

    return [F.lit(1).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source")]


def test_null_language_and_null_source_are_groups_apart(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    text = lambda n: " ".join(word(n) for _ in range(80))
    # short words are ordinary in one group and long ones in the other
    rows = [(i, text(3), None, "x", 0) for i in range(80)] + [(80 + i, text(24), "x", None, 0) for i in range(60)] + [(140 + i, text(24), None, "x", 0) for i in range(4)]
    out = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i] for i in range(140)) and not any(out[140 + i] for i in range(4))


def least_determinant(x, starts, seed=1):
    """Minimum covariance determinant from random starts, with the floors and consistency of the operator."""
    r, (n, d) = np.random.default_rng(seed), x.shape
    h, best = int(np.ceil(quality.KEEP * n)), None
    for _ in range(starts):
        own, last = x[r.choice(n, d + 1, replace=False)], np.inf
        while True:
            mean = own.mean(0)
            cov = quality.CONSISTENCY * np.cov(own.T, bias=True) + np.diag(np.square(quality.FLOORS))
            now = np.linalg.slogdet(cov)[1] if len(own) == h else np.inf
            if now < np.inf and now > last - 1e-9:
                break
            last, d2 = now, np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d2)[:h]]
        if best is None or last < best[0]:
            best = last, d2
    return best


def test_determinant_is_as_small_as_of_many_random_starts(spark):
    r = np.random.default_rng(4)
    groups, rows = {}, []
    for key in range(1, 5):
        turn = r.normal(size=(4, 4))
        x = r.normal(size=(300, 4)) @ turn
        x[: 15 * key] = r.normal(size=(15 * key, 4)) * 0.2 + 6 * key  # a tight cluster far away, up to a fifth of the rows
        groups[key] = x
        rows += [(key, *map(float, v)) for v in x]
    frame = spark.createDataFrame(rows, "key long, x0 double, x1 double, x2 double, x3 double")
    params = quality.estimates(frame)
    own = {p.key: p.log_det for p in params.collect()}
    far = quality._distance(frame, params).select("key", "x0", "d2").collect()
    for key, x in groups.items():
        want, d2 = least_determinant(x, 60)
        assert own[key] < want + 0.05
        got = {round(p.x0, 9): p.d2 for p in far if p.key == key}
        got = np.array([got[round(float(v), 9)] for v in x[:, 0]])
        assert np.corrcoef(np.log(got), np.log(d2))[0, 1] > 0.99 and got[: 15 * key].min() > 2 * np.median(got)
