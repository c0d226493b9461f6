"""Toxicity: held-out accuracy, the counterfactual penalty, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_pii import DOCS

from tessera.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit >= 0.85 * sum(r.toxic for r in out) and sum(r.predicted and not r.toxic for r in out) <= 0.01 * len(out)


def corpus(seed=1):
    """Toxic sentences mention one group far more often than others; neutral ones mention all."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        who = "muslim" if toxic and r.random() < 0.8 else r.choice(["christian", "jewish", "hindu"])
        bad = ["awfulbad"] if toxic and r.random() < 0.7 else []
        text = " ".join([word() for _ in range(8)] + bad + [who] + [word() for _ in range(8)]) + "."
        rows.append((i, text, int(toxic)))
    return rows


def weight(model, word):
    return float(model.weights[toxicity.token_features(word)].sum())


def test_counterfactual_penalty_evens_identity_terms(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    plain, fair = (toxicity.train(docs, labels, counterfactual=c) for c in (0.0, 1.0))
    spread = lambda m: max(w := [weight(m, g) for g in ("muslim", "christian", "jewish", "hindu")]) - min(w)
    assert spread(fair) < 0.35 * spread(plain)
    assert weight(fair, "awfulbad") > 0.5 * weight(plain, "awfulbad") > 0


def test_swaps_name_the_changed_features():
    (n, more, less), = toxicity._swaps("One line. The Muslim man, spoke!", (("muslim", "hindu"),))
    assert n == 4
    assert np.frombuffer(more, np.int32).tolist() == toxicity.token_features("hindu")
    assert np.frombuffer(less, np.int32).tolist() == toxicity.token_features("muslim")


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 30_000, "en", "s", 0), (2, "x", "en", "s", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    out = toxicity.classify(docs.withColumnRenamed("lang", "score"), none).collect()
    assert len(out) == 4 and all(r.score == 0 and r.predicted == 0 for r in out)
    some = spark.createDataFrame([(2, 1, 0), (2, 1, 1), (1, 1, None), (None, 1, 1), (77, 1, 1)], LABELS)
    assert all(0 <= r.score <= 1 for r in toxicity.classify(docs, some).collect())
    assert toxicity.classify(spark.createDataFrame([], DOCS), none).count() == 0
    assert docs.where(toxicity.held_out(F.col("doc_id"))).where("doc_id is null").count() == 0


def test_many_swaps_take_no_labelled_row_and_order_does_not_count(spark, monkeypatch):
    rows = corpus(2)[:60]
    lines = lambda t: " ".join(f"a {w} said x{k % 7}." for k, w in enumerate(["muslim", "hindu", "jewish"] * 40))
    given = [(i, f"{t} {lines(t)}" if i % 2 else t, "en", "s", 0) for i, t, _ in rows]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda docs, swaps, c, own=toxicity.fit: seen.append((docs, swaps)) or own(docs, swaps, c))
    models = [toxicity.train(spark.createDataFrame(g, DOCS).repartition(n), labels, sample=50) for g, n in ((given, 1), (given[::-1], 7))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias
    assert seen[0] == seen[1]
    docs, swaps = seen[0]
    chosen = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, _, _ in rows)
    assert len(docs) == min(50, chosen)
    assert len(swaps) < 40 and sum(x[2] for x in swaps) > 4 * 50


def test_neutral_mentions_score_alike_on_the_query_path(spark, monkeypatch):
    rows = corpus(4)
    neutral = [(f"we met a {who} near the {place} today.", who) for who in ("muslim", "christian", "jewish", "hindu") for place in ("lake", "hill", "road", "bridge")]
    given = [(i, t, "en", "s", 0) for i, t, _ in rows] + [(10_000 + i, t, "en", "s", 0) for i, (t, _) in enumerate(neutral)]
    docs = spark.createDataFrame(given, DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)

    def gap():
        scores = {r.doc_id: r.score for r in toxicity.classify(docs, labels).where("doc_id >= 10000").collect()}
        of = {who: np.mean([scores[10_000 + i] for i, (_, w) in enumerate(neutral) if w == who]) for who in ("muslim", "christian", "jewish", "hindu")}
        return max(of.values()) - min(of.values()), of["muslim"]

    fair, own = gap()
    monkeypatch.setattr(toxicity, "train", lambda d, y, train=toxicity.train: train(d, y, counterfactual=0.0))
    plain, before = gap()
    assert fair < 0.35 * plain and own < before and own < 0.5


def test_bytes_that_reach_the_driver_are_bounded(spark, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10_000)}" for _ in range(400)) + ". a muslim here." * 3 for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], LABELS)
    seen = []
    monkeypatch.setattr(toxicity, "BYTES", 100_000)
    monkeypatch.setattr(toxicity, "fit", lambda docs, swaps, c, own=toxicity.fit: seen.append((docs, swaps)) or own(docs, swaps, c))
    toxicity.train(docs, labels)
    toxicity.train(docs.repartition(13), labels)
    assert seen[0] == seen[1] and 50_000 < sum(len(x.more) for x in seen[0][0]) <= 100_000
