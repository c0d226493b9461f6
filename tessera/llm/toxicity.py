"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are its distinct lower-cased tokens, each giving hashed words
and word beginnings; the logit is their damped sum. Training minimises log loss
with an L1 proximal step, plus ``COUNTERFACTUAL`` times the mean squared change
of the logit of labelled sentences when an identity term in them is swapped for
another of its set: what a group is called must not move a score.

The classifier is fitted on at most ``SAMPLE`` labelled documents, those with
the least hash of their doc_id, never on held-out ones (crc32 of doc_id mod 5 is
0); executors make the features, and the driver gets the rows of at most ``MOST`` of these
documents, by the hash of their doc_id, and one row for each distinct change of features that swaps make,
with its weight over all sentences. Of either it gets ``BYTES`` at most: documents in the order of
that hash, and as many changes as rows of documents in the order of their sentences, the most frequent first, as long as their features fit. Neither
depends on partitioning. Scoring is one Arrow-batched pass without a shuffle over whole texts.

Defined results: null and empty texts score the bias alone; labels that are null
or belong to no document count for nothing; without labelled rows all scores are
0; repeated rows and null doc_ids are scored like others (a null id is not held
out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SAMPLE = 5000
#: Labelled rows to a document of the sample, as documents and labels may be repeated.
MOST = 4
#: Features that the driver gets of documents, and of swaps.
BYTES = 64 << 20
BUCKETS = 1 << 18
#: Lengths of the word beginnings that count beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Documents of the sample that must share a feature.
LEAST_DOCS = 4
#: The learning rate is the one of five with the fewest errors over four folds of the training rows at sf0.1.
SCALE, ROUNDS, RATE, SPARSE = 40.0, 120, 0.2, 1e-3
COUNTERFACTUAL = 1.0
#: Tokens in one generation of a worker's cache.
CACHE_TOKENS = 200_000

#: Sets of identity terms that may stand for one another.
IDENTITY_SETS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "migrant", "citizen"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "hindus"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def token_features(token: str) -> list[int]:
    """Hashed features of a lower-cased token (punctuation may cut it into words)."""
    out = []
    for word in WORD.findall(token):
        for x in ["w" + word, *("p" + word[:k] for k in BEGINNINGS if len(word) > k)]:
            out.append(xxhash.xxh64_intdigest(x) & (BUCKETS - 1))
    return out


def _array(features: list[list[int]]) -> bytes:
    return np.array([f for part in features for f in part], np.int32).tobytes()


def _swaps(text: str, sets: tuple[tuple[str, ...], ...]) -> Iterator[tuple[int, bytes, bytes]]:
    """Per sentence with an identity term: its tokens, and the features that a swap adds and takes away."""
    other = {w: s[(i + 1) % len(s)] for s in sets for i, w in enumerate(s)}
    for sentence in SENTENCE.split(text.lower()):
        tokens = set(sentence.split())
        swapped = {WORD.sub(lambda m: other.get(m[0], m[0]), t) for t in tokens}
        if swapped != tokens:
            yield len(tokens), _array([token_features(t) for t in sorted(swapped - tokens)]), _array([token_features(t) for t in sorted(tokens - swapped)])


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(docs: list, swaps: list, counterfactual: float = COUNTERFACTUAL) -> Model:
    """``docs``: (toxic, number of tokens, features); ``swaps``, distinct: (features, features taken away, sentences, sum of 1 / (1 + tokens))."""
    if not docs:
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)

    def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(p, np.int32) for p in parts]
        return np.concatenate(own) if own else np.zeros(0, np.int32), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])

    at, row = flat([bytes(r[2]) for r in docs])
    used = np.bincount(at, minlength=BUCKETS) >= LEAST_DOCS
    keep = used[at]
    at, row = at[keep], row[keep]
    place = np.cumsum(used, dtype=np.int32) - 1
    n, width = len(docs), int(used.sum())
    at = place[at]
    more, more_row = flat([bytes(r[0]) for r in swaps])
    less, less_row = flat([bytes(r[1]) for r in swaps])
    c_at, c_row = np.concatenate([more, less]), np.concatenate([more_row, less_row])
    c_sign = np.concatenate([np.ones(len(more)), -np.ones(len(less))])
    keep = used[c_at]
    c_at, c_row, c_sign = place[c_at[keep]], c_row[keep], c_sign[keep]
    damp = SCALE / np.sqrt(1 + np.array([r[1] for r in docs], float))
    # the squared damping of all sentences with the same change, over the number of sentences
    c_share = SCALE**2 * np.array([float(r[3]) for r in swaps]) / max(1, sum(r[2] for r in swaps))
    y = np.array([r[0] for r in docs], float)
    w, b, seen_w, seen_b = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = b + np.bincount(row, weights=w[at], minlength=n) * damp
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = np.bincount(at, weights=(g * damp)[row], minlength=width)
        if len(swaps) and counterfactual:
            change = np.bincount(c_row, weights=c_sign * w[c_at], minlength=len(swaps))
            gw += np.bincount(c_at, weights=(2 * counterfactual * change * c_share)[c_row] * c_sign, minlength=width)
        seen_w += gw * gw
        seen_b += g.sum() ** 2
        step = RATE / np.sqrt(seen_w)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - SPARSE * step, 0)
        b -= RATE / np.sqrt(seen_b) * g.sum()
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def held_out(doc_id: Column) -> Column:
    """Column: is this document kept from training?"""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sets=IDENTITY_SETS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on the labelled documents of a bounded sample."""
    known = labels.select(labels["doc_id"].alias("id"), labels["toxic"].cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample)  # its size bounds the broadcast
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for own, text, y in zip(part["id"], part["text"], part["y"]):
                text = text or ""
                tokens = set(text.lower().split())
                out.append((own, y, len(tokens), _array([token_features(t) for t in sorted(tokens)]), b""))
                out += [(own, None, *swap) for swap in _swaps(text, sets)]
            yield pd.DataFrame(out, columns=["id", "y", "n", "more", "less"]).astype({"y": "Int32", "n": "int32"})

    made = cut(rows.select(F.col("id").cast("long"), "text", "y").mapInPandas(run, "id long, y int, n int, more binary, less binary"))
    labelled = made.where("y is not null").orderBy(F.xxhash64("id"), "id", "y", "n", "more").limit(MOST * sample)
    labelled = _fitting(labelled, [F.xxhash64("id"), "id", "y", "n", "more"])
    # as decimals, the sum is the same in any order
    weight = F.sum((F.lit(1.0) / (1 + F.col("n"))).cast("decimal(20,18)")).alias("weight")
    swaps = made.where("y is null").groupBy("more", "less").agg(F.count(F.lit(1)).alias("sentences"), weight)
    order = [F.desc("sentences"), F.xxhash64("more", "less"), "more", "less"]
    swaps = _fitting(swaps.orderBy(*order).limit(MOST * sample), order)
    return fit(labelled.select("y", "n", "more").collect(), sorted(map(tuple, swaps.collect())), counterfactual)


def _fitting(rows: DataFrame, order: list) -> DataFrame:
    """The first of a bounded number of rows whose features have ``BYTES`` in all."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("bytes", F.sum(F.length("more") + F.length("less")).over(before)).where(F.col("bytes") <= BYTES).drop("bytes")


def score(text: Column, model: Model) -> Column:
    """Column: probability that a text is toxic."""
    weights, bias = model.weights, model.bias
    known: dict[str, float] = {}

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        young, old = known, {}
        for part in parts:
            z = np.empty(len(part))
            for i, text in enumerate(part):
                tokens = set((text or "").lower().split())
                if len(young) > CACHE_TOKENS:
                    young, old = {}, young
                for t in tokens:
                    if t not in young:
                        young[t] = old[t] if t in old else float(weights[token_features(t)].sum())
                z[i] = bias + SCALE * fsum(map(young.__getitem__, tokens)) / (1 + len(tokens)) ** 0.5
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(bias) else np.zeros(len(part)))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels)
    scored = docs.select(docs["doc_id"].alias("doc_id"), score(docs["text"], model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
