"""Near-duplicates at similarity 0.8: planted copies and edits, strangers, hot buckets, odd rows."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pii import DOCS

from tessera.llm import simhash, similar


def jaccard(a, b):
    s, t = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(r.randrange(80, 300))] + (passage if k % 2 else []) for k in range(120)]
    texts, group = [" ".join(b) for b in base], list(range(120))
    for k in range(120):
        for _ in range(3 if k % 10 else 25):
            w = list(base[k])
            for at in r.sample(range(len(w)), r.choice([0, 1, 2])):
                w[at] = word()
            texts.append(r.choice([" ", "  ", "\n"]).join(w).upper())
            group.append(k)
    return texts, group


@pytest.mark.parametrize("hot", [2048, 4])
def test_one_of_each_group_stays(spark, monkeypatch, hot):
    texts, group = corpus()
    monkeypatch.setattr(similar, "edges", lambda t, own=similar.edges: own(t, hot))
    assert min(jaccard(texts[g], t) for t, g in zip(texts, group)) > 0.75
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    docs = spark.createDataFrame([(i, texts[i], "en", "s", 0) for i in order], DOCS).withColumnsRenamed({"lang": "fp", "source": "row"})
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    # copies of under 0.8 are documents of their own, unless another copy connects them
    members = [[i for i, g in enumerate(group) if g == k] for k in range(120)]
    links = [(a, b) for own in members for k, a in enumerate(own) for b in own[:k] if jaccard(texts[a], texts[b]) >= 0.8 - 1e-9]
    want = sorted(set(groups_of(range(len(texts)), links).values()))
    assert 120 <= len(want) < 130
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_odd_tables(spark):
    assert similar.one_of_each(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b", None, None, None), (3, "A  B", "en", "s", 0), (3, "A  B", "en", "s", 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "x " * 20_000, "en", "s", 0), (None, "only one", "en", "s", 0)]
    kept = similar.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "6", "None"]


def prints_of(spark, texts):
    rows = []
    for t in texts:
        key, fp, bands = similar.signature(t)
        rows.append((int(np.array([key], np.uint64).view(np.int64)[0]), fp.view(np.int64).tolist(), bands.view(np.int64).tolist(), t))
    frame = spark.createDataFrame(rows, "text_key long, fp array<long>, bands array<long>, text string")
    return [r[0] for r in rows], similar.Texts(frame.drop("text"), frame.select("text_key", "text"))


def groups_of(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def family(r, word):
    """Pairs of similarity 0.6 to 0.85, around a base and in a chain of tails."""
    base = [word() for _ in range(r.randrange(60, 200))]
    out = [base]
    for _ in range(5):
        w = list(r.choice(out[-2:]))
        n = r.randrange(int(0.04 * len(w)), int(0.25 * len(w)))
        at = r.randrange(len(w) - n)
        out.append(w[:at] + [word() for _ in range(n if r.random() < 0.5 else 0)] + w[at + n :])
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("hot", [2048, 3])
def test_links_match_brute_force_between_0_6_and_0_85(spark, hot):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    families = [family(r, word) for _ in range(60)]
    texts = [t for f in families for t in f]
    keys, prints = prints_of(spark, texts)
    named, links, unlinked = dict(zip(texts, keys)), [], 0
    for f in families:
        for i, x in enumerate(f):
            for y in f[:i]:
                if jaccard(x, y) >= 0.8 - 1e-9:
                    links.append((named[x], named[y]))
                else:
                    unlinked += jaccard(x, y) >= 0.6
    assert len(links) > 50 and unlinked > 100
    found = [(x.a, x.b) for x in similar.edges(prints, hot).collect()]
    assert {frozenset(p) for p in found} <= {frozenset(p) for p in links}
    assert groups_of(keys, found) == groups_of(keys, links)


@pytest.mark.parametrize("hot", [2048, 2])
def test_text_that_links_to_the_hub_meets_those_that_do_not(spark, hot):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    few = lambda n: [word() for _ in range(n)]
    key = lambda t: int(np.array([similar.signature(t)[0]], np.uint64).view(np.int64)[0])
    texts = []
    while len(texts) < 40 * 3:
        x = few(90)
        h, x, y = " ".join(x + few(14)), " ".join(x), " ".join(few(14) + x)
        if key(h) < min(key(x), key(y)):  # h is the hub; y links to x alone
            texts += [h, x, y]
    keys, prints = prints_of(spark, texts)
    one = prints.prints.withColumn("bands", F.expr("array(0L)"))  # the only bucket of all
    pairs = [(x.a, x.b) for x in similar.edges(similar.Texts(one, prints.content), hot).collect()]
    groups = groups_of(keys, pairs)
    for h, x, y in zip(keys[::3], keys[1::3], keys[2::3]):
        assert groups[h] == groups[x] == groups[y]
    assert len(set(groups.values())) == 40


def test_blocks_of_a_bucket_meet_once_each(spark):
    rows = [(7, k, [k, 0, 0, 0], k) for k in range(50)] + [(8, k, [0, 0, 0, 0], 1) for k in range(9)]
    frame = spark.createDataFrame(rows, "bucket long, text_key long, fp array<long>, root long")
    for hot in (2048, 4):
        pairs = [(x.a, x.b) for x in similar.crossing(frame, hot).collect()]
        assert sorted(pairs) == [(a, b) for a in range(50) for b in range(a + 1, 50)]


def test_parity_bitmaps_lose_no_link_and_part_most_edits_of_a_template():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    close = far = parted = 0
    for n in (3, 5, 9, 40, 150, 600, 600, 5000):
        for _ in range(60):
            base = [word() for _ in range(n)]
            x, y = list(base), list(base)
            for w in (x, y):
                for at in r.sample(range(n), r.randrange(max(1, n // r.choice([20, 40])) + 1)):
                    w[at] = word()
            x, y = " ".join(x), " ".join(y)
            (p, a), (q, b) = similar.sketch(x), similar.sketch(y)
            meet = int(np.bitwise_count(a ^ b).sum()) * 1.8 <= (p + q) * 0.2 + 1e-6
            if jaccard(x, y) >= 0.8:
                close += 1
                assert meet
            elif jaccard(x, y) < 0.65 and n <= 600:
                far += 1
                parted += not meet
    assert close > 100 and far > 50 and parted > 0.95 * far


def fingerprints(r, n, words, flips):
    """Rows of whole words around few centers, some of them within the radius of each other."""
    centers = r.integers(0, 1 << 64, (3, words), dtype=np.uint64)
    bits = np.unpackbits(centers.view(np.uint8), axis=1, bitorder="little")[r.integers(0, 3, n)]
    for row in bits:
        row[r.permutation(64 * words)[: r.integers(0, flips)]] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def differ(x, y):
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=int)


@pytest.mark.parametrize("words, radius, flips", [(4, 72, 70), (4, 0, 2), (4, 300, 70), (1, 2, 4), (1, 64, 30)])
def test_bit_sliced_pairs_match_counted_bits(words, radius, flips):
    r = np.random.default_rng(3)
    for sizes in ([1], [2], [2, 1, 3, 5], [64, 65, 1, 63], [128], [300, 2, 2], [1, 1, 1]):
        sizes = np.array(sizes)
        values = fingerprints(r, sizes.sum(), words, flips)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        got = [(int(a), int(b)) for x, y in simhash.close_rows(values, sizes, radius) for a, b in zip(x, y)]
        near = (differ(values[:, None], values[None]) <= radius) & (bucket[:, None] == bucket)
        assert sorted(got) == list(map(tuple, np.argwhere(np.triu(near, 1)).tolist()))
        other = fingerprints(r, len(values), words, flips)
        assert (simhash.near_rows(values, other, radius) == (differ(values, other) <= radius)).all()
        assert simhash.near_rows(values, values, radius).all()


def test_candidates_are_those_of_the_carry_save_counters(spark, monkeypatch):
    r = np.random.default_rng(4)
    fp = fingerprints(r, 150, 4, 60).view(np.int64).tolist()
    pairs = pa.RecordBatch.from_pydict({"a": list(range(149)), "a_fp": fp[1:], "b": list(range(1, 150)), "b_fp": fp[:-1]})
    rows = pd.DataFrame({"bucket": 5, "band": 5, "block": 0, "own": True, "text_key": range(150), "root": range(150), "fp": [np.array(x) for x in fp]})
    beside = lambda: sum(len(x) for x in similar._near(iter([pairs, pairs.slice(0, 0)])))
    within = lambda: sum(len(x) for x in similar._met(iter([rows[:70], rows[70:]])))
    assert 0 < beside() < 149 and within() > 1000
    monkeypatch.setattr(simhash, "over_radius", lambda differing, over, radius: over | simhash.ALL)
    assert beside() == within() == 0  # nothing else finds candidates
    frame = spark.createDataFrame([(7, k, x, k) for k, x in enumerate(fp)], "bucket long, text_key long, fp array<long>, root long")
    plan = similar.crossing(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "bit_count" not in plan


def test_edits_of_a_template_meet_only_where_they_may_be_similar(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for at in r.sample(range(len(w)), r.randrange(1, 7)):
            w[at] = word()
        texts.append(" ".join(w))
    keys, prints = prints_of(spark, texts)
    links = [(keys[i], keys[j]) for i in range(120) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8 - 1e-9]
    found = [(x.a, x.b) for x in similar.edges(prints).collect()]
    assert groups_of(keys, found) == groups_of(keys, links)
    rows = prints.prints.select("text_key", "fp", F.explode("bands").alias("bucket"), F.col("text_key").alias("root"))
    known = prints.content.select("text_key", similar.sketches(F.col("text")).alias("s")).select("text_key", "s.*")
    known = known.join(prints.prints.select("text_key", "bands"), "text_key")
    pairs = [(x.a, x.b) for x in similar.crossing(rows, similar.HOT, known).collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in links} <= {frozenset(p) for p in pairs}
    assert len(pairs) < 0.5 * 120 * 119 / 2
