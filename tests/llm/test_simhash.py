"""SimHash: fingerprints and components against brute force, bit-sliced blocks, hot buckets."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_pii import DOCS

from tessera.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, radius=2):
    label = {v: v for v in values}
    for a, b in combinations(sorted(set(values)), 2):
        if (a ^ b).bit_count() <= radius and label[a] != label[b]:
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
    return label


def expected(ids, texts):
    prints = [fingerprint(t) for t in texts]
    label = roots(prints)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    return [(i, f"{p:016x}", least.get(label[p])) for i, p in zip(ids, prints)]


def test_fingerprints():
    r = random.Random(1)
    bits = ["A", "b", "É", "日本", "the", "of", " ", "\n", "\t\x0b", "\x1c", "\xa0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(400)] + [None, "", " ", "One", "one two", "x " * 9000]
    assert [simhash.fingerprint_of(t) for t in texts] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 7, 12])
def test_blocks_match_brute_force(radius):
    r = random.Random(radius)
    for n in (1, 2, 63, 64, 65, 200):
        base = [r.getrandbits(64) for _ in range(max(1, n // 5))]
        values = [r.choice(base) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(n)]
        cuts = sorted(r.randrange(n + 1) for _ in range(2))
        sizes = [s for s in (cuts[0], cuts[1] - cuts[0], n - cuts[1]) if s]
        got = simhash.linked_rows(np.array(values, np.uint64), np.array(sizes), radius)
        at = 0
        for s in sizes:
            label = roots(values[at : at + s], radius)
            first = {}
            for k in range(at, at + s):
                first.setdefault(label[values[k]], k)
            assert [int(x) for x in got[at : at + s]] == [first[label[v]] for v in values[at : at + s]]
            at += s


@pytest.mark.parametrize("hot", [2048, 3])
def test_components_with_hot_buckets(spark, hot):
    r = random.Random(9)
    values = [r.getrandbits(64) for _ in range(60)]
    chain = r.getrandbits(64)
    for k in range(24):
        chain ^= 1 << (k * 5 % 64) | 1 << (k * 7 % 61)
        values.append(chain)
    values += [values[0] ^ 1 << k for k in range(64)] + [0, 1, 3]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.star_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), hot)
    out = dict(simhash.components(edges).collect())
    label = roots(values)
    groups = {}
    for v, s in zip(values, signed):
        groups.setdefault(label[v], []).append(s)
    want = {s: min(g) for g in groups.values() if len(g) > 1 for s in g if s != min(g)}
    assert out == want


def test_query(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    texts = [" ".join(word() for _ in range(r.randrange(0, 200))) for _ in range(120)]
    texts += [t.replace(" ", "  ").upper() for t in texts[:10]] + [" ".join(t.split()[1:]) for t in texts[:30]] + [None, "", "one", "ONE", "one two"]
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS).withColumnsRenamed({"lang": "fp", "source": "row"})
    want = expected(ids, texts)
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in simhash.near_duplicates(docs).collect()), key=key) == sorted(want, key=key)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d", "en", "s", 0)] * 3, DOCS)
    assert simhash.near_duplicates(same).count() == 3
    assert simhash.near_duplicates(same.select(F.lit(None).cast("long").alias("doc_id"), "text")).where("component_id is null").count() == 3
