"""Sharding: near equal shards, groups together, gapless slots, large groups and odd rows."""

import random
import zlib
from collections import Counter, defaultdict

from test_pii import DOCS

from tessera.llm import sharding


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    out = sharding.shard(docs).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    slots, sizes, rows = defaultdict(list), Counter(), Counter()
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        rows[r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {r.doc_id: r.shard for r in out}, [sizes[k] for k in range(8)], [rows[k] for k in range(8)]


def test_balance_and_groups(spark):
    r = random.Random(7)
    texts = ["x " * r.randrange(1, 400) for _ in range(3000)] + ["same text"] * 100 + [None] * 5 + [""] * 5
    texts = [t and t + str(i) if i < 3000 else t for i, t in enumerate(texts)]
    places, sizes, rows = check(spark, texts)
    assert max(sizes) < 1.01 * min(sizes) and max(rows) < 1.15 * min(rows)
    assert len({places[i] for i in range(3000, 3100)}) == 1


def test_group_of_a_third_is_cut(spark):
    r = random.Random(8)
    texts = [f"{i} " * r.randrange(1, 60) for i in range(2000)] + ["copy of one text " * 5] * 1000
    _, sizes, rows = check(spark, texts)
    assert max(sizes) < 1.05 * min(sizes)


def test_odd_tables(spark):
    assert check(spark, [])[1] == [0] * 8
    check(spark, ["a"])
    docs = spark.createDataFrame([(1, "a", "en", "s", 0)] * 3 + [(None, None, None, None, None)], DOCS)
    out = sharding.shard(docs.withColumnRenamed("lang", "shard")).collect()
    assert len({(r.shard, r.slot) for r in out}) == 4
