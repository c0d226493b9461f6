"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's
3-word shingles. Fingerprints at ``RADIUS`` or fewer differing bits link;
components of links are groups of near-duplicates.

Candidates: of four 16-bit blocks at most two hold a differing bit, so two
linked fingerprints agree on at least one of the six pairs of blocks. Rows are
shuffled by those 32 bits. A bucket of over ``HOT`` fingerprints is dealt anew by
a third of its free bits (two differing bits leave one third alone), at most
twice; after that at most 14 bits are free, so a bucket is bounded whatever
the data, and no link is lost.

Within buckets, bit planes lie vertically in 64-bit words. A shift of all
planes by s compares each row with the one s further on; carry-save counters
add the differing bits of 64 rows at a time, for up to 64 shifts together, which are abandoned once all
counters exceed the radius. A bucket yields a star of edges for each group in
it, not its pairs. Stars then meet in rounds of large-star and small-star
joins, each written to the shared folder.

Defined results: null and empty texts have fingerprint zero, which links like any
other; under three words the whole sequence is the only shingle; a null doc_id
never names a component unless the component has no other; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

RADIUS = 2
SEED = 42
#: Fingerprints in a bucket before it is dealt anew by more bits.
HOT = 2048


def fingerprint_of(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < 3:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[: n - 2].tolist(), ends[2:].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n - 2)
    total = len(hashes)
    bits = np.unpackbits(np.pad(hashes, (0, -total % 255)).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 255, 64)
    ones = bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """Column: fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint_of(t) for t in part], np.uint64).astype(np.int64))

    return run(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> tuple[list[int], dict[int, list[int]]]:
    """Masks of agreeing bits: the six first ones, and the three finer ones of each."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    first = [a | b for a, b in combinations(blocks, 2)]
    finer: dict[int, list[int]] = {}

    def refine(mask: int, depth: int) -> None:
        free = [i for i in range(64) if not mask >> i & 1]
        finer[_signed(mask)] = []
        for part in (free[0::3], free[1::3], free[2::3]):
            new = mask | sum(1 << i for i in part)
            finer[_signed(mask)].append(_signed(new))
            if depth:
                refine(new, depth - 1)

    for mask in first:
        refine(mask, 1)
    return [_signed(m) for m in first], finer


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of uint64 words: a row of words for each bit, 64 of the rows in a word, and two words of zeros."""
    n = len(values)
    bits = np.packbits(np.unpackbits(np.ascontiguousarray(values).astype("<u8").view(np.uint8), axis=1, bitorder="little").T, axis=1, bitorder="little")
    planes = np.zeros((len(bits), (n // 64 + 3) * 8), np.uint8)
    planes[:, : bits.shape[1]] = bits
    return planes.view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odd = a ^ b
    return odd ^ c, (a & b) | (odd & c)


def over_radius(differing: Iterable[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """``over`` and the places that are set in more than ``radius`` of the ``differing`` planes, by carry-save counters."""
    # counters start so high that the first bit beyond the radius overflows them
    depth = (radius + 1).bit_length()
    head = (1 << depth) - 1 - radius
    counters = [np.full(over.shape, ALL if head >> k & 1 else 0, np.uint64) for k in range(depth)]
    saved: list[np.ndarray | None] = [None] * min(depth, SAVED)
    for carry in differing:
        for k in range(depth):
            if k >= len(saved):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            elif saved[k] is None:
                saved[k] = carry
                break
            else:
                counters[k], carry = _add(counters[k], saved[k], carry)
                saved[k] = None
        else:
            over = over | carry
            if (over == ALL).all():
                return over
    carry = np.zeros_like(over)
    for k in range(depth):
        left = saved[k] if k < len(saved) else None
        counters[k], carry = _add(counters[k], np.zeros_like(over) if left is None else left, carry)
    return over | carry


def near_rows(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether each row of ``x`` is within the radius of the row of ``y`` beside it."""
    planes = planes_of(x ^ y)
    over = over_radius(planes, np.zeros(planes.shape[1], np.uint64), radius)
    return np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(x)].astype(bool)


def close_rows(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): rows x < y of one bucket within the radius; each pair once, the pairs of a shift together.

    ``values``: uint64 fingerprints (or rows of several words), bucket after bucket, of ``sizes`` rows each.
    """
    n = len(values)
    planes = planes_of(values.reshape(n, -1))
    room = np.zeros(planes.shape[1] * 64, np.int64)
    room[:n] = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # rows from here to the bucket's end
    every = np.packbits(np.arange(len(room)) < n, bitorder="little").view("<u8")
    planes = planes[(planes != 0).any(axis=1) & (planes != every).any(axis=1)]  # planes in which the rows differ
    reach = int(sizes.max(initial=1))
    for off in range((reach + 63) // 64):
        first = int(off == 0)
        shift = np.arange(first, min(64, reach - 64 * off), dtype=np.uint64)[:, None]
        if not len(shift):
            continue
        width = n // 64 + 1 - off
        valid = room[: 64 * width] > 64 * off + shift.astype(np.int64)
        over = ~np.packbits(valid, axis=1, bitorder="little").view("<u8")  # rows without a partner count as too far
        back = np.uint64(64) - shift
        differing = (p[:width] ^ ((p[off : off + width] >> shift) | (p[off + 1 : off + 1 + width] << back)) for p in planes)
        over = over_radius(differing, over, radius)
        for k in np.flatnonzero((over != ALL).any(axis=1)):
            hit = np.flatnonzero(np.unpackbits((~over[k]).view(np.uint8), bitorder="little"))
            yield hit, hit + (64 * off + first + k)


def linked_rows(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the values, the first row of its linked group within its bucket (``values``, ``sizes``: as in ``close_rows``)."""
    parent = np.arange(len(values))
    for first, second in close_rows(values, sizes, radius):
        a, b = parent[first], parent[second]
        apart = a != b
        if apart.any():
            for x, y in set(zip(a[apart].tolist(), b[apart].tolist())):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return parent


#: Rows compared in one bit-sliced block.
BLOCK = 1 << 15
#: Counters that save a carry until there are two.
SAVED = 3
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def whole_buckets(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, sizes): whole buckets of more than one row, of parts that come sorted by ``bucket``."""

    def whole(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        bucket = frame["bucket"].to_numpy()
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(frame)]]))
        if (sizes > 1).any():
            yield frame[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]

    rest: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        bucket = part["bucket"].to_numpy()
        others = np.flatnonzero(bucket != bucket[-1])
        upto = int(others[-1]) + 1 if len(others) else 0
        if rest and bucket[0] != rest[-1]["bucket"].iloc[-1]:
            yield from whole(pd.concat(rest))
            rest = []
        if upto:
            yield from whole(pd.concat([*rest, part.iloc[:upto]]))
            rest = []
        rest.append(part.iloc[upto:])
    if rest:
        yield from whole(pd.concat(rest))


def blocks(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, sizes): the rows of buckets of like sizes, so that most rows take few shifts."""
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    done = 0
    while done < len(sizes):
        upto = max(done + 1, int(np.searchsorted(ends, starts[done] + BLOCK, "right")))
        order = done + np.argsort(-sizes[done:upto], kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(np.ceil(np.log2(sizes[order]))) != 0) + 1):
            yield np.concatenate([np.arange(starts[g], ends[g]) for g in group]), sizes[group]
        done = upto


def bucket_edges(radius: int = RADIUS):
    """A function for mapInPandas: stars (a, b) of the linked groups of buckets.

    Rows (bucket, text_key, fp) come sorted by bucket; ``fp`` is an array of longs, and
    the text_key is what the edges name.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sizes in whole_buckets(parts):
            keys, values = frame["text_key"].to_numpy(), np.stack(frame["fp"].to_numpy()).view(np.uint64)
            for rows, own in blocks(sizes):
                root = linked_rows(values[rows], own, radius)
                away = root != np.arange(len(rows))
                yield pd.DataFrame({"a": keys[rows][away], "b": keys[rows][root[away]]})

    return run


def star_edges(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) among the distinct ``fp`` of ``prints`` with the same components as all links."""
    first, finer = _masks()
    rows = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in first])).alias("mask"))
    rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    children = F.create_map(*[x for m, c in finer.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in c]))])
    ready = None
    for last in (False, False, True):
        if last:
            cold = rows
        else:
            crowd = rows.groupBy("mask", "part").count().where(F.col("count") > hot).select("mask", "part")
            cold = rows.join(crowd, ["mask", "part"], "left_anti")
            warm = rows.join(crowd, ["mask", "part"], "left_semi")
            rows = warm.select("fp", F.explode(children[F.col("mask")]).alias("mask"))
            rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        ready = cold if ready is None else ready.unionByName(cold)
    # the hash stands for (mask, part): should two meet, their rows are only compared in vain
    dealt = ready.select(F.xxhash64("mask", "part").alias("bucket"), F.col("fp").alias("text_key"), F.array("fp").alias("fp"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "text_key")
    return dealt.mapInPandas(bucket_edges(), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that reaches a lesser one: the least of these."""
    edges = cut(edges)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def named(prints: DataFrame) -> DataFrame:
    """(own, component_id) of every distinct ``fp`` of ``prints`` (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(star_edges(distinct.select("fp")))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(ids, "root").select(F.col("fp").alias("own"), "component_id")


def link(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp, ...), cheap to read twice, with the ``component_id`` of each row."""
    groups = named(prints)
    return prints.join(groups, prints["fp"] == groups["own"]).drop("own")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), fingerprint(docs["text"]).alias("fp")))
    return link(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
