"""Near-duplicates at five-word shingles and a similarity of 0.8: wide SimHash finds, exact Jaccard decides.

The pipeline's form of SimHash near-dedup. At that similarity 64-bit fingerprints differ
in about ten bits, too many for blocks of agreeing bits to find, so candidates meet in
other buckets: of ``BANDS`` bands of ``ROWS`` minhashes of the shingles, two texts of
similarity 0.8 share one except with odds of 1 in 90,000. Of these, pairs of fingerprints within
``RADIUS`` of 256 bits are candidates: 39 bits are expected at 0.8, 48 where the texts have but
four and five shingles, and the radius is almost four standard deviations beyond even these. A
candidate is a link if the Jaccard similarity of the sets of shingle hashes is ``SIMILARITY`` or
more. Groups are components of links: their members need not be 0.8 similar to the one that stays.

A text that a third of all others edit makes a group whose members are 0.6 similar to each other and
within ``RADIUS``. So each text also has a parity bitmap, where a shingle flips one of ``PARITY``
words of bits: shared shingles cancel, and the bits in which two bitmaps differ are at most the shingles that
only one text has. At similarity s these are at most (1 - s) / (1 + s) of both sizes, so the bound loses no link. In
texts of many thousand shingles it tells nothing, and the fingerprints decide alone who is a candidate.

Equal word sequences are one text throughout. In each bucket all texts are first compared
with one of them, the hub. Of the rest, texts that the links so far do not connect are compared
with each other, whether they link to the hub or not, so that each candidate pair is either
connected or checked, in the least of the buckets that they share. Buckets of over ``HOT`` texts are split into blocks, and
every pair of blocks is a key of its own. Fingerprints are compared as in simhash.py: bit-sliced, by carry-save
counters, a text with its hub in rows side by side and the texts of a key by shifts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .simhash import blocks, close_rows, components, near_rows, whole_buckets

SHINGLE, BANDS, ROWS, LANES, RADIUS = 5, 16, 3, 4, 72
SIMILARITY = 0.8
#: Words of a parity bitmap.
PARITY = 16
#: Texts in a block of a bucket, and parts of the pairs of one text when their texts are joined.
HOT, PARTS = 2048, 16
#: Shingle hashes that a worker keeps for the next pairs.
CACHE_HASHES = 1_000_000
#: Candidates that a worker holds before it hands them on.
PAIRS = 100_000

U = np.uint64
ODD = (np.random.default_rng(42).integers(1, 1 << 62, BANDS * ROWS + LANES, dtype=np.uint64) << U(1)) | U(1)

SIGNATURE = "text_key long, fp array<long>, bands array<long>"


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingles(text: str | None) -> tuple[bytes, np.ndarray]:
    """(the word sequence, its distinct shingle hashes in order)."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    n = len(words)
    if n <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 7)], U)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts = [joined[a:b] for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]
        hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(7)), U, n - SHINGLE + 1))
    return joined, hashes


def signature(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(key of the word sequence, fingerprint, bands)."""
    joined, hashes = shingles(text)
    total = len(hashes)
    lanes = np.empty(LANES, U)
    for k in range(LANES):
        own = np.pad(_spread(hashes * ODD[-1 - k]), (0, -total % 255)).astype("<u8")
        bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, 255, 64)
        ones = bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        lanes[k] = np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]
    least = np.array([_spread(hashes * ODD[k]).min() for k in range(BANDS * ROWS)], U).reshape(BANDS, ROWS)
    bands = _spread(least[:, 0] + _spread(least[:, 1] + _spread(least[:, 2] + np.arange(BANDS, dtype=U))))
    return xxhash.xxh64_intdigest(joined, 11), lanes, bands


def signatures(text: Column) -> Column:
    @F.pandas_udf(SIGNATURE)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [signature(t) for t in part]
            yield pd.DataFrame(
                {
                    "text_key": np.array([r[0] for r in rows], U).view(np.int64),
                    "fp": [r[1].view(np.int64) for r in rows],
                    "bands": [r[2].view(np.int64) for r in rows],
                }
            )

    return run(text)


def sketch(text: str | None) -> tuple[int, np.ndarray]:
    """(number of distinct shingles, parity bitmap)."""
    hashes = shingles(text)[1]
    bits = np.bincount((_spread(hashes * ODD[0]) % U(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return len(hashes), np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def sketches(text: Column) -> Column:
    @F.pandas_udf("size int, parity array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [sketch(t) for t in part]
            yield pd.DataFrame({"size": np.array([r[0] for r in rows], np.int32), "parity": [r[1].view(np.int64) for r in rows]})

    return run(text)


class Texts(NamedTuple):
    """Distinct texts: ``prints`` (text_key, fp, bands), cheap to read, and ``content`` (text_key, text)."""

    prints: DataFrame
    content: DataFrame


def _similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[int, np.ndarray] = {}
    held = 0
    for part in parts:
        keep = np.zeros(len(part), bool)
        for i, pair in enumerate(zip(part["a"], part["a_text"], part["b"], part["b_text"])):
            sets = []
            for key, text in (pair[:2], pair[2:]):
                own = known.get(key)
                if own is None:
                    own = shingles(text)[1]
                    held += len(own)
                    if held > CACHE_HASHES:
                        known, held = {}, len(own)
                    known[key] = own
                sets.append(own)
            less, more = sorted(map(len, sets))
            if less >= SIMILARITY * more:
                common = len(np.intersect1d(*sets, assume_unique=True))
                keep[i] = common >= SIMILARITY * (less + more - common) - 1e-9
        yield part.loc[keep, ["a", "b"]]


def verified(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose texts are similar."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    own = cut(content.join(nodes, "text_key", "left_semi").select("text_key", "text"))
    text = lambda x: own.select(F.col("text_key").alias(x), F.col("text").alias(f"{x}_text"))
    # a hub has many pairs: its text is laid beside each part of them
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)))
    hubs = parted.select("b", "part").distinct().join(text("b"), "b")
    joined = parted.join(text("a"), "a").join(hubs, ["b", "part"])
    return joined.select("a", "a_text", "b", "b_text").mapInPandas(_similar, "a long, b long")


def _near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, a_fp, b, b_fp) whose fingerprints are within the radius."""
    for part in parts:
        if part.num_rows:
            x, y = (part.column(c).flatten().to_numpy().view(U).reshape(-1, LANES) for c in ("a_fp", "b_fp"))
            yield part.select(["a", "b"]).filter(pa.array(near_rows(x, y, RADIUS)))


def _met(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of the rows of ``crossing``, which come sorted by bucket."""
    stack = lambda column: np.stack(column.to_numpy())
    for frame, sizes in whole_buckets(parts):
        key, band, block, own, root = (frame[c].to_numpy() for c in ("text_key", "band", "block", "own", "root"))
        fp = stack(frame["fp"]).view(U)
        known = "parity" in frame
        if known:
            bands, parity, size = stack(frame["bands"]), stack(frame["parity"]).view(U), frame["size"].to_numpy()
        found, held = [], 0
        for rows, members in blocks(sizes):
            for x, y in close_rows(fp[rows], members, RADIUS):
                x, y = rows[x], rows[y]
                may = (root[x] != root[y]) & (own[x] | (block[x] != block[y]))
                x, y = x[may], y[may]
                if known:
                    lone = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
                    may = lone * (1 + SIMILARITY) <= (size[x] + size[y]) * (1 - SIMILARITY) + 1e-6
                    x, y = x[may], y[may]
                    shared = (bands[x][:, :, None] == bands[y][:, None, :]).any(axis=2)
                    may = np.where(shared, bands[x], np.iinfo(np.int64).max).min(axis=1) == band[x]
                    x, y = x[may], y[may]
                found.append(np.sort([key[x], key[y]], axis=0))
                held += len(x)
                if held > PAIRS:
                    yield pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b"])
                    found, held = [], 0
        if held:
            yield pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b"])


def _mixed(rows: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets of ``rows`` that hold more than one root."""
    seen = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return seen.where("low <> high").select("bucket", "n")


def crossing(rows: DataFrame, hot: int = HOT, known: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, once or more: candidates of a bucket, of ``rows`` (bucket, text_key, fp, root), with different roots.

    With ``known`` (text_key, bands, size, parity) of these texts, each once, and without those that cannot be similar.
    """
    mixed = cut(_mixed(rows).select("bucket", F.ceil(F.col("n") / hot).cast("int").alias("blocks")))
    placed = rows.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("text_key"), "blocks").cast("int"))
    columns = ["text_key", "fp", "root"]
    if known is not None:
        placed, columns = placed.join(known, "text_key"), [*columns, "bands", "size", "parity"]
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    # the hash stands for (bucket, block, block): should two meet, their rows are only compared in vain
    dealt = placed.select(meeting.alias("bucket"), F.col("bucket").alias("band"), "block", (F.col("block") == F.col("other")).alias("own"), *columns)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_met, "a long, b long")


def edges(texts: Texts, hot: int = HOT) -> DataFrame:
    """(a, b): links with the components of all links among ``texts``, distinct by key."""
    prints = texts.prints
    rows = cut(prints.select("text_key", "fp", F.explode("bands").alias("bucket")))
    # written, so that joins with a skewed bucket can be split
    hubs = cut(
        rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "fp")).alias("hub"))
        .where("n > 1").select("bucket", F.col("hub.text_key").alias("hub"), F.col("hub.fp").alias("hub_fp"))
    )
    near = rows.join(hubs, "bucket").where("text_key <> hub")
    near = near.select(F.col("text_key").alias("a"), F.col("fp").alias("a_fp"), F.col("hub").alias("b"), F.col("hub_fp").alias("b_fp"))
    near = cut(near.mapInArrow(_near, "a long, b long").distinct())
    stars = cut(verified(near, texts.content))
    roots = cut(components(stars))
    shared = rows.join(hubs.select("bucket"), "bucket").join(roots, F.col("text_key") == F.col("node"), "left")
    shared = cut(shared.select("bucket", "text_key", "fp", F.coalesce("root", "text_key").alias("root")))
    # both written, so that the join with a skewed bucket can be split
    shared = cut(shared.join(cut(_mixed(shared)).select("bucket"), "bucket"))
    nodes = shared.select("text_key").distinct()
    content = cut(texts.content.join(nodes, "text_key", "left_semi").select("text_key", "text", sketches(F.col("text")).alias("s")))
    known = content.select("text_key", "s.*").join(prints.select("text_key", "bands"), "text_key")
    cross = crossing(shared, hot, known).distinct()
    # a hub is the lesser key of its pairs
    cross = cut(cross.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
    return stars.unionByName(verified(cross, content)).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that stay when each group keeps its row of the least doc_id.

    Null and empty texts are equal texts; of rows without a doc_id one stays only if no other row of its group
    has one; of repeated rows one stays.
    """
    columns = docs.columns
    rows = cut(docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), signatures(docs["text"]).alias("s")))
    rows = rows.select("doc", "doc_id", "row", "s.*")
    texts = cut(rows.groupBy("text_key").agg(F.min_by(F.struct("fp", "bands"), "row").alias("s"), F.min("row").alias("row")).select("text_key", "row", "s.*"))
    content = texts.select("text_key", "row").join(rows.select("row", F.col("doc")["text"].alias("text")), "row")
    roots = cut(components(edges(Texts(texts.drop("row"), content))))
    linked = cut(rows.select("text_key", "row", "doc_id").join(roots, F.col("text_key") == F.col("node"), "left").select(F.coalesce("root", "text_key").alias("root"), "row", "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))["row"]
    stay = cut(linked.groupBy("root").agg(first.alias("stay"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "stay"))
    gone = linked.join(stay, "root").where("row <> stay").select("row")
    return rows.join(gone, "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in columns])
