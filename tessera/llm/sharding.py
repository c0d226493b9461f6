"""Sharding by vector bin packing.

Groups are equal texts. Bytes, tokens and rows are balanced jointly, and sizes come
out near equal (law ``bytes``): atoms are placed, largest first, each in the shard
where the dot product of its vector with the residual capacity is highest among
those that it fits, or highest at all if it fits none. Where tokens and rows have kept
bytes apart, atoms then move from the fullest to the emptiest shard.

Atoms are bounded in number whatever the data. A group over a
``1 / (SHARDS * LARGE)`` part of any total is an atom; there are at most
``3 * SHARDS * LARGE`` of those. All other groups meet in ``ATOMS`` atoms by the
hash of their text. Only the atoms' vectors reach the driver, and their places
travel back as a table of that size. Equal texts share a shard, except that a
group over a whole shard's capacity is cut into pieces by the hash of a row number, as no
packing could balance it otherwise.

Slots number each shard's rows from 0: rows are ranked within ``(shard, part)``,
parts being hashes of the row number whose count grows with the rows, and the parts' sizes
give each its offset. No task holds a shard, even if one doc_id or text holds a third of
the rows. The row number is written with the rows, so it holds when tasks are repeated.

Defined results: a null text has size 1 and is a group of its own, the empty text
another of the same size; repeated rows get slots of their own; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SHARDS = 8
ATOMS, LARGE = 4096, 16
#: Rows of a slot part, on average.
PART_ROWS = 20_000
#: Gap in bytes between shards, of their mean, that is left alone.
EVEN = 0.002
DIMENSIONS = ("size", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (atoms x dimensions)."""
    total = np.maximum(vectors.sum(axis=0), 1)
    share = vectors / total * shards  # a shard's capacity is 1 in each dimension
    residual = np.ones((shards, vectors.shape[1]))
    places = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((*vectors.T[::-1], -share.max(axis=1))).tolist():
        fits = (residual >= share[i] - 1e-12).all(axis=1)
        gain = residual @ share[i]
        places[i] = np.where(fits, gain, -np.inf).argmax() if fits.any() else gain.argmax()
        residual[places[i]] -= share[i]
    # Bytes are the law: move what halves the gap between the fullest and the emptiest shard.
    size = vectors[:, 0]
    for _ in range(100 * shards):
        full = np.bincount(places, size, minlength=shards)
        gap = full.max() - full.min()
        movable = np.flatnonzero((places == full.argmax()) & (size < gap) & (size > 0))
        if gap <= EVEN * full.mean() or not len(movable):
            break
        places[movable[np.abs(size[movable] - gap / 2).argmin()]] = full.argmin()
    return places


def _group(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text, F.length(text)), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = docs["text"]
    spaces = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in " \n"), F.lit(0))
    rows = cut(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.when(text.isNull(), 0).otherwise(spaces + 1).cast("long").alias("tokens"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            _group(text).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("size", "tokens")] + [F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    groups = rows.groupBy("text_key").agg(*sums)
    parts = [F.col(x) / F.lit(float(max(1, total[x]))) * shards for x in DIMENSIONS]
    large = cut(groups.where(F.greatest(*parts) > 1 / LARGE).withColumn("pieces", F.greatest(F.lit(1), F.when(F.greatest(*parts) > 1, F.ceil(F.greatest(*parts) * 4)).otherwise(1)).cast("int")))
    # at most 3 * shards * LARGE rows
    keyed = rows.join(F.broadcast(large.select("text_key", "pieces")), "text_key", "left")
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    atom = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(ATOMS))).otherwise(F.xxhash64("text_key", piece))
    keyed = keyed.withColumn("atom", F.struct(F.col("pieces").isNotNull().alias("own"), atom.alias("id")))
    atoms = keyed.groupBy("atom").agg(*sums).orderBy("atom").collect()
    places = pack(np.array([[a[x] for x in DIMENSIONS] for a in atoms], float).reshape(-1, 3), shards).tolist()
    spark = docs.sparkSession
    placed = spark.createDataFrame([(a["atom"]["own"], a["atom"]["id"], p) for a, p in zip(atoms, places)], "own boolean, id long, shard int")
    keyed = keyed.select("doc_id", "size", "text_crc32", "row", F.col("atom.own").alias("own"), F.col("atom.id").alias("id"))
    number = max(1, -(-total["rows"] // PART_ROWS))
    put = keyed.join(F.broadcast(placed), ["own", "id"]).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(number)))
    counts = put.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    ranked = put.withColumn("rank", rank).join(offsets, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
