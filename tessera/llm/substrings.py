"""Substring dedup: repeated 35-word windows by compressed FM-indexes per shard.

A window's anchor is the least hash among its ``GRAM``-word grams, leftmost first, so
equal windows have equal anchors at equal offsets. Consecutive windows of a document
with one anchor position form a segment (at most 62 words). Shards are sets of anchors:

1. Each document gives one row for each distinct segment, with the list of its starts.
   Anchors that occur once in the corpus cannot hold a repeated window and go (a count,
   pre-aggregated, then a join).
2. Equal segments are counted, and one of each is kept with the place of one occurrence.
   Only for these is text fetched, one shuffle of the documents.
3. Each task builds FM-indexes (suffix array, BWT, wavelet matrix of packed bits with
   popcount ranks) over blocks of about ``BLOCK`` words of its shard and streams the block's
   segments through backward search. A step prepends one word to all current matches at once;
   where what is left occurs once only, the match is cut at its right end to its parent
   interval. The lengths so kept are the matching statistics, and starts where they reach
   ``WINDOW`` are reported as intervals. A suffix weighs as often as its segment occurs (twice
   at most), so exact copies need no second copy in the index.
4. An interval found holds for every occurrence of its segment.

An anchor of over ``HOT`` distinct segments (the edge of a passage in very many documents)
would make a shard too large. Its windows get anchors of their own, the hash of the
whole window, are counted like segments, and those that occur twice go to shards of
these anchors; equal windows still meet, however many there are.

Rows are known by 128 bits of the hash of doc_id and text. Rows that repeat both share
them, and have the same windows, each of which repeats those of the others. Texts are shuffled
by that key: to the segments that need text, and to the intervals found. Segment tables
are written to the shared folder.

Defined results: null and empty texts, and texts of under 35 words, lose nothing; an
empty result has the digest of the empty text; null doc_ids are as good as others; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

WINDOW, GRAM = 35, 8
#: Distinct segments of one anchor in a shard.
HOT = 1000
#: Words in one FM-index, and in one batch of documents.
BLOCK, BATCH = 1 << 18, 1 << 18

ODD = 0x9E3779B97F4A7C15
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each ``width`` consecutive values."""
    best, place, reach = values, np.arange(len(values), dtype=np.int32), 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(best) - step
        right = best[step:] < best[:n]
        best, place = np.where(right, best[step:], best[:n]), np.where(right, place[step:], place[:n])
        reach += step
    return place


def _batches(texts: list[bytes]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    rows, words, total = [], [], 0
    for i, text in enumerate(texts):
        own = text.split()
        if len(own) >= WINDOW:
            rows.append(i)
            words.append(own)
            total += len(own)
        if total > BATCH:
            yield rows, words
            rows, words, total = [], [], 0
    if rows:
        yield rows, words


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' distinct segments, one row a document."""
    inverse = pow(ODD, -1, 1 << 64)
    for batch in batches:
        for rows, words in _batches(batch.column("text").cast(pa.binary()).to_pylist()):
            sizes = np.array([len(w) for w in words])
            n = int(sizes.sum())
            up, down = _powers(ODD, n), _powers(inverse, n)
            sums = np.zeros(n + 1, U)
            np.cumsum(np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), U, n) * up, out=sums[1:])
            grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
            place = _lowest(grams, WINDOW - GRAM + 1)
            doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
            starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
            place = place[starts]
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(starts) != 1)]))
            windows = np.diff(np.concatenate([first, [len(starts)]]))
            begin = starts[first]
            content = _mix((sums[begin + windows + WINDOW - 1] - sums[begin]) * down[begin] + windows.astype(U))
            own, anchor = doc[begin], grams[place[first]]
            order = np.lexsort((content, anchor, own))  # stable: starts stay in order
            own, anchor, content, begin, windows = (x[order] for x in (own, anchor, content, begin, windows))
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
            at = (begin - (np.cumsum(sizes) - sizes)[own]).astype(np.int32)
            fields = {
                "anchor": pa.array(anchor[new].view(np.int64)),
                "content": pa.array(content[new].view(np.int64)),
                "windows": pa.array(windows[new].astype(np.int32)),
                "starts": pa.ListArray.from_arrays(pa.array(np.append(new, len(own)).astype(np.int32)), pa.array(at)),
            }
            ends = np.searchsorted(own[new], np.arange(len(rows) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([*fields.values()], [*fields]))
            keys = [batch.column(x).take(pa.array(rows)) for x in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays([*keys, lists], ["h1", "h2", "segments"])


class WaveletMatrix:
    """Ranks of symbols in a sequence, over one packed bit vector a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> shift & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bits, (0, 64 + -len(bits) % 64)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, packed, before, zeros))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.origin = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((U(1) << (at & 63).astype(U)) - U(1)))
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """Intervals of suffixes that begin with a pattern of up to ``depth`` positive symbols; symbol 0 ends every text."""

    def __init__(self, text: np.ndarray, weight: np.ndarray | None = None, depth: int = 64):
        n = self.size = len(text)
        symbols = int(text.max(initial=0)) + 1
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        ranks = [rank]  # by the first 1, 2, 4, ... symbols
        while reach < depth:
            after = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, n), np.int64)])[:n]
            key = rank * (n + symbols + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            ranks.append(rank)
            reach *= 2
            if rank[order[-1]] == n - 1:
                break
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        #: Weight of the suffixes before each place.
        self.weight = np.concatenate([[0], np.cumsum(np.ones(n, np.int64) if weight is None else weight[order])])
        common = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            own = np.append(ranks[k], np.full(2 * reach, -1))
            common += (own[order[:-1] + common] == own[order[1:] + common]) * (1 << k)
        #: Length of the common beginning of the suffix at a place and the one before.
        self.common = np.concatenate([[-1], common, [-1]]).astype(np.int16)
        place = np.arange(n + 1, dtype=np.int32)
        #: The nearest places on either side with a shorter one.
        self.left, self.right = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        for length in np.unique(common).tolist():
            less, at = self.common < length, self.common == length
            self.left[at] = np.maximum.accumulate(np.where(less, place, 0))[at]
            self.right[at] = np.minimum.accumulate(np.where(less, place, n)[::-1])[::-1][at]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval of many patterns that are not empty, and the length of their beginning it stands for."""
        a, b = self.common[low], self.common[high]
        return np.where(a >= b, self.left[low], low), np.where(b >= a, self.right[high], high), np.maximum(a, b).astype(np.int64)


def matching_statistics(texts: list[np.ndarray], twice: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (text, start, length): the longest matches from a start that occur twice among all texts, if ``least`` long.

    ``texts``: arrays of positive symbols; ``twice``: which of them count twice.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    offset = np.cumsum(sizes + 1) - sizes - 1
    for t, at in zip(texts, offset.tolist()):
        flat[at : at + len(t)] = t
    index = FMIndex(flat, np.repeat(np.where(twice, 2, 1), sizes + 1))
    q = np.flatnonzero(sizes >= least)
    # the match is what stands behind ``at``, up to ``end``
    end, at = sizes[q], sizes[q] - 1
    low, high = np.zeros(len(q), np.int64), np.full(len(q), index.size)
    while len(q):
        more_low, more_high = index.extend(flat[offset[q] + at], low, high)
        fits = index.weight[more_high] - index.weight[more_low] >= 2
        less_low, less_high, length = index.parent(low, high)
        alone = ~fits & (end == at + 1)  # the word itself occurs once
        low = np.where(fits, more_low, np.where(alone, 0, less_low))
        high = np.where(fits, more_high, np.where(alone, index.size, less_high))
        end = np.where(fits, end, np.where(alone, at, at + 1 + length))
        hit = fits & (end - at >= least)
        if hit.any():
            yield q[hit], at[hit], (end - at)[hit]
        at = at - (fits | alone)
        keep = (at >= 0) & (end >= least)
        if not keep.all():
            q, end, at, low, high = (x[keep] for x in (q, end, at, low, high))


def repeated_windows(texts: list[np.ndarray], twice: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) intervals of the starts whose window occurs twice among all texts."""
    found = [*matching_statistics(texts, twice, window)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    text, start = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(first[1:], len(text)) - 1
    return text[first], start[first], start[last]


def _match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals (anchor, content, first, last) of segments; rows come sorted by anchor and content."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[~frame.duplicated(["anchor", "content"])]  # rows that repeat doc_id and text
        words = [t.split(" ") for t in frame["text"]]
        codes, _ = pd.factorize(np.array(list(chain.from_iterable(words)), object))
        texts = np.split(codes + 1, np.cumsum([len(w) for w in words])[:-1])
        text, first, last = repeated_windows(texts, frame["twice"].to_numpy())
        own = frame[["anchor", "content"]].iloc[text]
        return own.assign(first=first.astype(np.int32), last=last.astype(np.int32))

    rest: pd.DataFrame | None = None
    limit = BLOCK // (WINDOW + 10)  # rows of about BLOCK words
    for part in parts:
        rest = part if rest is None else pd.concat([rest, part])
        anchor = rest["anchor"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        while len(rest) > 2 * limit and len(inner := cuts[(cuts > 0) & (cuts <= limit)]):
            yield block(rest.iloc[: inner[-1]])
            rest, cuts = rest.iloc[inner[-1] :], cuts - inner[-1]
    if rest is not None and len(rest):
        anchor = rest["anchor"].to_numpy()
        cuts = [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1), len(rest)]
        begin = 0
        for a, b in zip(cuts, [*cuts[1:], None]):
            if b is None or b - begin > limit:
                yield block(rest.iloc[begin:a])
                begin = a


#: Segments in a batch that leaves a task.
OUT_ROWS = 20_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, n, text) of the segments wanted of documents."""

    def out() -> pa.RecordBatch:
        keys = [pa.array(np.concatenate(x)) for x in zip(*done)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(texts, pa.binary()).cast(pa.string())], ["anchor", "content", "n", "text"])

    done, texts = [], []
    for batch in batches:
        column = batch.column("wanted")
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        wanted = column.flatten()
        keys = [wanted.field(x).to_numpy() for x in ("anchor", "content", "n")]
        start, windows = (wanted.field(x).to_numpy() for x in ("start", "windows"))
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words, own = text.split(), slice(ends[i], ends[i + 1])
            done.append([x[own] for x in keys])
            texts += [b" ".join(words[a : a + n + WINDOW - 1]) for a, n in zip(start[own].tolist(), windows[own].tolist())]
            if len(texts) > OUT_ROWS:
                yield out()
                done, texts = [], []
    if done:
        yield out()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and text: the hashes name a row, and rows that repeat it."""
    own, text = docs["doc_id"], docs["text"]
    return docs.select(own.alias("doc_id"), F.xxhash64(own, text).alias("h1"), F.xxhash64(F.lit(1), own, text).alias("h2"), text.alias("text"))


def repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(h1, h2, first, last): arrays of the intervals of starts of repeated windows."""
    keyed = _keyed(docs)
    long = keyed.where(F.length("text") >= 2 * WINDOW - 1).select("h1", "h2", "text")
    packed = cut(long.mapInArrow(_segments, "h1 long, h2 long, segments array<struct<anchor:long,content:long,windows:int,starts:array<int>>>"))
    rows = packed.select("h1", "h2", F.explode("segments").alias("s")).select("h1", "h2", "s.*")
    n = F.sum(F.size("starts")).alias("n")
    # Written, as Spark splits a skewed join only if each side has a shuffle of its own.
    shared = cut(rows.groupBy("anchor").agg(n).where("n > 1").select("anchor"))
    kept = cut(rows.join(shared, "anchor", "left_semi"))
    # any occurrence will do, and the table is written: it stays the same one
    place = [F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first(F.col("starts")[0]).alias("start")]
    distinct = cut(kept.groupBy("anchor", "content", "windows").agg(n, *place))
    crowded = cut(distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    fields = F.struct("anchor", "content", "start", "windows", "n")
    wanted = cut(distinct.groupBy("h1", "h2").agg(F.collect_list(fields).alias("wanted")))
    pieces = cut(long.join(wanted, ["h1", "h2"]).select("text", "wanted").mapInArrow(_pieces, "anchor long, content long, n long, text string"))
    crowd = cut(pieces.join(crowded, "anchor", "left_semi").select("anchor", "content", "n", F.split("text", " ").alias("words")).distinct())
    window = lambda at: F.slice("words", at + 1, WINDOW)
    codes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda at: F.xxhash64(window(at)))
    single = cut(crowd.select("anchor", "content", "n", F.posexplode(codes).alias("at", "code")))
    again = single.groupBy("code").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("anchor", "content", "at")]).where("n > 1")
    alone = crowd.drop("n").join(cut(again), ["anchor", "content"]).select(F.col("code").alias("anchor"), F.col("code").alias("content"), "n", F.array_join(window(F.col("at")), " ").alias("text"))
    dealt = pieces.join(crowded, "anchor", "left_anti").unionByName(alone).select("anchor", "content", (F.col("n") > 1).alias("twice"), "text")
    found = cut(dealt.repartition("anchor").sortWithinPartitions("anchor", "content").mapInPandas(_match, "anchor long, content long, first int, last int"))
    own = found.where("anchor = content").select(F.col("anchor").alias("code")).distinct()
    found = found.unionByName(single.join(own, "code", "left_semi").select("anchor", "content", F.col("at").alias("first"), F.col("at").alias("last")))
    parts = cut(found.groupBy("anchor", "content").agg(F.collect_set(F.struct("first", "last")).alias("parts")))
    each = lambda s: F.transform("parts", lambda p: F.struct((s + p["first"]).alias("first"), (s + p["last"]).alias("last")))
    gone = kept.join(parts, ["anchor", "content"]).select("h1", "h2", F.flatten(F.transform("starts", each)).alias("gone"))
    gone = gone.groupBy("h1", "h2").agg(F.flatten(F.collect_set("gone")).alias("gone"))
    return gone.select("h1", "h2", F.col("gone.first").alias("first"), F.col("gone.last").alias("last"))


def _outcome(docs: DataFrame, result: str, make) -> DataFrame:
    """doc_id and ``make(words, kept words)`` of every row."""
    found = repeated(docs).withColumnsRenamed({"h1": "own_h1", "h2": "own_h2"})

    @F.pandas_udf(result)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, lasts in parts:
            out = []
            for text, first, last in zip(texts, firsts, lasts):
                words = text.encode().split() if text else []
                kept = words
                if first is not None:
                    lost = np.zeros(len(words) + 1, np.int64)
                    np.add.at(lost, first, 1)
                    np.add.at(lost, last + WINDOW, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(lost[:-1]) == 0).tolist()]
                out.append(make(words, kept))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in result.split(", ")])

    keyed = _keyed(docs)
    joined = keyed.join(found, (keyed["h1"] == found["own_h1"]) & (keyed["h2"] == found["own_h2"]), "left")
    return joined.select("doc_id", run("text", "first", "last").alias("out")).select("doc_id", "out.*")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the text that is left, words joined by one space."""
    return _outcome(docs, "n_words long, n_removed long, text string", lambda w, k: (len(w), len(w) - len(k), b" ".join(k).decode()))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the text that is left."""
    return _outcome(docs, "n_words long, n_removed long, kept_sha256 string", lambda w, k: (len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()))
