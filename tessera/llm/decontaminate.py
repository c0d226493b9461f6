"""Benchmark decontamination: rare words of the items as seeds, then Smith-Waterman alignment.

Words are lower-cased letter and digit runs. The alignment scores match 4, mismatch and gap
-1, so that matches beyond a few edits still count. Similarity is the
share of the item's words that the best alignment matches; ``SIMILARITY`` and
more counts as a leak.

A leak matches ``need`` words of an item of n, so a document without ``SEEDS`` of its ``n - need + SEEDS``
rarest words holds none. Of the other documents those go on that hold ``need`` of the item's words at all, and in them
only stretches where ``need`` such words lie within ``REACH`` n words are aligned: as each word inserted or changed costs a
quarter of a match, no alignment is longer. All three are necessary conditions, however the edits
are spread, so no leak is lost before it is aligned.

Items go to the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the
documents a block: documents are never shuffled and the broadcast is bounded
however large the benchmark is. Texts are handled whole.

Defined results: null and empty texts and items give no pairs, nor do items of
fewer than ``LEAST_WORDS`` words; repeated documents give their pairs once each
row, repeated items once a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = 3
REACH = 5
#: Words of a stretch that are aligned at once, unless the item needs more.
PIECE = 10_000
SIMILARITY = 0.8
MATCH = 4
LEAST_WORDS = 5
BLOCK_BYTES = 8 << 20

WORD = re.compile(r"[^\W_]+")
PAIRS = "array<struct<item:long,similarity:double,start_word:int,end_word:int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment of ``item`` in ``passage``."""
    n, m = len(item), len(passage)
    score = np.zeros((n + 1, m + 1), np.int32)
    offset = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1] - 1, 0)
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + np.where(passage == item[i - 1], MATCH, -1))
        score[i] = np.maximum(np.maximum.accumulate(row + offset) - offset, 0)  # gaps in the item
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    i, j, end, matched = int(i), int(j), int(j), 0
    while i and j and score[i, j]:
        same = item[i - 1] == passage[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else -1):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return matched, j, end


@dataclass
class Seeds:
    """A block of items, ready to be looked for."""

    items: list[tuple[int, str]]
    ids: list[int] = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    need: list[int] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for item_id, text in dict.fromkeys(self.items):
            words = words_of(text)
            if len(words) < LEAST_WORDS:
                continue
            self.ids.append(item_id)
            self.texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
            self.need.append(math.ceil(SIMILARITY * len(words) - 1e-9))
        self.counts = [np.unique(own, return_counts=True) for own in self.texts]
        shared = np.zeros(len(self.vocabulary) + 1, np.int64)
        for own, _ in self.counts:
            shared[own] += 1
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, own in enumerate(self.texts):
            rarest = own[np.lexsort((own, shared[own]))][: len(own) - self.need[i] + SEEDS]
            for word, n in Counter(rarest.tolist()).items():
                self.places[word].append((i, n))
        self.seed = np.zeros(len(self.vocabulary) + 1, bool)
        self.seed[[*self.places]] = True

    def stretches(self, item: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """The parts of a document, in pieces, that hold every alignment matching enough of an item."""
        need, reach = self.need[item], REACH * len(self.texts[item])
        at = np.flatnonzero(np.isin(own, self.counts[item][0]))
        last = at[need - 1 :]
        first = at[: len(last)]
        close = last - first < reach
        first, last = first[close], last[close]
        new = np.flatnonzero(first[1:] > last[:-1]) + 1
        piece = max(PIECE, 4 * reach)
        for low, high in zip(first[np.r_[0, new]].tolist(), last[np.r_[new - 1, -1]].tolist()) if len(first) else ():
            for start in range(low, max(low + 1, high + 1 - reach), piece - reach):
                yield start, min(high + 1, start + piece)

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        words = words_of(text)
        if len(words) < LEAST_WORDS - 1 or not self.ids:
            return []
        known = self.vocabulary
        own = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        hits: dict[int, int] = defaultdict(int)
        for word in set(own[self.seed[own]].tolist()):
            for item, n in self.places[word]:
                hits[item] += n
        likely = [item for item, n in hits.items() if n >= SEEDS]
        if not likely:
            return []
        held = np.bincount(own, minlength=len(known) + 1)
        best: dict[int, tuple[int, float, int, int]] = {}
        for item in likely:
            target, need = self.texts[item], self.need[item]
            distinct, counts = self.counts[item]
            if np.minimum(counts, held[distinct]).sum() < need:
                continue
            for low, high in self.stretches(item, own):
                matched, a, b = align(target, own[low:high])
                found = (self.ids[item], matched / len(target), low + a, low + b)
                if matched >= need and (found[0] not in best or found[1] > best[found[0]][1]):
                    best[found[0]] = found
        return sorted(best.values())


def _find(text: Column, items: list[tuple[int, str]]) -> Column:
    @F.pandas_udf(PAIRS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = Seeds(items)
        for part in parts:
            yield pd.Series([[dict(zip(("item", "similarity", "start_word", "end_word"), p)) for p in seeds.find(t)] for t in part])

    return run(text)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    items = benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    number = -(-total * 2 // block_bytes)  # half full on average
    for k in range(number):
        yield sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).collect())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and word range of every leaked pair."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    found = None
    for items in blocks(benchmark):
        pairs = docs.select("doc_id", F.explode(_find(F.col("text"), items)).alias("p"))
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = docs.where("false").select("doc_id", F.explode(F.expr(f"cast(null as {PAIRS})")).alias("p"))
    return found.select("doc_id", F.col("p.item").alias("item_id"), "p.similarity", "p.start_word", "p.end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no passage of the benchmark."""
    for items in blocks(benchmark):
        docs = docs.where(F.size(_find(docs["text"], items)) == 0)
    return docs
