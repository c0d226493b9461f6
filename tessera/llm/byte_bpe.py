"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash (hash and displace) maps every pre-token that is
itself a vocabulary entry straight to its rank; a slot's stored bytes are
compared, so strangers fall through. Tier 2: a stranger's bytes become a linked
list, and a heap of (rank, position) pairs applies the merges lowest rank first.

Both tiers run inside Arrow-batched tasks. Every task builds the tables from
the vocabulary file, whose path is a parameter; nothing is shuffled and each
text is handled whole. A worker keeps the ids of words it has met in two
dictionaries of about ``CACHE_WORDS`` entries each; when the younger is full it
takes the place of the older.

Defined results: null and empty texts give no ids (and an empty decoding);
repeated rows are encoded each by itself; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in one generation of a Python worker's cache.
CACHE_WORDS = 300_000
#: Keys per displacement bucket of the perfect hash, on average.
BUCKET = 4

#: Rows of a result batch.
OUT_ROWS = 500

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space that decides its split as a whole.
LONG_SPACE = re.compile(r"\s\s+")


def long_runs(text: str) -> list[list[int]]:
    """Stretches around runs of white space, cut where a single space stands between words."""
    out: list[list[int]] = []
    for m in LONG_SPACE.finditer(text):
        if out and m.start() < out[-1][1]:
            start = out.pop()[0]
        else:
            start = max(out[-1][1] if out else 0, text.rfind(" ", out[-1][1] if out else 0, m.start()))
        end = text.find(" ", m.end())
        out.append([start, len(text) if end < 0 else end])
    return out


def _words(text: str) -> list[str]:
    """Cut before every space; with single spaces each begins a pre-token."""
    first, *rest = text.split(" ")
    return [first] * bool(first) + [" " + w for w in rest]


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // BUCKET)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        #: Per bucket a displacement, or -1 - slot where the bucket has one key.
        self.shift = np.zeros(self.buckets, np.int64)
        free: Iterator[int] | None = None
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if size > 1:
                own, d = hashes[order[starts[b] : starts[b] + size]], 0
                while True:
                    at = np.sort(self._slot(own, np.arange(d, d + 32, dtype=np.uint64)[:, None]), axis=1)
                    fit = ~(taken[at].any(axis=1) | (at[:, 1:] == at[:, :-1]).any(axis=1))
                    if fit.any():
                        break
                    d += 32
                k = int(fit.argmax())
                taken[at[k]] = True
                self.shift[b] = d + k
            elif size:
                free = free or iter(np.flatnonzero(~taken).tolist())  # all larger buckets are placed
                self.shift[b] = -1 - next(free)
            else:
                break
        self.slots: list[int] = [-1] * n
        for i, at in enumerate(self.find(hashes).tolist()):
            self.slots[at] = i

    def _slot(self, hashes: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hashes ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        d = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(hashes, np.maximum(d, 0).astype(np.uint64)))


def known_pattern() -> str | None:
    try:
        return default_vocabulary()[1]
    except ModuleNotFoundError:  # another vocabulary on a machine without that package
        return None


class Codec:
    """Encodes and decodes with one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = list(self.ranks)
        self.ids = [self.ranks[t] for t in self.tokens]
        self.perfect = PerfectHash(self.tokens)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.rank_of_two = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.decimal = {rank: str(rank) for rank in self.ids}
        self.pattern = regex.compile(pattern)
        #: Only of this pattern it is known that single spaces begin pre-tokens.
        self.cuts_at_spaces = pattern == known_pattern()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is no vocabulary entry."""
        n, rank_of, ranks = len(word), self.ranks.get, self.ranks
        # a part begins at i and ends where the next begins; pair[i]: rank of it joined with the next
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        of_two = self.rank_of_two
        pair = [of_two[a << 8 | b] for a, b in zip(word, word[1:])]
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if pair[i] != rank:
                continue  # one of the two has been merged meanwhile
            j = nxt[i]
            end = nxt[i] = nxt[j]
            pair[i] = pair[j] = -1
            if end < n:
                prev[end] = i
                r = pair[i] = rank_of(word[i : nxt[end]], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            before = prev[i]
            if before >= 0:
                r = pair[before] = rank_of(word[before:end], -1)
                if r >= 0:
                    heappush(heap, r * n + before)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : nxt[i]]])
            i = nxt[i]
        return tuple(out)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        at = self.perfect.find(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))).tolist()
        slots, tokens, ids = self.perfect.slots, self.tokens, self.ids
        return [(ids[k],) if tokens[k := slots[a]] == w else self.merge(w) for w, a in zip(words, at)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces of text that begin and end where pre-tokens do."""
        # letters after a space are one pre-token
        split = [[p] if not self.cuts_at_spaces or p[0] == " " and p[1:].isalpha() else self.pattern.findall(p) for p in pieces]
        known, older = self.known, self.older
        words = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
        fresh = [w for w in words if w not in older]
        known.update((w, older[w]) for w in words if w in older)
        known.update(zip(fresh, self.encode_words([w.encode() for w in fresh])))
        for piece, parts in zip(pieces, split):
            if len(parts) > 1:
                known[piece] = tuple(chain.from_iterable(map(known.__getitem__, parts)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; words new to the cache are encoded together."""
        cut = []
        for text in texts:
            if not self.cuts_at_spaces:
                cut.append([m[0] for m in self.pattern.finditer(text)])
                continue
            pieces, done = [], 0
            for start, end in long_runs(text):
                pieces += _words(text[done:start])
                pieces.append(text[start:end])
                done = end
            pieces += _words(text[done:])
            cut.append(pieces)
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = set(chain.from_iterable(cut)).difference(known)
        known.update((p, older[p]) for p in fresh if p in older)
        self.learn([p for p in fresh if p not in older])
        for pieces in cut:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec, built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(text: Column, path: str, pattern: str) -> Column:
    """Column: array of ids of each text (null text: empty)."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for part in parts:
            yield pd.Series([np.array(ids, np.int32) for ids in own.encode_all([t or "" for t in part])])

    return run(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Column: the bytes that ids stand for (null ids: empty)."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for part in parts:
            yield pd.Series([own.decode([] if x is None else x.tolist()) for x in part])

    return run(ids)


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id``, number of ids, digests of the ids and of their decoding (and the ids), of every text.

    One pass without a shuffle; results leave a task in batches of ``OUT_ROWS``.
    """
    default = default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = own.decimal.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                sizes, of_ids, of_text, all_ids = [], [], [], []
                for ids in own.encode_all([t or "" for t in part.column(1).to_pylist()]):
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                out = [part.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids))))
                yield pa.RecordBatch.from_arrays(out, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {RESULT}" + ", ids array<int>" * with_ids)
