"""Secret scans: base patterns, and character Markov models.

Base spans come from three patterns. The method scores every other run of ``SHORTEST`` or
more key characters by the log-likelihood ratio of two first-order character models, one trained on
random strings, the other on ordinary identifiers. Runs of ``LOG_ODDS`` and more, the logarithm of the odds
against a run in ordinary text being random, become spans of kind ``random``; nothing else decides.

``train`` takes labelled samples (value, random). ``samples`` makes them from all
documents. Random strings are the values of base spans that mix letters and digits, and, for each
distinct word of the corpus, one of ``random_forms`` of its digest. Ordinary
identifiers are long runs of letters, and, for each distinct word, the word and one of its ``plain_forms`` (snake, kebab and
camel case, paths, with dates, counters and numbers); the hash of the word chooses. Samples
are aggregated by character pair, so the model is a table of ``WIDTH`` x ``WIDTH`` whatever
the data, and travels in the plan as one literal.

DataFrame functions only; the texts are read once, and spans, runs and words are written
to the shared folder. Null and empty texts have no spans; with no sample of
either label the method adds none; repeated rows get the same spans each.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .shared import cut, hex_digest

KINDS = ("assign", "access", "hex")
METHOD = "random"
LOG_ODDS = 12.0
SHORTEST = 16
#: What each pair counts besides its occurrences, and the part of a model that is uniform.
SMOOTH, EVEN = 0.5, 0.1

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?=[0-9a-f])(?<![0-9a-f])[0-9a-f]{16,}+"
RUN = rf"(?=[A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of which any other counts as the last one.
WIDTH = len(ALPHABET)


def base_spans(text: Column) -> Column:
    """Column: the three kinds' spans of a text that is not null, sorted."""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    rules = (
        (ASSIGN, named, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 12),
        (ACCESS, text.contains("AKIA"), lambda m: F.length(m["value"]) >= 18),
        (HEX, F.lit(True), lambda m: F.lit(True)),
    )
    found = [
        F.when(can, S.spans(F.filter(S.matches(text, pattern), valid), kind, rank)).otherwise(S.none())
        for rank, (kind, (pattern, can, valid)) in enumerate(zip(KINDS, rules))
    ]
    return F.sort_array(F.concat(*found))


def runs(text: Column) -> Column:
    """Column: array of (start, end, value) of the long runs of key characters."""
    located = lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"))
    return F.transform(S.matches(text, RUN), located)


def _codes(value: Column) -> Column:
    """Column: places of the characters in the alphabet."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    return F.transform(chars, lambda c: F.when(place(c) < 0, WIDTH - 1).otherwise(place(c)))


def train(samples: DataFrame, smooth: float = SMOOTH) -> list[float] | None:
    """Log-likelihood ratios of the WIDTH x WIDTH character pairs, from (value string, random boolean)."""

    pairs = F.regexp_extract_all("value", F.lit("(?s)(?=(..))"), F.lit(1))
    counts = samples.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    place = {c: i for i, c in enumerate(ALPHABET)}
    seen = {True: [0] * WIDTH * WIDTH, False: [0] * WIDTH * WIDTH}
    for random, pair, n in counts.collect():  # values are of a bounded alphabet
        a, b = (place.get(c, WIDTH - 1) for c in pair)
        seen[random][a * WIDTH + b] += n
    if not any(seen[True]) or not any(seen[False]):
        return None

    totals = {label: [sum(counts[row : row + WIDTH]) for row in range(0, WIDTH * WIDTH, WIDTH)] for label, counts in seen.items()}

    def likelihood(label: bool, pair: int) -> float:
        row = pair // WIDTH * WIDTH
        own = (seen[label][pair] + smooth) / (totals[label][row // WIDTH] + smooth * WIDTH)
        return math.log((1 - EVEN) * own + EVEN / WIDTH)

    return [likelihood(True, p) - likelihood(False, p) for p in range(WIDTH * WIDTH)]


def ratio(value: Column, model: list[float]) -> Column:
    """Column: log-likelihood ratio of a value."""
    table = F.lit(np.array(model, float))

    def total(codes: Column) -> Column:
        step = lambda acc, i: acc + F.get(table, F.get(codes, i) * WIDTH + F.get(codes, i + 1))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 2), F.lit(0.0), step)

    return S.let(_codes(value), total)


def vocabulary(text: Column) -> Column:
    """Column: the distinct runs of three and more ASCII letters of a text, lower case, but none beside a digit, as these may be random."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9])[a-z]{3,}+(?![0-9])"), F.lit(0)))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, values, runs, words): base spans and their values, and the runs and words outside them."""
    text = F.coalesce(docs["text"], F.lit(""))
    found = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text")).select("*", base_spans(F.col("text")).alias("base"), runs(F.col("text")).alias("runs"))
    value = lambda s: F.regexp_extract(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), r"[A-Za-z0-9+/_.=-]+$", 0)
    outside = F.filter("runs", lambda r: ~S.overlaps(r["start"], r["end"], F.col("base")))
    return found.select("doc_id", "base", F.transform("base", value).alias("values"), outside.alias("runs"), vocabulary(F.col("text")).alias("words"))


def _digest(word: Column, n: int = 0) -> Column:
    return F.sha2(F.concat(word, F.lit(str(n))), 256)


def _base64(word: Column, n: int = 0) -> Column:
    return F.base64(F.unhex(_digest(word, n)))


def random_forms(word: Column) -> list[Column]:
    """Columns: random strings that a word's digests make, of several alphabets."""
    whole = F.concat(_base64(word), _base64(word, 1))
    kept = lambda x, drop: F.substring(F.regexp_replace(x, drop, ""), 1, 32)
    return [
        F.substring(_digest(word), 1, 40), _base64(word), kept(whole, "[^A-Za-z0-9]"), kept(F.lower(whole), "[^a-z]"), kept(F.lower(whole), "[^a-z0-9]"),
        kept(F.upper(whole), "[^A-Z0-9]"), F.translate(kept(whole, "="), "+/", "-_"), kept(whole, "[^A-Za-z]"),
    ]


def plain_forms(word: Column) -> list[Column]:
    """Columns: identifiers as people and programs write them, around a word."""
    number = lambda n, low, span: (F.pmod(F.xxhash64(word, F.lit(n)), F.lit(span)) + low).cast("string")
    two = lambda n, span: F.lpad(number(n, 1, span), 2, "0")
    year, month, day = number(1, 1980, 60), two(2, 12), two(3, 28)
    capital, upper = F.initcap(word), F.upper(word)
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return [
        join(word, "_", word, "_", word), join(word, "-", word, "-", word), join(word, capital, capital), join(capital, capital), join(upper, "_", upper), join(word, "/", word, "/", capital),
        join(word, "_", year, "-", month, "-", day), join(upper, "_", year, month, day, "_", two(4, 23), two(5, 59), two(6, 59)), join(word, "-", word, "-", number(7, 0, 10**10)),
        join(word, "_", F.lpad(number(8, 0, 1000), 5, "0")), join(word, number(9, 1, 40), "_", word, "-", number(10, 1, 10)), join(year, "-", month, "-", day, "-", word, "-", word),
        join(word, "=", number(11, 0, 10**6)), join(word, "=", word), join(number(12, 0, 10**9), "-", number(13, 0, 10**6), "-", number(14, 0, 10**4)), join("----", word, "----", "====", word, "____"),
    ]


def labelled(rows: DataFrame) -> DataFrame:
    """(value, random): the distinct values of base spans, and the distinct runs of letters outside them."""
    secret = rows.select(F.explode("values").alias("value"), F.lit(True).alias("random"))
    letters = rows.select(F.explode("runs.value").alias("value"), F.lit(False).alias("random")).where(F.col("value").rlike("^[A-Za-z]+$"))
    return secret.distinct().unionByName(letters.distinct())


def samples(rows: DataFrame) -> DataFrame:
    """(value, random): the labelled values, but no random ones without letter or digit, and what the words make."""
    found = labelled(rows).where(~F.col("random") | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    words = cut(rows.select(F.explode("words").alias("word")).distinct())

    def chosen(forms: list[Column]) -> Column:
        out = forms[0]  # cases, as only the chosen one is computed
        for i, form in enumerate(forms[1:], 1):
            out = F.when(F.pmod(F.xxhash64("word"), F.lit(len(forms))) == i, form).otherwise(out)
        return out

    word = F.col("word")
    made = words.select(F.explode(F.array(*[F.struct(v.alias("value"), F.lit(r).alias("random")) for v, r in ((chosen(random_forms(word)), True), (chosen(plain_forms(word)), False), (word, False))])).alias("s"))
    return found.unionByName(made.select("s.*"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, and all spans as text, of every row."""
    rows = cut(scanned(docs))
    model = train(samples(rows))
    more = S.none()
    if model is not None:
        likely = F.filter("runs", lambda r: ratio(r["value"], model) >= LOG_ODDS)
        more = F.transform(likely, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), r["end"].alias("end"), F.lit(METHOD).alias("kind")))
    return rows.select(
        "doc_id",
        *[S.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        hex_digest(S.written(F.col("base"))).alias("base_sha256"),
        S.written(F.sort_array(F.concat("base", more))).alias("spans"),
    )
