"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans come from four patterns and checks; each is a seed. The method then looks for
identifiers that no pattern knows: every other token with four digits or an at sign is
a candidate. Seeds and candidates are the instances of a graph. Its patterns are lexical: the
words beside an instance (two before, one on either side, one before; lower case,
digits as 9, a word that looks like an identifier itself as #) with the shape of what stands in the slot.

Scores go back and forth ``ROUNDS`` times over the graph of all documents. A pattern's confidence is the
mean score of its distinct instances; with ``CONFIDENCE``, and instances that score ``SUPPORT`` in all, it is
trusted. A seed scores 1, another instance the confidence of the best trusted pattern that it has, and 0 without
one, so that only trusted patterns make others trusted. Candidates in the slot of a pattern trusted at the end become
spans of kind ``context``.

Everything is DataFrame functions. Texts are read once for the base spans and
instances, which alone are written to the shared folder; the graph is
pre-aggregated before it is shuffled, and patterns of under ``SUPPORT`` instances
cannot qualify and leave it first. Of words beside an instance the nearest ``CONTEXT`` characters count.

Rows are known by (doc_id, hash of text) where the found spans meet them, so
repeated rows get the same spans. Null and empty texts have no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .shared import cut, hex_digest

KINDS = ("email", "ip", "card", "phone")
METHOD = "context"
ROUNDS, CONFIDENCE, SUPPORT, CONTEXT = 3, 0.75, 5, 120

LOCAL = r"[A-Za-z0-9._%+-]"
#: A failed local part is not tried again from its inside; \G allows a match right after another.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])"
#: Java's \s is ASCII white space, as in words.
NEAR = "array<struct<start:int,end:int,value:long,seed:boolean,patterns:array<string>>>"
INSTANCE = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){4}|[^\s@]*+@)\S++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
            return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.length(digits).between(12, 19) & (F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0)

    return S.let(_digits(value), total)


def base_matches(text: Column, context: int = 0) -> list[Column]:
    """Columns: of each kind the valid matches in a text that is not null."""
    rules = (
        (EMAIL, text.contains("@"), lambda m: F.lit(True)),
        (IP, F.lit(True), lambda m: m["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        (CARD, F.lit(True), lambda m: F.length(m["value"]).between(12, 37) & _luhn(m["value"])),
        (PHONE, text.contains("+"), lambda m: F.length(_digits(m["value"])).between(9, 15)),
    )
    return [F.when(can, F.filter(S.matches(text, pattern, context=context), valid)) for pattern, can, valid in rules]


def _sorted_spans(found: list[Column]) -> Column:
    return F.sort_array(F.concat(*[F.coalesce(S.spans(m, kind, rank), S.none()) for rank, (kind, m) in enumerate(zip(KINDS, found))]))


def base_spans(text: Column) -> Column:
    """Column: the four kinds' spans of a text that is not null, sorted."""
    return _sorted_spans(base_matches(text))


def shape(value: Column) -> Column:
    """Column: letter and digit runs as a and 9, without separators inside, and how many digits, in fours."""
    digits = F.floor(F.length(_digits(value)) / 4).cast("string")
    return F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[-._/:() ]+", ""), "[0-9]+", "9"), r"\p{L}+", "a"), F.lit(" "), digits)


def lexical(left: Column, right: Column, value: Column) -> Column:
    """Column: array of the patterns around a value."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}0-9:=_]+", ""), "[0-9]+", "9")
    word = lambda x: F.when(x.rlike("@|(?:[^0-9]*+[0-9]){4}"), "#").otherwise(plain(x))
    one, two = word(F.regexp_extract(left, r"(\S+)\s*$", 1)), word(F.regexp_extract(left, r"(\S+)\s+\S+\s*$", 1))
    next_ = word(F.regexp_extract(right, r"^\s*(\S+)", 1))
    around = (((two, one), "{} {} _"), ((one, next_), "{} _ {}"), ((one,), "{} _"))

    def written(words: tuple[Column, ...], form: str) -> Column:
        known = F.lit(True)
        for w in words:
            known &= w != ""
        first, *rest = form.split("{}")
        return F.when(known, F.concat(F.lit(first), *[x for w, r in zip(words, rest) for x in (w, F.lit(r))], F.lit(" "), shape(value)))

    return F.filter(F.array(*[written(*x) for x in around]), lambda p: p.isNotNull())


def instances(found: list[Column], text: Column) -> Column:
    """Column: array of (start, end, value, seed, patterns): the valid matches, and candidate tokens outside them."""

    def made(start: Column, value: Column, m: Column, seed: bool) -> Column:
        whole = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.xxhash64(value).alias("value"), F.lit(seed).alias("seed"), lexical(m["left"], m["right"], value).alias("patterns"))
        return F.when(F.length(value) > 0, whole)

    def candidate(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], r"^[^\p{L}0-9+@]*", 0))
        return S.let(F.regexp_extract(m["value"], r"^[^\p{L}0-9+@]*+(.*?)[^\p{L}0-9]*$", 1), lambda value: made(m["start"] + lead, value, m, False))

    seeds = F.concat(*[F.coalesce(F.transform(k, lambda m: made(m["start"], m["value"], m, True)), F.array().cast(NEAR)) for k in found])
    base = _sorted_spans(found)
    others = F.transform(S.matches(text, INSTANCE, context=CONTEXT), candidate)
    others = S.let(base, lambda b: F.filter(others, lambda t: t.isNotNull() & ~S.overlaps(t["start"], t["end"], b)))
    return F.filter(F.concat(seeds, others), lambda t: F.size(t["patterns"]) > 0)


def _key(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("hash")]


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, base, near): what the texts hold, one row each; ``near`` are the instances."""
    text = F.col("text")
    rows = docs.select(*_key(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = rows.select("*", *[m.alias(k) for k, m in zip(KINDS, base_matches(text, CONTEXT))])
    own = [F.col(k) for k in KINDS]
    return found.select("doc_id", "hash", _sorted_spans(own).alias("base"), instances(own, text).alias("near"))


def patterns(rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, confidence) of the trusted patterns."""
    near = rows.select(F.explode("near").alias("n")).select("n.value", "n.seed", F.explode("n.patterns").alias("pattern"))
    edges = near.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") >= support)
    edges = cut(edges.join(wide, "pattern"))
    scores = edges.select("value", "seed").distinct().groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    trusted = None
    for _ in range(rounds):
        mass = F.sum("score")
        sure = edges.join(scores, "value").groupBy("pattern").agg((mass / F.max("width")).alias("confidence"), mass.alias("mass"))
        trusted = cut(sure.where((F.col("confidence") >= confidence) & (F.col("mass") >= support)).select("pattern", "confidence"))
        best = F.when(F.max("seed"), 1.0).otherwise(F.coalesce(F.max("confidence"), F.lit(0.0)))
        scores = edges.join(trusted, "pattern", "left").groupBy("value").agg(best.alias("score"))
    return trusted


def discovered(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, hash, more): spans that the trusted patterns add to each row that has any."""
    near = rows.select("doc_id", "hash", F.explode("near").alias("n")).where(~F.col("n.seed"))
    near = near.select("doc_id", "hash", F.col("n.start").alias("start"), F.col("n.end").alias("end"), F.explode("n.patterns").alias("pattern"))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(METHOD).alias("kind"))
    return near.join(trusted.select("pattern"), "pattern", "left_semi").groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(span)).alias("more"))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, hash, base) and all their spans as ``spans``."""
    more = more.select(F.col("doc_id").alias("own_id"), F.col("hash").alias("own_hash"), "more")
    joined = rows.join(more, (rows["hash"] == more["own_hash"]) & rows["doc_id"].eqNullSafe(more["own_id"]), "left").drop("own_id", "own_hash")
    return joined.withColumn("spans", F.sort_array(F.concat("base", F.coalesce("more", S.none())))).drop("more")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, and all spans as text, of every row."""
    rows = cut(scanned(docs))
    all_spans = _with_more(rows.select("doc_id", "hash", "base"), discovered(rows, patterns(rows)))
    return all_spans.select(
        "doc_id",
        *[S.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        hex_digest(S.written(F.col("base"))).alias("base_sha256"),
        S.written(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every span in ``text`` replaced by its kind in angle brackets."""
    rows = cut(scanned(docs))
    more = cut(discovered(rows, patterns(rows)))
    columns = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), *_key(docs), base_spans(F.coalesce(docs["text"], F.lit(""))).alias("base"))
    clean = S.redact(F.col("doc.text"), F.col("spans"), lambda kind: F.concat(F.lit("<"), F.upper(kind), F.lit(">")))
    return _with_more(whole, more).select(*[clean.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in columns])
