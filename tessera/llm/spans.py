"""Character spans of regular expressions, with DataFrame functions only.

Spans are ``struct<start:int, rank:int, end:int, kind:string>`` in code points,
end exclusive; ``rank`` is the place of the kind in its list, so the natural
order of the struct is by start, then kind as listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, group: int = 0, context: int = 0) -> Column:
    """Column: array<struct<start:int, value:string>> of the leftmost non-overlapping matches.

    With ``context`` also ``left`` and ``right``: so many characters at most before and behind
    the match. The pattern is one for which Java's matcher has no quadratic retries; it may have groups.
    """
    kind = "array<struct<start:int,value:string" + ",left:string,right:string" * bool(context) + ">>"

    def located(values: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def walk(pieces: Column) -> Column:
            tail = [F.lit("").alias("tail")] * bool(context)
            start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"), *tail)

            def step(acc: Column, i: Column) -> Column:
                own, before = F.get(values, i), F.get(pieces, i)
                begin = acc["at"] + F.length(before)
                found, tail = [begin.alias("start"), own.alias("value")], []
                if context:
                    left = F.right(F.concat(acc["tail"], before), F.lit(context))
                    after = F.concat(F.get(pieces, i + 1), F.coalesce(F.get(values, i + 1), F.lit("")))
                    found += [left.alias("left"), F.left(after, F.lit(context)).alias("right")]
                    tail = [F.right(F.concat(left, own), F.lit(context)).alias("tail")]
                return F.struct((begin + F.length(own)).alias("at"), F.concat(acc["out"], F.array(F.struct(*found))).alias("out"), *tail)

            return F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), start, step, lambda acc: acc["out"])

        return F.when(F.size(values) == 0, F.array().cast(kind)).otherwise(let(pieces, walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), located)


def spans(found: Column, kind: str, rank: int) -> Column:
    """Column: spans of ``matches``."""
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind")),
    )


def none() -> Column:
    return F.array().cast(SPANS)


def written(found: Column) -> Column:
    """Column: kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(start: Column, end: Column, found: Column) -> Column:
    return F.exists(found, lambda s: (s["start"] < end) & (s["end"] > start))


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, found: Column, tag: Callable[[Column], Column]) -> Column:
    """Column: the text with each stretch of overlapping spans replaced by the tag of its first kind."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag(s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def whole(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, whole))
