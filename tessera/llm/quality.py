"""Quality rules: base statistics, and robust multivariate outliers.

Base statistics are computed within each row. The method transforms them into
the vector ``VECTOR`` and estimates its centre and covariance per language and
source by minimum covariance determinant: of the subsets of a ``KEEP`` share of rows, the one
whose covariance has the least determinant. Three deterministic starts (quartiles alone, and these
with the correlations of the hyperbolic tangents or of the spatial signs of the standardised rows) each
take concentration steps, which re-estimate both from the rows with the least Mahalanobis distance, until the
determinant no longer falls; the estimate with the least one stays. A step is one
pre-aggregated pass: moments are summed per group and bin of distance, and bins are taken until the share is
reached, the last one in part, so no group is gathered or sorted, however large. A covariance floor
keeps constant statistics from rejecting small deviations.

Rows whose squared distance exceeds ``CUTOFF`` are rejected. A normal vector does so with odds of 3e-12, so that
of the texts of a corpus of 100 TB less than one would go by chance.

Groups of under ``LEAST_GROUP`` rows are judged by the estimate over all rows;
with fewer rows than that in all, nothing is rejected by the method. Texts
without words have no vector and fail the base rule. Null and empty texts have no
words; a null language or source is a value of its own, apart from the empty one; repeated rows are
judged alike.

The estimates are one row a group, written to the shared folder; Spark measures that
table before it may broadcast it, and otherwise shuffles salted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_BREAK, cut
from .spans import let

VECTOR = ("word_length", "symbols", "repeats", "lines")
KEEP, LEAST_GROUP = 0.75, 50
#: Fall of the logarithm of the determinant below which a start has converged.
FALL = 1e-3
#: Raises the covariance of the closest three quarters to that of a normal sample, in four dimensions.
CONSISTENCY = 1.49
#: Floors of the standard deviations, in the units of the vector.
FLOORS = (0.10, 0.02, 0.15, 0.25)
CUTOFF = 60.0
#: Bins per doubling of the squared distance, and their range.
FINE, LOW, HIGH = 4, -60, 200

#: Parts of a group in a shuffled join.
SALTS = 64

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _of(text: Column, characters: str) -> Column:
    """Column: how many of some ASCII characters a text holds."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in characters), F.lit(0))


def words(text: Column) -> Column:
    """Column: array of the words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def repeated_words(own: Column) -> Column:
    """Column: words inside 3-word windows found twice or more.

    First a window is its 64-bit hash, whose low bits give way to the window's place, so
    that one sort of longs brings equal windows together with their places. In long texts few
    bits are left, so windows that meet are compared by whole hashes of another seed.
    """

    def windows(hashes: Column, n: Column, low: Column) -> Column:
        high = F.bitwise_not(low)
        three = lambda i: [F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)]
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*three(i)).bitwiseAND(high).bitwiseOR(i.cast("long")))

        def near(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a).bitwiseXOR(F.get(s, b)).bitwiseAND(high) == 0, F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), n - 3), lambda k: same(k, k + 1) | same(k, k - 1))
            place = lambda k: F.get(s, k).bitwiseAND(low).cast("int")
            return F.sort_array(F.transform(hit, lambda k: F.struct(F.xxhash64(F.lit(3), *three(place(k))).alias("hash"), place(k).alias("at"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["hash"] == F.get(s, b)["hash"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k + 1) | same(k, k - 1))
            return F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(hit, lambda k: F.get(s, k)["at"])))

        def covered(p: Column) -> Column:
            three = F.lit(3)
            fresh = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.least(three, F.coalesce(F.get(p, k + 1) - F.get(p, k), three)))
            return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x))

        return let(F.sort_array(packed), lambda s: let(near(s), lambda t: let(twice(t), covered)))

    hashed = F.transform(own, lambda w: F.xxhash64(w))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(own) + 1)).cast("int")) - 1
    known = let(hashed, lambda h: let(low, lambda m: windows(h, F.size(h), m)))
    return F.when(F.size(own) < 3, F.lit(0).cast("long")).otherwise(known)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["source"].alias("source"), text.alias("text"))
    rows = rows.select("*", words(F.col("text")).alias("own"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("own").cast("long").alias("n_words"),
        (F.length("text") - _of(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        _of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("own")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """Columns: the transformed statistics (null without words)."""
    return [
        F.log(F.try_divide("word_chars", "n_words")),
        F.sqrt(F.try_divide("n_symbols", "word_chars")),
        F.sqrt(F.try_divide("n_repeat_words", "n_words")),
        F.log1p(F.col("n_dup_lines").cast("double")),
    ]


D = len(VECTOR)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


MOMENTS = ["n", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i, j in PAIRS]]


def _factor(params: DataFrame) -> DataFrame:
    """Group key, start, centre, lower Cholesky factor of the floored covariance and the logarithm of its determinant."""
    for i, j in PAIRS:
        inner = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))) if i == j else inner / F.col(f"l{j}{j}"))
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0)).alias("log_det")
    return cut(params.select("key", "start", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS], log_det))


def _beside(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with each of the ``params`` of their key.

    Rows are salted, so that where the join shuffles no task gets all rows of a group.
    """
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = params.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.join(salted, ["key", "salt"])


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with their squared Mahalanobis distance ``d2``."""
    rows = _beside(rows, params)
    for i in range(D):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0))
    return rows.withColumn("d2", d2)


def _sums(x: str) -> list[Column]:
    """Columns: count, sums and sums of products of the columns x0, x1, ..."""
    return [
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(f"{x}{i}").alias(f"s{i}") for i in range(D)],
        *[F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"p{i}{j}") for i, j in PAIRS],
    ]


def _mean(i: int) -> Column:
    return F.col(f"s{i}") / F.col("n")


def _covariance(i: int, j: int) -> Column:
    return F.col(f"p{i}{j}") / F.col("n") - _mean(i) * _mean(j)


def _starts(rows: DataFrame) -> DataFrame:
    """The three starts of each group."""
    quartiles = rows.groupBy("key").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(D)])
    spread = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0))
    plain = quartiles.select("key", F.lit(0).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    plain = _factor(plain)
    near = _distance(rows, plain)  # the factor is diagonal, so z is standardised
    tanh = F.array(*[F.tanh(f"z{i}") for i in range(D)])
    sign = F.array(*[F.col(f"z{i}") / F.sqrt(F.greatest("d2", F.lit(1e-12))) for i in range(D)])
    bent = near.select("key", F.posexplode(F.array(tanh, sign)).alias("start", "y")).select("key", (F.col("start") + 1).alias("start"), *[F.col("y")[i].alias(f"y{i}") for i in range(D)])
    bent = bent.groupBy("key", "start").agg(*_sums("y")).join(plain.drop("start"), "key")
    own = lambda i: F.sqrt(F.greatest(_covariance(i, i), F.lit(1e-12)))
    scatter = lambda i, j: F.pow(f"l{i}{i}", F.lit(2.0)) - FLOORS[i] ** 2 if i == j else _covariance(i, j) / (own(i) * own(j)) * F.col(f"l{i}{i}") * F.col(f"l{j}{j}")
    return plain.unionByName(_factor(bent.select("key", "start", *[f"m{i}" for i in range(D)], *[scatter(i, j).alias(f"c{i}{j}") for i, j in PAIRS])))


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of every start."""
    far = _distance(rows, params)
    level = F.floor(F.log2(F.greatest("d2", F.lit(1e-30))) * FINE)
    sums = far.groupBy("key", "start", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), level)).alias("bin")).agg(*_sums("x"))
    # a group has at most HIGH - LOW + 1 bins
    binned = sums.groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct("bin", *MOMENTS))).alias("bins"), F.sum("n").alias("all"))
    before = F.struct(*[F.lit(0.0).alias(x) for x in MOMENTS])

    def step(acc: Column, b: Column) -> Column:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (KEEP * F.col("all") - acc["n"]) / b["n"]))
        return F.struct(*[(acc[x] + part * b[x]).alias(x) for x in MOMENTS])

    half = binned.select("key", "start", F.aggregate("bins", before, step).alias("t")).select("key", "start", "t.*")
    return _factor(half.select("key", "start", *[_mean(i).alias(f"m{i}") for i in range(D)], *[(CONSISTENCY * _covariance(i, j)).alias(f"c{i}{j}") for i, j in PAIRS]))


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and factor of each key of ``rows`` (key, x0, x1, ...) with the least determinant."""
    # the starts are no estimates of a subset, so the first step replaces them
    found = params = _concentrate(rows, _starts(rows))
    while not params.isEmpty():
        before = params.select("key", "start", F.col("log_det").alias("before"))
        params = cut(_concentrate(rows, params).join(before, ["key", "start"]).where(F.col("log_det") < F.col("before") - FALL).drop("before"))
        found = found.unionByName(params)
    names = [*[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS]]
    best = found.groupBy("key").agg(F.min_by(F.struct(*names, "log_det"), F.struct("log_det", "start")).alias("t"))
    return cut(best.select("key", "t.*"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed, squared distance and kept of every row."""
    # null flags, as hashes skip nulls
    own_key = F.xxhash64(F.col("lang").isNull(), F.coalesce("lang", F.lit("")), F.col("source").isNull(), F.coalesce("source", F.lit("")))
    rows = cut(statistics(docs).select("*", own_key.alias("own_key"), *[x.alias(f"x{i}") for i, x in enumerate(vector())]))
    able = rows.where("n_words > 0").select("own_key", *[f"x{i}" for i in range(D)])
    groups = cut(able.groupBy("own_key").count())
    large = groups.where(F.col("count") >= LEAST_GROUP).select("own_key", F.col("own_key").alias("key"))
    # key 0 is the estimate over all rows
    own = able.join(large, "own_key").drop("own_key")
    both = own.unionByName(able.withColumn("key", F.lit(0).cast("long")).drop("own_key"))
    enough = groups.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] >= LEAST_GROUP
    if enough:
        keyed = rows.join(large, "own_key", "left").withColumn("key", F.coalesce("key", F.lit(0).cast("long")))
        judged = _distance(keyed, estimates(both))
    else:
        judged = rows.withColumn("d2", F.lit(None).cast("double"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("d2") > CUTOFF, F.lit(False))).alias("kept"),
        F.col("d2").alias("distance"),
    )
