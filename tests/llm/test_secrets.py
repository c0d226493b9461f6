"""Secrets: base spans against Python's re, the model on held-out strings, odd rows."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F
from test_pii import DOCS, soup

from tessera.llm import secrets

RULES = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def base(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: r for r in secrets.find(docs).collect()}


def test_base_spans_match_brute_force(spark):
    r = random.Random(3)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "key", "=", ":", " ", '"', "'", "AKIA", "ABC123XYZ0", "0123abcd", "deadbeef", "x", "é", "_", ".", "\n", "日"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(20))) for _ in range(1500)] + soup(100, 5) + [None, "", "token" + " " * 30_000, "f" * 50_000, "token=" * 5000, "AKIA" * 9]
    out = rows_of(spark, texts)
    for i, t in enumerate(texts):
        want = base(t)
        assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(out[i].spans.split(","))
        assert [out[i][f"n_{k}"] for k, *_ in RULES] == [len(re.findall(f"{k}:", want)) for k, *_ in RULES]


def test_model_tells_random_strings_from_identifiers(spark):
    r = random.Random(4)
    syllables = ["get", "user", "name", "list", "table", "count", "value", "index", "order", "item", "parse", "write"]
    words = lambda: "".join(r.choice(syllables) for _ in range(5))
    token = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    texts = [f"{words()} token = {token()} {words()}" for _ in range(400)]
    camel = ["".join(w.capitalize() for w in (r.choice(syllables) for _ in range(5))) + "2" for _ in range(50)]
    hidden = [token() for _ in range(50)]
    out = rows_of(spark, texts + [f"see {w} there" for w in camel + hidden])
    flagged = [out[400 + i].spans for i in range(100)]
    assert sum(s == "" for s in flagged[:50]) >= 49
    assert sum(s == "random:4:36" for s in flagged[50:]) >= 48


def test_empty_and_repeated(spark):
    assert secrets.find(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "token=abcdefabcdef", "en", "s", 0)] * 2 + [(None, None, None, None, None)], DOCS)
    assert secrets.find(docs.withColumnRenamed("lang", "base")).where("n_assign = 1").count() == 2


def test_all_distinct_values_are_counted(spark):
    rows = spark.range(30_000, numPartitions=8).selectExpr("array(lower(lpad(hex(id % 25000), 32, '0'))) values", "array(struct(translate(lpad(lower(hex(id)), 20, '0'), '0123456789abcdef', 'abcdefghijklmnop') value)) runs")
    found = {r.random: r["count"] for r in secrets.labelled(rows).groupBy("random").count().collect()}
    assert found == {True: 25_000, False: 30_000}


def language():
    r = random.Random(6)
    syllables = ["ba", "cor", "din", "el", "fas", "gri", "ho", "in", "ket", "lu", "men", "no", "par", "qui", "res", "sta", "ti", "ur", "ven", "wi", "xo", "yel", "zan", "the", "ing", "tion", "er", "ly"]
    invented = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(2, 5)))
    corpus = [" ".join(invented() for _ in range(60)) for _ in range(300)]
    return invented, corpus, r


def test_precision_and_recall_by_sort_on_held_out_strings(spark):
    """Learned from a corpus, judged on identifiers of other words and on random strings of many alphabets."""
    invented, corpus, r = language()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(corpus)], DOCS)
    model = secrets.train(secrets.samples(secrets.scanned(docs)))
    all_ = string.ascii_letters + string.digits
    drawn = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    w = invented  # mostly words that the corpus does not have
    date = lambda sep: f"{r.randrange(1990, 2030)}{sep}{r.randrange(1, 13):02d}{sep}{r.randrange(1, 29):02d}"
    hidden = {
        "base62": lambda: drawn(all_, 32), "lower": lambda: drawn(string.ascii_lowercase, 32), "base36": lambda: drawn(string.ascii_lowercase + string.digits, 24),
        "upper": lambda: drawn(string.ascii_uppercase + string.digits, 24), "base64": lambda: drawn(all_ + "+/", 40), "url": lambda: drawn(all_ + "-_", 43),
    }
    plain = {
        "snake": lambda: "_".join(w() for _ in range(4)), "kebab": lambda: "-".join(w() for _ in range(4)), "camel": lambda: w() + "".join(w().capitalize() for _ in range(3)),
        "image": lambda: f"IMG_{date('')}_{r.randrange(240000):06d}", "order": lambda: f"{w()}-{w()}-{r.randrange(10**10)}", "constant": lambda: "_".join(w().upper() for _ in range(4)),
        "path": lambda: "/".join(w() for _ in range(5)), "dated": lambda: f"{w()}_{w()}_{date('-')}", "digits": lambda: drawn(string.digits, 18), "rule": lambda: "-" * r.randrange(16, 99),
    }
    rows = [(kind, sort, v) for kind, sorts in (("hidden", hidden), ("plain", plain)) for sort, f in sorts.items() for v in (f() for _ in range(200)) if len(v) >= secrets.SHORTEST]
    frame = spark.createDataFrame(rows, "kind string, sort string, v string")
    flagged = {}
    for x in frame.withColumn("hit", secrets.ratio(F.col("v"), model) >= secrets.LOG_ODDS).groupBy("kind", "sort").agg(F.avg(F.col("hit").cast("int")).alias("share")).collect():
        flagged[x.kind, x.sort] = x.share
    assert all(share >= 0.9 for (kind, _), share in flagged.items() if kind == "hidden"), flagged
    assert all(share <= 0.01 for (kind, _), share in flagged.items() if kind == "plain"), flagged


def test_lower_case_runs_are_judged_by_the_ratio_alone(spark):
    _, texts, r = language()
    token = "".join(r.choice(string.ascii_lowercase) for _ in range(40))
    out = rows_of(spark, [*texts, f"see {token} there", "see order-number-1234567890 and IMG_20240101_123456 there", "z" * 50_000])
    assert [out[300 + i].spans for i in range(3)] == ["random:4:44", "", ""]
