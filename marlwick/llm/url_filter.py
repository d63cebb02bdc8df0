"""URL filtering with DataFrame operations only.

Rules come first: the longest one that fits decides. Every other URL is judged
by a logistic regression on hashed character n-grams of its host and path. The
model is trained by accelerated gradient descent; each step is one aggregation
over the labelled table, of which only the gradient (one number for each bucket)
reaches the driver. Scoring is one projection of the pages: the weights are a
constant array in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path prefix, verdict)
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Words of unwanted and of plain sites, what stands beside them in host names, and forms of URLs.
UNWANTED = (
    "casino poker slots roulette jackpot lottery gambling bets betting pills pharmacy viagra steroids porn xxx adult escorts nude webcam hookup "
    "loans payday crypto bitcoin replica warez torrent crack keygen spam phishing malware popup adware ads clicks clickbait cashback giveaway"
).split()
PLAIN = (
    "news docs blog wiki library museum weather science history sports recipes travel music school university hospital garden forum books market "
    "city health law energy theatre railway post bank farm camera track planet river mountain bicycle coffee bakery dentist architects chess radio"
).split()
BESIDE = "best top online mega super vip now my the one land point".split()
FORMS = ["https://{}.com/{}", "http://www.{}.org/articles/{}", "https://m.{}.net/item/{}.html", "http://blog.{}.info/p/{}/"]
#: Letters of made-up names, most of which are plain sites.
ONSETS, VOWELS, CODAS = "b c d f g h j k l m n p r s t th v w st br".split(), "a e i o u ea ou".split(), ["", "n", "r", "s", "l", "nd", "st"]


def labelled_hosts(made_up: int = 80) -> list[tuple[str, int]]:
    """(host, label): words alone and with another beside them, by the same rule for both labels, and made-up names; label 1 for unwanted."""
    out = []
    for label, words in ((1, UNWANTED), (0, PLAIN)):
        for i, word in enumerate(words):
            beside = [BESIDE[(i + k) % len(BESIDE)] for k in (0, 5)]
            out += [(word, label), (f"{beside[0]}-{word}", label), (f"{word}{beside[1]}", label)]
    syllable = lambda n: ONSETS[n % 20] + VOWELS[n // 20 % 7] + CODAS[n // 140 % 7]
    names = [syllable(37 * k + 11) + syllable(71 * k + 5) + syllable(13 * k) * (k % 2) for k in range(made_up)]
    return out + [(name, 0) for name in dict.fromkeys(names)]


def labelled_urls(spark: SparkSession, hosts: list[tuple[str, int]] | None = None) -> DataFrame:
    """The small labelled table used by default: (url, label), each host in every form, so that forms say nothing of the label."""
    hosts = labelled_hosts() if hosts is None else hosts
    rows = [(form.format(host, 100 + 37 * i % 9000), label) for i, (host, label) in enumerate(hosts) for form in FORMS]
    return spark.createDataFrame(rows, "url string, label int")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by the fixed reading of the contract; both empty for null or no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(rows: DataFrame, sizes: tuple[int, ...], buckets: int) -> DataFrame:
    """``rows`` (host, path, ...) plus _grams, the distinct buckets of their n-grams. Digits are all read as 0."""
    chars = lambda c: F.split(F.concat(F.lit("^"), F.translate(c, "123456789", "000000000"), F.lit("$")), "")
    held = rows.withColumns({"_host": chars(F.col("host")), "_path": chars(F.col("path"))})
    parts = []
    for part in ("_host", "_path"):
        for n in sizes:
            gram = ", ".join(f"{part}[i + {j}]" for j in range(n))
            parts.append(
                f"CASE WHEN size({part}) >= {n} THEN transform(sequence(0, size({part}) - {n}), "
                f"i -> cast(pmod(xxhash64('{part}', {gram}), {buckets}) AS int)) ELSE cast(array() AS array<int>) END"
            )
    return held.withColumn("_grams", F.array_distinct(F.concat(*map(F.expr, parts)))).drop("_host", "_path")


def probability(weights: list[float], bias: float) -> Column:
    """The model's probability of label 1 from _grams."""
    table = ",".join(f"{w:.6g}" for w in weights)
    dot = f"aggregate(_grams, 0D, (s, g) -> s + cast(split('{table}', ',') AS array<double>)[g])"
    z = F.lit(bias) + F.expr(dot) / F.sqrt(F.greatest(F.size("_grams"), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 8192, rounds: int = 40,
          ridge: float = 0.0005, most: int = 20_000) -> tuple[list[float], float]:
    """(weights, bias) fitted to ``labelled`` (url, label), of which ``most`` rows at most are used, by hash order.

    The mean log loss and half the squared weights times ``ridge`` are lowered by accelerated descent. A bucket's step is
    one over a bound of the loss's curvature there, a quarter of the mean of |x| times the row's sum of |x|: rare n-grams
    take long steps. Rows with a null url or label are left out. A table without rows gives the zero model, whose
    probability of 1/2 means allow.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = written(features(rows.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path")), sizes, buckets).select("label", "_grams"), "urls")
    n = rows.count()
    weights, bias = [0.0] * buckets, 0.0
    if not n:
        return weights, bias
    # A row of m buckets has 1 / sqrt(m) in each of them and 1 for the bias (bucket -1).
    scale = F.sqrt(F.greatest(F.size("_grams"), F.lit(1)).cast("double"))
    spread = rows.select("label", "_grams", scale.alias("s"), F.explode(F.concat(F.array(F.lit(-1)), "_grams")).alias("g"))
    bound = F.sum(F.when(F.col("g") < 0, F.col("s") + 1).otherwise(1 + 1 / F.col("s"))) / (4 * n)
    curvature = {x.g: x.v for x in spread.groupBy("g").agg(bound.alias("v")).collect()}
    steps = [1 / (curvature.get(g, 1.0) + ridge) for g in range(buckets)]
    ahead, ahead_bias = weights[:], bias
    for r in range(rounds):
        error = (F.col("label") - probability(ahead, ahead_bias)) / n
        pulled = rows.select(F.explode(F.concat(F.array(F.lit(-1)), "_grams")).alias("g"), error.alias("e"), scale.alias("s"))
        slope = {x.g: x.v for x in pulled.groupBy("g").agg(F.sum(F.when(F.col("g") < 0, F.col("e")).otherwise(F.col("e") / F.col("s"))).alias("v")).collect()}
        new = [w + step * (slope.get(g, 0.0) - ridge * w) for g, (w, step) in enumerate(zip(ahead, steps, strict=True))]
        new_bias = ahead_bias + slope.get(-1, 0.0) / curvature[-1]
        push = r / (r + 3)
        ahead = [a + push * (a - b) for a, b in zip(new, weights, strict=True)]
        ahead_bias = new_bias + push * (new_bias - bias)
        weights, bias = new, new_bias
    if not all(map(math.isfinite, weights)):
        raise ArithmeticError("the fit diverged")
    return weights, bias


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[Rule] = RULES,
               sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 8192) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url).

    The model blocks at a score (probability of an unwanted page) above 1/2;
    where a rule decides, the score is given all the same. A null or odd url has
    an empty host and path and is judged by the model. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    weights, bias = train(labelled if labelled is not None else labelled_urls(pages.sparkSession), sizes, buckets)
    host, path = split_url(F.col("url"))
    rows = features(pages.select("page_id", host.alias("host"), path.alias("path")), sizes, buckets)
    rows = rows.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "score": probability(weights, bias)})
    return rows.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "score",
    )
