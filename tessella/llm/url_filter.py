"""URL filter: rules first, then the ratio of two character language models.

Rules (host, path) fit a host and its subdomains where the URL's path starts with the rule's; the longest wins.
URLs that a rule decides are the labels of two smoothed variable-order Markov models, one for accepted and one for
rejected URLs. Their n-grams are counted over all such URLs and all counts are kept, as a written table. The URLs to
be scored are exploded into n-grams; each distinct n-gram gets its two chances by joins with the counts, and the
logarithms' differences are summed for each URL. The models read all that follows the first ``://``, query and fragment
too, or the whole of a URL without it. A URL that no rule decides is blocked if the log-likelihood difference per
character is under a threshold. It is set on held-out URLs of both labels (one in ``folds``, by hash), with scores
rounded to hundredths: the one nearest to 0 at which the share of accepted URLs under it and that of rejected URLs over it
have the smallest sum. ``calibrated`` gives these shares.

Edge cases: a null URL and one without ``://`` have empty host and path, and a null URL is an empty text for the models; without URLs of both labels the models decide nothing and all such URLs are allowed; repeated
rows count as often as they occur; a null id passes through. URLs to be scored are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import ship_package, small_or_shuffled, table, written

ORDER, FOLDS = 4, 5
#: Scores are told apart in hundredths up to this size, so the counts that calibration gathers are few.
MOST = 10.0
ALPHABET = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest (verdict, rule) that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.find("/") if "/" in rule else len(rule)
        fits = ((host == rule[:at]) | host.endswith(f".{rule[:at]}")) & path.startswith(rule[at:])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def count_grams(labelled: DataFrame, text: str, label: str, order: int) -> DataFrame:
    """label, gram, n over all rows; a gram is a context of up to order characters and the one after it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, Counter] = {}
            for s, kind in zip(pdf[text], pdf[label]):
                padded = "\x02" * order + s + "\x03"
                grams = seen.setdefault(kind, Counter())
                for k in range(1, order + 2):
                    grams.update(padded[i - k : i] for i in range(order + 1, len(padded) + 1))
            for kind, grams in seen.items():
                yield pd.DataFrame({"label": kind, "gram": list(grams), "n": list(grams.values())})

    return labelled.select(text, label).mapInPandas(count, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class MarkovModel:
    """Witten-Bell interpolation from the longest known context down to a uniform distribution; the plain form of gram_scores, for one label."""

    def __init__(self, grams: dict[str, int], order: int, alphabet: int = ALPHABET):
        self.grams, self.order, self.floor = grams, order, 1 / alphabet
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in grams.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.known: dict[str, float] = {}

    def chance(self, gram: str) -> float:
        p = self.known.get(gram)
        if p is None:
            p = self.chance(gram[1:]) if len(gram) > 1 else self.floor
            if n := self.total.get(gram[:-1]):
                t = self.kinds[gram[:-1]]
                p = (self.grams.get(gram, 0) + t * p) / (n + t)
            if len(self.known) < 500_000:
                self.known[gram] = p
        return p

    def log_likelihood(self, text: str) -> float:
        padded = "\x02" * self.order + text + "\x03"
        return sum(math.log(self.chance(padded[i - self.order - 1 : i])) for i in range(self.order + 1, len(padded) + 1))


def full_grams(text: Column, order: int) -> Column:
    """The gram of order + 1 characters that ends at each character of text and at its end."""
    chars = F.concat(F.array_repeat(F.lit("\x02"), order), F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), F.array(F.lit("\x03")))
    return let(chars, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - order - 1), lambda i: F.concat(*[F.get(v, i + k) for k in range(order + 1)])))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def gram_scores(needed: DataFrame, counts: DataFrame, order: int, accepted: str = "allow", rejected: str = "block") -> DataFrame:
    """gram, score for the distinct grams of order + 1 characters in needed (gram): log chance if accepted less that if rejected, by Witten-Bell interpolation over all counts."""
    labels = (accepted, rejected)
    suffixes = needed.select(F.explode(F.array(*[F.substring("gram", -k, k) for k in range(1, order + 2)])).alias("gram"))
    known = [F.when(F.col("label") == x, F.col("n")).otherwise(0).alias(f"n{j}") for j, x in enumerate(labels)]
    rows = counts.select("gram", *known, F.lit(False).alias("asked")).unionByName(suffixes.select("gram", F.lit(0).alias("n0"), F.lit(0).alias("n1"), F.lit(True).alias("asked")))
    rows = rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("asked").alias("asked")).withColumn("size", F.length("gram"))
    context = Window.partitionBy(F.expr("left(gram, size - 1)"), "size")  # no more rows than there are characters
    rows = rows.withColumns({f"total{j}": F.sum(f"n{j}").over(context) for j in (0, 1)} | {f"kinds{j}": F.sum((F.col(f"n{j}") > 0).cast("int")).over(context) for j in (0, 1)})
    rows = written(rows.filter("asked").drop("asked"), "grams")
    below = None
    for k in range(1, order + 2):
        level = rows.filter(F.col("size") == k)
        if below is not None:
            level = level.withColumn("shorter", F.substring("gram", -(k - 1), k - 1)).join(below, "shorter")
        less = lambda j: F.lit(1 / ALPHABET) if below is None else F.col(f"less{j}")  # noqa: E731, B023
        chance = lambda j: F.when(F.col(f"total{j}") > 0, (F.col(f"n{j}") + F.col(f"kinds{j}") * less(j)) / (F.col(f"total{j}") + F.col(f"kinds{j}"))).otherwise(less(j))
        below = level.select(F.col("gram").alias("shorter"), chance(0).alias("less0"), chance(1).alias("less1"))
    return below.select(F.col("shorter").alias("gram"), (F.log("less0") - F.log("less1")).alias("score"))


def text_scores(texts: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """key, score for texts (key, text) of distinct keys: log-likelihood difference per character."""
    grams = texts.select("key", F.explode(full_grams(F.col("text"), order)).alias("gram"))
    scores = written(gram_scores(grams.select("gram").distinct(), counts, order), "gram-scores")
    return grams.join(small_or_shuffled(scores), "gram").groupBy("key").agg((F.sum("score") / F.count("*")).alias("score"))


def model_text(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")


def calibrated(held: DataFrame) -> tuple[float, float, float]:
    """held (label, score) -> threshold, share of accepted rows under it, share of rejected rows not under it."""
    bins = held.select("label", F.round(100 * F.greatest(F.least("score", F.lit(MOST)), F.lit(-MOST))).cast("int").alias("bin")).groupBy("label", "bin").count()
    n = {(r["label"], r["bin"]): r["count"] for r in bins.collect()}  # two labels and 2,001 bins at most
    yes, no = (max(1, sum(v for (label, _), v in n.items() if label == x)) for x in ("allow", "block"))
    best, under, over = (math.inf, 0.0, 0.0, 0.0, 0.0), 0, sum(v for (label, _), v in n.items() if label == "block")
    for cut in range(-round(100 * MOST), round(100 * MOST) + 2):  # bins under cut are blocked
        best = min(best, ((under / yes) + (over / no), abs(cut / 100 - 0.005), cut / 100 - 0.005, under / yes, over / no))
        under, over = under + n.get(("allow", cut), 0), over - n.get(("block", cut), 0)
    return best[2:]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """pages with host, path, rule, verdict and score (null where a rule decides)."""
    return judged_urls(pages, rules, url, order, folds)[0]


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", order: int = ORDER, folds: int = FOLDS) -> tuple[DataFrame, tuple[float, float, float] | None]:
    """What filter_urls gives, and what calibrated gives, or None without URLs of both labels."""
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col(f"`{url}`"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    judged = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), host.alias("host"), path.alias("path"), model_text(F.col(f"`{url}`")).alias("_text"))
    rule, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_label": verdict})
    shown = [*[F.col(f"_row.`{c}`") for c in rest], "host", "path", "rule", "score", "verdict"]
    judged = judged.withColumns({"_key": F.xxhash64("_text"), "_held": F.coalesce((F.pmod(F.xxhash64("_text"), F.lit(folds)) == 0) & F.col("_label").isNotNull(), F.lit(False))})
    counts = written(count_grams(judged.filter(F.col("_label").isNotNull() & ~F.col("_held")), "_text", "_label", order), "gram-counts")
    if not {"allow", "block"} <= {r["label"] for r in counts.select("label").distinct().collect()}:
        return judged.withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.coalesce("_label", F.lit("allow"))).select(*shown), None
    held = judged.filter("_held")
    texts = judged.filter(F.col("_label").isNull()).select("_key", "_text").unionByName(held.select("_key", "_text")).groupBy(F.col("_key").alias("key")).agg(F.min("_text").alias("text"))
    scores = written(text_scores(written(texts, "texts"), counts, order).select(F.col("key").alias("_scored"), F.col("score").alias("_score")), "scores")
    scores = small_or_shuffled(scores)
    found = calibrated(held.join(scores, F.col("_key") == F.col("_scored")).select(F.col("_label").alias("label"), F.col("_score").alias("score")))
    judged = judged.join(scores, F.col("_key") == F.col("_scored"), "left").withColumn("score", F.when(F.col("_label").isNull(), F.col("_score")))
    return judged.withColumn("verdict", F.coalesce("_label", F.when(F.col("score") < found[0], "block").otherwise("allow"))).select(*shown), found


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")
