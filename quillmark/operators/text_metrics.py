"""Corpus metrics of generated text against references. Formulas are those of the papers, stated at each function.

Input rows have id, hypothesis and reference. Texts are lower-cased words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, let, words
from ..plans.staging import stash


def tokens(text: Column) -> Column:
    return words(folded(text))


def ngrams(words_: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; none where there are fewer."""
    return let(words_, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.expr("cast(array() as array<string>)")))


def told_apart(grams: Column) -> Column:
    """Sorted n-grams, each with its number among equal ones."""
    return let(F.array_sort(grams), lambda s: F.transform(s, lambda x, i: F.concat_ws("\n", x, (i - F.array_position(s, x)).cast("string"))))


def clipped(h: Column, r: Column) -> Column:
    """How many of h's n-grams r has, each at most as often as in r: what both have when equal ones are numbered."""
    return F.size(F.array_intersect(told_apart(h), told_apart(r)))


def bleu(rows: DataFrame, most: int = 4) -> DataFrame:
    """Corpus BLEU-1..4: BP * exp(mean of ln p_n), p_n = clipped matches / n-grams over the corpus,
    BP = min(1, exp(1 - reference words / hypothesis words)). 0 where a p_n is 0."""
    h, r = tokens(F.col("hypothesis")), tokens(F.col("reference"))
    # equal pairs of texts are compared once
    held = rows.groupBy("hypothesis", "reference").agg(F.count(F.lit(1)).alias("times")).select(h.alias("h"), r.alias("r"), "times")
    per = held.select("times", F.size("h").alias("h_len"), F.size("r").alias("r_len"), *[x for n in range(1, most + 1) for x in (clipped(ngrams(F.col("h"), n), ngrams(F.col("r"), n)).alias(f"m{n}"), F.greatest(F.size("h") - (n - 1), F.lit(0)).alias(f"t{n}"))])
    total = per.agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in per.columns if c != "times"])
    brevity = F.when(F.col("h_len") >= F.col("r_len"), 1.0).otherwise(F.exp(1.0 - F.try_divide(F.col("r_len"), F.col("h_len"))))
    scores, logs = [], F.lit(0.0)
    for n in range(1, most + 1):
        logs = logs + F.when(F.col(f"m{n}") > 0, F.ln(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}"))))
        scores.append(F.coalesce(brevity * F.exp(logs / n), F.lit(0.0)).alias(f"bleu_{n}"))
    return total.select(*scores)


def lcs(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two word arrays."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left.to_pylist(), right.to_pylist()):
                row = [0] * (len(y) + 1)
                for word in x:
                    corner = 0
                    for j, other in enumerate(y, 1):
                        corner, row[j] = row[j], corner + 1 if word == other else max(row[j], row[j - 1])
                out.append(row[-1])
            yield pa.array(out, pa.int64())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(a, b)


def rouge_l(rows: DataFrame, beta: float = 1.2) -> DataFrame:
    """Per row: ROUGE-L = (1 + b^2) R P / (R + b^2 P), with R and P the common subsequence over each length; 0 without one."""
    held = rows.select("id", tokens(F.col("hypothesis")).alias("h"), tokens(F.col("reference")).alias("r"))
    held = held.withColumn("common", lcs(F.col("h"), F.col("r")))
    p, r = F.try_divide(F.col("common"), F.size("h")), F.try_divide(F.col("common"), F.size("r"))
    return held.select("id", F.col("common").alias("lcs"), F.coalesce(F.try_divide((1 + beta**2) * r * p, r + beta**2 * p), F.lit(0.0)).alias("rouge_l"))


def exact_meteor(rows: DataFrame) -> DataFrame:
    """Per row METEOR over exact matches only: F = 10PR / (R + 9P), without stems, synonyms or the fragment penalty."""
    held = rows.select("id", tokens(F.col("hypothesis")).alias("h"), tokens(F.col("reference")).alias("r"))
    m = clipped(F.col("h"), F.col("r"))
    p, r = F.try_divide(m, F.size("h")), F.try_divide(m, F.size("r"))
    return held.select("id", F.coalesce(F.try_divide(10 * p * r, r + 9 * p), F.lit(0.0)).alias("meteor_exact"))


def cider(rows: DataFrame, most: int = 4) -> DataFrame:
    """Per row CIDEr with one reference: the mean over n of ten times the cosine of tf-idf vectors, where
    idf = ln(rows / rows whose reference has the n-gram, 1 at least) and tf is the share of the text's n-grams."""
    held = rows.groupBy("hypothesis", "reference").agg(F.count(F.lit(1)).alias("times"))
    # equal pairs of texts are compared once, under a number of their own; each counts as often as it occurs
    pairs = stash(held.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    both = pairs.repartition("pair").select("pair", "times", tokens(F.col("hypothesis")).alias("h"), tokens(F.col("reference")).alias("r"))
    each = lambda side: F.flatten(F.array(*[F.transform(ngrams(F.col(side), n), numbered(n)) for n in range(1, most + 1)]))
    long = both.select("pair", "times", F.explode(F.concat(F.transform(each("h"), sided("h")), F.transform(each("r"), sided("r")))).alias("x")).select("pair", "times", "x.*")
    tf = long.groupBy("pair", "times", "n", "g").agg(F.count_if(F.col("side") == "h").alias("h"), F.count_if(F.col("side") == "r").alias("r"))
    df = tf.where(F.col("r") > 0).groupBy("n", "g").agg(F.sum("times").alias("df"))
    size = pairs.agg(F.sum("times").alias("rows"))
    weighed = tf.join(df, ["n", "g"], "left").join(F.broadcast(size)).withColumn("idf", F.ln(F.col("rows") / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))))
    sums = weighed.groupBy("pair", "n").agg(F.sum(F.col("h") * F.col("r") * F.col("idf") * F.col("idf")).alias("hr"), F.sum(F.pow(F.col("h") * F.col("idf"), 2)).alias("hh"), F.sum(F.pow(F.col("r") * F.col("idf"), 2)).alias("rr"))
    per = sums.select("pair", F.coalesce(F.try_divide(F.col("hr"), F.sqrt("hh") * F.sqrt("rr")), F.lit(0.0)).alias("s")).groupBy("pair").agg((10.0 * F.sum("s") / most).alias("cider"))
    made = stash(pairs.join(per, "pair", "left").select(F.col("hypothesis").alias("_h"), F.col("reference").alias("_r"), F.coalesce("cider", F.lit(0.0)).alias("cider")), "cider")
    return rows.join(made, F.col("hypothesis").eqNullSafe(F.col("_h")) & F.col("reference").eqNullSafe(F.col("_r")), "left").select("id", "cider")


def numbered(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))


def sided(side: str):
    return lambda x: F.struct(F.lit(side).alias("side"), x["n"].alias("n"), x["g"].alias("g"))
