"""URL filters by expanded expressions, in DataFrame functions only.

Each URL is expanded into those host suffixes that have as many labels as some rule's host, times those prefixes of its
path that are as long as some rule's path, so that neither a long host nor a long path costs more than the rules ask for.
An expression's SHA-256 is looked up in two steps: an equi-join on its first four bytes, then a comparison of the full
digest. Of the rules that fit a URL, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, quoted

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Separates host from path before hashing; no host has it.
BAR = "\n"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The host's last labels, as many as each of the given counts says; none for a count that the host has not."""
    have = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    counts = F.filter(F.lit(labels).cast("array<int>"), lambda k: k <= have)
    return F.transform(counts, lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """Beginnings of the path that are as long as each of the given lengths says, where the path is as long."""
    return F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(BAR), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """Every row of ``pages`` with host, path, rule (``host`` + ``path`` of the winning rule, else null) and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the URL's path
    starts with the rule's path. The longest (host and path together) wins; of equally long ones the longer host,
    then block. Without a rule the verdict is ``default``.

    A null URL and one without ``://`` has empty host and path, and can only fit a rule with both empty. Rules with
    a null host, path or verdict are left out; repeated ones count once, and contradicting ones block. Repeated
    pages each give a row. Columns of ``pages`` called host, path, rule or verdict give way. URLs are expanded once
    for each distinct URL, and only URLs that meet a rule are joined back, so neither a hot host nor repeated URLs
    gather in one task; Spark broadcasts the rules only below its own size threshold. The driver holds the distinct label
    counts and path lengths of the rules, a few numbers however many rules there are.
    """
    rule = rules.select(F.translate(F.col("host"), *LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    rule = rule.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    count = lambda n: [r.n for r in rule.select(n.alias("n")).distinct().orderBy("n").collect()]
    lengths, labels = count(F.length("r_path")), count(F.size(F.split("r_host", r"\.")))
    rule = rule.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("key", F.substring("r_digest", 1, prefix_chars))
    judged = attach(pages, {"host": host_of(F.col(quoted(url_col))), "path": path_of(F.col(quoted(url_col)))})
    urls = judged.select(F.col("host"), F.col("path")).distinct()
    expanded = urls.select("host", "path", F.explode(host_suffixes(F.col("host"), labels)).alias("suffix")).select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), lengths)).alias("prefix"))
    expanded = expanded.select("host", "path", digest(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn("key", F.substring("digest", 1, prefix_chars))
    met = expanded.join(rule, "key").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    left, right = judged.alias("l"), best.alias("r")
    joined = left.join(right, (F.col("l.host") == F.col("r.host")) & (F.col("l.path") == F.col("r.path")), "left")
    kept = [F.col("l." + quoted(c)) for c in judged.columns if c.lower() not in ("rule", "verdict")]
    return joined.select(*kept, F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
