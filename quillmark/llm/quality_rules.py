"""Quality rules as weak supervision, in DataFrame functions only.

Rules measure a text and vote good, bad or abstain; expectation-maximisation over all texts estimates how far each can
be trusted; a text is kept if its posterior probability of being good reaches ``least``, and if no base rule fails it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stash
from .weak_supervision import fit

SPACE = r"\x20\x09-\x0D"
BLANK, BLANKS = f"[{SPACE}]+", " \t\n\x0b\x0c\r"
#: Frequent function words of the corpus's languages; fixed values.
FUNCTION_WORDS = tuple("the of and to in is that it for as with was on are be this le la les de des et un une que en qui dans du est pour par der die das und ist nicht ein eine den zu mit von el los las y que del se por con una no".split())
RULES = ("symbols", "letters", "plain_words", "capitals", "word_length", "repeated_words", "repeated_lines", "function_words")
#: A measure at most the first number votes good, one over the second votes bad, between them the rule abstains.
LIMITS = {"symbols": (0.02, 0.10), "capitals": (0.20, 0.50), "repeated_words": (0.20, 0.50), "repeated_lines": (0.20, 0.60)}


def without(text: Column, what: str) -> Column:
    return F.regexp_replace(text, what, "")


#: Words in three-word windows that occur twice or more, from hashes of all windows. Where no hash repeats, nothing does.
#: Else windows are sorted by hash with their places; only those whose hash repeats are compared as texts, again by
#: sorting. Places that are left cover three words each, overlaps once.
REPEATS = """
if(size(array_distinct(hashes)) = size(hashes), 0L,
  aggregate(array(sort_array(transform(hashes, (h, i) -> named_struct('x', h, 'i', i)))), 0L, (z, s) ->
  aggregate(array(sort_array(transform({again}, e -> named_struct('x', concat(words[e.i], ' ', words[e.i + 1], ' ', words[e.i + 2]), 'i', e.i)))), 0L, (y, s) ->
  aggregate(
    sort_array(transform({again}, e -> e.i)), named_struct('n', 0L, 'end', -1),
    (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.end), 'end', p + 3), a -> a.n))))
""".format(again="filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x))")
HASHES = "transform(if(size(words) < 3, cast(array() as array<string>), slice(words, 1, size(words) - 2)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))"


def measured(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` of every row, with the measures of its text in the struct ``m``."""
    t = F.col("text")
    held = docs.select(F.struct(*[F.col(quoted(c)) for c in carry]).alias("row"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    inner = F.btrim(t, F.lit(BLANKS))
    words = F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, BLANK))
    # what is left of a text without its plain words are its other words
    odd = F.btrim(F.regexp_replace(t, rf"(?<![^{SPACE}])\p{{L}}++[.,;:!?]?(?![^{SPACE}])", ""), F.lit(BLANKS))
    n_odd = F.when(odd == "", 0).otherwise(F.size(F.split(odd, BLANK)))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    held = held.select("row", words.alias("words"), n_odd.alias("n_odd"), lines.alias("lines"))
    held = held.select("*", F.array_join("words", "").alias("joined"), F.expr(HASHES).alias("hashes"))
    held = held.withColumn("letters", without(F.col("joined"), r"[^\p{L}]+"))
    n = F.size("words")
    m = F.struct(
        n.cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(without(F.col("joined"), "[#*$%&|<>]+"))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATS).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.length("letters").alias("n_letters"),
        (F.length("letters") - F.length(without(F.col("letters"), r"\p{Lu}+"))).alias("n_capitals"),
        F.size(F.filter("words", lambda w: w.isin(*FUNCTION_WORDS))).alias("n_frequent"),
        (n - F.col("n_odd")).alias("n_plain"),
    )
    return held.select("row", m.alias("m"))


def votes(m: Column) -> Column:
    """Votes of RULES, from the measures."""
    share = lambda a, b: m[a].cast("double") / F.greatest(m[b], F.lit(1))
    limit = lambda x, name: F.when(x <= LIMITS[name][0], 1).when(x > LIMITS[name][1], -1).otherwise(0)
    at_least = lambda x, good, bad: F.when(x >= good, 1).when(x < bad, -1).otherwise(0)
    length = share("word_chars", "n_words")
    known = share("n_frequent", "n_words")
    return F.when(m["n_words"] == 0, F.array(*[F.lit(0)] * len(RULES))).otherwise(
        F.array(
            limit(share("n_symbols", "n_words"), "symbols"),
            at_least(share("n_letters", "word_chars"), 0.90, 0.80),
            at_least(share("n_plain", "n_words"), 0.85, 0.60),
            limit(share("n_capitals", "n_letters"), "capitals"),
            F.when(length.between(3, 10), 1).when((length < 2) | (length > 14), -1).otherwise(0),
            limit(share("n_repeat_words", "n_words"), "repeated_words"),
            limit(share("n_dup_lines", "n_lines"), "repeated_lines"),
            at_least(known, 0.10, 0.02),
        )
    )


def quality_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, least: float = 0.5, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``carry`` (all columns unless given) of every row, with the measures, votes, quality (the posterior), base_failed
    and kept.

    Base rules: fewer than ``min_words`` words, or more than ``repeat_percent`` percent of the words in three-word
    windows that repeat. Null or empty text has no words, no votes, and fails. Repeated rows each count and each give
    a row. Columns of ``docs`` named like a result give way to it. An empty table gives no rows. Measures are taken
    once, in-row, and staged in the shared folder; only the counts of vote patterns are shuffled.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes", "quality", "base_failed", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    rows = measured(docs, text_col, carry)
    staged = stash(rows.select("row", "m", votes(F.col("m")).alias("votes")), "quality")
    model = fit(staged, "votes", len(RULES))
    m = F.col("m")
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])
    quality = model.posterior(F.col("votes"))
    return staged.select("row.*", *[m[k].alias(k) for k in names[:5]], "votes", quality.alias("quality"), failed.alias("base_failed"), (~failed & (quality >= least)).alias("kept"))
