"""A quality classifier from weak labels.

Overlapping heuristic labellers vote on every text; expectation-maximisation over the counts of vote patterns
estimates how accurate each is (see ``weak_supervision``); the posterior probabilities are the labels of a hashed
linear scorer, which is trained on a bounded sample and then scores every text.

Toxicity is judged apart from quality, by a second hashed linear scorer over words and beginnings of words. Its
labels are those of a table of labelled rows, of which a bounded sample is read; without such a table, one general
labeller (a list of insults) stands in.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, free_name, quoted, received, ship, stash
from .weak_supervision import fit

#: Common English insults, the labeller of toxicity where there are no labelled rows; fixed values.
INSULTS = frozenset(b"trash pathetic idiot idiots disgusting worthless stupid clown loser losers scum moron morons vermin filth".split())
#: Toxicity's scorer: buckets of features, lengths of beginnings of words, folds, and least toxic rows that a feature needs.
BUCKETS, STEMS, FOLDS, LEAST_SEEN = 1 << 18, (4, 6), 4, 3
#: What is taken off a feature's log odds, in standard errors, and the least that must be left.
DOUBT, LEAST_ODDS = 1.5, 1.0
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for as with was on are be this le la les de des et un une que en qui dans du est pour par der die das und ist nicht ein eine den zu mit von el los las y que del se por con una no".encode().split()
)
SYMBOLS = b"#*$%&|<>!"
LABELLERS = ("symbols", "letters", "plain_words", "capitals", "word_length", "dominance", "function_words", "punctuation", "repetition", "stutter")
LETTERS = bytes([*range(65, 91), *range(97, 123)])
#: First bytes of characters beyond ASCII, which count as letters, and the bytes that follow these.
FIRST, FURTHER = bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))
BLANKS = b" \t\n\x0b\x0c\r"
#: A word of letters with a mark at its end at most.
PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff]+[.,;:!?]?(?!\S)")
STOP = re.compile(rb"[.?,](?!\S)")
MARKS = b".,;:!?"


def count(data: bytes, which: bytes) -> int:
    """How many bytes of ``data`` are among ``which``."""
    return len(data) - len(data.translate(None, which))


def label(text: str | None) -> list[int]:
    """Votes of LABELLERS: 1 good, -1 bad, 0 abstains; all abstain where a text has no words."""
    data = (text or "").encode()
    low = data.lower()
    words = low.split()
    n = len(words)
    if not n:
        return [0] * len(LABELLERS)
    size = len(data.translate(None, FURTHER + BLANKS))
    letters = count(data, LETTERS + FIRST)
    most = lambda x, good, bad: 1 if x <= good else -1 if x > bad else 0
    least = lambda x, good, bad: 1 if x >= good else -1 if x < bad else 0
    stops = len(STOP.findall(data)) / n
    return [
        most(count(data, SYMBOLS) / n, 0.03, 0.15),
        least(letters / size, 0.90, 0.80),
        least(len(PLAIN.findall(data)) / n, 0.85, 0.60),
        most(count(data, LETTERS[:26]) / max(1, letters), 0.2, 0.5),
        1 if 3 <= size / n <= 10 else -1 if size / n < 2 or size / n > 14 else 0,
        0 if n < 10 else most(max(Counter(words).values()) / n, 0.15, 0.3),
        least(sum(map(FUNCTION_WORDS.__contains__, words)) / n, 0.10, 0.02),
        1 if 0.03 <= stops <= 0.4 else -1 if stops > 0.7 else 0,
        least(fresh_share(words), 0.8, 0.5),
        0 if n < 10 else most(sum(map(bytes.__eq__, words, words[1:])) / n, 0.02, 0.15),
    ]


def fresh_share(words: list) -> float:
    """Distinct three-word windows over all of them; 1 where there are none."""
    return len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 1.0


#: The class of each byte of a word's shape: capitals, small letters, digits, others beyond ASCII; marks stay.
SHAPE = bytes(85 if 65 <= b <= 90 else 108 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 110 if b >= 128 else b for b in range(256))


def features(text: str | None, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: buckets and values, ``dims`` and one of each at most, however long
    the text.

    Words and their shapes (classes of the first twelve bytes) have their share times ten; one more bucket tells, in
    tenths, how much the text repeats itself. Each distinct word is hashed once.
    """
    words = (text or "").encode().split()
    seen = Counter(words)
    own = zlib.crc32(b"\x01%d" % int(10 * fresh_share(words))) % dims
    if not seen:
        return np.array([own]), np.array([2.0], np.float32)
    hashes = np.fromiter((h for w in seen for h in (zlib.crc32(w), zlib.crc32(w.translate(SHAPE)[:12], 1))), np.int64, 2 * len(seen)) % dims
    x = np.bincount(hashes, np.repeat(np.fromiter(seen.values(), np.float64, len(seen)), 2), dims)
    i = np.flatnonzero(x)
    return np.append(i, own), np.append(x[i] * (5 / len(words)), 2.0).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: list[float], dims: int, epochs: int, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of hashed features, by gradient steps in a fixed order."""
    w, b, g = np.zeros(dims), 0.0, np.full(dims, 1e-8)
    gb = 1e-8
    for _ in range(epochs):
        for (i, x), y in zip(rows, target):
            e = 1 / (1 + np.exp(-np.clip(w[i] @ x + b, -30, 30))) - y
            d = e * x + decay * w[i]
            g[i] += d * d
            w[i] -= rate * d / np.sqrt(g[i])
            gb += e * e
            b -= rate * e / np.sqrt(gb)
    return w, b


def traits(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:k], k) % BUCKETS for k in STEMS if len(word) > k)]


def plain_words(text: str | None) -> Counter:
    """How often each word occurs, A-Z lower-cased, without marks at its ends."""
    return Counter(w.strip(MARKS) for w in (text or "").encode().lower().split())


def evidence(seen: Counter, of_word: Callable[[bytes], float]) -> float:
    """The mean of the words' weights; 0 without words."""
    return sum(n * of_word(w) for w, n in seen.items()) / max(1, sum(seen.values()))


def weigher(weights: dict[int, float]) -> Callable[[bytes], float]:
    """Sums the weights of a word's traits; the last 65,536 words are remembered."""
    return functools.lru_cache(1 << 16)(lambda word: sum(weights.get(i, 0.0) for i in traits(word)))


def odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """A feature's weight: the log odds of toxic rows that have it, less some doubt; 0 where little is left."""
    if toxic < LEAST_SEEN:
        return 0.0
    found = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    found -= DOUBT * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return found if found > LEAST_ODDS else 0.0


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and bias of the probability of ``y`` given evidence ``z``, by Newton steps."""
    scale = float(z.std()) or 1.0
    x, w = np.stack([z / scale, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = x.T @ (x * (q * (1 - q))[:, None]) + ridge * np.eye(2)
        w += np.linalg.solve(bend, x.T @ (y - q) - ridge * w)
    return float(w[0] / scale), float(w[1])


def toxicity_model(rows: DataFrame) -> tuple[dict[int, float], float, float]:
    """Weights by bucket, slope and bias from labelled ``rows`` (id, text, toxic boolean); no weights if none is toxic.

    Rows are counted by bucket and fold where they are. Evidence for the calibration comes from weights of the other folds.
    The driver gets the buckets that enough toxic rows have, and one number a row.
    """
    spark = rows.sparkSession
    rows = stash(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int")), "classifier-labelled")

    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted({i for w in plain_words(x.as_py()) for i in traits(w)}) for x in batch], pa.list_(pa.int32()))

    buckets.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    sums = [F.count_if((F.col("fold") == k) & (F.col("toxic") == t)).alias(f"n{k}{int(t)}") for k in range(FOLDS) for t in (True, False)]
    totals = rows.agg(*sums).first()
    if not sum(totals[f"n{k}1"] for k in range(FOLDS)):
        return {}, 0.0, 0.0
    held = rows.select("fold", "toxic", F.explode(F.arrow_udf(buckets, "array<int>")(F.col("text"))).alias("bucket"))
    counts = held.groupBy("bucket").agg(*sums).where("+".join(f"n{k}1" for k in range(FOLDS)) + f" >= {LEAST_SEEN}").orderBy("bucket").collect()

    def weights(out: int | None) -> dict[int, float]:
        def of(r, t: int) -> int:
            return sum(r[f"n{k}{t}"] for k in range(FOLDS) if k != out)

        found = {r.bucket: odds(of(r, 1), of(r, 0), of(totals, 1), of(totals, 0)) for r in counts}
        return {k: v for k, v in found.items() if v}

    shipped = ship(spark, [weights(k) for k in range(FOLDS)])

    def unseen(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of_fold = [weigher(w) for w in received(shipped)]
        for texts, folds in batches:
            yield pa.array([evidence(plain_words(t), of_fold[k]) for t, k in zip(texts.to_pylist(), folds.to_pylist())], pa.float64())

    unseen.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    told = rows.select(F.arrow_udf(unseen, "double")("text", "fold").alias("z"), F.col("toxic").cast("int").alias("y")).orderBy("z", "y").collect()
    return weights(None), *calibrate(np.array([r.z for r in told]), np.array([float(r.y) for r in told]))


def insulting(text: str | None, share: float) -> bool:
    """Whether more than ``share`` of a text's words are insults."""
    return evidence(plain_words(text), lambda w: float(w in INSULTS)) > share


def classify_quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", dims: int = 1 << 14, sample: int = 3000, epochs: int = 5, least: float = 0.1, labels: DataFrame | None = None, labelled: int = 3000, toxic_least: float = 0.5, insult_share: float = 0.008) -> DataFrame:
    """Every row of ``docs`` with score (probability of good quality), toxicity (probability) and kept: a score of at
    least ``least`` and a toxicity below ``toxic_least``.

    The scorer of quality is trained on the ``sample`` rows whose ids hash lowest, a documented bound on what the driver
    holds; accuracies are estimated from all rows, and all rows are scored. ``least`` is low since scores lie near 0 and 1
    and a good text that is lost costs more than a bad one kept.

    The scorer of toxicity is fitted on rows of ``labels`` (``id_col`` and toxic, 0 or 1; several for an id count as
    toxic if one is, nulls do not count): of the ``labelled`` ids there that hash lowest, at most ``labelled`` rows that
    ``docs`` has. Without ``labels`` it is fitted on the sample, where texts with over ``insult_share`` insults count as
    toxic. Without a toxic row to learn from, toxicity is 0 everywhere.

    Null or empty text has no features and gets the bias alone. Repeated rows each give a row; columns named like a result
    give way; an empty table gives no rows.
    """

    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([label(x.as_py()) for x in batch], pa.list_(pa.int32()))

    vote.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.col(quoted(text_col)).cast("string")
    voted = stash(docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.arrow_udf(vote, "array<int>")(text).alias("votes")), "classifier-votes")
    model = fit(voted, "votes", len(LABELLERS))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = voted.where(F.col("id").isNotNull()).orderBy(*order).limit(sample).select("id", model.posterior(F.col("votes")).alias("y"))
    pair = pa.struct([("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([dict(zip("ix", features(t.as_py(), dims))) for t in batch], pair)

    hashed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    own = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), text.alias("text"))
    few = own.join(F.broadcast(chosen), "id").select("id", "y", F.arrow_udf(hashed, "struct<i:array<int>,x:array<float>>")(F.col("text")).alias("f"))
    rows = few.orderBy(*order, "f").limit(sample).collect()
    w, b = train([(np.array(r.f.i, np.int64), np.array(r.f.x)) for r in rows], [r.y for r in rows], dims, epochs)
    if labels is None:
        told = chosen.select("id", F.lit(None).cast("boolean").alias("toxic"))
    else:
        known = labels.select(F.col(quoted(id_col)).cast("string").alias("id"), (F.col("toxic").cast("int") > 0).alias("toxic")).dropna()
        told = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(*order).limit(labelled)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([insulting(x.as_py(), insult_share) for x in batch], pa.bool_())

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judged = own.join(F.broadcast(told), "id").orderBy(*order, "text").limit(sample if labels is None else labelled)
    if labels is None:
        judged = judged.withColumn("toxic", F.arrow_udf(judge, "boolean")(F.col("text")))
    shipped = ship(docs.sparkSession, (w, b, *toxicity_model(judged)))
    kind = pa.struct([("score", pa.float64()), ("toxicity", pa.float64())])

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias, toxic, slope, shift = received(shipped)
        of_word = weigher(toxic)
        for batch in batches:
            out = []
            for x in batch:
                t = x.as_py()
                i, v = features(t, dims)
                z = bias + weights[i] @ v
                u = slope * evidence(plain_words(t), of_word) + shift
                out.append({"score": float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), "toxicity": float(1 / (1 + np.exp(-np.clip(u, -30, 30)))) if toxic else 0.0})
            yield pa.array(out, kind)

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    held = free_name(docs, "_scored")
    scored = docs.withColumn(held, F.arrow_udf(score, "struct<score:double,toxicity:double>")(text))
    s = F.col(held)
    return attach(scored, {"score": s["score"], "toxicity": s["toxicity"], "kept": (s["score"] >= least) & (s["toxicity"] < toxic_least)}).drop(held)
