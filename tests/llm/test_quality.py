import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from quillmark.llm.quality_classifier import LABELLERS, classify_quality, label
from quillmark.llm.quality_rules import RULES, quality_rules
from quillmark.llm.weak_supervision import fit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x\x0by\x0cz\r\n x", "é😀 #*$", "a\n\n a\na\n\na", "w " * 60_000]
    for _ in range(150):
        vocabulary = [rng.choice(["the", "of", "é", "x#", "😀", "a|", "B"]) + str(rng.randint(0, rng.choice([2, 5, 500]))) for _ in range(rng.choice([3, 10, 400]))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(rng.randint(1, 150))))
    return out


def test_measures_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(0, None), (None, "a b c")]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, Kept string")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(frame).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)


def em(patterns, rules, steps=30, belief=0.8, smooth=20.0, prior=0.8):
    good, bad = [belief] * rules, [belief] * rules
    for _ in range(steps):
        q = n = 0.0
        s = {k: [0.0] * rules for k in ("gg", "g", "bb", "b")}
        for votes, count in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(good[j] / (1 - bad[j])) if v == 1 else math.log((1 - good[j]) / bad[j]) if v == -1 else 0 for j, v in enumerate(votes))
            w = 1 / (1 + math.exp(-z))
            q, n = q + count * w, n + count
            for j, v in enumerate(votes):
                s["gg"][j] += count * w * (v == 1)
                s["g"][j] += count * w * (v != 0)
                s["bb"][j] += count * (1 - w) * (v == -1)
                s["b"][j] += count * (1 - w) * (v != 0)
        prior = (q + 1) / (n + 2)
        good = [(x + smooth * belief) / (y + smooth) for x, y in zip(s["gg"], s["g"])]
        bad = [(x + smooth * belief) / (y + smooth) for x, y in zip(s["bb"], s["b"])]
    return prior, good, bad


def test_expectation_maximisation_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        y = 1 if rng.random() < 0.7 else -1
        rows.append(([0 if rng.random() < 0.2 else y if rng.random() < a else -y for a in (0.9, 0.8, 0.65, 0.85)],))
    model = fit(spark.createDataFrame(rows, "v array<int>"), "v", 4)
    prior, good, bad = em(sorted(Counter(tuple(r[0]) for r in rows).items()), 4)
    assert math.isclose(model.prior, prior, rel_tol=1e-9) and abs(prior - 0.7) < 0.05
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(model.good + model.bad, good + bad))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality_rules(none).count() == 0 and classify_quality(none).count() == 0
    assert fit(spark.createDataFrame([], "v array<int>"), "v", 3).good == (0.8, 0.8, 0.8)


def test_accuracy_of_both_against_labels(spark):
    # rules and limits were chosen with labels of this generator in view: a guard against regressions, no estimate
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "truth")
    # the classifier's bag of words does not see all of the texts that only repeat themselves
    for judged, wrong in ((quality_rules(docs, carry=["doc_id"]).where("not base_failed"), 0.1), (classify_quality(docs), 0.4)):
        rows = judged.join(labels, "doc_id").where("toxic = 0").select("kept", "truth").collect()
        good, bad = [r.kept for r in rows if r.truth == 1], [r.kept for r in rows if r.truth == 0]
        assert sum(good) >= 0.98 * len(good), (sum(good), len(good))
        assert len(bad) == 0 or sum(bad) <= wrong * len(bad), (sum(bad), len(bad))


def test_toxicity_on_labels_that_it_was_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    told = labels.where("pmod(xxhash64(doc_id, 9), 2) = 0")
    rest = docs.join(labels.join(told, "doc_id", "left_anti"), "doc_id").select("doc_id", "text", F.col("toxic").alias("truth"))
    rows = classify_quality(docs.select("doc_id", "text").join(told.select("doc_id"), "doc_id").unionByName(rest.select("doc_id", "text")), labels=told).join(rest.select("doc_id", "truth"), "doc_id").select("toxicity", "truth").collect()
    toxic, clean = [r.toxicity >= 0.5 for r in rows if r.truth == 1], [r.toxicity >= 0.5 for r in rows if r.truth == 0]
    assert len(toxic) > 100 and sum(toxic) >= 0.88 * len(toxic), (sum(toxic), len(toxic))
    assert sum(clean) <= 0.01 * len(clean), (sum(clean), len(clean))


def test_rules_run_without_python(spark):
    frame = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    plan = quality_rules(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(RULES) <= 10


def test_classifier_handles_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "the of and"), (3, ""), (4, "the " * 100_000)]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, SCORE string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    odd = spark.createDataFrame([(1, None, "x"), (None, 1, "x"), (3, 0, "x"), (4, 1, "x"), (4, 1, "x"), (9, 1, "x")], "doc_id bigint, toxic int, text string")
    for labels in (None, none, odd):
        got = classify_quality(frame, labels=labels).select("doc_id", F.col("score").between(0, 1).alias("ok"), "toxicity").collect()
        assert len(got) == 5 and all(r.ok and 0 <= r.toxicity < 0.5 for r in got), labels


def hashed(text, dims):
    words = (text or "").encode().split()
    grams = list(zip(words, words[1:], words[2:]))
    own = zlib.crc32(b"\x01%d" % int(10 * (len(set(grams)) / len(grams) if grams else 1.0))) % dims
    if not words:
        return [(own, 2.0)]
    shape = lambda w: re.sub(rb"[\x80-\xff]", b"n", re.sub(rb"[0-9]", b"\0", re.sub(rb"[A-Z]", b"U", re.sub(rb"[a-z]", b"l", w)))).replace(b"\0", b"0")[:12]
    x = Counter()
    for w in words:
        x[zlib.crc32(w) % dims] += 1
        x[zlib.crc32(shape(w), 1) % dims] += 1
    return [(k, float(np.float32(5 * v / len(words)))) for k, v in sorted(x.items())] + [(own, 2.0)]


def logistic(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def brute_scores(rows, ids_in_order, dims, epochs):
    """Scores of all rows from plain loops: votes, EM, gradient steps in the order of the ids' hashes, one row an id."""
    prior, good, bad = em(sorted(Counter(tuple(label(t)) for t in rows.values()).items()), len(LABELLERS))
    w, g, b, gb = Counter(), Counter(), 0.0, 1e-8
    for _ in range(epochs):
        for i in ids_in_order:
            votes = label(rows[i])
            y = logistic(math.log(prior / (1 - prior)) + sum(math.log(p / (1 - q)) if v == 1 else math.log((1 - p) / q) if v == -1 else 0 for v, p, q in zip(votes, good, bad)))
            f = hashed(rows[i], dims)
            e = logistic(sum(w[k] * x for k, x in f) + b) - y
            steps = {k: e * x + 1e-4 * w[k] for k, x in f}
            for k, d in steps.items():
                g[k] += d * d
                w[k] -= 0.5 * d / math.sqrt(g[k] + 1e-8)
            gb += e * e
            b -= 0.5 * e / math.sqrt(gb)
    return {i: logistic(b + sum(w[k] * x for k, x in hashed(t, dims))) for i, t in rows.items()}


def brute_toxicity(rows, truth, folds):
    """Toxicity of all rows: log odds of words and beginnings, and a logistic curve fitted by plain gradient descent."""

    def features(t):
        return [[w, *[(k, w[:k]) for k in (4, 6) if len(w) > k]] for w in (x.strip(b".,;:!?") for x in (t or "").lower().encode().split())]

    def weights(ids):
        on, off = Counter(), Counter()
        for i in ids:
            (on if truth[i] else off).update({f for fs in features(rows[i]) for f in fs})
        n, m = sum(truth[i] for i in ids), sum(not truth[i] for i in ids)
        found = {f: math.log((k + 0.5) / (n + 1) / (off[f] + 0.5) * (m + 1)) - 1.5 * math.sqrt(1 / (k + 0.5) + 1 / (off[f] + 0.5)) for f, k in on.items() if k >= 3}
        return {f: v for f, v in found.items() if v > 1}

    def mean(t, of):
        fs = features(t)
        return sum(of.get(f, 0.0) for x in fs for f in x) / max(1, len(fs))

    z = [(mean(rows[i], weights([j for j in truth if folds[j] != folds[i]])), truth[i]) for i in truth]
    middle = sum(x for x, _ in z) / len(z)
    scale = math.sqrt(sum((x - middle) ** 2 for x, _ in z) / len(z)) or 1.0
    a = c = 0.0
    for _ in range(30_000):
        e = [(logistic(a * x / scale + c) - y, x / scale) for x, y in z]
        a -= 0.02 * (sum(d * x for d, x in e) + 0.01 * a)
        c -= 0.02 * (sum(d for d, _ in e) + 0.01 * c)
    whole = weights(list(truth))
    return {i: logistic(a / scale * mean(t, whole) + c) for i, t in rows.items()}


def test_classifier_against_brute_force(spark):
    rng = random.Random(8)
    common = "the of and to in is that it house river table green walk slowly stone".split()
    rows, truth = {}, {}
    for i in range(70):
        words = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            words += [rng.choice(["grubnak", "grubnaks", "Zelfwort!", "zelfworter"]) for _ in range(4)]
        if i % 7 == 0:
            words = [rng.choice(["###", "$$9", "x", "QQQQQQ"]) for _ in words] + words[-4:]
        rng.shuffle(words)
        rows[i] = " ".join(words)
        if i < 45:
            truth[i] = toxic
    rows |= {100: None, 101: "", 102: "the the the", 103: "É" * 40}
    frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(t)) for i, t in truth.items()], "doc_id bigint, toxic int")
    key = F.col("doc_id").cast("string")
    keys = frame.select("doc_id", F.xxhash64(key).alias("h"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4)).alias("fold")).collect()
    folds, first = {r.doc_id: r.fold for r in keys}, [r.doc_id for r in sorted(keys, key=lambda r: (r.h, str(r.doc_id)))][:40]
    got = {r.doc_id: r for r in classify_quality(frame, labels=labels, dims=512, sample=40, epochs=3).collect()}
    scores, toxicity = brute_scores(rows, first, 512, 3), brute_toxicity(rows, truth, folds)
    assert set(got) == set(rows)
    for i, r in got.items():
        assert math.isclose(r.score, scores[i], rel_tol=1e-4, abs_tol=1e-5), (i, r.score, scores[i])
        assert math.isclose(r.toxicity, toxicity[i], rel_tol=1e-3, abs_tol=1e-4), (i, r.toxicity, toxicity[i])
        assert r.kept == (scores[i] >= 0.1 and toxicity[i] < 0.5)
    assert any(r.toxicity >= 0.5 for r in got.values()) and any(r.toxicity < 0.5 for r in got.values())
