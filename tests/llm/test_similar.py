import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from quillmark.llm import similar


def plain_set(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """(id, component) of every row over all pairs."""
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, least.get(find(i))) for i, (doc, _) in enumerate(rows))


def corpus(seed):
    """Texts with one passage that many have, groups of edited copies near the threshold, and odd rows."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (None, "one"), (None, "unique words here only"), (5, "a b c d e f")]
    for k in range(20):
        body = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120, 300]))] + passage * (k % 2)
        for c in range(rng.choice([1, 4, 25])):
            copy = list(body)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 10**9)}"
            rows.append((100 + 100 * k + c, " ".join(copy[: len(copy) - rng.choice([0, 0, len(copy) // 6])])))
    return rows


@pytest.mark.parametrize("sample, centres", [(1, 1), (16, 4)])
def test_against_brute_force(spark, monkeypatch, sample, centres):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    monkeypatch.setattr(similar, "CENTRES", centres)
    rows = corpus(sample)
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, Component_ID string")
    assert Counter((r.doc_id, r.component_id) for r in similar.similar_groups(frame).collect()) == brute(rows)


def test_sketches_never_hide_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.choice([1, 5, 64, 65, 700])))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(-(1 << 62), 1 << 62, rng.choice([0, 3, 300]))]))
        far = len(np.setxor1d(a, b))
        assert similar.least_difference(similar.sketch_of(a), similar.sketch_of(b)) <= far
        assert far or similar.sketch_of(a) == similar.sketch_of(b)


def test_empty_table(spark):
    assert similar.similar_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()


def test_stage_removes_edited_copies(spark):
    words = [f"w{k}" for k in range(100)]
    edited = [w if k not in (30, 70) else "changed" for k, w in enumerate(words)]
    other = [w if k % 9 else "changed" for k, w in enumerate(words)]
    got = kept(spark, [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(other))])
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_stage_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (1, b), (1, b), (1, b + " more"), (2, c), (2, a.upper()), (None, a), (7, "x y z"), (None, "own text"), (None, "own  text")]
    got = Counter((r.doc_id, r.text.lower().split()[0]) for r in kept(spark, rows))
    assert got == {(1, "b0"): 1, (2, "c0"): 1, (2, "a0"): 1, (7, "x"): 1, (None, "own"): 1}
