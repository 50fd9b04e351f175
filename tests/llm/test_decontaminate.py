import random
import re
import weakref

import quillmark.llm.decontaminate as decontaminate_module
from quillmark.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = {}
    wins = {}
    for item, text in items:
        w = words(text)
        if w:
            for i in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[i : i + window]), set()).update([] if item is None else [str(item)])
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, owners in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= owners
        out.setdefault(doc, []).append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(spark, docs, items, **options):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {}
    for r in decontaminate(frame, bench, **options).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.item_ids, r.contaminated))
    want = brute(docs, items, options.get("window", 13))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def random_case(seed, vocabulary=6):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "b", "é1", "the", "x9", "Of"][:vocabulary])
    text = lambda n: rng.choice([" ", ", ", "\n-"]).join(word() for _ in range(n))
    items = [(i % 7, text(rng.choice([0, 1, 3, 5, 13, 20]))) for i in range(10)] + [(None, "b b b b"), (3, None), (9, "")]
    docs = [(i, text(rng.choice([0, 2, 12, 13, 40, 200]))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[3][1] + " zzz " + (items[4][1] or "")), (0, "b b b b")]
    return docs, items


def test_against_brute_force(spark):
    for seed in range(3):
        check(spark, *random_case(seed))


def test_blocks_give_the_same(spark):
    docs, items = random_case(7)
    check(spark, docs, items, block_windows=6)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c"), (2, None)], [])


def test_clashing_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "one two three", "own", 5, "mine")], "doc_id bigint, text string, N_Words string, extra int, _hits string")
    bench = spark.createDataFrame([(4, "two three"), (5, "two"), (6, "four")], "item_id bigint, text string")
    for most in (100, 1):
        row = decontaminate(frame, bench, block_windows=most).first()
        assert (row.n_words, row.n_hit, row.item_ids, row.extra, row._hits) == (3, 2, ["4", "5"], 5, "mine")


def test_long_text(spark):
    long = " ".join(["filler"] * 50_000 + ["alpha", "beta", "gamma"] + ["filler"] * 50_000)
    check(spark, [(1, long)], [(1, "alpha beta gamma")])


def test_one_block_at_a_time(spark, monkeypatch):
    docs, items = random_case(5)
    sizes, made = [], decontaminate_module.WindowIndex

    class Counted(made):
        def __init__(self, *given):
            super().__init__(*given)
            sizes.append(len(self.windows))
            alive.add(self)
            assert len([x for x in alive if x.windows]) <= 2  # the last one and the one being made

    alive = weakref.WeakSet()
    monkeypatch.setattr(decontaminate_module, "WindowIndex", Counted)
    check(spark, docs, items, block_windows=6)
    assert len(sizes) > 5
