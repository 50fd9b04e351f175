import random
from collections import Counter

import xxhash
from quillmark.llm.simhash import BKTree, components, fingerprint_of, links_of, near_duplicates


def plain_print(text, k=3):
    w = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - 2**64 if x >> 63 else x


def cloud(seed, n=150):
    """Fingerprints in chains and clusters around a few centres."""
    rng = random.Random(seed)
    out = {0, 2**64 - 1, 1 << 63}
    for _ in range(6):
        now = rng.getrandbits(64)
        for _ in range(n // 6):
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                now ^= 1 << rng.randrange(64)
            out.add(now)
            if rng.random() < 0.1:
                now = rng.choice(sorted(out))
    return sorted(out)


def test_fingerprints(spark):
    rng = random.Random(0)
    for _ in range(200):
        t = " ".join(rng.choice(["A", "b\t", "é", "x\n", "Ü", "\x0bq"]) for _ in range(rng.randint(0, 40)))
        assert fingerprint_of(t, 3) == plain_print(t)
    assert fingerprint_of(None, 3) == 0
    long = "a b c d " * 40_000
    assert fingerprint_of(long, 3) == plain_print(long)


def test_tree_finds_all_within_the_radius():
    values = cloud(1)
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        for r in (0, 1, 2, 5):
            assert sorted(tree.within(v, r)) == [x for x in values if (x ^ v).bit_count() <= r]


def test_components_against_brute_force(spark):
    for seed in range(2):
        values = cloud(seed)
        prints = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
        pairs = [(signed(a), signed(b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
        want = roots(pairs, [signed(v) for v in values])
        for capacity in (4096, 3):  # the second deals out large shards
            links = links_of(prints, 2, capacity)
            assert all((((r.a ^ r.b) & (2**64 - 1)) >= 0) for r in links.collect())
            got = {r.node: r.root for r in components(links).collect()}
            assert {n: got.get(n, n) for n in want} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: v for k, v in roots(edges, {x for e in edges for x in e}).items() if k != v}
    assert got == want


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(pairs, range(len(rows)))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    return Counter((doc, signed(prints[i]), least.get(root[i])) for i, (doc, _) in enumerate(rows))


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (3, "one"), (None, "one"), (None, "unique words here only")]
    for k in range(12):
        body = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([5, 300, 900]))]
        for c in range(rng.randint(1, 6)):
            copy = list(body)
            if c % 2:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((10 + 10 * k + c, " ".join(copy)))
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, Component_ID string")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(frame).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
