"""SimHash near-duplicates with BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. Bits are cut into ``radius + 2`` blocks; linked
fingerprints agree in two blocks at least, whatever bits differ, so each distinct fingerprint goes to one shard for
every pair of blocks, keyed by the pair and its bits. A shard's BK-tree (children keyed by integer Hamming distance to
their parent) is built where its fingerprints meet, and a probe follows only edges within the radius of its own
distance. Trees are sent to the tasks of their shard, not to all tasks: probing every tree with every fingerprint
would grow with the square of the corpus.

A shard gives a forest that connects what is linked in it (each fingerprint and the least of its group), never all
pairs. A shard of more than ``capacity`` distinct fingerprints is dealt out further, exactly: two fingerprints within
two bits meet in a fingerprint that is at most one bit from each, so they are dealt by those; that holds for a radius up to 2, which is what the queries use.

Components come from alternating large-star and small-star steps over the forest; each step is staged in the shared
folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, drained, quoted, small_batches, stash

SEED = 42


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = [] if text is None else text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    hashes = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist()))
    return print_of(np.fromiter(hashes, np.uint64, len(words) - shingle + 1))


def print_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half the unsigned 64-bit hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """Fingerprints as signed 64-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in drained(batches):
            yield pa.array(np.array([fingerprint_of(x.as_py(), shingle) for x in batch], np.uint64).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(text.cast("string"))


class BKTree:
    """Nodes are [value, {distance: node}]; values are unsigned integers."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Values at most ``radius`` from ``value``."""
        open_nodes = [] if self.root is None else [self.root]
        while open_nodes:
            near, children = open_nodes.pop()
            d = (near ^ value).bit_count()
            if d <= radius:
                yield near
            if len(children) <= 2 * radius + 1:
                open_nodes += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                open_nodes += [children[k] for k in range(d - radius, d + radius + 1) if k in children]


class Forest:
    """Union-find whose roots are the least members, by signed value."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_of(radius: int) -> list[int]:
    """Masks of radius + 2 blocks of nearly equal width."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, least of its group) for every fingerprint of a shard that is linked within it, except the least."""
    tree, forest = BKTree(), Forest()
    for v in values:
        for near in tree.within(v, radius):
            forest.join(signed(v), signed(near))
        tree.add(v)
    return [(x, forest.root(x)) for x in list(forest.up)]


def links_of(prints: DataFrame, radius: int, capacity: int) -> DataFrame:
    """Links (a, b) with b < a that connect every pair of distinct fingerprints (column ``fp``) within the radius."""
    masks = [signed(x | y) for x, y in itertools.combinations(blocks_of(radius), 2)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    large = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    large = stash(large, "simhash-shards")
    sized = keyed.join(large, ["table", "key"])  # fingerprints alone in their shard go here

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(values: list[int]) -> pa.RecordBatch:
            pairs = shard_links([v & (2**64 - 1) for v in values], radius)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, values = None, []
        for batch in drained(batches):
            out = []
            for key in zip(*[batch.column(k).to_pylist() for k in ("table", "key", "sub", "fp")]):
                if key[:3] != now:
                    if len(values) > 1:
                        out.append(linked(values))
                    now, values = key[:3], []
                values.append(key[3])
            yield from out
        if len(values) > 1:
            yield linked(values)

    fits = sized.where(F.col("n") <= capacity).select("table", "key", F.lit(0).cast("bigint").alias("sub"), "fp")
    rest = sized.where(F.col("n") > capacity)
    if radius <= 2:
        # all that is at most one bit away outside of the key's own bits; groups have 65 members at most
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)])
        of_key = F.array(*[F.lit(m) for m in masks])
        rest = rest.select("table", "key", F.explode(near).alias("sub"), "fp").where(F.col("sub").bitwiseAND(F.get(of_key, F.col("table"))) == F.col("key"))
    else:
        # a wider radius has no such meeting point one bit away; these shards stay whole
        rest = rest.select("table", "key", F.lit(0).cast("bigint").alias("sub"), "fp")
    dealt = fits.unionByName(rest).repartition("table", "key", "sub").sortWithinPartitions("table", "key", "sub", "fp")
    return dealt.mapInArrow(trees, "a bigint, b bigint").distinct()


def components(links: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node that it is connected with. Roots have no row.

    Large-star steps hang each node's larger neighbours on the least of its neighbourhood, small-star steps its smaller
    ones, until nothing changes. Neighbourhoods are only ever reduced to their least member before they are joined
    back, so a node with very many neighbours is a skewed join that Spark splits, never one group.
    """
    edges = stash(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = small.unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        edges = stash(fresh, label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, capacity: int = 4096, similarity: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) of every row, with fingerprint (signed 64-bit) and component_id: the
    smallest id of a row that can be reached over links between fingerprints, the row's own included.

    Words are runs without ASCII blanks, A-Z lower-cased; a text of fewer than ``shingle`` words is one shingle; null
    and empty texts have fingerprint 0 and are linked like any other. Rows with a null id take part, and have a null
    component only where no member has an id. Repeated rows each give a row. Columns named like a result give way. An
    empty table gives no rows. Texts are read once and not shuffled; copies meet as one fingerprint, summed up before
    the shuffle.

    With ``similarity``, links are verified instead: the result is that of ``similar.similar_groups``.
    """
    small_batches(docs.sparkSession)
    if similarity is not None:
        from .similar import similar_groups

        return similar_groups(docs, id_col, text_col, shingle, similarity, radius, capacity, carry)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("fingerprint", "component_id")]
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in carry]).alias("row"), F.col(quoted(id_col)).alias("id"), fingerprint(F.col(quoted(text_col)), shingle).alias("fp"))
    rows = stash(rows, "simhash-prints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links_of(prints, radius, capacity), "simhash-components")
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.where(F.col("root") != F.col("fp")).join(whole, "root").select("fp", "component_id")
    alone = whole.select(F.col("root").alias("fp"), "component_id")
    by_print = named.unionByName(alone)
    return rows.join(by_print, "fp").select("row.*", F.col("fp").alias("fingerprint"), "component_id")
