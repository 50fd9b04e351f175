"""SimHash near-duplicates that are verified: groups of texts whose word shingles have a Jaccard similarity, exactly.

It is the mode of ``simhash.near_duplicates`` with a similarity. Candidates come in three steps; each is verified, and
what it links is not compared again by the next:

* fingerprints of the shingles within ``radius`` bits, found by the BK-trees of ``simhash``;
* sets that meet under a shingle and are not linked yet: each with a few of those there, first the same few for all,
  which are nearest to the majority of the fingerprints there, then those nearest to its own;
* all that meet and are not in one component yet: of a large group of near copies few are left by then.

Fingerprints of similar texts may differ in any number of bits, so the last two steps are what loses no link. Two sets
with similarity t or more share a shingle among the first ``n - ceil(t * n) + 1`` of each, in any order that is the
same for all sets. The order puts shingles that are common in a sixteenth of the texts last, so that a passage that
many texts have makes no candidates; the sample decides on speed only, never on what is found.

A pair is verified in two steps. A set's sketch has a bit for the parity of each of as many parts of the hashes as it
has shingles; where the sketches of two sets differ in more bits than the sets may in shingles, the pair goes. Sets
themselves are made and sent for the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drained, quoted, received, ship, stash
from .simhash import SEED, components, links_of, print_of

#: One text in so many is counted for the order, and so many common shingles at most are told apart by their counts.
SAMPLE, MOST_COMMON = 16, 1 << 17
#: In each of so many rounds a set is compared with so many of those that are under a shingle with it.
ROUNDS, CENTRES = 2, 4
#: So many pairs are given at a time.
PAIRS = 1 << 16
#: Up to so many row numbers are sent to all tasks; with more, texts are shuffled.
MOST_SENT = 500_000


def shingles_of(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes (signed, ascending) of a text's word shingles; words as in SimHash."""
    from xxhash import xxh64_intdigest

    words = [] if text is None else text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    return np.unique(hashes.view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def shingles(text: Column, shingle: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in drained(batches):
            yield lists([shingles_of(x.as_py(), shingle) for x in batch])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<bigint>")(text.cast("string"))


def sketch_of(found: np.ndarray) -> bytes:
    """The parities of as many parts of the hashes as there are shingles, rounded up to a power of two."""
    parts = max(64, 1 << max(0, len(found) - 1).bit_length())
    return np.packbits((np.bincount(found & (parts - 1), minlength=parts) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that at least one of two sets has and the other has not, as far as their sketches tell."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_similar(n: Column, m: Column, a: Column, b: Column, similarity: Fraction) -> Column:
    """Whether sketches ``a`` and ``b`` of sets of sizes ``n`` and ``m`` allow the similarity."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in drained(batches):
            yield pa.array([least_difference(x, y) * (up + down) <= (k + j) * (down - up) for k, j, x, y in zip(*[c.to_pylist() for c in batch])], pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(n, m, a, b)


def marks(text: Column, shingle: int, similarity: Fraction, shipped) -> Column:
    """The hash of a text's set of shingles, the set's size, fingerprint and sketch, and the shingles under which it meets
    others."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh64_intdigest

        common, counts = received(shipped)
        for batch in drained(batches):
            keys, sizes, prints, sketches, prefixes = [], [], [], [], []
            for x in batch:
                found = shingles_of(x.as_py(), shingle)
                n = len(found)
                at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                often = np.where(common[at] == found, counts[at], 0) if len(common) else np.zeros(n, np.int64)
                keys.append(xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(n)
                prints.append(print_of(found.view(np.uint64)))
                sketches.append(sketch_of(found))
                prefixes.append(found[np.lexsort((found, often))[: n - -(-n * similarity.numerator // similarity.denominator) + 1]])
            yield pa.StructArray.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), lists(prefixes)], ["key", "n", "fp", "sketch", "prefix"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<key:bigint,n:bigint,fp:bigint,sketch:binary,prefix:array<bigint>>")(text.cast("string"))


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three sampled texts or more have, ascending, with their counts."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = some.select(F.explode(shingles(F.col("text"), shingle)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = counted.where(F.col("n") > 2).orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    tokens, counts = (np.asarray(found.column(k).to_numpy(), np.int64) for k in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def by_token(rows: DataFrame, of_bucket: Callable[..., Iterator[tuple[np.ndarray, ...]]], names: list[str]) -> DataFrame:
    """What ``of_bucket`` makes of the columns (token, key and further ones) of each token with two keys or more, each
    key once and ascending."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
            fresh = np.ones(len(held[0]), bool)
            fresh[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
            held = [x[fresh] for x in held]
            cuts = np.concatenate([[0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, [len(held[0])]])
            many = np.diff(cuts) > 1
            for a, b in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist()):
                yield from of_bucket(*[x[a:b] for x in held])

        def buckets() -> Iterator[tuple[np.ndarray, ...]]:
            tail = None
            for batch in drained(batches):
                held = [np.asarray(batch.column(k).to_numpy(), np.int64) for k in columns]
                if not len(held[0]):
                    continue
                if tail is not None:
                    held = [np.concatenate(x) for x in zip(tail, held)]
                last = int(np.searchsorted(held[0], held[0][-1]))
                tail = [x[last:] for x in held]
                if last:
                    yield from made([x[:last] for x in held])
            if tail is not None:
                yield from made(tail)

        out, size = [], 0
        for some in buckets():
            out.append(some)
            size += len(some[0])
            if size >= PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names)

    dealt = rows.repartition("token").sortWithinPartitions("token", "key")
    return dealt.mapInArrow(run, ", ".join(f"{k} bigint" for k in names))


def may_meet(n: np.ndarray, at: np.ndarray, m: int, other: int, similarity: Fraction) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` can be similar whose first common shingle is at these places."""
    up, down = similarity.numerator, similarity.denominator
    common = -(-(n + m) * up // (up + down))
    return (np.minimum(n, m) * down >= np.maximum(n, m) * up) & (at + common <= n) & (other + common <= m)


def sent(keys: DataFrame, label: str) -> DataFrame:
    """``keys``, staged, to be broadcast if there are few enough."""
    keys = stash(keys, label)
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def similar_links(rows: DataFrame, text: Column, shingle: int, similarity: Fraction, radius: int, capacity: int) -> DataFrame:
    """Links (a, b) that connect every pair of distinct sets with the similarity; ``rows`` has key, n, fp, sketch,
    prefix and a unique at, and what ``text`` needs."""
    up, down = similarity.numerator, similarity.denominator
    sets = stash(rows.groupBy("key").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "similar-sets")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Those of ``pairs`` (a, b) that are similar."""
        of = {k: sets.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in ("a", "b")}
        some = pairs.distinct().join(of["a"], "a").join(of["b"], "b")
        some = stash(some.where(may_be_similar(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), similarity)).select("a", "b"), f"similar-{label}-near")
        wanted = sets.join(some.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select("key", "at")
        tokens = rows.select("at", *[c for c in ("text", "row") if c in rows.columns]).join(sent(wanted, f"similar-{label}-wanted"), "at").select("key", shingles(text, shingle).alias("s"))
        tokens = stash(tokens, f"similar-{label}-tokens")
        whole = some.join(tokens.select(F.col("key").alias("a"), F.col("s").alias("of_a")), "a").join(tokens.select(F.col("key").alias("b"), F.col("s").alias("of_b")), "b")
        same = F.size(F.array_intersect("of_a", "of_b"))
        return stash(whole.where(same * (up + down) >= (F.size("of_a") + F.size("of_b")) * up).select("a", "b"), f"similar-{label}")

    def met_of(token, key, n, place):
        yield token, key, n, place

    def star_of(token, key, n, place, fp, root):
        ones = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * ones > len(fp)).view(np.int64)
        centres = np.lexsort((key, np.bitwise_count(fp ^ middle)))[:CENTRES]
        for k in centres.tolist():
            near = (root != root[k]) & may_meet(n, place, n[k], place[k], similarity)
            yield np.maximum(key[near], key[k]), np.minimum(key[near], key[k])

    def nearest_of(token, key, n, place, fp, root):
        names, at, sizes = np.unique(root, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(at != sizes.argmax()).tolist():
            others = np.flatnonzero((root != root[k]) & may_meet(n, place, n[k], place[k], similarity))
            if len(others) > CENTRES:
                others = others[np.argsort(np.bitwise_count(fp[others] ^ fp[k]), kind="stable")[:CENTRES]]
            yield np.maximum(key[others], key[k]), np.minimum(key[others], key[k])

    def rest_of(token, key, n, place, fp, root):
        if (root != root[0]).any():
            for k in range(1, len(key)):
                near = (root[:k] != root[k]) & may_meet(n[:k], place[:k], n[k], place[k], similarity)
                yield np.full(int(near.sum()), key[k]), key[:k][near]

    # sets of one fingerprint are paired with the least of them, and that with the least of the linked fingerprint
    least = sets.groupBy("fp").agg(F.min("key").alias("least"))
    same = sets.join(least, "fp").where(F.col("key") != F.col("least")).select(F.col("key").alias("a"), F.col("least").alias("b"))
    near = links_of(least.select("fp"), radius, capacity)
    of_print = {k: least.select(F.col("fp").alias(k), F.col("least").alias(f"least_{k}")) for k in ("a", "b")}
    near = near.join(of_print["a"], "a").join(of_print["b"], "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    names = ["token", "key", "n", "place"]
    placed = rows.select("key", "n", F.posexplode("prefix").alias("place", "token")).withColumn("place", F.col("place").cast("bigint"))
    met = stash(by_token(placed.select(*names), met_of, names).join(sets.select("key", "fp"), "key").select(*names, "fp"), "similar-met")
    links = verified(same.unionByName(near), "prints")
    for number in range(ROUNDS + 1):
        roots = components(links, f"similar-forest{number}")
        rooted = met.join(roots, met.key == roots.node, "left").select(*names, "fp", F.coalesce("root", "key").alias("root"))
        how = rest_of if number == ROUNDS else nearest_of if number else star_of
        more = verified(by_token(rooted, how, ["a", "b"]), f"round{number}")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2, capacity: int = 4096, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) of every row, with component_id: the smallest id of a row that can be
    reached over pairs of texts whose sets of word shingles have the Jaccard similarity, the row's own included; and
    leads: true for exactly one row of each component, the least by id, then by a hash of what is carried, nulls last.

    Words are runs without ASCII blanks, A-Z lower-cased; a text of fewer than ``shingle`` words is one shingle; null
    and empty texts are one group. Shingles and sets are told apart by 64-bit hashes. Rows with a null id take part,
    and have a null component only where no member has an id. Columns named like a result give way.
    """
    spark, least = docs.sparkSession, Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("component_id", "leads")]
    text = F.col(quoted(text_col))
    shipped = ship(spark, common_shingles(docs.select(text.alias("text")), shingle))
    row = F.struct(*[F.col(quoted(c)) for c in carry])
    held = {} if text_col in carry else {"text": text}
    rows = docs.select(row.alias("row"), *[v.alias(k) for k, v in held.items()], F.col(quoted(id_col)).alias("id"), F.monotonically_increasing_id().alias("at"), marks(text, shingle, least, shipped).alias("m"))
    rows = stash(rows.select(*[k for k in rows.columns if k != "m"], "m.*"), "similar-rows")
    staged = F.col("text") if held else F.col("row").getField(text_col)
    roots = components(similar_links(rows, staged, shingle, least, radius, capacity), "similar-components")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", F.xxhash64("row").alias("hash"), "at")
    named = rows.select("key", "at", rank.alias("rank")).join(roots, rows.key == roots.node, "left").select("at", "rank", F.coalesce("root", "key").alias("root"))
    first = named.groupBy("root").agg(F.min("rank").alias("first")).select("root", F.col("first.id").alias("component_id"), F.col("first.at").alias("leader"))
    others = named.join(first, "root").where(F.col("at") != F.col("leader")).select("at", "component_id", "leader")
    out = rows.select("row", "id", "at").join(sent(others, "similar-others"), "at", "left")
    return out.select("row.*", F.when(F.col("leader").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("leader").isNull().alias("leads"))
