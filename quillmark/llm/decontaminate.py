"""Benchmark decontamination by a prefix-filtered set join.

A benchmark text is cut into windows of ``window`` words. A window is a set of word shingles with their
offsets. Shingles are ordered by rarity: how often all documents contain them. A document contains a window
exactly only if it contains every shingle of it, so one necessary token, the rarest, is the whole prefix that
has to be joined. A document position that joins is bounded by length (the window must fit) and by position
(the window starts ``offset`` words earlier), and then verified word by word over the window.

The prefix index grows with the benchmark, not with the corpus. It is made, counted, shipped and released in blocks of
at most ``block_windows`` windows, one block at a time, so neither the driver nor a task ever holds two; a larger
benchmark takes several passes, whose hits are staged and united by document. In a single pass documents are never
shuffled, so a hot source or passage needs no salting.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, drained, free_name, quoted, received, ship, small_batches, stash

#: Words are runs of digits, letters a-z and bytes of non-ASCII characters, after A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = 0x9E3779B97F4A7C15
HITS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def split_words(text: str | None) -> list[bytes]:
    """The words of a text; none for null."""
    return [] if text is None else text.encode().translate(FOLD).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Runs of ``window`` words; all words at once where there are fewer, nothing where there are none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Vocabulary(dict):
    """Word to number; -1 for a word that no benchmark text has."""

    def __missing__(self, key):
        return -1


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for each run of ``size`` words; what keys say is always verified by the words."""
    n = len(ids) - size + 1
    key = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for k in range(size):
            key = (key + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
            key ^= key >> np.uint64(29)
    return key


class WindowIndex:
    """Distinct windows of a benchmark with the items that have them, and the prefix tokens of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(split_words(text), window):
                owners.setdefault(w, set()).update(() if item is None else (item,))
        self.vocabulary = Vocabulary()
        for w in owners:
            for word in w:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        self.windows = [np.array([self.vocabulary[x] for x in w], np.int64) for w in owners]
        self.items = [sorted(x) for x in owners.values()]
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows})

    def all_keys(self) -> dict[int, np.ndarray]:
        """By shingle size, the sorted keys of every shingle of the windows."""
        return {s: np.unique(np.concatenate([shingle_keys(w, s) for w in self.windows if min(self.shingle, len(w)) == s])) for s in self.sizes}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Chooses each window's rarest shingle as its prefix token; ties go to the smaller key, then the first place."""
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {s: {} for s in self.sizes}
        for number, w in enumerate(self.windows):
            size = min(self.shingle, len(w))
            keys = shingle_keys(w, size).tolist()
            _, key, offset = min((counts.get((size, k), 0), k, i) for i, k in enumerate(keys))
            self.prefix[size].setdefault(key, []).append((number, offset))
        self.tokens = {s: np.array(sorted(p), np.uint64) for s, p in self.prefix.items()}

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))

    @staticmethod
    def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places in ``keys`` whose key is in the sorted ``known``."""
        if not len(keys) or not len(known):
            return np.zeros(0, np.int64)
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return np.flatnonzero(known[at] == keys)

    def candidates(self, ids: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles all of whose words the benchmark has and whose key is known, and those keys."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.ones(n, bool)
        for k in range(size):
            whole &= ids[k : k + n] >= 0
        places = np.flatnonzero(whole)
        if not len(places):
            return places, np.zeros(0, np.uint64)
        keys = np.zeros(len(places), np.uint64)
        for k in range(size):
            keys = (keys + ids[places + k].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
            keys ^= keys >> np.uint64(29)
        hit = self.member(keys, known)
        return places[hit], keys[hit]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Disjoint spans of words inside any occurrence of a window, and the items whose windows occur."""
        ids, found, spans = self.ids(words), set(), []
        for size, tokens in self.tokens.items():
            places, keys = self.candidates(ids, size, tokens)
            for place, key in zip(places.tolist(), keys.tolist()):
                for number, offset in self.prefix[size][key]:
                    w, start = self.windows[number], place - offset
                    if start < 0 or start + len(w) > len(ids):
                        continue
                    if np.array_equal(ids[start : start + len(w)], w):
                        found.add(number)
                        spans.append((start, start + len(w)))
        return merged(spans), sorted({i for n in found for i in self.items[n]})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shingle_counts(docs: DataFrame, text_col: str, index: WindowIndex) -> dict[tuple[int, int], int]:
    """How often all documents contain each benchmark shingle of a block, by (size, key).

    Each task adds up what it sees, so at most one row for a benchmark shingle and task is shuffled.
    """
    shipped = ship(docs.sparkSession, (index, index.all_keys()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, keys = received(shipped)
        total = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
        for batch in drained(batches):
            for text in batch.column(0):
                ids = ix.ids(split_words(text.as_py()))
                for s, k in keys.items():
                    _, got = ix.candidates(ids, s, k)
                    np.add.at(total[s], np.searchsorted(k, got), 1)
        rows = [(s, int(k), int(c)) for s in keys for k, c in zip(keys[s].view(np.int64), total[s]) if c]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["size", "key", "n"])

    seen = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "size int, key bigint, n bigint")
    rows = seen.groupBy("size", "key").agg(F.sum("n").alias("n")).collect()
    shipped.destroy()
    return {(r["size"], r.key & (2**64 - 1)): r.n for r in rows}


def find_windows(docs: DataFrame, text_col: str, index: WindowIndex):
    """A column expression: the document's hits under one block of the index."""
    shipped = ship(docs.sparkSession, index)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ix = received(shipped)
        for batch in drained(batches):
            out = []
            for text in batch:
                words = split_words(text.as_py())
                spans, items = ix.match(words)
                out.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": items})
            yield pa.array(out, kind)

    hits.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(hits, HITS)(F.col(text_col).cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, share: tuple[int, int] = (1, 20), block_windows: int = 250_000) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, n_items, item_ids (sorted as strings), hit_spans and contaminated.

    ``hit_spans`` are disjoint runs of word numbers inside any occurrence of a benchmark window. A document is
    contaminated if it has a hit and hits are at least ``share`` of its words.

    Null or empty text has no words and no hits. A benchmark row without text (or words) has no window; one
    without an id marks hits but names no item. Repeated rows of ``docs`` each give a row; a repeated item counts
    once. Columns of ``docs`` named like a result give way to it. Empty tables give no rows or no hits. Whole
    texts are read whatever their length. Benchmark texts come to the driver one block of ``block_windows`` windows at a
    time (a single text of more is a block of its own); each block is two passes over ``docs``.
    """
    small_batches(docs.sparkSession)
    texts = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull()).distinct()

    def ordered(items: list[tuple[str | None, str | None]], rows: DataFrame, column: str) -> WindowIndex:
        index = WindowIndex(sorted(items, key=lambda x: (x[0] or "", x[1] or "")), window, shingle)
        index.order(shingle_counts(rows, column, index) if index.windows else {})
        return index

    blocks = blocks_of(texts, window, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return finish(docs, find_windows(docs, text_col, ordered(first, docs, quoted(text_col))), share)
    # further blocks: a pass for each over a table that the shared folder holds, so that every pass sees the same rows
    found = stash(docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.expr("uuid()").alias("uid")), "docs")
    text, united = f"row.{quoted(text_col)}", None
    for block in itertools.chain([first, second], blocks):
        part = found.select("uid", find_windows(found, text, ordered(block, found, text)).alias("h")).where(F.size("h.spans") > 0)
        part = stash(part, "hits")
        united = part if united is None else united.unionByName(part)
    joined = united.groupBy("uid").agg(F.flatten(F.collect_list("h.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items"))
    nothing = WindowIndex([], window, shingle)
    nothing.order({})
    empty = found.select("row", "uid", find_windows(found, text, nothing).alias("e"))
    whole = empty.join(joined, "uid", "left")
    hits = F.struct(F.col("e.n_words").alias("n_words"), union_spans(F.coalesce(F.col("spans"), F.col("e.spans"))).alias("spans"), F.coalesce(F.col("items"), F.col("e.items")).alias("items"))
    held = free_name(docs, "_hits")
    return finish(whole.select("row.*", hits.alias(held)), F.col(held), share, held)


def blocks_of(texts: DataFrame, window: int, most: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of at most ``most`` windows, the next one only when it is asked for."""
    block, room = [], most
    for item, text in texts.toLocalIterator():
        n = len(windows_of(split_words(text), window))
        if n > room and block:
            yield block
            block, room = [], most
        block.append((item, text))
        room -= n
    if block:
        yield block


def union_spans(spans):
    """Sorted spans whose overlaps are joined, as a column expression."""
    step = lambda out, x: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
        F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:int,end:int>>)"), step)


def finish(docs: DataFrame, hits, share: tuple[int, int], held: str | None = None) -> DataFrame:
    """``docs`` with what its hits, in the column ``held`` if they have one, say."""
    if held is None:
        held = free_name(docs, "_hits")
        docs = docs.withColumn(held, hits)
    h = F.col(held)
    n_hit = F.coalesce(F.aggregate(h["spans"], F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long")
    out = attach(docs, {"n_words": h["n_words"], "n_hit": n_hit, "n_items": F.size(h["items"]).cast("long"), "item_ids": h["items"], "hit_spans": h["spans"], "contaminated": (n_hit > 0) & (share[1] * n_hit >= share[0] * h["n_words"])})
    return out.drop(held)
