"""Byte-level BPE encoding and decoding with a vocabulary file of the tokenizers library.

Texts are encoded by a merge engine that is built from the file's ranks. Long texts are cut where a blank follows a
letter or digit of ASCII, which is a boundary of the pre-tokenizer whatever stands around it. Long text without such a
place is pre-tokenized by the library itself; a piece that is still long is concatenated as a tree: its halves are
encoded apart (leaves in parallel threads), then windows of growing size around each join are encoded again until the
window's first and last tokens are those that both sides already had there. Byte-pair encodings are exact where every
pair of neighbouring tokens is, so from there on nothing outside the window can change.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, drained, free_name, quoted, received, ship, small_batches, worker_cache

#: The pre-tokenizer's pattern, a fixed value of the public byte-level format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Largest vocabulary file that is shipped to the executors, in bytes.
MOST_BYTES = 64 << 20


def byte_of() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder; ``leaf`` is the most characters (in pieces: bytes) that are encoded at once."""

    def __init__(self, data: bytes, leaf: int = 16384, threads: int = 2):
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the ids of merged tokens must follow the order of merges")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched as they are")
        self.data, self.leaf, self.threads, self.alphabet = data, leaf, threads, byte_of()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merged = 256 + len(merges)
        self.tokens = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in model["vocab"].items():
            if i < self.merged:
                self.tokens[i] = bytes(self.alphabet[c] for c in token)
        for s, i in self.special.items():
            self.tokens[i] = s.encode()

    @cached_property
    def engine(self):
        """Encodes by ranks; made only where something is encoded."""
        import tiktoken

        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.tokens[: self.merged])}, special_tokens={})

    @cached_property
    def library(self):
        """The library's own tokenizer; made only where long text has no certain boundary."""
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.data)

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return np.concatenate([np.array([self.special[p]], np.uint32) if k % 2 else self.plain(p) for k, p in enumerate(parts)])

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text in which no special token is looked for."""
        if len(text) <= self.leaf:
            return self.engine.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
        return np.concatenate([self.plain(p) if len(p) <= self.leaf else self.unsplit(p) for p in self.parts(text)])

    def parts(self, text: str) -> Iterator[str]:
        """Cuts before a blank that follows an ASCII letter or digit, at most ``leaf`` characters apart where possible."""
        at = 0
        while len(text) - at > self.leaf:
            end = self.boundary(text, at, at + self.leaf)
            if end <= at:
                end = self.next_boundary(text, at + self.leaf)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    @staticmethod
    def certain(text: str, p: int) -> bool:
        return text[p] == " " and text[p - 1].isascii() and text[p - 1].isalnum()

    def boundary(self, text: str, low: int, high: int) -> int:
        p = text.rfind(" ", low + 1, high)
        while p > low and not self.certain(text, p):
            p = text.rfind(" ", low + 1, p)
        return p

    def next_boundary(self, text: str, low: int) -> int:
        p = text.find(" ", low)
        while p > 0 and not self.certain(text, p):
            p = text.find(" ", p + 1)
        return p if p > 0 else len(text)

    def unsplit(self, text: str) -> np.ndarray:
        """Long text without a certain boundary: the library's pre-tokens one by one, the long ones as trees."""
        out: list[int] = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            raw = bytes(self.alphabet[c] for c in piece)
            out += self.engine._encode_single_piece(raw) if len(raw) <= self.leaf else self.tree(raw)
        return np.array(out, np.uint32)

    def tree(self, piece: bytes) -> list[int]:
        """Encodes one long piece: leaves in parallel, then joins from the bottom up."""
        count = 1
        while len(piece) > count * self.leaf:
            count *= 2
        cuts = [len(piece) * k // count for k in range(count + 1)]
        leaves = [piece[a:b] for a, b in zip(cuts, cuts[1:])]
        with ThreadPoolExecutor(self.threads) as pool:
            level = list(pool.map(self.engine._encode_single_piece, leaves))
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int], width: int = 4) -> list[int]:
        """The encoding of two neighbours as one: the window grows until its two outer tokens on each side stand."""
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            inner = self.engine._encode_single_piece(b"".join(self.tokens[i] for i in (*left[len(left) - a :], *right[:b])))
            head = a == len(left) or inner[:2] == left[len(left) - a :][:2]
            tail = b == len(right) or inner[-2:] == right[:b][-2:]
            if head and tail:
                return left[: len(left) - a] + inner + right[b:]
            width *= 2

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"the tokenizer file has more than {MOST_BYTES} bytes")
    return data


def opened(shipped, leaf: int, threads: int) -> ByteBPE:
    """The worker's own encoder, built once for all of its tasks."""
    cache = worker_cache()
    key = f"bpe:{shipped._jbroadcast.id() if getattr(shipped, '_jbroadcast', None) else shipped._path}:{leaf}:{threads}"
    if key not in cache:
        for old in [k for k in cache if k.startswith("bpe:")]:
            del cache[old]
        cache[key] = ByteBPE(received(shipped), leaf, threads)
    return cache[key]


def int_lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def slices(batch: pa.Array, most: int = 4 << 20, rows: int = 500) -> Iterator[pa.Array]:
    """Parts of a batch of ``rows`` rows, and of ``most`` bytes where rows are large, so that outputs stay small."""
    step = max(1, min(rows, most * len(batch) // max(1, batch.nbytes)))
    return (batch.slice(k, step) for k in range(0, len(batch), step))


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", leaf: int = 16384, threads: int = 2) -> DataFrame:
    """Every row of ``docs`` with ids (array<int>) and n_tokens.

    A null or empty text has no ids. Whole texts are encoded, of any length. A special token's string in a text is
    that token, as the library does by default. Repeated rows each give a row; empty tables give none. Columns of
    ``docs`` called ids or n_tokens give way. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shipped = ship(docs.sparkSession, tokenizer_file(tokenizer_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = opened(shipped, leaf, threads)
        for batch in drained(batches):
            for part in slices(batch):
                yield int_lists([bpe.encode(t) if (t := x.as_py()) else np.zeros(0, np.uint32) for x in part])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    ids = F.arrow_udf(run, "array<int>")(F.col(quoted(text_col)).cast("string"))
    held = attach(docs, {"ids": ids})
    return attach(held, {"n_tokens": F.size("ids").cast("long")})


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Every row of ``encoded`` with decoded: the text of its ids, special tokens included; null ids give the empty text.

    Ids that are not in the vocabulary raise an error. A column called decoded gives way.
    """
    shipped = ship(encoded.sparkSession, tokenizer_file(tokenizer_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = opened(shipped, 16384, 2)
        for batch in drained(batches):
            for part in slices(batch):
                yield pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in part], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return attach(encoded, {"decoded": F.arrow_udf(run, "string")(F.col(quoted(ids_col)))})


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", leaf: int = 16384, threads: int = 2) -> DataFrame:
    """Every row of ``docs`` with ids, n_tokens and decoded, the text that the ids decode to, as ``decode_ids`` after
    ``encode_texts`` gives them; but one worker for a task does both, and ids do not go there and back."""
    small_batches(docs.sparkSession)
    shipped = ship(docs.sparkSession, tokenizer_file(tokenizer_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = opened(shipped, leaf, threads)
        for batch in drained(batches):
            for part in slices(batch):
                ids = [bpe.encode(t) if (t := x.as_py()) else np.zeros(0, np.uint32) for x in part]
                decoded = pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())
                yield pa.StructArray.from_arrays([int_lists(ids), decoded], ["ids", "decoded"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    held = free_name(docs, "_coded")
    coded = docs.withColumn(held, F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")(F.col(quoted(text_col)).cast("string")))
    c = F.col(held)
    return attach(coded, {"ids": c["ids"], "n_tokens": F.size(c["ids"]).cast("long"), "decoded": c["decoded"]}).drop(held)
