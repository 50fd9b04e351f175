"""Encoding of prompt and response, padding of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words

IGNORED = -100


def word_ids(text: Column, size: int = 32000) -> Column:
    """A stand-in tokenizer: one id per word, from its checksum; ids below 10 are free for special tokens."""
    return F.transform(words(text), lambda w: (F.crc32(w) % (size - 10) + 10).cast("int"))


def encode_pair(prompt_ids: Column, response_ids: Column, max_length: int, max_response: int, max_prompt: int | None = None, eos: int | None = 2) -> Column:
    """Struct of input_ids, attention_mask and labels. The response keeps its place: a prompt that is too long loses its
    beginning, and a response that is too long by itself is cut and stands alone. Labels ignore the prompt.

    The response's cap counts its end token, which is appended before it is cut. ``max_prompt`` caps the prompt first.
    """
    response = F.slice(F.concat(response_ids, F.array(F.lit(eos))) if eos is not None else response_ids, 1, max_response)
    prompt = F.slice(prompt_ids, 1, max_prompt) if max_prompt is not None else prompt_ids

    def fit(p: Column, r: Column) -> Column:
        room = F.lit(max_length) - F.size(r)
        kept = F.when(F.size(p) + F.size(r) <= max_length, p).when(room <= 0, F.slice(p, 1, 0)).otherwise(F.slice(p, F.greatest(F.size(p) - room, F.lit(0)) + 1, F.greatest(room, F.lit(0))))
        return let(F.struct(kept.alias("p"), F.slice(r, 1, max_length).alias("r")), lambda x: F.struct(F.concat(x["p"], x["r"]).alias("input_ids"), F.array_repeat(F.lit(1), F.size(x["p"]) + F.size(x["r"])).alias("attention_mask"), F.concat(F.array_repeat(F.lit(IGNORED), F.size(x["p"])), x["r"]).alias("labels")))

    return let(F.struct(prompt.alias("p"), response.alias("r")), lambda x: fit(x["p"], x["r"]))


def padded(encoded: Column, width: Column, pad: int = 0) -> Column:
    """The encoded example filled up to ``width``."""
    more = lambda field, by: F.concat(encoded[field], F.array_repeat(F.lit(by), (width - F.size(encoded["input_ids"])).cast("int")))
    return F.struct(more("input_ids", pad).alias("input_ids"), more("attention_mask", 0).alias("attention_mask"), more("labels", IGNORED).alias("labels"))


def pad_batches(examples: DataFrame, column: str = "encoded", batch: str = "batch_id", multiple: int = 8, pad: int = 0) -> DataFrame:
    """``examples`` with ``column`` padded to the longest of its batch, rounded up to a multiple.

    Batches are summed up to one width each before rows meet them again.
    """
    widths = examples.groupBy(batch).agg((F.ceil(F.max(F.size(f"{column}.input_ids")) / multiple) * multiple).cast("int").alias("_width"))
    return examples.join(widths, batch).withColumn(column, padded(F.col(column), F.col("_width"), pad)).drop("_width")


def pad_pair_batches(pairs: DataFrame, batch: str = "batch_id", multiple: int = 8, pad: int = 0) -> DataFrame:
    """Chosen and rejected sides of pairs, each padded for itself."""
    return pad_batches(pad_batches(pairs, "chosen_encoded", batch, multiple, pad), "rejected_encoded", batch, multiple, pad)
