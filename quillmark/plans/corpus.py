"""A code-like corpus over the driver's tables, for queries of rules that prose never meets.

Function texts, reference comments, model outputs and similarities are functions of the order key, so SQL can make the
same rows. The outputs stand in for language models, the similarities for sentence encoders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import POOL_INSTRUCTION

#: Fragments of a function: (modulus, remainder, text); modulus 1 always holds. Fixed values of the fixture.
FRAGMENTS = (
    (3, 0, "onlyOwner "),
    (10, 9, "whenNotPaused "),
    (7, 0, "returns (bool) "),
    (1, 0, "{ "),
    (4, 0, "require(amount > 0); "),
    (5, 0, "if (block.timestamp >= deadline) { total += 1; } "),
    (6, 1, "token.transfer(to, amount); "),
    (11, 0, "to.delegatecall(data); "),
    (13, 0, "unchecked { total += amount; } "),
    (8, 2, "_mint(to, amount); "),
    (8, 6, "_burn(to, amount); "),
    (9, 4, "allowance[to] = amount; "),
    (1, 0, "emit Done(to); }"),
)
REFERENCES = (
    "Transfers the given amount of tokens to the recipient.",
    "Only the owner can update the stored total.",
    "Mints new tokens to the given address.",
    "Updates the stored total for the given account.",
    "Allows the admin to change the total amount.",
    "Sets ownership details for the given account.",
    "Burns the given amount from the account.",
    "@dev Stores   the amount. Emits an event afterwards.",
)
OUTPUTS = (
    "",
    "Only the owner can withdraw in case of emergency.",
    "Sends funds at any time without checking anything.",
    "Returns true and prevents reentrancy for callers.",
    "Transfers tokens.",
    "Actualiza la función y devuelve el total.",
    "Updates the stored total after the deadline has passed.",
    "Comment: Updates the total without transferring funds to recipient.",
    "Overflow safe update of the total using only internal calls.",
    '"Checks the amount and then sends tokens to the recipient."',
)
#: Samples in a task.
PORTION = 20_000
#: Passes of the stand-in models: source and stage number.
PASSES = (("base_zero_shot", 0), ("sft_greedy", 1), ("sft_temp_0.3", 2))


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def function_text(k: Column) -> Column:
    head = F.concat(F.lit("function f"), k.cast("string"), F.lit("(address to, uint256 amount) public "))
    return F.concat(head, *[F.lit(t) if m == 1 else F.when(k % m == r, t).otherwise("") for m, r, t in FRAGMENTS])


def model_output(k: Column, stage: int) -> Column:
    return pick(OUTPUTS, (k * 31 + 17 * stage) % 10)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per order: id, instruction, function, reference, outputs and the key k."""
    k = F.col("o_orderkey")
    # a key makes a sample that costs far more than its eight bytes: keys are spread before texts are made from them, over
    # as many tasks as the input asks for
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k)
    rows = keys.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(keys.count() / PORTION)))
    outputs = F.create_map(*[x for source, stage in PASSES for x in (F.lit(source), F.array(model_output(k, stage)))])
    return rows.select(k.cast("string").alias("id"), F.lit(POOL_INSTRUCTION).alias("instruction"), function_text(k).alias("function"), pick(REFERENCES, k % 8).alias("reference"), outputs.alias("outputs"), k.alias("k"))


def flat_similarity(candidates: Column, k: Column, a: int, b: int) -> Column:
    """By place j: ((a k + b j) % 1200 - 200) / 1000."""
    return F.transform(candidates, lambda c, j: ((k * a + j * b) % 1200 - 200) / 1000.0)


def source_similarity(candidates: Column, k: Column, a: int, b: int, bases: tuple[float, float, float], exact: bool) -> Column:
    """By place j: a base for the source (reference, hard negative, model) less ((a k + b j) % 300) / 1000; ``exact``
    leaves the reference undiminished."""

    def one(c: Column, j: Column) -> Column:
        less = ((k * a + j * b) % 300) / 1000.0
        base = F.when(c["source"] == "reference", bases[0]).when(F.startswith(c["source"], F.lit("hard_negative")), bases[1]).otherwise(bases[2])
        return base - F.when((c["source"] == "reference") & F.lit(exact), 0.0).otherwise(less)

    return F.transform(candidates, one)
