"""The preference loss and its metrics over columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return -(F.greatest(F.lit(0.0), -x) + F.log1p(F.exp(-F.abs(x))))


def sequence_logp(token_logps: Column, labels: Column, average: bool = False, ignored: int = -100) -> Column:
    """The sum of the log-probabilities of a sequence's labelled tokens, or their mean; 0 where none is labelled."""
    kept = F.filter(F.zip_with(token_logps, labels, lambda p, y: F.when(y != ignored, p)), lambda p: p.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p)
    return total / F.greatest(F.size(kept), F.lit(1)) if average else total


def dpo_terms(beta: float, sft_weight: float = 0.0) -> dict[str, Column]:
    """Per pair: losses, rewards, accuracy and margin, from policy_ and ref_ chosen_logp and rejected_logp."""
    c = F.col
    logits = (c("policy_chosen_logp") - c("policy_rejected_logp")) - (c("ref_chosen_logp") - c("ref_rejected_logp"))
    chosen, rejected = beta * (c("policy_chosen_logp") - c("ref_chosen_logp")), beta * (c("policy_rejected_logp") - c("ref_rejected_logp"))
    dpo, sft = -log_sigmoid(beta * logits), -c("policy_chosen_logp")
    return {
        "dpo_loss": dpo,
        "sft_loss": sft,
        "loss": dpo + sft_weight * sft,
        "chosen_reward": chosen,
        "rejected_reward": rejected,
        "reward_acc": (chosen > rejected).cast("double"),
        "reward_margin": chosen - rejected,
    }


METRICS = ("loss", "dpo_loss", "sft_loss", "reward_acc", "reward_margin")


def exact_sum(value: Column) -> Column:
    """A sum to twelve decimals that does not depend on the order of addition; what is not finite makes it so."""
    finite = ~F.isnan(value) & (F.abs(value) < 1e24)
    return F.coalesce(F.sum(F.when(finite, value.cast("decimal(38,12)"))).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(~finite, value)), F.lit(0.0))


def weighted_means(batches: DataFrame, prefix: str, weight: str = "n") -> list[Column]:
    """Means of batch metrics weighted by batch size, from the batches' sums where they have them; 0 without batches."""
    total = lambda m: F.col(f"{m}_sum") if f"{m}_sum" in batches.columns else F.col(m) * F.col(weight)
    return [F.coalesce(F.try_divide(exact_sum(total(m).cast("double")), F.sum(weight)), F.lit(0.0)).alias(f"{prefix}_{m}") for m in METRICS]


def batch_metrics(terms: DataFrame, *keys: str) -> DataFrame:
    """Means of each batch, its size n, and the sums that means over several batches are made of."""
    sums = [exact_sum(F.col(m)).alias(f"{m}_sum") for m in METRICS]
    return terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS], *sums)


def eval_metrics(batches: DataFrame) -> DataFrame:
    """One row of eval_ metrics, all 0 without batches."""
    return batches.agg(*weighted_means(batches, "eval"))


def total_steps(batches: int, accumulation: int, epochs: float, warmup_ratio: float = 0.0) -> tuple[int, int, int]:
    """Optimizer steps per epoch, in all, and of the warm-up, as the schedule counts them."""
    per_epoch = math.ceil(batches / accumulation)
    whole = int(epochs * per_epoch)
    return per_epoch, whole, int(warmup_ratio * whole)


def learning_rate(step: Column, base: float, warmup: int, whole: int, kind: str = "cosine") -> Column:
    """The rate after ``step`` optimizer steps: a linear rise, then a linear or half-cosine fall, or constant."""
    rise = step / float(max(1, warmup))
    left = (step - warmup) / float(max(1, whole - warmup))
    fall = {"linear": F.greatest(F.lit(0.0), 1.0 - left), "cosine": F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.lit(math.pi) * left))), "constant": F.lit(1.0)}[kind]
    return base * F.when(step < warmup, rise).otherwise(fall)


def train_log(batches: DataFrame, logging_steps: int, per_epoch: int, accumulation: int, rate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Training metrics over windows of ``logging_steps`` optimizer steps, begun anew with each epoch.

    ``batches`` has epoch and batch (both from 0), n and the sums of ``batch_metrics``; ``per_epoch`` batches are an epoch.
    Micro-batches after an epoch's last whole accumulation make no step. A row is written at each step that is a
    multiple of ``logging_steps``; what an epoch has gathered since its last row is dropped. With ``rate``, rows have the
    learning_rate that it gives for their step.
    """
    steps = per_epoch // accumulation
    at = F.col("epoch") * steps + F.floor(F.col("batch") / accumulation) + 1
    step = (F.ceil(at / logging_steps) * logging_steps).cast("long")
    inside = batches.withColumn("step", step).where(F.col("step") <= (F.col("epoch") + 1) * steps)
    rows = inside.groupBy("step", (F.col("epoch") + 1).alias("epoch")).agg(*weighted_means(inside, "train"))
    return rows if rate is None else rows.withColumn("learning_rate", rate(F.col("step")))


def best_checkpoints(evals: DataFrame, loss: str = "eval_loss") -> DataFrame:
    """``evals`` (step, loss) with best_so_far before each and is_best: strictly better than all earlier ones.

    Rows are one per evaluation of a run, so a single ordered window is small.
    """
    before = F.min(loss).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return evals.withColumn("best_before", before).withColumn("is_best", F.coalesce(F.col(loss) < F.col("best_before"), F.lit(True)))
