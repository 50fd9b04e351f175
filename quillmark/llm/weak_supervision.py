"""Expectation-maximisation over votes of overlapping rules, as one SQL expression.

Each rule votes good (1), bad (-1) or abstains (0). Given a text's unknown quality, rules vote independently: a good
text gets a good vote from rule j with probability a_j, a bad text a bad vote with b_j, abstentions aside. All that the
estimate needs of the corpus is how often each pattern of votes occurs: at most 3^rules rows, however large the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules: 3^10 patterns are 59,049 rows of a few bytes.
MOST_RULES = 10


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts; good[j], bad[j]: how often rule j's vote is right on good and on bad texts."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        """The probability that a text with these votes (array<int>) is good."""
        import math

        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (a, b) in enumerate(zip(self.good, self.bad)):
            v = F.element_at(votes, j + 1)
            logit = logit + F.when(v == 1, math.log(a / (1 - b))).when(v == -1, math.log((1 - a) / b)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


#: One step: posterior of each pattern under p, then sums of it, then smoothed ratios. Written once for all rules.
STEP = """
aggregate(patterns,
  named_struct('q', 0D, 'n', 0D, 'gg', {zeros}, 'g', {zeros}, 'bb', {zeros}, 'b', {zeros}),
  (s, h) -> aggregate(array({posterior}), s, (t, w) -> named_struct(
    'q', t.q + h.n * w, 'n', t.n + h.n,
    'gg', zip_with(t.gg, h.v, (x, v) -> x + if(v = 1, h.n * w, 0D)),
    'g', zip_with(t.g, h.v, (x, v) -> x + if(v <> 0, h.n * w, 0D)),
    'bb', zip_with(t.bb, h.v, (x, v) -> x + if(v = -1, h.n * (1D - w), 0D)),
    'b', zip_with(t.b, h.v, (x, v) -> x + if(v <> 0, h.n * (1D - w), 0D)))),
  s -> named_struct(
    'prior', (s.q + 1D) / (s.n + 2D),
    'good', zip_with(s.gg, s.g, (x, y) -> (x + {smooth} * {belief}) / (y + {smooth})),
    'bad', zip_with(s.bb, s.b, (x, y) -> (x + {smooth} * {belief}) / (y + {smooth}))))
"""
POSTERIOR = """
1D / (1D + exp(-(ln(p.prior / (1D - p.prior)) + aggregate(
  zip_with(h.v, zip_with(p.good, p.bad, (a, b) -> named_struct('up', ln(a / (1D - b)), 'down', ln((1D - a) / b))),
    (v, w) -> case when v = 1 then w.up when v = -1 then w.down else 0D end),
  0D, (x, y) -> x + y))))
"""


def fit(votes: DataFrame, votes_col: str, rules: int, steps: int = 30, belief: float = 0.8, smooth: float = 20.0, prior: float = 0.8) -> VoteModel:
    """Estimates the rules' accuracies from all rows of ``votes``.

    Every rule starts at ``belief``, which also counts as ``smooth`` earlier votes, so that a rule that never votes keeps
    it. Null votes abstain. Without rows the model is what it starts with.
    """
    if not 1 <= rules <= MOST_RULES:
        raise ValueError(f"between 1 and {MOST_RULES} rules")
    v = [F.coalesce(F.get(F.col(votes_col), j), F.lit(0)).alias(f"v{j}") for j in range(rules)]
    counted = votes.select(*v).groupBy(*[f"v{j}" for j in range(rules)]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    packed = counted.select(F.struct(F.array(*[F.col(f"v{j}") for j in range(rules)]).alias("v"), F.col("n")).alias("h"))
    held = packed.agg(F.array_sort(F.collect_list("h")).alias("patterns"))
    zeros = f"array_repeat(0D, {rules})"
    start = f"named_struct('prior', {prior}D, 'good', array_repeat({belief}D, {rules}), 'bad', array_repeat({belief}D, {rules}))"
    step = STEP.format(zeros=zeros, posterior=POSTERIOR, smooth=f"{smooth}D", belief=f"{belief}D")
    got = held.selectExpr(f"aggregate(sequence(1, {steps}), {start}, (p, k) -> {step}) AS m").first().m
    return VoteModel(got.prior, tuple(got.good), tuple(got.bad))
