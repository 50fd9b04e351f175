"""Candidate records: rule-made negatives, ordered deduplication across sources, counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..functions.scoring import contains_any
from ..functions.text import folded, let, prediction_clean, without_terms
from .kinds import once_each

CANDIDATE = "struct<source:string,comment:string,role_hint:string,perturbation_type:string,decode_strategy:string,model_stage:string,temperature:double>"
FIELDS = {"source": "string", "comment": "string", "role_hint": "string", "perturbation_type": "string", "decode_strategy": "string", "model_stage": "string", "temperature": "double"}


def candidate(**given: Column) -> Column:
    """A candidate; fields not given are null."""
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def no_candidates() -> Column:
    return F.expr(f"cast(array() as array<{CANDIDATE}>)")


def first_of_each(items: Column, key) -> Column:
    """The elements whose key no earlier element has, in order."""
    return let(items, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def fact_bits(function: Column) -> Column:
    """Per kind of negative's fact, whether the function shows it; all that negatives take from a function."""
    return let(F.lower(F.coalesce(function, F.lit(""))), lambda code: F.array(*[contains_any(code, terms) for terms in rules.GENERATOR_FACTS.values()]))


def hard_negatives(function: Column, reference: Column, most: int = 4) -> Column:
    """Plausible but unfaithful comments, as candidates: rules in order, cleaned, first of equal ones, then the first
    ``most``. A rule whose text is blank or a repeat gives nothing, but one cut off later has had its turn."""
    return negatives_of(fact_bits(function), reference, most)


def negatives_of(found: Column, reference: Column, most: int = 4) -> Column:
    """The hard negatives of functions with these fact bits."""
    names = list(rules.GENERATOR_FACTS)

    def build(r: Column) -> Column:
        ref, low = r["ref"], F.lower(r["ref"])
        facts = {n: F.get(r["found"], k) for k, n in enumerate(names)}
        owner = F.regexp_replace(F.regexp_replace(ref, r"(?i)\bonly the owner\b", "any user"), r"(?i)\bowner\b", "user")
        admin = F.regexp_replace(ref, r"(?i)\badmin\b", "user")
        reversal = F.when(F.contains(low, F.lit("owner")), owner).when(F.contains(low, F.lit("admin")), admin).otherwise(F.lit(rules.ANY_USER))
        omission = without_terms(prediction_clean(ref), rules.REMOVED_TERMS, rules.GENERIC_SENTENCE)
        made = [
            (F.lit(True), *rules.GENERIC_NEGATIVE),
            (facts["access_control"], "hard_negative_access_control", "access_control_reversal", prediction_clean(reversal)),
            (facts["access_control"], "hard_negative_access_omission", "access_control_omission", omission),
            *[(facts[f], source, kind, text) for f, source, kind, text in rules.FIXED_NEGATIVES],
        ]
        as_item = lambda source, kind, text: candidate(source=F.lit(source), comment=text if isinstance(text, Column) else F.lit(text), role_hint=F.lit("negative_only"), perturbation_type=F.lit(kind))
        return F.filter(F.array(*[F.when(holds, as_item(s, k, t)) for holds, s, k, t in made]), lambda x: x.isNotNull())

    record = F.struct(prediction_clean(reference).alias("ref"), found.alias("found"))
    cleaned = F.transform(let(record, build), lambda x: x.withField("comment", prediction_clean(x["comment"])))
    return F.slice(first_of_each(F.filter(cleaned, lambda x: x["comment"] != ""), lambda x: folded(x["comment"])), 1, most)


@dataclass(frozen=True)
class GenerationPlan:
    """What is asked of the models for each sample. Sampling at a temperature gives that many outputs."""

    greedy_base: bool = True
    greedy_tuned: bool = True
    sampling: tuple[tuple[float, int], ...] = ((0.3, 1), (0.6, 2), (0.9, 2))
    negatives: int = 4

    def passes(self) -> list[tuple[str, str, str, float, int]]:
        """(source, stage, strategy, temperature, outputs), in the order in which candidates are added."""
        out = []
        if self.greedy_base:
            out.append(("base_zero_shot", "base", "greedy", 0.0, 1))
        if self.greedy_tuned:
            out.append(("sft_greedy", "sft", "greedy", 0.0, 1))
        return out + [(f"sft_temp_{t}", "sft", "sampling", t, n) for t, n in self.sampling if n > 0]


def asked_for(outputs: Column, plan: GenerationPlan) -> Column:
    """The outputs that the plan asks for, by pass, from a map of pass name to outputs (array<string>)."""
    none = F.expr("cast(array() as array<string>)")
    return F.array(*[F.slice(F.coalesce(F.try_element_at(outputs, F.lit(source)), none), 1, n) for source, *_, n in plan.passes()]).cast("array<array<string>>")


def model_candidates(asked: Column, plan: GenerationPlan) -> Column:
    """Candidates from the outputs by pass, in the plan's order."""
    parts = []
    for k, (source, stage, strategy, temperature, _) in enumerate(plan.passes()):
        name = (lambda i, s=source: F.concat(F.lit(f"{s}_"), (i + 1).cast("string"))) if strategy == "sampling" else (lambda i, s=source: F.lit(s))
        made = lambda text, i: candidate(source=name(i), comment=text, role_hint=F.lit("model_candidate"), decode_strategy=F.lit(strategy), model_stage=F.lit(stage), temperature=F.lit(temperature))
        parts.append(F.transform(F.get(asked, k), made))
    return F.concat(*parts) if parts else no_candidates()


def with_negatives(pool: DataFrame, most: int = 4) -> DataFrame:
    """Pool rows (function, reference) with ``negatives``, made once for each reference and combination of facts."""
    held = pool.withColumn("_found", fact_bits(F.col("function")))
    return once_each(held, ["reference", "_found"], lambda kinds: kinds.withColumn("negatives", negatives_of(F.col("_found"), F.col("reference"), most))).drop("_found")


def build_candidates(pool: DataFrame, plan: GenerationPlan = GenerationPlan(), also: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """Pool rows (id, instruction, function, reference and, if models ran, outputs: map of pass to texts) with
    candidates, num_candidates, source_counts and role_counts.

    The reference comes first, then negatives, then model outputs in the plan's order. Texts are cleaned, blank ones
    go, and of those equal when folded the first stays. Records that have the same reference, outputs and facts of
    their functions have the same candidates, which are made once.

    ``also`` are steps that add what scoring and pairing need of candidates, ``_facts`` and ``_evidence``, in the same
    go: ``scored.with_judged`` and ``pairs.add_displayed``.
    """
    if also:
        held = pool.withColumn("_of", S.function_facts(F.col("function")))
    else:
        held = pool.withColumn("_of", F.struct(fact_bits(F.col("function")).alias("found")))
    if "outputs" in pool.columns:
        held = held.withColumn("_asked", asked_for(F.col("outputs"), plan)).drop("outputs")

    def derive(kinds: DataFrame) -> DataFrame:
        parts = [F.array(candidate(source=F.lit("reference"), comment=F.col("reference"), role_hint=F.lit("positive_anchor"))), negatives_of(F.col("_of.found"), F.col("reference"), plan.negatives)]
        if "_asked" in kinds.columns:
            parts.append(model_candidates(F.col("_asked"), plan))
        cleaned = F.filter(F.transform(F.concat(*parts), lambda x: x.withField("comment", prediction_clean(x["comment"]))), lambda x: x["comment"] != "")
        kept = kinds.withColumn("candidates", first_of_each(cleaned, lambda x: folded(x["comment"])))
        kept = kept.withColumns({"num_candidates": F.size("candidates"), "source_counts": frequencies(F.transform("candidates", lambda c: c["source"])), "role_counts": frequencies(F.transform("candidates", lambda c: c["role_hint"]))})
        if also:
            kept = kept.withColumns({"_facts": F.col("_of.facts"), "_evidence": F.col("_of.evidence")})
        for step in also:
            kept = step(kept)
        return kept.drop("_evidence")

    return once_each(held, [c for c in ("reference", "_of", "_asked") if c in held.columns], derive).drop("_of", "_asked")


def frequencies(values: Column) -> Column:
    """How often each value occurs in an array, as a map."""
    keys = F.array_distinct(values)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(values, lambda v: v == k))))
