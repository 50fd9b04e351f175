"""Scoring of candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import exploded, normalized
from .kinds import once_each


def explode_candidates(records: DataFrame, *carry: str) -> DataFrame:
    """One row per candidate that is not blank, with its place ``pos`` in the record."""
    rows = exploded(records, ["id", *carry], F.col("candidates"), "pos", "candidate")
    return rows.where(normalized(F.col("candidate.comment")) != "")


def judged(facts: Column, evidence: Column, comment: Column) -> Column:
    """What of a score depends on function and comment alone, as a struct."""
    own = F.struct(S.style(comment).alias("style"), S.covered_facts(facts, comment).alias("covered"), S.claim_flags(evidence, comment).alias("flags"))
    made = lambda o: F.struct(o["style"]["f_style"].alias("f_style"), o["style"]["style_flags"].alias("style_flags"), o["covered"].alias("covered"), o["flags"].alias("flags"), S.coverage(facts, o["covered"]).alias("f_sec"), S.claim_penalty(o["flags"]).alias("penalty"), (normalized(comment) != "").alias("shown"))
    return S.let(own, made)


def with_judged(rows: DataFrame, comments: Column | None = None) -> DataFrame:
    """Rows with _facts, _evidence and comments (else those of their candidates), with ``judged`` of each as ``_judged``."""
    texts = F.transform("candidates", lambda c: c["comment"]) if comments is None else comments
    return rows.withColumn("_judged", F.transform(texts, lambda c: judged(F.col("_facts"), F.col("_evidence"), c)))


def score_record(candidates: Column, side: Column, sem: Column, facts: Column, judgements: Column, weights: S.Weights = S.Weights()) -> Column:
    """The scored candidates of a record, best first; ties keep their order.

    ``side`` and ``sem`` are arrays of raw similarities by place, ``judgements`` those of ``judged``. Blank candidates
    are left out; a similarity that is missing counts as 0. Scores are found and sorted as small structs, since each
    transform copies what it makes; candidates are put together last, by place.
    """

    def small(r: Column) -> Column:
        def near(j: Column, i: Column) -> Column:
            raw = F.struct(F.coalesce(F.get(r["side"], i), F.lit(0.0)).alias("side"), F.coalesce(F.get(r["sem"], i), F.lit(0.0)).alias("sem"))
            return F.when(j["shown"], S.let(raw, lambda o: ordered(j, i, o)))

        return F.transform(r["judged"], near)

    def ordered(j: Column, i: Column, o: Column) -> Column:
        score = S.final_score(S.clamp(o["side"]), S.clamp(o["sem"]), j["f_sec"], j["f_style"], j["penalty"], weights)
        # structs compare field by field, so they sort by score, then by place
        return F.struct((-score).alias("order"), i.alias("pos"), o["side"].alias("side"), o["sem"].alias("sem"))

    def whole(x: Column) -> Column:
        c, j = F.get(candidates, x["pos"]), F.get(judgements, x["pos"])
        plain = {"side_raw": x["side"], "f_code": S.clamp(x["side"]), "sentence_sim_raw": x["sem"], "f_sem": S.clamp(x["sem"]), "f_sec": j["f_sec"], "hallucination_penalty": j["penalty"], "f_style": j["f_style"], "num_security_facts": F.size(facts), "security_facts": facts, "covered_security_facts": j["covered"], "hallucination_flags": j["flags"], "style_flags": j["style_flags"]}
        fields = [c[k].alias(k) for k in ("source", "comment", "role_hint", "perturbation_type", "decode_strategy", "model_stage", "temperature")]
        return F.struct(x["order"].alias("order"), x["pos"].alias("pos"), (-x["order"]).alias("score"), *fields, *[v.alias(k) for k, v in plain.items()])

    record = F.struct(side.alias("side"), sem.alias("sem"), judgements.alias("judged"))
    return F.transform(F.sort_array(F.filter(S.let(record, small), lambda x: x.isNotNull())), whole)


def score_records(records: DataFrame, side: Column, sem: Column, weights: S.Weights = S.Weights()) -> DataFrame:
    """Candidate records with their candidates scored and sorted, best_candidate, worst_candidate and score_range.

    What does not depend on the similarities is found once for each combination of comments, facts and evidence, if the
    candidates were not built with it. A record without scored candidates has null best and worst, and a range of 0.
    """
    if "_judged" in records.columns:
        held = records
    else:
        held = records.withColumns({"_facts": S.coverage_facts(F.col("function")), "_evidence": S.claim_evidence(F.col("function")), "_comments": F.transform("candidates", lambda c: c["comment"])})
        held = once_each(held, ["_facts", "_evidence", "_comments"], lambda kinds: with_judged(kinds, F.col("_comments"))).drop("_evidence", "_comments")
    held = held.withColumns({"side": side, "sem": sem})
    held = held.withColumn("candidates", score_record(F.col("candidates"), F.col("side"), F.col("sem"), F.col("_facts"), F.col("_judged"), weights)).drop("side", "sem", "_facts", "_judged")
    best, worst = F.try_element_at("candidates", F.lit(1)), F.try_element_at("candidates", F.lit(-1))
    gap = F.coalesce(best["score"] - worst["score"], F.lit(0.0))
    return held.withColumns({"best_candidate": best, "worst_candidate": worst, "score_range": gap})
