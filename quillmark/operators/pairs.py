"""Preference pairs: ranking and constrained selection within each record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import PAIRING_SYSTEM_PROMPT, display_clean, exploded, let, pair_prompt
from .candidates import first_of_each
from .kinds import once_each


@dataclass(frozen=True)
class PairRules:
    min_margin: float = 0.20
    max_pairs: int = 3
    min_chosen_score: float = 0.70
    max_rejected_score: float = 0.55
    min_chosen_style: float = 0.60
    prefer_hard_negative: bool = True
    max_hard_negative_pairs: int = 1
    #: How many low-ranked candidates are looked at, in each phase.
    reach: int = 5


def displayed(comments: Column) -> Column:
    """What selection needs of each comment, as a map by comment (null as blank): text, key, length penalty, and whether it
    is valid."""

    def made(comment: Column) -> Column:
        return let(display_clean(comment), lambda text: F.struct(text.alias("text"), F.lower(text).alias("key"), S.display_penalty(text).alias("less"), (~S.has_artifact(comment) & S.is_valid_display(text)).alias("valid")))

    return F.map_from_arrays(comments, F.transform(comments, made))


def told(comment: Column) -> Column:
    return F.coalesce(comment, F.lit(""))


def comments_of(candidates: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(candidates, lambda c: told(c["comment"]))))


def add_displayed(rows: DataFrame) -> DataFrame:
    """Rows with ``displayed`` of the comments of their candidates as ``_displayed``, which scoring carries along."""
    return rows.withColumn("_displayed", let(comments_of(F.col("candidates")), displayed))


def with_displayed(records: DataFrame) -> DataFrame:
    """The same, made once for each set of comments."""
    held = records.withColumn("_texts", comments_of(F.col("candidates")))
    return once_each(held, ["_texts"], lambda kinds: kinds.withColumn("_displayed", displayed(F.col("_texts")))).drop("_texts")


def usable(candidates: Column, shown: Column) -> Column:
    """Scored, valid candidates, the first of those that are displayed alike, with what selection needs of each; ``shown``
    is the map of ``displayed``, ``pos`` the place among ``candidates``."""
    needed = ("source", "role_hint", "score", "hallucination_penalty", "f_style")

    def all_of(r: Column) -> Column:
        def item(c: Column, i: Column) -> Column:
            made = lambda d: F.when(c["score"].isNotNull() & d["valid"], F.struct(i.alias("pos"), d["text"].alias("text"), d["key"].alias("key"), (c["score"] - d["less"]).alias("adj"), S.is_hard_negative(c["source"], c["role_hint"]).alias("hard"), F.struct(*[c[k].alias(k) for k in needed]).alias("c")))
            return let(F.try_element_at(r["shown"], told(c["comment"])), made)

        return first_of_each(F.filter(F.transform(r["candidates"], item), lambda x: x.isNotNull()), lambda x: x["key"])

    return let(F.struct(candidates.alias("candidates"), shown.alias("shown")), all_of)


def ranked(items: Column, falling: bool) -> Column:
    """By adjusted score, ties by place."""
    keyed = F.transform(items, lambda x: F.struct((-x["adj"] if falling else x["adj"]).alias("order"), x["pos"].alias("pos"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def add_usable(rows: DataFrame, p: PairRules = PairRules()) -> DataFrame:
    """Rows with ``_usable``, from their candidates, ``_judged`` and ``_displayed``: valid candidates with all that ranking
    needs and no similarity changes. ``wins`` and ``loses`` tell who may be chosen or rejected if the score allows it,
    ``like`` the first of those displayed alike, ``twin`` whether there are others."""

    def all_of(r: Column) -> Column:
        def item(c: Column, i: Column) -> Column:
            def made(x: Column) -> Column:
                d, j, hard = x["d"], x["j"], S.is_hard_negative(c["source"], c["role_hint"])
                wins = ~hard & (j["penalty"] <= 0) & (j["f_style"] >= p.min_chosen_style)
                loses = ~S.is_reference(c["source"]) & ~S.is_anchor(c["role_hint"])
                fields = {"pos": i, "text": d["text"], "key": d["key"], "less": d["less"], "wins": wins, "loses": loses, "source": c["source"], "f_sec": j["f_sec"], "f_style": j["f_style"], "penalty": j["penalty"]}
                return F.when(j["shown"] & d["valid"], F.struct(*[v.alias(k) for k, v in fields.items()]))

            return let(F.struct(F.try_element_at(r["shown"], told(c["comment"])).alias("d"), F.get(r["judged"], i).alias("j")), made)

        return F.filter(F.transform(r["candidates"], item), lambda x: x.isNotNull())

    def with_twins(items: Column) -> Column:
        keys = lambda: F.transform(items, lambda x: x["key"])
        alike = lambda ks: F.transform(items, lambda x: x.withField("like", F.array_position(ks, x["key"])).withField("twin", F.size(F.filter(ks, lambda k: k == x["key"])) > 1))
        return let(keys(), alike)

    record = F.struct(F.col("candidates").alias("candidates"), F.col("_judged").alias("judged"), F.col("_displayed").alias("shown"))
    return rows.withColumn("_usable", let(let(record, all_of), with_twins))


def ranked_pool(usable: Column, side: Column, sem: Column, chosen: bool, p: PairRules = PairRules(), weights: S.Weights = S.Weights()) -> Column:
    """Those of ``_usable`` that may be chosen (else rejected), as structs with ``at``, the place there, and ``adj``: the
    same ones in the same order as ``ranked`` gives of ``usable``. Of those displayed alike the best scored stays.

    ``side`` and ``sem`` are arrays of raw similarities by place among the candidates. Only scores are found here, for
    those alone that can be in the pool or have a twin, and no candidate is copied.
    """

    def of(r: Column) -> Column:
        def one(u: Column, i: Column) -> Column:
            may = u["wins"] if chosen else u["loses"]
            near = lambda x: S.clamp(F.coalesce(F.get(r[x], u["pos"]), F.lit(0.0)))
            score = S.final_score(near("side"), near("sem"), u["f_sec"], u["f_style"], u["penalty"], weights)

            def made(s: Column) -> Column:
                fits = may & ((s >= p.min_chosen_score) if chosen else (s <= p.max_rejected_score))
                adj = s - u["less"]
                fields = {"order": -adj if chosen else adj, "less_score": -s, "at": i, "adj": adj, "fits": fits, "like": u["like"], "twin": u["twin"]}
                return F.when(s.isNotNull() & (fits | u["twin"]), F.struct(*[v.alias(k) for k, v in fields.items()]))

            return F.when(may | u["twin"], let(score, made))

        return F.filter(F.transform(r["usable"], one), lambda x: x.isNotNull())

    def best_of_twins(items: Column) -> Column:
        before = lambda y, x: (y["like"] == x["like"]) & ((y["less_score"] < x["less_score"]) | ((y["less_score"] == x["less_score"]) & (y["at"] < x["at"])))
        return F.filter(items, lambda x: x["fits"] & (~x["twin"] | ~F.exists(items, lambda y: before(y, x))))

    record = F.struct(usable.alias("usable"), side.alias("side"), sem.alias("sem"))
    return F.sort_array(let(let(record, of), best_of_twins))


def choose(candidates: Column, shown: Column, p: PairRules) -> Column:
    """The pairs of one record, as structs of c (chosen), r (rejected) and type.

    Phase 1 pairs the best chosen with hard negatives, phase 2 with low model candidates, phase 3 the second best with
    any low candidate; each takes only what its margin and the limits allow. Hard negatives count over all phases.
    """

    def fits(c: Column, r: Column) -> Column:
        return (c["key"] != r["key"]) & (c["adj"] - r["adj"] >= p.min_margin)

    def pair(c: Column, r: Column, kind: Column) -> Column:
        return F.struct(c.alias("c"), r.alias("r"), kind.alias("type"))

    def select(chosen: Column, rejected: Column) -> Column:
        top, second = F.get(chosen, 0), F.get(chosen, 1)
        hard = F.filter(F.filter(rejected, lambda r: r["hard"]), lambda r: fits(top, r))
        one = F.transform(F.slice(hard, 1, min(p.max_hard_negative_pairs, p.max_pairs)), lambda r: pair(top, r, F.lit("top_vs_hard_negative")))
        if not p.prefer_hard_negative:
            one = F.slice(one, 1, 0)
        number = lambda text: lambda r, i: F.struct(r.alias("r"), F.concat(F.lit(text), (i + 1).cast("string")).alias("type"))
        low = F.transform(F.slice(F.filter(rejected, lambda r: ~r["hard"]), 1, p.reach), number("top_vs_low_model_"))
        two = F.transform(F.filter(low, lambda x: fits(top, x["r"])), lambda x: pair(top, x["r"], x["type"]))

        def third(taken: Column) -> Column:
            any_low = F.filter(F.transform(F.slice(rejected, 1, p.reach), number("second_top_vs_low_")), lambda x: fits(second, x["r"]))
            room = p.max_hard_negative_pairs - F.size(F.filter(taken, lambda x: x["r"]["hard"]))
            within = let(any_low, lambda a: F.filter(a, lambda x, i: ~x["r"]["hard"] | (F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y["r"]["hard"])) <= room)))
            three = F.transform(within, lambda x: pair(second, x["r"], x["type"]))
            return F.when(F.size(chosen) >= 2, F.concat(taken, three)).otherwise(taken)

        return F.slice(let(F.slice(F.concat(one, two), 1, p.max_pairs), third), 1, p.max_pairs)

    def pools(items: Column) -> Column:
        can_win = lambda x: ~x["hard"] & (x["c"]["score"] >= p.min_chosen_score) & (F.coalesce(x["c"]["hallucination_penalty"], F.lit(0.0)) <= 0) & F.coalesce(x["c"]["f_style"] >= p.min_chosen_style, F.lit(True))
        can_lose = lambda x: ~S.is_reference(x["c"]["source"]) & ~S.is_anchor(x["c"]["role_hint"]) & (x["c"]["score"] <= p.max_rejected_score)
        both = F.struct(ranked(F.filter(items, can_win), True).alias("chosen"), ranked(F.filter(items, can_lose), False).alias("rejected"), F.size(items).alias("n"))
        return let(both, lambda b: F.when((b["n"] >= 2) & (F.size(b["chosen"]) > 0) & (F.size(b["rejected"]) > 0), select(b["chosen"], b["rejected"])))

    return F.when(F.size(candidates) >= 2, let(usable(candidates, shown), pools))


SIDE = {"source": "source", "role_hint": "role_hint", "score": "score", "f_code": "f_code", "f_sem": "f_sem", "f_sec": "f_sec", "f_style": "f_style", "hallucination_penalty": "hallucination_penalty", "security_facts": "covered_security_facts", "hallucination_flags": "hallucination_flags"}


def build_pairs(scored: DataFrame, p: PairRules = PairRules()) -> DataFrame:
    """Flat preference pairs of scored records (id, instruction, function, reference, candidates)."""
    held = scored if "_displayed" in scored.columns else with_displayed(scored)
    rows = exploded(held, ["id", "instruction", "function", "reference", "candidates"], choose(F.col("candidates"), F.col("_displayed"), p), "pair_index", "pair")
    flat = [
        F.concat(F.col("id").cast("string"), F.lit("_pair_"), F.col("pair_index").cast("string")).alias("id"),
        F.col("id").alias("source_id"),
        pair_prompt(F.col("instruction"), F.col("function")).alias("prompt"),
        F.lit(PAIRING_SYSTEM_PROMPT).alias("system_prompt"),
        "function",
        "reference",
        F.col("pair.c.text").alias("chosen"),
        F.col("pair.r.text").alias("rejected"),
    ]
    for name, key in (("chosen", "c"), ("rejected", "r")):
        whole = F.get("candidates", F.col(f"pair.{key}.pos"))
        flat += [whole[field].alias(f"{name}_{out}") for out, field in SIDE.items()]
        flat.append(F.col(f"pair.{key}.adj").alias(f"{name}_adjusted_score"))
    flat += [(F.col("pair.c.adj") - F.col("pair.r.adj")).alias("margin"), F.col("pair.type").alias("pair_type")]
    return rows.select(*flat)


def pair_summary(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: counts, margins (0 without pairs), five distributions as maps, and violations of the two invariants.

    Pairs are gone through once: they are summed up by their five kinds, of which there are few combinations, and those
    sums meet in one row, which all else comes from.
    """
    kinds = {"pair_type": "pair_type", "chosen_source": "chosen_source", "rejected_source": "rejected_source", "chosen_role": "chosen_role_hint", "rejected_role": "rejected_role_hint"}
    small = pairs.groupBy(*kinds.values()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.endswith("id", F.lit("_pair_0"))).alias("k"), F.sum("margin").alias("s"), F.max("margin").alias("high"), F.min("margin").alias("low"))
    bad_chosen = S.is_hard_negative(F.col("chosen_source"), F.col("chosen_role_hint"))
    bad_rejected = S.is_reference(F.col("rejected_source")) | S.is_anchor(F.col("rejected_role_hint"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    totals = small.agg(
        total(F.col("n")).alias("num_dpo_pairs"),
        F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("avg_margin"),
        F.coalesce(F.max("high"), F.lit(0.0)).alias("max_margin"),
        F.coalesce(F.min("low"), F.lit(0.0)).alias("min_margin_actual"),
        total(F.when(bad_chosen, F.col("n"))).alias("invalid_chosen_hard_negative"),
        total(F.when(bad_rejected, F.col("n"))).alias("invalid_rejected_reference"),
        total(F.col("k")).alias("k"),
        F.collect_list(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in kinds.items()], F.col("n"))).alias("all"),
    )

    def distribution(kind: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("all", lambda x: x[kind])))
        return F.map_from_arrays(names, F.transform(names, lambda v: F.aggregate(F.filter("all", lambda x: x[kind] == v), F.lit(0).cast("long"), lambda s, x: s + x["n"])))

    whole = records.agg(F.count(F.lit(1)).alias("num_records"))
    # two tables of one row each
    row = whole.join(totals)
    return row.withColumns({"skipped_records_without_pairs": F.col("num_records") - F.col("k"), **{f"{k}_distribution": distribution(k) for k in kinds}}).drop("k", "all")
