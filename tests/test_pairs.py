import random

from pyspark.sql import functions as F
from quillmark.functions.scoring import is_valid_comment
from quillmark.operators.candidates import GenerationPlan, build_candidates, hard_negatives
from quillmark.operators.pairs import PairRules, build_pairs, pair_summary
from quillmark.operators.scored import score_records
from quillmark.plans.commands import SCORED

TEXTS = [f"Updates the stored {w} for every given account." for w in ("total", "amount", "price", "share", "limit", "fee", "rate")] + ["Moves it now", "updates the  stored total for every given account.", "bad", "Updates // it all now"]


def record(rng, k):
    items = []
    for _ in range(rng.randint(0, 9)):
        source, role = rng.choice([("reference", "positive_anchor"), ("hard_negative_x", "negative_only"), ("sft_greedy", "model_candidate"), ("base_zero_shot", None), (None, "negative_only")])
        items.append({"source": source, "role_hint": role, "comment": rng.choice(TEXTS), "score": rng.choice([None, 0.1, 0.3, 0.5, 0.55, 0.6, 0.7, 0.75, 0.9]), "hallucination_penalty": rng.choice([0.0, 0.0, 0.25]), "f_style": rng.choice([None, 0.5, 0.6, 1.0])})
    return (str(k), "do", f"f{k}", "ref", items)


def penalty(text):
    n = len(text.split())
    return 0.03 if n < 5 else 0.0 if n <= 15 else 0.05


def select(items, p, valid):
    """A plain greedy reading of the selection, with counters."""
    if len(items) < 2:
        return []
    seen, usable = set(), []
    for c in items:
        key = " ".join(c["comment"].lower().split())
        if c["score"] is None or c["comment"] not in valid or key in seen:
            continue
        seen.add(key)
        hard = (c["source"] or "").startswith("hard_negative") or c["role_hint"] == "negative_only"
        usable.append(dict(c, key=key, text=" ".join(c["comment"].split()), hard=hard, adj=c["score"] - penalty(c["comment"])))
    if len(usable) < 2:
        return []
    chosen = sorted([c for c in usable if not c["hard"] and c["score"] >= p.min_chosen_score and c["hallucination_penalty"] <= 0 and (c["f_style"] is None or c["f_style"] >= p.min_chosen_style)], key=lambda c: -c["adj"])
    low = sorted([c for c in usable if c["source"] != "reference" and c["role_hint"] != "positive_anchor" and c["score"] <= p.max_rejected_score], key=lambda c: c["adj"])
    if not chosen or not low:
        return []
    out, hard_used = [], 0

    def offer(c, r, kind):
        nonlocal hard_used
        if len(out) >= p.max_pairs or c["key"] == r["key"] or c["adj"] - r["adj"] < p.min_margin:
            return
        if r["hard"]:
            if hard_used >= p.max_hard_negative_pairs:
                return
            hard_used += 1
        out.append((c["text"], r["text"], kind))

    if p.prefer_hard_negative:
        for r in low:
            if r["hard"]:
                offer(chosen[0], r, "top_vs_hard_negative")
    for i, r in enumerate([r for r in low if not r["hard"]][:5]):
        offer(chosen[0], r, f"top_vs_low_model_{i + 1}")
    for c in chosen[1:2]:
        for i, r in enumerate(low[:5]):
            offer(c, r, f"second_top_vs_low_{i + 1}")
    return out


def test_selection_against_a_greedy_reading(spark):
    rng = random.Random(3)
    rows = [record(rng, k) for k in range(400)]
    frame = spark.createDataFrame(rows, SCORED).repartition(3).cache()
    ok = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    valid = {r.t for r in ok.where(is_valid_comment(F.col("t"))).collect()}
    for p in (PairRules(), PairRules(min_margin=-1.0, max_pairs=4, max_hard_negative_pairs=2, min_chosen_score=0.3, max_rejected_score=0.8), PairRules(max_pairs=0), PairRules(max_hard_negative_pairs=0, min_margin=0.1), PairRules(prefer_hard_negative=False, min_margin=0.1), PairRules(min_margin=0.05, max_pairs=10, max_hard_negative_pairs=3)):
        got: dict[str, list] = {}
        for r in build_pairs(frame, p).collect():
            got.setdefault(r.source_id, []).append((int(r.id.rsplit("_", 1)[1]), r.chosen, r.rejected, r.pair_type))
        for k, _, _, _, items in rows:
            want = select(items, p, valid)
            assert [x[1:] for x in sorted(got.get(k, []))] == want, (p, k)


def test_summary_and_invariants(spark):
    rng = random.Random(5)
    frame = spark.createDataFrame([record(rng, k) for k in range(200)], SCORED)
    made = build_pairs(frame, PairRules(min_margin=0.05))
    s = pair_summary(frame, made).first()
    assert s.num_records == 200 and s.num_dpo_pairs == made.count() > 0
    assert s.invalid_chosen_hard_negative == 0 and s.invalid_rejected_reference == 0
    assert sum(s.pair_type_distribution.values()) == s.num_dpo_pairs
    none = pair_summary(frame, made.where("false")).first()
    assert (none.num_dpo_pairs, none.avg_margin, none.skipped_records_without_pairs, none.pair_type_distribution) == (0, 0.0, 200, {})


def negatives(spark, function, reference, n=4):
    row = spark.createDataFrame([(function, reference)], "f string, r string")
    return [(c.source.removeprefix("hard_negative_"), c.comment) for c in row.select(hard_negatives(row.f, row.r, n).alias("n")).first().n]


def test_negatives(spark):
    assert negatives(spark, "", "Ref text.") == [("generic_incomplete", "Executes the function.")]
    got = negatives(spark, "onlyOwner", "Only the owner can set the total.")
    assert got[1:] == [("access_control", "any user can set the total."), ("access_omission", "the can set the total.")]
    assert negatives(spark, "onlyOwner", "Sets ownership details here.")[1] == ("access_control", "Sets ownership details here.")
    assert negatives(spark, "admin", "The admin acts")[1:] == [("access_control", "The user acts"), ("access_omission", "Performs the requested operation.")]
    assert negatives(spark, "mint burn", "x")[1:] == [("action_reverse", "Burns tokens from the caller."), ("action_reverse", "Mints new tokens to the caller.")]
    many = negatives(spark, "onlyowner deadline approve callback require( paused unchecked delegatecall", "x", 20)
    assert len(many) == 11 and len(negatives(spark, "onlyowner deadline approve callback", "x")) == 4


def test_candidates_and_scores(spark):
    pool = spark.createDataFrame([("a", "do", "onlyOwner", "Only the owner can act on it.", {"base_zero_shot": ["only  the OWNER can act on it.", "cut"], "sft_greedy": [""], "sft_temp_0.6": ["One answer here now.", "Two."]})], "id string, instruction string, function string, reference string, outputs map<string,array<string>>")
    made = build_candidates(pool, GenerationPlan(negatives=2))
    row = made.first()
    assert [c.source for c in row.candidates] == ["reference", "hard_negative_generic_incomplete", "hard_negative_access_control", "sft_temp_0.6_1", "sft_temp_0.6_2"]
    assert row.candidates[3].temperature == 0.6 and row.num_candidates == 5 and row.role_counts == {"positive_anchor": 1, "negative_only": 2, "model_candidate": 2}
    same = F.transform("candidates", lambda c: F.lit(0.5))
    scored = score_records(made, same, same).first()
    assert [c.score for c in scored.candidates] == sorted([c.score for c in scored.candidates], reverse=True)
    assert scored.best_candidate.score - scored.worst_candidate.score == scored.score_range
    empty = score_records(made.withColumn("candidates", F.slice("candidates", 1, 0)), F.array(F.lit(0.0)), F.array(F.lit(0.0))).first()
    assert empty.best_candidate is None and empty.score_range == 0.0
