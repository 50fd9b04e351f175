"""What depends on a few columns alone is computed once for each of their combinations."""

import os
import re

import pytest
from pyspark.sql import functions as F
from quillmark.operators.kinds import once_each
from quillmark.plans import catalog, corpus


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables with so many orders that their texts repeat."""
    folder = tmp_path_factory.mktemp("many")
    spark.range(12000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    os.symlink("/root/testdata/sf0.001/conversations.parquet", folder / "conversations.parquet")
    return str(folder)


def plan(spark, name, sf_dir):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_rows_are_derived_once_a_combination(spark):
    rows = spark.createDataFrame([(i, [None, "a", "b"][i % 3], [i % 2 == 0], f"t{i}") for i in range(60)], "id int, a string, b array<boolean>, own string")
    seen = []

    def derive(kinds):
        seen.append(kinds.count())
        return kinds.withColumn("made", F.concat(F.coalesce("a", F.lit("-")), F.col("b")[0].cast("string")))

    want = sorted(map(tuple, derive(rows).collect()))
    assert sorted(map(tuple, once_each(rows, ["a", "b"], derive).collect())) == want
    assert seen == [60, 6]
    # where hardly any repeat, and where there are none, each row is derived in its place
    assert sorted(r.made for r in once_each(rows.limit(4), ["a", "b"], derive).collect()) == sorted(x[4] for x in want if x[0] < 4)
    assert seen == [60, 6, 4] and once_each(rows.where("false"), ["a", "b"], derive).count() == 0


def test_tasks_grow_with_the_input(spark, tmp_path):
    spark.range(5 * corpus.PORTION + 1).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert corpus.pool(spark, str(tmp_path)).rdd.getNumPartitions() == 6


#: Queries whose rules and cleaning are not gone through once a row.
ONCE = [
    "scored_records",
    "cider",
    "scored_records_by_source",
    "violated_invariants",
    "pair_summary",
    "candidate_union_dedup",
    "candidate_counts",
    "chosen_pool",
    "dpo_pairs",
    "rejected_pool",
    "comment_validity",
    "hard_negatives",
    "final_score",
]


@pytest.mark.parametrize("name", ONCE)
def test_texts_are_not_cleaned_once_a_row(spark, many, name):
    assert "regexp_replace" not in plan(spark, name, many)


def test_bleu_compares_equal_pairs_once(spark, many):
    assert re.search(r"Aggregate \[hypothesis#\d+, reference#\d+\]", plan(spark, "bleu", many))


def test_facts_with_shared_terms_are_the_same(spark, many):
    from quillmark.functions import scoring as S
    from quillmark.operators.candidates import fact_bits

    f = F.col("function")
    rows = corpus.pool(spark, many).select(f).union(spark.createDataFrame([(None,), ("",), ("returns\t(uint x, BOOL y) callBack only owner",)], "function string"))
    apart = F.struct(fact_bits(f).alias("found"), S.coverage_facts(f).alias("facts"), S.claim_evidence(f).alias("evidence"))
    assert rows.where(~S.function_facts(f).eqNullSafe(apart)).count() == 0


def test_scores_are_the_same_whether_built_with_judgements_or_not(spark, many):
    from quillmark.operators import candidates, pairs, scored

    pool = corpus.pool(spark, many).where("k < 300")
    same = F.transform("candidates", lambda c, i: i / 10)
    plain = scored.score_records(candidates.build_candidates(pool), same, same)
    whole = scored.score_records(candidates.build_candidates(pool, also=(scored.with_judged, pairs.add_displayed)), same, same)
    want, got = ({r.id: (r.candidates, r.score_range) for r in x.collect()} for x in (plain, whole))
    assert len(want) == 300 and want == got
    low = pairs.PairRules(min_margin=-1.0, min_chosen_score=0.0, max_rejected_score=1.0)
    assert sorted(map(str, pairs.build_pairs(plain, low).collect())) == sorted(map(str, pairs.build_pairs(whole, low).collect()))


def test_ranked_pools_are_those_of_scored_records(spark):
    from quillmark.operators import candidates, pairs, scored

    # comments that are displayed alike, or by letters alone, and scores that tie
    texts = ["Sends all the tokens to them.", "@dev Sends all the tokens to them.", "sends all the tokens to them. ", "/// Sends all the tokens to them.", "Only the owner can stop it.", "Ok.", "Burns some tokens of the account."]
    rows = [(i, i, "f() { onlyOwner; }", [(None if (i + j) % 9 == 0 else ("reference" if j == 0 else f"hard_negative_{j}" if j % 3 == 2 else f"m{j}"), t, "positive_anchor" if j == 3 else "model_candidate") for j, t in enumerate(texts)]) for i in range(40)]
    made = spark.createDataFrame(rows, "id int, k int, function string, c array<struct<source:string,comment:string,role_hint:string>>")
    made = made.withColumn("candidates", F.transform("c", lambda x: candidates.candidate(source=x["source"], comment=x["comment"], role_hint=x["role_hint"])))
    side = F.transform("candidates", lambda c, j: ((F.col("k") * 3 + j * 5) % 7) / 7.0)
    rule = pairs.PairRules(min_chosen_score=0.4, max_rejected_score=0.5, min_chosen_style=0.5)
    held = made.withColumns({"_facts": catalog.S.coverage_facts(F.col("function")), "_evidence": catalog.S.claim_evidence(F.col("function"))})
    held = pairs.add_usable(pairs.add_displayed(scored.with_judged(held)), rule)
    items = pairs.usable(F.col("candidates"), F.col("_displayed"))
    whole = pairs.with_displayed(scored.score_records(made, side, side)).select("k", items.alias("items"))
    S = catalog.S
    win = F.filter("items", lambda x: ~x["hard"] & (x["c"]["score"] >= rule.min_chosen_score) & (x["c"]["hallucination_penalty"] <= 0) & (x["c"]["f_style"] >= rule.min_chosen_style))
    lose = F.filter("items", lambda x: ~S.is_reference(x["c"]["source"]) & ~S.is_anchor(x["c"]["role_hint"]) & (x["c"]["score"] <= rule.max_rejected_score))
    for chosen, pool in ((True, win), (False, lose)):
        want = {r.k: r.x for r in whole.select("k", F.transform(pairs.ranked(pool, chosen), lambda x: F.struct(x["text"], x["c"]["source"], x["adj"])).alias("x")).collect()}
        ranked = pairs.ranked_pool(F.col("_usable"), side, side, chosen, rule)
        got = {r.k: r.x for r in held.select("k", F.transform(ranked, lambda x: F.struct(F.get("_usable", x["at"])["text"], F.get("_usable", x["at"])["source"], x["adj"])).alias("x")).collect()}
        assert sum(map(len, want.values())) > 40 and {k: list(map(tuple, x)) for k, x in got.items()} == {k: list(map(tuple, x)) for k, x in want.items()}


@pytest.mark.parametrize("name", ["rejected_pool", "chosen_pool"])
def test_pools_do_not_build_scored_candidates_once_a_row(spark, many, name):
    assert "covered_security_facts" not in plan(spark, name, many)
