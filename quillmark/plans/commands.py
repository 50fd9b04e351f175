"""The batch steps as functions with configurations, and a command line over them.

    python -m quillmark.plans.commands candidates --pool pool.jsonl --output candidates.jsonl
"""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import candidates as C
from ..operators import encode, models, pairs, preference, resume, scored, vectors
from ..sources import jsonl, tables

RECORD = f"id string, instruction string, function string, reference string, candidates array<{C.CANDIDATE}>"
SCORED_CANDIDATE = "struct<score:double,source:string,comment:string,role_hint:string,perturbation_type:string,decode_strategy:string,model_stage:string,temperature:double,side_raw:double,f_code:double,sentence_sim_raw:double,f_sem:double,f_sec:double,hallucination_penalty:double,f_style:double,num_security_facts:int,security_facts:array<string>,covered_security_facts:array<string>,hallucination_flags:array<string>,style_flags:array<string>>"
SCORED = f"id string, instruction string, function string, reference string, candidates array<{SCORED_CANDIDATE}>"


@dataclass(frozen=True)
class Candidates:
    pool: str = ""
    output: str = ""
    resume: bool = False
    max_samples: int | None = None
    plan: C.GenerationPlan = field(default_factory=C.GenerationPlan)


def make_candidates(spark: SparkSession, c: Candidates, generators: dict[str, models.Generator] | None = None) -> DataFrame:
    """Candidate records of a pool file; with ``resume`` only of samples that the output does not have yet."""
    samples = jsonl.pool_samples(jsonl.read_lines(spark, c.pool))
    done = jsonl.done_ids(spark, c.output) if c.resume else spark.createDataFrame([], "id string")
    todo = resume.remaining(samples, done, c.max_samples)
    if generators:
        prompt = T.render_chat(T.chat_messages(F.col("instruction"), F.col("function")))
        todo = models.generate_outputs(todo, prompt, generators, c.plan)
    made = C.build_candidates(todo, c.plan).drop("line_no", "source_file", "token_seq")
    jsonl.write_records(made, c.output, append=c.resume)
    return jsonl.read_records(spark, c.output, RECORD)


def settings(config) -> Column:
    """The fields of a configuration as one struct, for a run's summary."""
    return F.struct(*[F.lit(v).alias(k) for k, v in dataclasses.asdict(config).items()])


@dataclass(frozen=True)
class Scores:
    candidates: str = ""
    output: str = ""
    weights: S.Weights = field(default_factory=S.Weights)


def similarities(records: DataFrame, encoder: vectors.Encoder) -> DataFrame:
    """``records`` with side and sem: arrays of cosines of each candidate with its function and its reference.

    Each distinct text is encoded once; a candidate's place travels with it, and rows meet again by id.
    """
    rows = T.exploded(records, ["id", "function", "reference"], F.col("candidates.comment"), "pos", "comment")
    near = vectors.text_similarity(vectors.text_similarity(rows, "function", "comment", encoder, "side"), "comment", "reference", encoder, "sem")
    packed = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "side", "sem"))).alias("s"))
    return records.join(packed, "id", "left").withColumns({"side": F.col("s.side"), "sem": F.col("s.sem")}).drop("s")


def score(spark: SparkSession, c: Scores, encoder: vectors.Encoder = vectors.hashed_encoder) -> DataFrame:
    """Scored records; a summary goes beside them."""
    near = similarities(jsonl.read_records(spark, c.candidates, RECORD), encoder)
    out = scored.score_records(near, F.coalesce("side", F.expr("cast(array() as array<double>)")), F.coalesce("sem", F.expr("cast(array() as array<double>)")), c.weights)
    plain = out.withColumn("candidates", F.transform("candidates", lambda x: x.dropFields("order", "pos")))
    plain = plain.withColumns({k: F.col(k).dropFields("order", "pos") for k in ("best_candidate", "worst_candidate")})
    jsonl.write_records(plain, c.output)
    back = jsonl.read_records(spark, c.output, SCORED)
    n = F.coalesce(F.size("candidates"), F.lit(0))
    jsonl.write_summary(back.agg(F.count(F.lit(1)).alias("num_records"), F.coalesce(F.sum(n), F.lit(0)).alias("num_candidates")).withColumns({"weights": settings(c.weights), "encoder": F.lit(getattr(encoder, "__name__", "encoder"))}), c.output)
    return back


@dataclass(frozen=True)
class Pairs:
    scored: str = ""
    output: str = ""
    rules: pairs.PairRules = field(default_factory=pairs.PairRules)


def make_pairs(spark: SparkSession, c: Pairs) -> DataFrame:
    records = jsonl.read_records(spark, c.scored, SCORED)
    made = pairs.build_pairs(records.withColumn("candidates", F.coalesce("candidates", F.expr(f"cast(array() as array<{SCORED_CANDIDATE}>)"))), c.rules)
    jsonl.write_records(made, c.output)
    back = jsonl.read_records(spark, c.output, made.schema)
    jsonl.write_summary(pairs.pair_summary(records, back).withColumn("rules", settings(c.rules)), c.output)
    return back


@dataclass(frozen=True)
class Predictions:
    test: str = ""
    output: str = ""
    resume: bool = False
    max_samples: int | None = None
    model: str = "model"
    base_model_path: str = ""
    adapter_path: str = ""


def predict(spark: SparkSession, c: Predictions, generator: models.Generator = models.echo_generator) -> DataFrame:
    samples = jsonl.prediction_samples(jsonl.read_lines(spark, c.test))
    done = jsonl.done_ids(spark, c.output) if c.resume else spark.createDataFrame([], "id string")
    todo = resume.remaining(samples, done, c.max_samples)
    prompt = T.render_chat(T.chat_messages(F.col("instruction"), F.col("function")))
    made = models.predictions(todo, prompt, generator, T.prediction_clean_basic, c.model, c.base_model_path, c.adapter_path)
    jsonl.write_records(made, c.output, append=c.resume)
    return jsonl.read_records(spark, c.output, made.schema)


@dataclass(frozen=True)
class Training:
    """What the preference trainer needs of the data; the optimisation itself is outside of this library."""

    pairs: str = ""
    cache: str = ""
    eval_ratio: float = 0.1
    seed: int = 42
    max_length: int = 1152
    max_prompt: int = 1024
    max_response: int = 128
    batch: int = 2
    beta: float = 0.1
    sft_weight: float = 0.0
    overwrite_cache: bool = False


def training_data(spark: SparkSession, c: Training, reference_logps, tokenize=encode.word_ids) -> DataFrame:
    """Pairs split, encoded and with reference log-probabilities from the cache, which is filled and swapped in.

    Also with ``overwrite_cache`` the cache holds all pairs afterwards, of both parts.
    """
    samples = resume.split_train_eval(jsonl.pair_samples(jsonl.read_lines(spark, c.pairs)), c.eval_ratio, c.seed)
    schema = "id string, ref_chosen_logp double, ref_rejected_logp double"
    known = jsonl.exists(spark, c.cache) and not c.overwrite_cache
    cache = jsonl.read_records(spark, c.cache, schema) if known else spark.createDataFrame([], schema)
    cache = resume.latest_of_each(cache.withColumn("at", F.monotonically_increasing_id()), "at").select("id", "ref_chosen_logp", "ref_rejected_logp")
    filled, merged = resume.fill_cache(samples, cache, reference_logps)
    jsonl.swap_records(merged, c.cache)
    filled, _ = resume.fill_cache(samples, jsonl.read_records(spark, c.cache, schema), reference_logps)
    messages = F.array(F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    prompt = tokenize(T.render_chat(messages))
    both = {f"{k}_encoded": encode.encode_pair(prompt, tokenize(F.col(k)), c.max_length, c.max_response, c.max_prompt) for k in ("chosen", "rejected")}
    return filled.withColumns(both)


def evaluate(terms: DataFrame, *keys: str) -> DataFrame:
    """Evaluation metrics of pairs whose log-probabilities a policy has given."""
    return preference.eval_metrics(preference.batch_metrics(terms, *keys))


def evaluate_table(spark: SparkSession, source: str, output: str, headed: bool, encoder: vectors.Encoder = vectors.hashed_encoder) -> DataFrame:
    """A table of the evaluation with its similarities, written to a path of its own."""
    if headed:
        out = vectors.summary_similarity(tables.read_headed_csv(spark, source), encoder)
        tables.write_csv(out.drop("similar"), output, True, "ISO-8859-1")
    else:
        out = vectors.code_summary_similarity(tables.read_plain_csv(spark, source), encoder)
        tables.write_csv(out, output, False)
    return out


@dataclass(frozen=True)
class Evaluation:
    source: str = ""
    output: str = ""
    headed: bool = True


def evaluation(spark: SparkSession, c: Evaluation, encoder: vectors.Encoder = vectors.hashed_encoder) -> DataFrame:
    return evaluate_table(spark, c.source, c.output, c.headed, encoder)


@dataclass(frozen=True)
class Split:
    pairs: str = ""
    output: str = ""
    eval_ratio: float = 0.1
    seed: int = 42


def split(spark: SparkSession, c: Split) -> DataFrame:
    """Training pairs with their part, under the output; a summary counts them."""
    made = resume.split_train_eval(jsonl.pair_samples(jsonl.read_lines(spark, c.pairs)), c.eval_ratio, c.seed)
    jsonl.write_records(made, c.output)
    back = jsonl.read_records(spark, c.output, made.schema)
    part = lambda name: F.count_if(F.col("part") == name).alias(f"num_{name}")
    jsonl.write_summary(back.agg(F.count(F.lit(1)).alias("num_pairs"), part("train"), part("eval")).withColumn("settings", settings(c)), c.output)
    return back


STEPS = {"candidates": (Candidates, make_candidates), "score": (Scores, score), "pairs": (Pairs, make_pairs), "predict": (Predictions, predict), "split": (Split, split), "evaluate": (Evaluation, evaluation)}
NESTED = {"plan": C.GenerationPlan, "weights": S.Weights, "rules": pairs.PairRules}


def add_options(parser: argparse.ArgumentParser, kind: type) -> None:
    """One option per field; booleans can be switched off with --no-..."""
    for f in dataclasses.fields(kind):
        if f.name in NESTED:
            add_options(parser, NESTED[f.name])
        elif isinstance(f.default, bool):
            parser.add_argument(f"--{f.name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=f.default)
        elif not isinstance(f.default, tuple):
            as_type = int if f.default is None else type(f.default)
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=as_type, default=f.default)


def configured(kind: type, args: argparse.Namespace):
    values = {}
    for f in dataclasses.fields(kind):
        values[f.name] = configured(NESTED[f.name], args) if f.name in NESTED else getattr(args, f.name, f.default)
    return kind(**values)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    for name, (kind, _) in STEPS.items():
        add_options(steps.add_parser(name), kind)
    args = parser.parse_args(argv)
    kind, run = STEPS[args.step]
    spark = SparkSession.builder.appName(f"quillmark {args.step}").getOrCreate()
    run(spark, configured(kind, args))


if __name__ == "__main__":
    main()
