"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..functions import text as T
from ..operators import candidates as C
from ..operators import encode, models, pairs, preference, resume, scored, text_metrics, vectors
from ..operators.kinds import once_each
from ..sources import jsonl, tables
from . import corpus, sql, staging

REGISTERED: dict[str, tuple] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        REGISTERED[f.__name__] = (f, oracle)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(xs: Column) -> Column:
    return F.array_join(xs, ",")


# --- text -------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({sql.folded('text')}) AS key_md5, CAST({sql.n_words('coalesce(text, chr(32))')} AS INTEGER) AS n_words FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("key_md5"), T.word_count(F.coalesce("text", F.lit(" "))).alias("n_words"))


def affixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts with what model output may carry around it."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    raw = F.concat(pick(sql.BEFORE, F.col("conv_id") * 7 + F.col("turn")), F.col("text"), pick(sql.AFTER, F.col("conv_id") * 5 + F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))


def cleaned(how):
    return lambda spark, sf_dir: affixed(spark, sf_dir).select("conv_id", "turn", how(F.col("raw")).alias("cleaned"))


for _name, _how, _steps in (("display_clean", T.display_clean, sql.DISPLAY), ("prediction_clean_full", T.prediction_clean, sql.PREDICTION), ("prediction_clean_basic", T.prediction_clean_basic, sql.BASIC)):
    REGISTERED[_name] = (cleaned(_how), f"SELECT conv_id, turn, raw AS cleaned FROM {sql.steps(sql.affixed(), 'raw', *_steps)}")

#: Comments of all kinds: references, raw model outputs, rule texts, and prose.
COMMENTS_SQL = f"(SELECT k * 4 + stage AS id, comment FROM {sql.STAGED} UNION ALL SELECT k * 4 + 3, reference FROM {sql.POOL} UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations)"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = corpus.pool(spark, sf_dir)
    four = F.array(*[F.struct((F.col("k") * 4 + s).alias("id"), corpus.model_output(F.col("k"), s).alias("comment")) for s in (0, 1, 2)], F.struct((F.col("k") * 4 + 3).alias("id"), F.col("reference").alias("comment")))
    prose = table(spark, sf_dir, "conversations").select((F.lit(-1) - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.col("text").alias("comment"))
    return pool.select(F.inline(four)).unionByName(prose)


@query(f"SELECT id, english, artifact, return_artifact, generic, valid, length_penalty, CAST(len(w) AS INTEGER) AS n_words FROM {sql.validity(COMMENTS_SQL)}")
def comment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, shown = F.col("comment"), F.col("shown")
    flags = {"english": S.probably_english(shown), "artifact": S.has_artifact(c), "return_artifact": S.has_return_artifact(shown), "generic": S.is_too_generic(shown), "valid": ~S.has_artifact(c) & S.is_valid_display(shown), "length_penalty": S.display_penalty(shown), "n_words": T.word_count(shown)}
    return once_each(comments(spark, sf_dir), ["comment"], lambda kinds: kinds.withColumn("shown", T.display_clean(c)).withColumns(flags)).select("id", *flags)


# --- sources ----------------------------------------------------------------------------------------------------------

#: Lines of all layouts, some broken, by order key.
LINE_FORMS = (
    '{"id": "x%s", "instruction": "do", "input": "f%s() {}", "output": "Does %s."}',
    '{"instruction": "do", "function": "  ", "reference": "Says %s.", "token_seq": "g%s() {}", "source_file": "a%s.sol"}',
    '{"prompt": "p", "reference": "Old %s.", "token_seq": "h%s() {}", "id": "b%s"}',
    '{"instruction": null, "function": "k%s() {}", "reference": null, "n": "%s", "m": "%s"}',
    '{"instruction": "do", "input": "%s", "output": " ", "a": "%s", "b": "%s"}',
    '{"broken": %s, %s, %s',
    '  ',
    '{"id": "both%s", "instruction": "do", "input": "i%s() {}", "output": "Both.", "function": "no", "reference": "%s"}',
    '{"instruction": "do", "reference": "%s%s%s"}',
)


def line_text(k: Column) -> Column:
    form = F.get(F.array(*map(F.lit, LINE_FORMS)), (k % len(LINE_FORMS)).cast("int"))
    return F.replace(form, F.lit("%s"), k.cast("string"))


def _pool_sql() -> str:
    form = "(CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {sql.q(x)}" for i, x in enumerate(LINE_FORMS)) + " END)"
    rows = f"(SELECT o_orderkey AS line_no, {sql.strip(f'''replace({form}, '%s', CAST(o_orderkey AS VARCHAR))''')} AS line FROM orders)"
    good = f"(SELECT line_no, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM {rows} WHERE line <> '')"
    keyed = f"(SELECT *, json_keys(j) AS keys FROM {good} WHERE json_type(j) = 'OBJECT')"
    text = lambda n: f"CASE WHEN list_contains(keys, '{n}') THEN coalesce({sql.strip(f'''json_extract_string(j, '$.{n}')''')}, 'None') END"
    has = lambda *ns: "(" + " AND ".join(f"list_contains(keys, '{n}')" for n in ns) + ")"
    a, c, b = has("instruction", "input", "output"), has("instruction", "function", "reference"), has("prompt", "reference", "token_seq")
    fn = f"CASE WHEN {a} THEN {text('input')} WHEN {c} THEN (CASE WHEN {text('function')} = '' AND {has('token_seq')} THEN {text('token_seq')} ELSE {text('function')} END) ELSE {text('token_seq')} END"
    return f"""SELECT * FROM (SELECT CASE WHEN {has('id')} THEN coalesce(json_extract_string(j, '$.id'), 'None') ELSE 'dpo_pool_' || line_no END AS id,
      CASE WHEN {a} OR {c} THEN {text('instruction')} ELSE {sql.q(T.POOL_INSTRUCTION)} END AS instruction, {fn} AS function,
      CASE WHEN {a} THEN {text('output')} ELSE {text('reference')} END AS reference, {text('source_file')} AS source_file, {text('token_seq')} AS token_seq, line_no
      FROM {keyed} WHERE {a} OR {c} OR {b}) WHERE function <> '' AND reference <> ''"""


@query(_pool_sql())
def pool_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line_text(F.col("o_orderkey")).alias("value"))
    return jsonl.pool_samples(lines)


#: Lines of training samples, predictions, pairs and records, some broken or blank, by order key.
RECORD_FORMS = (
    '{"id": "s%s", "instruction": "do", "input": " f%s() {} ", "output": "Does %s."}',
    '{"instruction": "do", "input": "f%s() {}", "output": "  "}',
    '{"id": "p%s", "prompt": "q%s", "chosen": "Good %s.", "rejected": "Bad."}',
    '',
    '{"id": "r%s", "prompt": "q", "chosen": "Ok.", "rejected": "No %s.", "system_prompt": "be brief"}',
    '{"id": "p%s", "prompt": " ", "chosen": "x", "rejected": "y"}',
    '{"id": "broken%s", ',
    '{"instruction": null, "input": "g%s() {}", "output": "é %s"}',
    '[%s]',
    '{"id": null, "prompt": "n%s", "chosen": "c", "rejected": null}',
)
RECORDS_SQL = "(SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, replace(CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {sql.q(x)}" for i, x in enumerate(RECORD_FORMS)) + " END, '%s', CAST(o_orderkey AS VARCHAR)) AS line FROM orders)"
OBJECTS_SQL = f"(SELECT *, json_keys(j) AS keys FROM (SELECT line_no, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM {RECORDS_SQL} WHERE line <> '') WHERE json_type(j) = 'OBJECT')"


def text_sql(name: str) -> str:
    return f"CASE WHEN list_contains(keys, '{name}') THEN coalesce(trim(json_extract_string(j, '$.{name}')), 'None') END"


def has_sql(*names: str) -> str:
    return "(" + " AND ".join(f"list_contains(keys, '{n}')" for n in names) + ")"


def id_sql(prefix: str) -> str:
    return f"CASE WHEN list_contains(keys, 'id') THEN coalesce(json_extract_string(j, '$.id'), 'None') ELSE '{prefix}' || line_no END"


def record_file(spark: SparkSession, sf_dir: str) -> str:
    """The lines in the order of their keys, written as text: files are named in that order, lines stand in it within."""
    k = F.col("o_orderkey")
    line = F.replace(F.get(F.array(*map(F.lit, RECORD_FORMS)), (k % len(RECORD_FORMS)).cast("int")), F.lit("%s"), k.cast("string"))
    path = staging.new_path(spark, "records")
    table(spark, sf_dir, "orders").select(k, line.alias("value")).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return path


SAMPLES_SQL = f"SELECT {id_sql('sample_')} AS id, {text_sql('instruction')} AS instruction, {text_sql('input')} AS function, {text_sql('output')} AS {{0}}, line_no FROM {OBJECTS_SQL} WHERE {has_sql('instruction', 'input', 'output')}"


@query(f"SELECT * FROM ({SAMPLES_SQL.replace('{0}', 'comment')}) WHERE instruction <> '' AND function <> '' AND comment <> ''")
def sft_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.sft_samples(jsonl.read_lines(spark, record_file(spark, sf_dir)))


@query(SAMPLES_SQL.replace('{0}', 'reference'))
def prediction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.prediction_samples(jsonl.read_lines(spark, record_file(spark, sf_dir)))


@query(f"""SELECT * FROM (SELECT {", ".join(f"{text_sql(c)} AS {c}" for c in ("id", "prompt", "chosen", "rejected"))}, CASE WHEN {has_sql('system_prompt')} THEN {text_sql('system_prompt')} ELSE {sql.q(T.SYSTEM_PROMPT)} END AS system_prompt
  FROM {OBJECTS_SQL} WHERE {has_sql('id', 'prompt', 'chosen', 'rejected')}) WHERE prompt <> '' AND chosen <> '' AND rejected <> ''""")
def pair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.pair_samples(jsonl.read_lines(spark, record_file(spark, sf_dir)))


@query(f"SELECT json_extract_string(j, '$.id') AS id, json_extract_string(j, '$.prompt') AS prompt FROM {OBJECTS_SQL}")
def lenient_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.read_records(spark, record_file(spark, sf_dir), "id string, prompt string")


@query(f"SELECT DISTINCT id FROM (SELECT json_extract_string(j, '$.id') AS id FROM {OBJECTS_SQL}) WHERE id IS NOT NULL")
def done_ids_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.done_ids(spark, record_file(spark, sf_dir))


@query(f"SELECT id FROM (SELECT * FROM ({SAMPLES_SQL.replace('{0}', 'reference')}) WHERE id NOT IN (SELECT 's' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0) ORDER BY line_no LIMIT 100)")
def capped_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = jsonl.prediction_samples(jsonl.read_lines(spark, record_file(spark, sf_dir)))
    done = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("id"))
    return resume.remaining(samples, done, 100).select("id")


def nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, -n_nationkey / 4::DOUBLE AS ref_chosen_logp, CASE WHEN n_nationkey % 2 = 0 THEN -1::DOUBLE ELSE -2::DOUBLE END AS ref_rejected_logp FROM nation")
def reference_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, appended to for even keys, read with the last row of each id, swapped with itself, and read again."""
    path, schema = staging.new_path(spark, "cache"), "id string, ref_chosen_logp double, ref_rejected_logp double, at long"
    rows = nation_rows(spark, sf_dir).select(F.col("k").cast("string").alias("id"), (-F.col("k") / 4).alias("ref_chosen_logp"), F.lit(-2.0).alias("ref_rejected_logp"), F.lit(0).alias("at"))
    jsonl.write_records(rows, path)
    jsonl.write_records(rows.where("cast(id as int) % 2 = 0").withColumns({"ref_rejected_logp": F.lit(-1.0), "at": F.lit(1)}), path, append=True)
    last = resume.latest_of_each(jsonl.read_records(spark, path, schema), "at")
    jsonl.swap_records(last, path)
    return jsonl.read_records(spark, path, schema).select("id", "ref_chosen_logp", "ref_rejected_logp")


@query("SELECT 'f' || n_nationkey || '() { \"q\", }' AS method, n_name || chr(10) || 'é' AS summary FROM nation")
def plain_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.new_path(spark, "plain")
    made = nation_rows(spark, sf_dir).select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit('() { "q", }')).alias("method"), F.concat("name", F.lit("\né")).alias("summary"))
    tables.write_csv(made, path, False)
    return tables.read_plain_csv(spark, path)


@query("SELECT n_name || ', é' AS comment, 'n ' || n_nationkey AS comment1 FROM nation")
def headed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.new_path(spark, "headed")
    made = nation_rows(spark, sf_dir).select(F.concat("name", F.lit(", é")).alias("comment"), F.concat(F.lit("n "), F.col("k").cast("string")).alias("comment1"), F.lit(0.5).alias("similarity"))
    tables.write_csv(made, path, True, "ISO-8859-1")
    return tables.read_headed_csv(spark, path)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, 'h ' || o_orderkey AS hypothesis, 'r ' || o_orderkey * 2 AS reference FROM orders")
def parallel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of as many lines, cut in different places."""
    paths = []
    for label, text, parts in (("hypothesis", F.concat(F.lit("h "), F.col("o_orderkey").cast("string")), 3), ("reference", F.concat(F.lit("r "), (F.col("o_orderkey") * 2).cast("string")), 5)):
        paths.append(staging.new_path(spark, label))
        table(spark, sf_dir, "orders").repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey").select(text.alias("value")).write.text(paths[-1])
    return tables.read_parallel_text(spark, *paths)


@query("SELECT n_nationkey AS step, n_nationkey / 2::DOUBLE AS train_loss, NULL::DOUBLE AS eval_loss FROM nation UNION ALL SELECT n_nationkey, NULL, n_nationkey / 4::DOUBLE FROM nation WHERE n_nationkey % 5 = 0")
def train_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = staging.new_path(spark, "log"), nation_rows(spark, sf_dir)
    train, evals = rows.select(F.col("k").alias("step"), (F.col("k") / 2).alias("train_loss")), rows.where("k % 5 = 0").select(F.col("k").alias("step"), (F.col("k") / 4).alias("eval_loss"))
    jsonl.write_log(train.where("step < 10"), evals.where("step < 10"), path)
    jsonl.write_log(train.where("step >= 10"), evals.where("step >= 10"), path)
    return jsonl.read_records(spark, path, "step long, train_loss double, eval_loss double")


# --- facts, claims, style, score --------------------------------------------------------------------------------------


@query(f"SELECT k, {', '.join(f'''{sql.any_of('lower(function)', t)} AS {n}''' for n, t in rules.GENERATOR_FACTS.items())} FROM {sql.POOL}")
def detect_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pool(spark, sf_dir).select("k", *[c.alias(n) for n, c in S.generator_facts(F.col("function")).items()])


@query(f"SELECT k, array_to_string(f, ',') AS facts, CAST(len(f) AS INTEGER) AS num_facts FROM (SELECT k, {sql.facts_list('lower(function)')} AS f FROM {sql.POOL})")
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.pool(spark, sf_dir).select("k", S.coverage_facts(F.col("function")).alias("f"))
    return rows.select("k", joined(F.col("f")).alias("facts"), F.size("f").alias("num_facts"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's functions against each stand-in output; what depends on the function alone is found before."""
    pool = corpus.pool(spark, sf_dir).select("k", "function", S.coverage_facts(F.col("function")).alias("facts"), S.claim_evidence(F.col("function")).alias("evidence"))
    return pool.select("k", "facts", "evidence", F.posexplode(F.array(*[corpus.model_output(F.col("k"), s) for s in (0, 1, 2)])).alias("stage", "comment"))


@query(f"SELECT k, stage, array_to_string(covered, ',') AS covered, f_sec FROM {sql.scored(f'(SELECT *, 0 AS side, 0 AS sem FROM {sql.STAGED})')}")
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(spark, sf_dir).withColumn("c", S.covered_facts(F.col("facts"), F.col("comment")))
    return rows.select("k", "stage", joined(F.col("c")).alias("covered"), S.coverage(F.col("facts"), F.col("c")).alias("f_sec"))


@query(f"SELECT k, stage, array_to_string(flags, ',') AS flags, penalty FROM {sql.scored(f'(SELECT *, 0 AS side, 0 AS sem FROM {sql.STAGED})')}")
def hallucination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(spark, sf_dir).withColumn("f", S.claim_flags(F.col("evidence"), F.col("comment")))
    return rows.select("k", "stage", joined(F.col("f")).alias("flags"), S.claim_penalty(F.col("f")).alias("penalty"))


@query(f"SELECT id, {sql.style_score('shown')} AS f_style, array_to_string({sql.style_flags('shown')}, ',') AS style_flags FROM (SELECT id, {sql.squeeze('comment')} AS shown FROM {COMMENTS_SQL})")
def style_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir).select("id", S.style(F.col("comment")).alias("s"))
    return rows.select("id", "s.f_style", joined(F.col("s.style_flags")).alias("style_flags"))


FLAT = "((k * 37 + stage * 53) % 1200 - 200) / 1000::DOUBLE AS side, ((k * 41 + stage * 59) % 1200 - 200) / 1000::DOUBLE AS sem"


@query(f"SELECT k, stage, round(score, 9) AS score FROM {sql.scored(f'(SELECT *, {FLAT} FROM {sql.STAGED})')}")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, stage = F.col("k"), F.col("stage")
    judged = scored.judged(F.col("facts"), F.col("evidence"), F.col("comment"))
    rows = once_each(staged(spark, sf_dir), ["facts", "evidence", "comment"], lambda kinds: kinds.withColumn("j", judged))
    side, sem = ((k * 37 + stage * 53) % 1200 - 200) / 1000.0, ((k * 41 + stage * 59) % 1200 - 200) / 1000.0
    score = S.final_score(S.clamp(side), S.clamp(sem), F.col("j.f_sec"), F.col("j.f_style"), F.col("j.penalty"))
    return rows.select("k", "stage", F.round(score, 9).alias("score"))


# --- candidates and pairs ---------------------------------------------------------------------------------------------

PLAN = C.GenerationPlan(sampling=((0.3, 1),))


@query(f"SELECT k, CAST(place - 1 AS INTEGER) AS pos, source, comment, kind AS perturbation_type FROM {sql.negatives()}")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.exploded(C.with_negatives(corpus.pool(spark, sf_dir)), ["k"], F.col("negatives"), "pos", "c")
    return rows.select("k", "pos", "c.source", "c.comment", "c.perturbation_type")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build_candidates(corpus.pool(spark, sf_dir), PLAN)


@query(f"SELECT k, CAST(pos AS INTEGER) AS pos, source, comment, role_hint FROM {sql.candidates()}")
def candidate_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.exploded(records(spark, sf_dir), ["k"], F.col("candidates"), "pos", "c")
    return rows.select("k", "pos", "c.source", "c.comment", "c.role_hint")


@query(f"SELECT k, CAST(count(*) AS INTEGER) AS num_candidates, CAST(count(*) FILTER (role_hint = 'negative_only') AS INTEGER) AS n_negative, CAST(count(*) FILTER (role_hint = 'model_candidate') AS INTEGER) AS n_model, CAST(count(*) FILTER (source = 'hard_negative_action_reverse') AS INTEGER) AS n_reverse, CAST(count(DISTINCT source) AS INTEGER) AS n_sources FROM {sql.candidates()} GROUP BY k")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda m, key: F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0))
    return records(spark, sf_dir).select("k", "num_candidates", count("role_counts", "negative_only").alias("n_negative"), count("role_counts", "model_candidate").alias("n_model"), count("source_counts", "hard_negative_action_reverse").alias("n_reverse"), F.size("source_counts").alias("n_sources"))


def similarities(flat: bool) -> tuple[Column, Column]:
    c, k = F.col("candidates"), F.col("k")
    if flat:
        return corpus.flat_similarity(c, k, 37, 53), corpus.flat_similarity(c, k, 41, 59)
    return corpus.source_similarity(c, k, 37, 53, (0.9, 0.35, 0.75), False), corpus.source_similarity(c, k, 41, 59, (1.0, 0.3, 0.8), True)


def scored_corpus(spark: SparkSession, sf_dir: str, flat: bool = False, shown: bool = False) -> DataFrame:
    also = (scored.with_judged, pairs.add_displayed) if shown else (scored.with_judged,)
    return scored.score_records(C.build_candidates(corpus.pool(spark, sf_dir), PLAN, also), *similarities(flat))


def _scored_sql(kind: str) -> str:
    ordered = "ORDER BY score DESC, pos"
    return f"""SELECT k, CAST(row_number() OVER (PARTITION BY k {ordered}) - 1 AS INTEGER) AS place, source, round(score, 9) AS score, f_sec, f_style, penalty AS hallucination_penalty,
      first(source) OVER (PARTITION BY k {ordered}) AS best_source, last(source) OVER (PARTITION BY k {ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS worst_source,
      round(max(score) OVER (PARTITION BY k) - min(score) OVER (PARTITION BY k), 9) AS score_range FROM {sql.scored_candidates(kind)}"""


def flat_scores(spark: SparkSession, sf_dir: str, flat: bool) -> DataFrame:
    ends = [F.col("best_candidate.source").alias("best_source"), F.col("worst_candidate.source").alias("worst_source"), F.round("score_range", 9).alias("score_range")]
    rows = T.exploded(scored_corpus(spark, sf_dir, flat), ["k", *ends], F.col("candidates"), "place", "c")
    return rows.select("k", "place", "c.source", F.round("c.score", 9).alias("score"), "c.f_sec", "c.f_style", "c.hallucination_penalty", "best_source", "worst_source", "score_range")


@query(_scored_sql("flat"))
def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_scores(spark, sf_dir, True)


@query(_scored_sql("by_source"))
def scored_records_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_scores(spark, sf_dir, False)


def pool_rows(spark: SparkSession, sf_dir: str, chosen: bool) -> DataFrame:
    held = C.build_candidates(corpus.pool(spark, sf_dir), PLAN, (scored.with_judged, pairs.add_displayed, pairs.add_usable))
    rows = T.exploded(held, ["k", "_usable"], pairs.ranked_pool(F.col("_usable"), *similarities(False), chosen), "at", "x")
    c = F.get("_usable", F.col("x.at"))
    return rows.select("k", (F.col("at") + 1).alias("rank"), c["text"].alias("text"), c["source"].alias("source"), F.round("x.adj", 9).alias("adjusted"))


@query(f"WITH {sql.SELECTION_CTES} SELECT k, CAST(rank AS INTEGER) AS rank, shown AS text, source, round(adj, 9) AS adjusted FROM c")
def chosen_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_rows(spark, sf_dir, True)


@query(f"WITH {sql.SELECTION_CTES} SELECT k, CAST(rank AS INTEGER) AS rank, shown AS text, source, round(adj, 9) AS adjusted FROM r")
def rejected_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_rows(spark, sf_dir, False)


@query(
    f"WITH {sql.SELECTION_CTES} SELECT k || '_pair_' || pair_index AS id, CAST(k AS VARCHAR) AS source_id, chosen, rejected, chosen_source, rejected_source, chosen_role_hint, rejected_role_hint, round(chosen_score, 9) AS chosen_score, round(rejected_score, 9) AS rejected_score, round(margin, 9) AS margin, pair_type, "
    f"md5({sql.q(T.POOL_INSTRUCTION)} || chr(10) || chr(10) || 'Solidity function:' || chr(10) || function || chr(10) || chr(10) || {sql.q(T.PAIRING_TAIL)}) AS prompt_md5 FROM pairs JOIN {sql.POOL} USING (k)"
)
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.build_pairs(scored_corpus(spark, sf_dir, shown=True))
    rounded = [F.round(c, 9).alias(c) for c in ("chosen_score", "rejected_score", "margin")]
    return rows.select("id", "source_id", "chosen", "rejected", "chosen_source", "rejected_source", "chosen_role_hint", "rejected_role_hint", *rounded, "pair_type", F.md5("prompt").alias("prompt_md5"))


def shown_map(m: Column) -> Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query(f"""WITH {sql.SELECTION_CTES},
d AS (SELECT 'pair_type' AS kind, pair_type AS value, count(*) AS n FROM pairs GROUP BY 2 UNION ALL SELECT 'chosen_source', chosen_source, count(*) FROM pairs GROUP BY 2 UNION ALL SELECT 'rejected_source', rejected_source, count(*) FROM pairs GROUP BY 2 UNION ALL SELECT 'rejected_role', rejected_role_hint, count(*) FROM pairs GROUP BY 2)
SELECT (SELECT count(*) FROM orders) AS num_records, (SELECT count(*) FROM pairs) AS num_dpo_pairs, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT k) FROM pairs) AS skipped_records_without_pairs,
  (SELECT round(coalesce(avg(margin), 0), 7) FROM pairs) AS avg_margin, (SELECT round(coalesce(max(margin), 0), 9) FROM pairs) AS max_margin, (SELECT round(coalesce(min(margin), 0), 9) FROM pairs) AS min_margin_actual,
  (SELECT count(*) FILTER (starts_with(chosen_source, 'hard_negative') OR chosen_role_hint = 'negative_only') FROM pairs) AS invalid_chosen_hard_negative, (SELECT count(*) FILTER (rejected_source = 'reference' OR rejected_role_hint = 'positive_anchor') FROM pairs) AS invalid_rejected_reference,
  {", ".join(f"(SELECT string_agg(value || '=' || n, ',' ORDER BY value) FROM d WHERE kind = '{k}') AS {k}_distribution" for k in ("pair_type", "chosen_source", "rejected_source", "rejected_role"))}""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = pairs.pair_summary(corpus.pool(spark, sf_dir), pairs.build_pairs(scored_corpus(spark, sf_dir, shown=True)))
    shown = [shown_map(F.col(f"{k}_distribution")).alias(f"{k}_distribution") for k in ("pair_type", "chosen_source", "rejected_source", "rejected_role")]
    return row.select("num_records", "num_dpo_pairs", "skipped_records_without_pairs", F.round("avg_margin", 7).alias("avg_margin"), F.round("max_margin", 9).alias("max_margin"), F.round("min_margin_actual", 9).alias("min_margin_actual"), "invalid_chosen_hard_negative", "invalid_rejected_reference", *shown)


@query(f"""WITH n AS (SELECT k, source, role_hint, lead(source) OVER w AS after, lead(role_hint) OVER w AS after_role FROM {sql.candidates()} WINDOW w AS (PARTITION BY k ORDER BY pos))
SELECT CAST(count(*) AS BIGINT) AS num_dpo_pairs, count(*) FILTER (starts_with(after, 'hard_negative') OR after_role = 'negative_only') AS invalid_chosen_hard_negative, count(*) FILTER (source = 'reference' OR role_hint = 'positive_anchor') AS invalid_rejected_reference
FROM n WHERE after IS NOT NULL""")
def violated_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate rejected in favour of the next one, which breaks both invariants very often."""
    c = F.col("candidates")
    rows = T.exploded(records(spark, sf_dir), ["k"], F.transform(c, lambda x, i: F.struct(x.alias("r"), F.get(c, i + 1).alias("c"))), "pos", "p").where(F.col("p.c").isNotNull())
    sides = [F.col(f"p.{key}.{field}").alias(f"{name}_{field}") for name, key in (("chosen", "c"), ("rejected", "r")) for field in ("source", "role_hint")]
    made = rows.select(F.concat_ws("_pair_", F.col("k").cast("string"), F.col("pos").cast("string")).alias("id"), *sides, F.lit("any").alias("pair_type"), F.lit(0.0).alias("margin"))
    return pairs.pair_summary(corpus.pool(spark, sf_dir), made).select("num_dpo_pairs", "invalid_chosen_hard_negative", "invalid_rejected_reference")


# --- vectors ----------------------------------------------------------------------------------------------------------

VECTOR_PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({}.embedding, lambda p: p::DOUBLE * p::DOUBLE)))"


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a, b = rows.select("vec_id", F.col("embedding").alias("a")), rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


@query(f"SELECT a.vec_id, round({DOT} / ({NORM.format('a')} * {NORM.format('b')}), 5) AS cosine, round({sql.clamp(DOT)}, 5) AS clamped {VECTOR_PAIRS}")
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf_dir).select("vec_id", F.round(vectors.cosine(a, b), 5).alias("cosine"), F.round(S.clamp(vectors.dot(a, b)), 5).alias("clamped"))


@query(f"SELECT a.vec_id, {DOT} >= 0.5 AS similar {VECTOR_PAIRS}")
def similarity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("vec_id", (vectors.dot(F.col("a"), F.col("b")) >= 0.5).alias("similar"))


@query()
def encode_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir)
    out = vectors.text_similarity(rows, "prompt", "response")
    return out.select("id", F.round("similarity", 5).alias("similarity"), (F.col("similarity") >= 0.5).alias("similar"))


@query()
def generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("Summarise.").alias("instruction"), F.col("text").alias("function"), F.lit("").alias("reference"))
    prompt = T.render_chat(T.chat_messages(F.col("instruction"), F.col("function")))
    return models.predictions(rows, prompt, models.echo_generator, T.prediction_clean_basic, "echo").select("id", "prediction", "model")


# --- training data ----------------------------------------------------------------------------------------------------

TURNS_SQL = "(SELECT conv_id || '_' || turn AS id, conv_id, turn, text AS prompt, next AS response FROM (SELECT *, lead(role) OVER w AS after, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND after = 'assistant')"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it, by joining turns with their successors' numbers."""
    rows = table(spark, sf_dir, "conversations")
    user = rows.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = rows.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(reply, ["conv_id", "turn"]).select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", "prompt", "response")


@query(f"SELECT id, md5('<|im_start|>system' || chr(10) || {sql.q(T.SYSTEM_PROMPT)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5, response FROM {TURNS_SQL}")
def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(turn("system", F.lit(T.SYSTEM_PROMPT)), turn("user", F.col("prompt")))
    return turn_pairs(spark, sf_dir).select("id", F.md5(T.render_chat(messages)).alias("prompt_md5"), "response")


@query(f"SELECT id FROM {TURNS_SQL} WHERE conv_id % 3 <> 0")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir)
    done = rows.where(F.col("conv_id") % 3 == 0)
    return resume.remaining(rows, done).select("id")


@query(f"SELECT id, CASE WHEN conv_id % 4 = 0 THEN -turn - 0.25::DOUBLE ELSE -length(response)::DOUBLE END AS ref_chosen_logp, CASE WHEN conv_id % 4 = 0 THEN -turn - 0.5::DOUBLE ELSE -length(prompt)::DOUBLE END AS ref_rejected_logp FROM {TURNS_SQL}")
def ref_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir)
    cache = rows.where(F.col("conv_id") % 4 == 0).select("id", (-F.col("turn") - 0.25).alias("ref_chosen_logp"), (-F.col("turn") - 0.5).alias("ref_rejected_logp"))
    compute = lambda missing: missing.select("id", (-F.length("response")).cast("double").alias("ref_chosen_logp"), (-F.length("prompt")).cast("double").alias("ref_rejected_logp"))
    filled, _ = resume.fill_cache(rows, cache, compute)
    return filled.select("id", "ref_chosen_logp", "ref_rejected_logp")


@query(f"SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || id), id) <= floor(count(*) OVER () * 0.1::DOUBLE) THEN 'eval' ELSE 'train' END AS part FROM {TURNS_SQL}")
def split_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.split_train_eval(turn_pairs(spark, sf_dir), 0.1).select("id", "part")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded turn pairs in batches of eight conversations, with a word-checksum tokenizer in place of a real one."""
    e = encode.encode_pair(word_numbers(F.col("prompt")), word_numbers(F.col("response")), 96, 48, 80)
    return turn_pairs(spark, sf_dir).select("id", F.floor(F.col("conv_id") / 8).alias("batch_id"), e.alias("encoded"))


def word_numbers(text: Column) -> Column:
    """Word lengths as ids, so that SQL can make the same ones."""
    return F.transform(T.words(text), lambda w: (F.length(w) + 10).cast("int"))


ENCODED_SQL = f"""
(SELECT id, conv_id // 8 AS batch_id, p2 || r2 AS input_ids, list_transform(p2, lambda x: -100) || r2 AS labels FROM (
  SELECT *, CASE WHEN len(p) + len(r) <= 96 THEN p WHEN len(r) >= 96 THEN p[1:0] ELSE p[greatest(len(p) - (96 - len(r)), 0) + 1:] END AS p2, r[1:96] AS r2 FROM (
    SELECT id, conv_id, list_transform({sql.words('prompt')}, lambda w: length(w) + 10)[1:80] AS p, (list_transform({sql.words('response')}, lambda w: length(w) + 10) || [2])[1:48] AS r FROM {TURNS_SQL})))
"""


@query(f"SELECT id, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, CAST(len(input_ids) AS INTEGER) AS n FROM {ENCODED_SQL}")
def encode_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("encoded")
    text = lambda xs: F.array_join(xs.cast("array<string>"), ",")
    return encoded(spark, sf_dir).select("id", text(e["input_ids"]).alias("input_ids"), text(e["labels"]).alias("labels"), F.size(e["attention_mask"]).alias("n"))


@query(f"""WITH e AS (SELECT *, len(input_ids) AS n, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS BIGINT) AS width FROM {ENCODED_SQL})
SELECT id, batch_id, CAST(width AS INTEGER) AS width, array_to_string(list_resize(input_ids, width, 0), ',') AS input_ids, array_to_string(list_resize(labels, width, -100), ',') AS labels, CAST(n AS BIGINT) AS attended FROM e""")
def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("encoded")
    text = lambda xs: F.array_join(xs.cast("array<string>"), ",")
    rows = encode.pad_batches(encoded(spark, sf_dir))
    return rows.select("id", "batch_id", F.size(e["input_ids"]).alias("width"), text(e["input_ids"]).alias("input_ids"), text(e["labels"]).alias("labels"), F.aggregate(e["attention_mask"], F.lit(0).cast("long"), lambda s, x: s + x).alias("attended"))


# --- loss and metrics -------------------------------------------------------------------------------------------------

LOGPS = {"policy_chosen_logp": (7, 300, -0.5), "policy_rejected_logp": (11, 310, -0.75), "ref_chosen_logp": (13, 290, -0.25), "ref_rejected_logp": (17, 320, -1.0)}
LOGPS_SQL = "(SELECT o_orderkey AS k, " + ", ".join(f"-((o_orderkey * {a}) % {m}) / 4::DOUBLE + {c}::DOUBLE AS {n}" for n, (a, m, c) in LOGPS.items()) + " FROM orders)"
SOFT = "CASE WHEN x >= 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END"
TERMS_SQL = f"""(SELECT *, dpo_loss + 0.1::DOUBLE * sft_loss AS loss FROM (SELECT k, {SOFT} AS dpo_loss, -policy_chosen_logp AS sft_loss, rc AS chosen_reward, rr AS rejected_reward, CASE WHEN rc > rr THEN 1::DOUBLE ELSE 0::DOUBLE END AS reward_acc, rc - rr AS reward_margin
  FROM (SELECT *, 0.03::DOUBLE * ((policy_chosen_logp - policy_rejected_logp) - (ref_chosen_logp - ref_rejected_logp)) AS x, 0.03::DOUBLE * (policy_chosen_logp - ref_chosen_logp) AS rc, 0.03::DOUBLE * (policy_rejected_logp - ref_rejected_logp) AS rr FROM {LOGPS_SQL})))"""


def loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    logps = [(-((k * a) % m) / 4.0 + c).alias(n) for n, (a, m, c) in LOGPS.items()]
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), *logps)
    return rows.select("k", *[c.alias(n) for n, c in preference.dpo_terms(0.03, 0.1).items()])


@query(f"SELECT k, round(dpo_loss, 7) AS dpo_loss, round(loss, 7) AS loss, round(chosen_reward, 7) AS chosen_reward, round(rejected_reward, 7) AS rejected_reward, reward_acc FROM {TERMS_SQL}")
def dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 7).alias(c) for c in ("dpo_loss", "loss", "chosen_reward", "rejected_reward")]
    return loss_terms(spark, sf_dir).select("k", *rounded, "reward_acc")


#: Orders go into micro-batches of four by key; 300 micro-batches are an epoch.
BATCHES_SQL = f"(SELECT (k // 4) // 300 AS epoch, (k // 4) % 300 AS batch, count(*) AS n, {', '.join(f'sum(CAST({m} AS DECIMAL(38, 12))) AS {m}' for m in preference.METRICS)} FROM {TERMS_SQL} GROUP BY 1, 2)"


def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor(F.col("k") / 4)
    keyed = loss_terms(spark, sf_dir).withColumns({"epoch": F.floor(number / 300), "batch": number % 300})
    return preference.batch_metrics(keyed, "epoch", "batch")


def means_sql(prefix: str) -> str:
    return ", ".join(f"round(CAST(sum({m}) AS DOUBLE) / sum(n), 10) AS {prefix}_{m}" for m in preference.METRICS)


@query(f"SELECT {means_sql('eval')} FROM {BATCHES_SQL}")
def dpo_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.eval_metrics(micro_batches(spark, sf_dir)).select(*[F.round(f"eval_{m}", 10).alias(f"eval_{m}") for m in preference.METRICS])


LOG_SQL = f"SELECT CAST(ceil((epoch * 37 + batch // 8 + 1) / 10.0) * 10 AS BIGINT) AS step, epoch + 1 AS epoch, {means_sql('train')} FROM {BATCHES_SQL} WHERE ceil((epoch * 37 + batch // 8 + 1) / 10.0) * 10 <= (epoch + 1) * 37 GROUP BY 1, 2"


@query(LOG_SQL)
def train_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.train_log(micro_batches(spark, sf_dir), 10, 300, 8)
    return rows.select("step", "epoch", *[F.round(f"train_{m}", 10).alias(f"train_{m}") for m in preference.METRICS])


@query(f"SELECT step, train_loss AS eval_loss, coalesce(train_loss < min(train_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM ({LOG_SQL})")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = train_log_windows(spark, sf_dir).select("step", F.col("train_loss").alias("eval_loss"))
    return preference.best_checkpoints(evals).select("step", "eval_loss", "is_best")


RATE = (2e-5, 20, 400)


@query(f"SELECT k AS step, round({RATE[0]}::DOUBLE * CASE WHEN k < {RATE[1]} THEN k / {RATE[1]}::DOUBLE ELSE greatest(0, 0.5::DOUBLE * (1 + cos(pi() * (k - {RATE[1]}) / {RATE[2] - RATE[1]}))) END, 12) AS learning_rate FROM (SELECT DISTINCT o_orderkey % 420 AS k FROM orders)")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 420).alias("step")).distinct()
    return steps.select("step", F.round(preference.learning_rate(F.col("step"), *RATE), 12).alias("learning_rate"))


@query("SELECT k, round(list_sum([x for x in p if x % 3 <> 0]) / 8::DOUBLE, 7) AS total, round(list_sum([x for x in p if x % 3 <> 0]) / 8::DOUBLE / len([x for x in p if x % 3 <> 0]), 7) AS mean FROM (SELECT o_orderkey AS k, [-((o_orderkey * i) % 40) * 3 - i for i in range(1, 8)] AS p FROM orders)")
def sequence_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = F.array(*[(-((k * i) % 40) * 3 - i).cast("int") for i in range(1, 8)])
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.transform(values, lambda x: x / 8.0).alias("p"), F.transform(values, lambda x: F.when(x % 3 == 0, -100).otherwise(1)).alias("y"))
    return rows.select("k", F.round(preference.sequence_logp(F.col("p"), F.col("y")), 7).alias("total"), F.round(preference.sequence_logp(F.col("p"), F.col("y"), True), 7).alias("mean"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST((a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) / 2 AS FLOAT)::DOUBLE * i)), 4) AS weighed FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token vectors and one that the mask leaves out, summed up with weights by place."""
    tokens = F.array("a", F.transform("a", lambda x: x * 100), "b")
    pooled = vectors.mean_pool(tokens, F.array(F.lit(1), F.lit(0), F.lit(1)))
    total = F.aggregate(F.transform(pooled, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return neighbours(spark, sf_dir).select("vec_id", F.round(total, 4).alias("weighed"))


# --- text metrics -----------------------------------------------------------------------------------------------------

#: Each model output of stage 0 against the reference of its function.
METRIC_SQL = f"(SELECT k AS id, {sql.words(sql.folded(sql.output_sql(0)))} AS h, {sql.words(sql.folded('reference'))} AS r FROM {sql.POOL})"


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pool(spark, sf_dir).select(F.col("k").alias("id"), corpus.model_output(F.col("k"), 0).alias("hypothesis"), "reference")


def grams_sql(side: str) -> str:
    return " UNION ALL ".join(f"SELECT id, {n} AS n, unnest(list_transform(range(1, greatest(len({side}) - {n - 1}, 0) + 1), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g FROM m" for n in (1, 2, 3, 4))


GRAMS_CTES = f"m AS MATERIALIZED {METRIC_SQL}, gh AS (SELECT id, n, g, count(*) AS c FROM ({grams_sql('h')}) GROUP BY 1, 2, 3), gr AS (SELECT id, n, g, count(*) AS c FROM ({grams_sql('r')}) GROUP BY 1, 2, 3)"


@query(f"""WITH {GRAMS_CTES},
len AS (SELECT sum(len(h)) AS h, sum(len(r)) AS r FROM m),
t AS (SELECT n, sum(c) AS total FROM gh GROUP BY 1), x AS (SELECT n, sum(least(gh.c, gr.c)) AS matched FROM gh JOIN gr USING (id, n, g) GROUP BY 1),
p AS (SELECT n, ln(matched / total) AS lp FROM t JOIN x USING (n)),
bp AS (SELECT CASE WHEN h >= r THEN 1::DOUBLE ELSE exp(1 - r / h) END AS b FROM len)
SELECT {", ".join(f"round((SELECT b FROM bp) * exp((SELECT avg(lp) FROM p WHERE n <= {n})), 7) AS bleu_{n}" for n in (1, 2, 3, 4))}""")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.bleu(metric_rows(spark, sf_dir)).select(*[F.round(f"bleu_{n}", 7).alias(f"bleu_{n}") for n in (1, 2, 3, 4)])


@query(f"""WITH RECURSIVE m AS MATERIALIZED {METRIC_SQL}, f(id, h, r, k, row) AS (
  SELECT id, h, r, 0, list_transform(range(0, len(r) + 1), lambda i: 0) FROM m UNION ALL
  SELECT id, h, r, k + 1, list_reduce(range(1, len(r) + 1), lambda done, j: list_append(done, greatest(row[j + 1], done[j], CASE WHEN r[j] = h[k + 1] THEN row[j] + 1 ELSE 0 END)), [0::BIGINT]) FROM f WHERE k < len(h)),
c AS (SELECT id, list_last(row) AS lcs, list_last(row) / len(h) AS p, list_last(row) / len(r) AS q FROM f WHERE k = len(h))
SELECT id, CAST(lcs AS BIGINT) AS lcs, round(CASE WHEN lcs > 0 THEN (1 + 1.44::DOUBLE) * q * p / (q + 1.44::DOUBLE * p) ELSE 0 END, 7) AS rouge_l FROM c""")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.rouge_l(metric_rows(spark, sf_dir)).select("id", "lcs", F.round("rouge_l", 7).alias("rouge_l"))


@query(f"""WITH {GRAMS_CTES}, x AS (SELECT id, sum(least(gh.c, gr.c)) AS c FROM gh JOIN gr USING (id, n, g) WHERE n = 1 GROUP BY 1)
SELECT id, round(coalesce(10 * (c / len(h)) * (c / len(r)) / (c / len(r) + 9 * (c / len(h))), 0), 7) AS meteor_exact FROM m LEFT JOIN x USING (id)""")
def meteor_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.exact_meteor(metric_rows(spark, sf_dir)).select("id", F.round("meteor_exact", 7).alias("meteor_exact"))


@query(f"""WITH {GRAMS_CTES}, df AS (SELECT n, g, count(*) AS df FROM gr GROUP BY 1, 2), tf AS (SELECT id, n, g, coalesce(gh.c, 0) AS h, coalesce(gr.c, 0) AS r FROM gh FULL JOIN gr USING (id, n, g)),
w AS (SELECT tf.*, ln((SELECT count(*) FROM m) / greatest(coalesce(df, 0), 1)) AS idf FROM tf LEFT JOIN df USING (n, g)),
s AS (SELECT id, n, sum(h * r * idf * idf) AS hr, sqrt(sum(h * h * idf * idf)) AS hh, sqrt(sum(r * r * idf * idf)) AS rr FROM w GROUP BY 1, 2),
c AS (SELECT id, 10 * sum(CASE WHEN hh * rr = 0 THEN 0 ELSE hr / (hh * rr) END) / 4 AS cider FROM s GROUP BY 1)
SELECT id, round(coalesce(cider, 0), 6) AS cider FROM m LEFT JOIN c USING (id)""")
def cider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.cider(metric_rows(spark, sf_dir)).select("id", F.round("cider", 6).alias("cider"))


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in REGISTERED.items() if text}
