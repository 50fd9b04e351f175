import math

from pyspark.sql import functions as F
from quillmark.operators import encode, preference, resume, text_metrics, vectors
from quillmark.plans import catalog, commands
from quillmark.sources import jsonl, tables
from quillmark.streaming.incremental import stream_candidates


def test_encoding_and_padding(spark):
    rows = [(1, 3, 2), (2, 10, 2), (3, 5, 9), (4, 0, 0), (5, 6, 1)]
    frame = spark.createDataFrame([(i, list(range(10, 10 + p)), list(range(50, 50 + r))) for i, p, r in rows], "id int, p array<int>, r array<int>")
    e = frame.withColumn("encoded", encode.encode_pair(frame.p, frame.r, 8, 20, None, 2)).withColumn("batch_id", F.lit(0))
    got = {r.id: r.encoded for r in e.collect()}
    assert got[1].input_ids == [10, 11, 12, 50, 51, 2] and got[1].labels == [-100] * 3 + [50, 51, 2]
    assert got[2].input_ids == [15, 16, 17, 18, 19, 50, 51, 2]
    assert got[3].input_ids == list(range(50, 58)) and got[3].labels == got[3].input_ids
    assert got[4].input_ids == [2]
    wide = {r.id: r.encoded for r in encode.pad_batches(e).collect()}
    assert {len(x.input_ids) for x in wide.values()} == {8} and wide[1].attention_mask == [1] * 6 + [0] * 2 and wide[1].labels[-2:] == [-100, -100]


def test_split(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("id"))
    for ratio, n in ((0.0, 0), (0.001, 0), (0.25, 25), (1.0, 100)):
        parts = [r.part for r in resume.split_train_eval(frame, ratio).collect()]
        assert parts.count("eval") == n and len(parts) == 100
    one = {r.id for r in resume.split_train_eval(frame, 0.2).where("part = 'eval'").collect()}
    two = {r.id for r in resume.split_train_eval(frame.repartition(7), 0.2).where("part = 'eval'").collect()}
    assert one == two


def test_loss_is_stable(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (-1.0, -9000.0, 0.0, 0.0), (-9000.0, -1.0, 0.0, 0.0)], "policy_chosen_logp double, policy_rejected_logp double, ref_chosen_logp double, ref_rejected_logp double")
    rows = frame.select(*[c.alias(k) for k, c in preference.dpo_terms(0.1).items()]).collect()
    assert math.isclose(rows[0].dpo_loss, math.log(2)) and rows[0].reward_acc == 0.0
    assert rows[1].dpo_loss < 1e-9 and math.isclose(rows[2].dpo_loss, 899.9)
    logps = spark.createDataFrame([([-1.0, -2.0, -4.0], [-100, 5, 6]), ([-1.0], [-100])], "p array<double>, y array<int>")
    assert [r.x for r in logps.select(preference.sequence_logp(F.col("p"), F.col("y"), True).alias("x")).collect()] == [-3.0, 0.0]


def loop(epochs, per_epoch, accumulation, logging):
    """The training loop's counters, one micro-batch after another."""
    rows, step = [], 0
    for e in range(epochs):
        held = []
        for b in range(per_epoch):
            held.append(e * per_epoch + b)
            if (b + 1) % accumulation == 0:
                step += 1
                if step % logging == 0:
                    rows.append((step, e + 1, sum(held) / len(held)))
                    held = []
    return rows


def test_log_windows(spark):
    for epochs, per_epoch, accumulation, logging in ((3, 10, 4, 2), (2, 7, 2, 3), (1, 5, 8, 1), (4, 9, 3, 2)):
        frame = spark.range(epochs * per_epoch).select(F.floor(F.col("id") / per_epoch).alias("epoch"), (F.col("id") % per_epoch).alias("batch"), F.lit(2).alias("n"), *[F.col("id").cast("double").alias(m) for m in preference.METRICS])
        got = sorted((r.step, r.epoch, r.train_loss) for r in preference.train_log(frame, logging, per_epoch, accumulation).collect())
        assert got == loop(epochs, per_epoch, accumulation, logging)
    assert preference.total_steps(10, 4, 2.5, 0.1) == (3, 7, 0)
    assert preference.eval_metrics(spark.createDataFrame([], "n int, " + ", ".join(f"{m} double" for m in preference.METRICS))).first().eval_loss == 0.0


def test_cache(spark):
    pairs = spark.createDataFrame([("a",), ("b",)], "id string")
    cache = spark.createDataFrame([("a", -1.0, -2.0)], "id string, ref_chosen_logp double, ref_rejected_logp double")
    filled, merged = resume.fill_cache(pairs, cache, lambda m: m.select("id", F.lit(-5.0).alias("ref_chosen_logp"), F.lit(-6.0).alias("ref_rejected_logp")))
    assert sorted(map(tuple, filled.collect())) == [("a", -1.0, -2.0), ("b", -5.0, -6.0)] and merged.count() == 2


def test_jsonl_sources(spark, tmp_path):
    path = tmp_path / "pool.jsonl"
    lines = ['{"instruction": "i", "input": "f", "output": "o"}', "", "{bad", "[1]", '{"instruction": "i", "input": "f2", "output": "o2", "function": "no", "reference": "no"}', '{"id": null, "instruction": null, "function": " ", "reference": "r", "token_seq": " t ", "source_file": "s.sol"}', '{"prompt": "p", "reference": "r", "token_seq": "t"}', '{"instruction": "i", "input": " ", "output": "o"}']
    path.write_bytes("\n".join(lines).encode() + b'\n{"instruction": "\xff", "input": "g", "output": "h"}\n')
    got = {r.line_no: r for r in jsonl.pool_samples(jsonl.read_lines(spark, str(path))).collect()}
    assert sorted(got) == [1, 5, 6, 7, 9]
    assert got[1].id == "dpo_pool_1" and got[5].function == "f2" and got[9].instruction == "�"
    assert (got[6].id, got[6].instruction, got[6].function, got[6].source_file) == ("None", "None", "t", "s.sol")
    assert got[7].instruction.startswith("Generate a concise")
    assert [r.id for r in jsonl.sft_samples(jsonl.read_lines(spark, str(path))).orderBy("line_no").collect()] == ["sample_1", "sample_5", "sample_9"]
    assert jsonl.prediction_samples(jsonl.read_lines(spark, str(path))).count() == 4


def test_csv_and_parallel_text(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes('comment,comment1\n"caf\xe9, x",caf\xe9\n'.encode("latin-1"))
    row = tables.read_headed_csv(spark, str(tmp_path / "h.csv")).first()
    assert (row.comment, row.comment1) == ("caf\xe9, x", "caf\xe9")
    (tmp_path / "p.csv").write_text('"function f() {\n}",does it\n')
    out = commands.evaluate_table(spark, str(tmp_path / "p.csv"), str(tmp_path / "out"), headed=False)
    assert out.first().method.endswith("}") and (tmp_path / "out").exists()
    (tmp_path / "a").write_text("x\n\nz\n")
    (tmp_path / "b").write_text("1\n2\n3\n")
    assert sorted(map(tuple, tables.read_parallel_text(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect())) == [(1, "x", "1"), (2, "", "2"), (3, "z", "3")]


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "a array<float>, b array<float>, t array<array<float>>, m array<int>")
    row = frame.select(vectors.cosine(frame.a, frame.b).alias("c"), vectors.normalize(frame.a).alias("n"), vectors.mean_pool(frame.t, frame.m).alias("p")).first()
    assert math.isclose(row.c, 0.96) and [round(x, 6) for x in row.n] == [0.6, 0.8] and row.p == [2.0, 3.0]
    texts = spark.createDataFrame([("a b", "a b"), ("a b", "c d"), (None, "x")], "comment string, comment1 string")
    assert sorted(round(r.similarity, 5) for r in vectors.summary_similarity(texts).collect())[-1] == 1.0


def test_metrics_of_equal_texts(spark):
    rows = spark.createDataFrame([(1, "The cat sat on the mat today", "the cat sat on the mat today"), (2, "a b c d e", "a b c d e")], "id int, hypothesis string, reference string")
    assert all(math.isclose(x, 1.0) for x in text_metrics.bleu(rows).first())
    assert [r.rouge_l for r in text_metrics.rouge_l(rows).collect()] == [1.0, 1.0]
    assert all(math.isclose(r.cider, 10.0) for r in text_metrics.cider(rows).collect())
    blank = spark.createDataFrame([(1, "", "a b"), (2, "x", "")], "id int, hypothesis string, reference string")
    assert list(text_metrics.bleu(blank).first()) == [0.0] * 4 and {r.rouge_l for r in text_metrics.rouge_l(blank).collect()} == {0.0}


def test_steps_over_files(spark, tmp_path):
    pool, out = str(tmp_path / "pool.jsonl"), lambda n: str(tmp_path / n)
    with open(pool, "w") as f:
        for i in range(6):
            f.write(f'{{"id": "s{i}", "instruction": "do", "function": "function f{i}() onlyOwner {{ require(x); }}", "reference": "Only the owner can update the stored total of {i}."}}\n')
    made = commands.make_candidates(spark, commands.Candidates(pool, out("c.jsonl"), resume=True, max_samples=4))
    assert made.count() == 4
    made = commands.make_candidates(spark, commands.Candidates(pool, out("c.jsonl"), resume=True))
    assert made.count() == 6
    scored = commands.score(spark, commands.Scores(out("c.jsonl"), out("s.jsonl")))
    assert scored.count() == 6 and (tmp_path / "s.summary.json").exists()
    commands.make_pairs(spark, commands.Pairs(out("s.jsonl"), out("p.jsonl")))
    assert (tmp_path / "p.summary.json").exists()
    stream = stream_candidates(spark, f"{tmp_path}/pool*.jsonl", out("stream"), out("state"))
    stream.awaitTermination()
    assert spark.read.json(out("stream")).count() == 6
    with open(str(tmp_path / "pool2.jsonl"), "w") as f:
        f.write('{"id": "s1", "instruction": "do", "function": "f", "reference": "Again the same sample here."}\n{"id": "new", "instruction": "do", "function": "f", "reference": "A new sample is here."}\n')
    stream_candidates(spark, f"{tmp_path}/pool*.jsonl", out("stream"), out("state")).awaitTermination()
    assert sorted(r.id for r in spark.read.json(out("stream")).select("id").collect()) == ["new"] + [f"s{i}" for i in range(6)]


def test_training_data(spark, tmp_path):
    path = tmp_path / "pairs.jsonl"
    path.write_text("".join(f'{{"id": "p{i}", "prompt": "do {i}", "chosen": "good", "rejected": "bad"}}\n' for i in range(10)))
    logps = lambda m: m.select("id", F.lit(-1.0).alias("ref_chosen_logp"), F.lit(-2.0).alias("ref_rejected_logp"))
    for _ in range(2):
        rows = commands.training_data(spark, commands.Training(str(path), str(tmp_path / "cache")), logps).collect()
        assert len(rows) == 10 and sum(r.part == "eval" for r in rows) == 1 and rows[0].ref_rejected_logp == -2.0


def test_every_query_runs_and_rules_occur(spark, data):
    for name, f in catalog.queries().items():
        assert f(spark, data).limit(5).count() >= 0, name
    facts = {x for r in catalog.extract_facts(spark, data).collect() for x in r.facts.split(",")}
    flags = {x for r in catalog.hallucination_flags(spark, data).collect() for x in r.flags.split(",")}
    kinds = {r.pair_type.rstrip("12345") for r in catalog.dpo_pairs(spark, data).collect()}
    assert len(facts - {""}) == 8 and len(flags - {""}) == 10
    assert {"top_vs_hard_negative", "top_vs_low_model_"} <= kinds


def test_lines_with_equal_checksums_stay_apart(spark, tmp_path):
    import zlib

    seen, k = {}, 0
    while True:
        line = '{"instruction": "do", "function": "f%d() {}", "reference": "Does it."}' % k
        if (c := zlib.crc32(line.encode())) in seen:
            break
        seen[c], k = line, k + 1
    (tmp_path / "pool").mkdir()
    (tmp_path / "pool" / "a.jsonl").write_text(seen[c] + "\n" + line + "\n")
    stream_candidates(spark, f"{tmp_path}/pool", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(f"longer line {k}" for k in range(5000)))
    got = {r.line_no: r.value for r in jsonl.read_lines(spark, f"{tmp_path}/in").collect()}
    assert got == {1: "one", **{k + 2: f"longer line {k}" for k in range(5000)}}


def test_split_and_evaluation_steps(spark, tmp_path):
    (tmp_path / "pairs.jsonl").write_text("".join('{"id": "p%d", "prompt": "q", "chosen": "a", "rejected": "b"}\n' % k for k in range(20)))
    out = f"{tmp_path}/split"
    commands.main(["split", "--pairs", f"{tmp_path}/pairs.jsonl", "--output", out, "--eval-ratio", "0.25"])
    assert spark.read.json(out).where("part = 'eval'").count() == 5
    told = spark.read.json(f"{out}.summary.json").first()
    assert (told.num_pairs, told.num_train, told.num_eval, told.settings.seed) == (20, 15, 5, 42)
    (tmp_path / "plain.csv").write_text("add a,add a\nsend,mint\n")
    commands.main(["evaluate", "--source", f"{tmp_path}/plain.csv", "--output", f"{tmp_path}/scored", "--no-headed"])
    assert sorted(round(float(r._c2), 3) for r in spark.read.csv(f"{tmp_path}/scored").collect())[-1] == 1.0
