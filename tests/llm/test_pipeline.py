import hashlib
import importlib.util
import pathlib

import corpus_pipeline
import pytest
from quillmark.llm import pii, quality_rules
from quillmark.llm.bpe import ByteBPE
from quillmark.llm.queries import tokenizer_path

HERE = pathlib.Path(__file__).parent


def other(name):
    """A test module beside this one, for its brute-force versions."""
    spec = importlib.util.spec_from_file_location(f"brute_{name}", HERE / f"test_{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output over a small corpus with planted cases."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    passage = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    clean = docs.where("n_chars between 600 and 3000").orderBy("doc_id").limit(3).collect()
    rows = [tuple(r) for r in docs.collect()]
    rows += [(9000 + k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(clean)]
    rows += [(9100, clean[0].text.replace(" ", "  ") + "\n", "en", "x", 1), (9101, " ".join([passage] * 4), "en", "x", 1), (9102, clean[1].text + " Mail me at some.one@mail.example.org now.", "en", "x", 1), (None, None, None, None, None), (9103, "", "en", "x", 0)]
    rows += [(9104, " ".join(r.text for r in docs.where("n_chars between 2000 and 3000").orderBy("doc_id").limit(40).collect()) + " " + " ".join(passage.split()[:13]), "en", "x", 1)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, now, str(folder)).write.parquet(f"{folder}/{name}")
        fresh = spark.read.parquet(f"{folder}/{name}")
        out.append((now.collect(), fresh.collect(), fresh.columns))
        now = fresh
    return str(folder), out


def test_columns(stages):
    _, out = stages
    assert all(columns == list(corpus_pipeline.DOCUMENT) for _, _, columns in out[:-1])


def test_quality(spark, stages):
    brute = other("quality")
    before, after, _ = stages[1][0]
    judged = quality_rules.quality_rules(spark.createDataFrame(before)).collect()
    from collections import Counter

    prior, good, bad = brute.em(sorted(Counter(tuple(r.votes) for r in judged).items()), len(quality_rules.RULES))
    import math

    def keep(r):
        z = math.log(prior / (1 - prior)) + sum(math.log(good[j] / (1 - bad[j])) if v == 1 else math.log((1 - good[j]) / bad[j]) if v == -1 else 0 for j, v in enumerate(r.votes))
        return not brute.base(r.text)[-1] and 1 / (1 + math.exp(-z)) >= 0.5

    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in judged if keep(r))


def test_one_of_each_group(stages):
    brute = other("similar")
    before, after, _ = stages[1][1]
    want = brute.brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(doc for doc, component in want if doc == component)
    assert not {9000, 9001, 9002, 9100} & {r.doc_id for r in after}


def test_decontamination(spark, stages):
    brute = other("decontaminate")
    before, after, _ = stages[1][2]
    items = [tuple(r) for r in spark.read.parquet(f"{stages[0]}/benchmark.parquet").collect()]
    want = brute.brute([(r.doc_id, r.text) for r in before], items, 13)
    assert sorted(r.doc_id for r in after) == sorted(doc for doc, found in want.items() if not found[0][1])
    assert 9104 in {r.doc_id for r in before} and not {9101, 9104} & {r.doc_id for r in after}
    assert not want[9104][0][3]  # a passage in a long document is under a twentieth of it


def test_personal_data(stages):
    brute = other("pii")
    before, after, _ = stages[1][3]
    text = {r.doc_id: r.text for r in after}
    assert set(text) == {r.doc_id for r in before}
    for r in before:
        found = brute.base(r.text)
        assert found or "[EMAIL]" not in text[r.doc_id]
        for kind, a, b in found:
            if kind == "email":
                assert r.text[a:b] not in text[r.doc_id]
        if not found and "[" not in text[r.doc_id]:
            assert text[r.doc_id] == r.text
    assert pii.BASE == ("email", "ip", "card", "phone")


def test_encoding(stages):
    with open(tokenizer_path(), "rb") as f:
        bpe = ByteBPE(f.read())
    before, after, _ = stages[1][4]
    got = {r.doc_id: r for r in after}
    for r in before:
        ids = bpe.library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].ids == ids and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, stages[0]).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages[1][4][1])
