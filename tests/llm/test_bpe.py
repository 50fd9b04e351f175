import random

import pytest
from quillmark.llm.bpe import ByteBPE, decode_ids, encode_texts, round_trip
from quillmark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def small():
    with open(tokenizer_path(), "rb") as f:
        return ByteBPE(f.read(), leaf=48)


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 3000, "!" * 2000, " " * 1500, "\n" * 999 + "x", "漢字" * 700, "'s" * 400, "it're" * 50, "0123456789" * 100]
    alphabets = ["abcdefgh", "ab1 !'s,  \n.é漢", "the of\t'", "<|endoftx>"]
    for k in range(200):
        out.append("".join(rng.choice(alphabets[k % 4]) for _ in range(rng.randint(1, 900))))
    return out


def test_exact_against_the_library(small):
    for t in texts():
        want = small.library.encode(t, add_special_tokens=False).ids
        assert small.encode(t).tolist() == want, t[:60]
        assert small.decode(want) == small.library.decode(want, skip_special_tokens=False) == t


def test_join_grows_until_both_sides_agree(small):
    rng = random.Random(9)
    for _ in range(300):
        word = bytes(rng.choice(b"abetionsh") for _ in range(rng.randint(2, 120)))
        cut = rng.randint(1, len(word) - 1)
        one = small.engine._encode_single_piece
        assert small.join(one(word[:cut]), one(word[cut:]), width=1) == one(word)


def test_frame_round_trip(spark):
    rows = list(enumerate(texts()[:40])) + [(1000, None), (0, "")]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, IDS string")
    coded = decode_ids(encode_texts(frame, tokenizer_path(), leaf=64), tokenizer_path())
    got = sorted((r.doc_id, r.decoded, r.n_tokens == len(r.ids)) for r in coded.collect())
    assert got == sorted((i, t or "", True) for i, t in rows)
    both = round_trip(frame, tokenizer_path(), leaf=64)
    assert both.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and sorted(map(str, both.collect())) == sorted(map(str, coded.collect()))
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0
