import pytest
from quillmark.functions import scoring as S
from quillmark.functions import text as T


def run(spark, function, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in frame.select("i", function(frame.t).alias("x")).orderBy("i").collect()]


def test_normalizing(spark):
    assert run(spark, T.folded, [None, "", "  A \tB\n ", "　x\x1cY "]) == ["", "", "a b", "x y"]
    once = run(spark, T.folded, ["  A  b "])
    assert run(spark, T.folded, once) == once


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""),
        ("/** @dev Moves tokens. */", "Moves tokens."),
        ("  * @notice  Says it @param x y", "Says it"),
        ("@Dev @NOTICE a b  @Returns z", "a b"),
        ("```solidity\ncode\n```", "code"),
        ("// a // b", "a b"),
        ("@dev @dev twice", "@dev twice"),
        ("mail@return.x stays", "mail@return.x stays"),
    ],
)
def test_display_clean(spark, raw, want):
    assert run(spark, T.display_clean, [raw]) == [want]


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""),
        ("Comment: Output: Moves.", "Moves."),
        ("Output: Comment: Moves.", "Comment: Moves."),
        ("assistant\nHello there", "Hello there"),
        ("```\nFirst line\nsecond", "First line"),
        ('"Quoted text."', "Quoted text."),
        ("'mixed\"", "'mixed\""),
        ('"', '"'),
        ("Wow! Then. More", "Wow! Then."),
        ("Is it? No! x", "Is it?"),
        ("/** @dev Moves  all. Then ends. */", "Moves all."),
        ("a\n\nb", "a"),
        ("Does it @param x", "Does it"),
    ],
)
def test_prediction_clean(spark, raw, want):
    assert run(spark, T.prediction_clean, [raw]) == [want]


def test_basic_clean_differs(spark):
    assert run(spark, T.prediction_clean_basic, ["Output: x", "```\ny", '```"q"', "Comment: a  b. c"]) == ["Output: x", "", "q", "a  b. c"]


def test_words_and_terms(spark):
    assert run(spark, T.word_count, ["", " ", "a", " a  b c "]) == [0, 0, 1, 3]
    f = lambda t: T.without_terms(t, ("owner", "only"), "Generic.")
    assert run(spark, f, ["Only the OWNER can update it", "only owner may", "ownership stays the same"]) == ["the can update it", "Generic.", "ownership stays the same"]


def test_validity(spark):
    words = lambda n: " ".join(f"word{i}" for i in range(n))
    cases = {words(2): False, words(3): True, words(40): True, words(41): False, "see http://x.y now": False, "La función hace todo": False, "123 456 789": False, "a b c d a b c d": False, "It will return the value": False, "Returns the balance now.": True, "Executes the function...": False, "Here is what it does": False, None: False}
    assert run(spark, S.is_valid_comment, list(cases)) == list(cases.values())


def test_letter_share(spark):
    ok, low = "a" * 95 + "é" * 5, "a" * 94 + "é" * 6
    assert run(spark, S.probably_english, [ok, low, "İK", ""]) == [True, False, True, False]


def test_length_penalty(spark):
    sizes = {0: 0.03, 4: 0.03, 5: 0.0, 15: 0.0, 16: 0.05, 25: 0.05, 26: 0.10, 40: 0.10, 41: 0.20}
    assert run(spark, S.length_penalty, [" ".join(["w"] * n) for n in sizes]) == list(sizes.values())


def style(comment):
    """The deductions one after another, as plain arithmetic."""
    text = " ".join((comment or "").split())
    if not text:
        return 0.0, ["empty"]
    n, s, flags = len(text.split()), 1.0, []
    for holds, less, flag in ((n < 5, 0.35, "too_short"), (5 <= n < 8, 0.15, "slightly_short"), (n > 40, 0.35, "too_long"), (35 < n <= 40, 0.15, "slightly_long"), (sum(text.count(c) for c in ".!?") > 2, 0.20, "multi_sentence"), ("{" in text, 0.30, "contains_code_or_markdown"), ("here is" in text.lower(), 0.25, "template_phrase"), (text[-1] not in ".!?", 0.05, "no_sentence_end")):
        if holds:
            s -= less
            flags.append(flag)
    return max(0.0, min(1.0, s)), flags


def test_style(spark):
    cases = [None, "", "One.", "One two three four five six.", "{ a. b. c. } Here is", " ".join(["w"] * 36), " ".join(["w"] * 41) + " x!"]
    got = run(spark, S.style, cases)
    assert [(r.f_style, r.style_flags) for r in got] == [style(c) for c in cases]


def test_coverage_and_flags(spark):
    code = "function f() public { require(x); unchecked { y; } }"
    frame = spark.createDataFrame([(code, "Checks the overflow safe sum"), ("", "Only the owner can act"), ("onlyOwner", "Only the owner can act"), ("", "")], "f string, c string")
    facts = S.coverage_facts(frame.f)
    rows = frame.select(facts.alias("facts"), S.covered_facts(facts, frame.c).alias("cov"), S.coverage(facts, S.covered_facts(facts, frame.c)).alias("f_sec"), S.claim_flags(S.claim_evidence(frame.f), frame.c).alias("flags")).collect()
    assert rows[0].facts == ["state_validation", "unchecked_arithmetic"] and rows[0].f_sec == 1.0 and rows[0].flags == ["contradict_unchecked_arithmetic"]
    assert rows[1].f_sec == 1.0 and rows[1].flags == ["unsupported_access_control_claim", "unsupported_owner_permission_claim"]
    assert rows[2].flags == [] and rows[2].cov == ["access_control"]
    assert rows[3].flags == []


def test_penalty_is_capped(spark):
    text = "only the owner at any time without checking does not transfer only internal prevents reentrancy"
    frame = spark.createDataFrame([("block.timestamp require( transferfrom oracle", text)], "f string, c string")
    flags = S.claim_flags(S.claim_evidence(frame.f), frame.c)
    row = frame.select(flags.alias("f"), S.claim_penalty(flags).alias("p")).first()
    assert len(row.f) >= 5 and row.p == 1.0
