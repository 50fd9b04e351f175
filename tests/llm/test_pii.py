import hashlib
import random
import re
import time

from pyspark.sql import functions as F
from quillmark.llm.pii import find_pii, pii_report, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))), ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in p.finditer(text) if ok(m)]


def card(rng, n, good=True):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c) == good)


def texts():
    rng = random.Random(11)
    out = [None, "", "a@b.c_d@e.f", "x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.255 0000255.1.1.01", "4444 4444-4444 4448", "+1 (487) 555-7209", "+12345678 +1-", "\x01a@b.co\x01", "é😀 a.b@c-d.e.f 漢"]
    parts = lambda: rng.choice([card(rng, rng.randint(14, 20), rng.random() < 0.7), "a.b@c.d", "@", ".", "+1 (22) 333-4444", "1.2.3.4", "999.1.1.1", "-", " ", "é", "😀", "x_y", "+", "(", "12", "\n", "\x01", "%"])
    out += ["".join(parts() for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return out


def test_base_kinds_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii_report(find_pii(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    for i, t in rows:
        want = base(t)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), (t, shown, got[i].spans)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert got[i].spans == shown or got[i].spans.startswith(shown)


def test_own_kinds_need_checksum_or_context(spark):
    rows = [(1, "My IBAN is GB82 WEST 1234 5698 7654 32."), (2, "My IBAN is GB82 WEST 1234 5698 7654 33."), (3, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"'), (4, "commit 9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]
    got = {r.doc_id: [s.kind for s in r.pii] for r in find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["secret"], 4: []}


def test_account_numbers_end_where_their_country_says(spark):
    rows = [(1, "PAY TO IBAN GB82 WEST 1234 5698 7654 32 AND CALL"), (2, "GB82WEST12345698765432 is the account"), (3, "GB82WEST12345698765432X"), (4, "XX82 WEST 1234 5698 7654 32")]
    got = {r.doc_id: [t[s.start : s.end] for s in r.pii if s.kind == "iban"] for (_, t), r in zip(rows, find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect())}
    assert got == {1: ["GB82 WEST 1234 5698 7654 32"], 2: ["GB82WEST12345698765432"], 3: [], 4: []}


def test_context_on_both_sides(spark):
    secret = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    rows = [(1, f"{secret} is the token"), (2, f"{secret} is {'far ' * 20} the token"), (3, f"token {'far ' * 20} {secret}")]
    got = {r.doc_id: [s.kind for s in r.pii] for r in find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["secret"], 2: [], 3: []}


def test_very_many_matches_in_one_text(spark):
    words = [f"u{k}@h{k}.org" if k % 2 else f"1.2.3.{k % 256}" for k in range(100_000)]
    text = " ".join(words)
    began = time.time()
    row = pii_report(find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert time.time() - began < 30
    shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base(text))
    assert row.n_email == 50_000 and row.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    began = time.time()
    clean = redact(find_pii(spark.createDataFrame([(1, "é" + text)], "doc_id bigint, text string"))).first().text
    assert time.time() - began < 60
    assert clean == "é" + " ".join("[EMAIL]" if k % 2 else "[IP]" for k in range(100_000))


def test_redaction(spark):
    rows = [(1, "é mail a@b.co or +1 (22) 333-4444!"), (2, "clean"), (3, None), (4, ""), (5, "a@b.co")]
    got = {r.doc_id: r.text for r in redact(find_pii(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got == {1: "é mail [EMAIL] or [PHONE]!", 2: "clean", 3: None, 4: "", 5: "[EMAIL]"}
    again = redact(find_pii(redact(find_pii(spark.createDataFrame([(1, " ".join(t or "" for t in texts()[:30]))], "doc_id bigint, text string"))).drop("pii"))).first()
    assert "@b" not in again.text


def test_very_long_texts_and_runs(spark):
    long = "a" * 60_000 + " 1.1" * 20_000 + " x@y" + ".z" * 20_000 + " " + "1" * 30_000
    frame = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    row = pii_report(find_pii(frame)).first()
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(long)).encode()).hexdigest()


def test_native_plan_clashing_names_and_empty_table(spark):
    found = find_pii(spark.createDataFrame([(1, "a@b.c", "own", "m")], "doc_id bigint, text string, PII string, _marked string"))
    assert found.first()._marked == "m" and [s.kind for s in found.first().pii] == ["email"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert find_pii(spark.createDataFrame([], "doc_id bigint, text string")).select(F.col("pii")).count() == 0


def test_secrets_have_no_upper_length(spark):
    rows = [(n, "token " + "a1B2c3D4" * n + " end") for n in (3, 25, 26, 5000)]
    for r in redact(find_pii(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect():
        assert r.text == "token [SECRET] end"
