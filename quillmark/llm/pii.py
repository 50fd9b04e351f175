"""Personal data by patterns, checksums and context, in DataFrame functions only.

A pattern proposes spans, a validator (part range, digit count, Luhn, mod-97) confirms them, and words nearby move the
score. Spans of the base kinds (email, ip, card, phone) always stay once confirmed; the method's own kinds (iban,
secret) need a score of at least ``threshold``.

Positions come from marking: each match is put between two marks, the text is split at them, and every second part is
a match; the lengths before it add up to its start. The marks are taken out of the text first, one for one. Sums and
cuts go block by block, so n matches in a text cost n times the root of n, not the square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, free_name, quoted

MARK, STAND_IN = "\x01", "\x03"
#: Words that make a span of the kind more likely within ``near`` characters before or after it. Fixed values.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "mobile", "call"),
    "iban": ("iban", "account", "bank", "konto"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "key"),
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    checksum: float = 0.0


#: Characters of an account number by country. Fixed values.
IBAN = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def iban_pattern() -> str:
    """Exactly as many characters as the country's numbers have, so that a word after the number is none of it."""
    forms = [f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN.items()]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


#: Possessive forms of the base patterns: what they match is the same, in linear time and without recursion.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.3, 0.5),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6),
    Kind("iban", iban_pattern(), 0.2, 0.6),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+", 0.3),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def mod97(text: Column) -> Column:
    """The remainder by 97 of an account number: its first four characters go last, letters count 10 to 35."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    digit = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(digit(c) > 9, (r * 100 + digit(c)) % 97).otherwise((r * 10 + digit(c)) % 97))


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(match) == 1
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def before_each(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of integers what ``op`` makes of all before it, from 0 on; one more for the end.

    Blocks of about the root of the length are gone through one by one, then the blocks' ends.
    """

    def along(xs: Column) -> Column:
        """What ``op`` makes of the elements before each, and of all."""
        step = lambda s, x: F.struct(op(s["now"], x).alias("now"), F.concat(s["out"], F.array(op(s["now"], x))).alias("out"))
        return F.aggregate(xs, F.struct(F.lit(0).alias("now"), F.array(F.lit(0)).alias("out")), step, lambda s: s["out"])

    def joined(r: Column) -> Column:
        starts = along(F.transform(r["blocks"], lambda b: F.element_at(b, -1)))
        return let(F.struct(r["blocks"].alias("blocks"), starts.alias("starts")), lambda q: F.concat(F.flatten(F.transform(q["blocks"], lambda b, k: let(F.get(q["starts"], k), lambda s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: op(x, s))))), F.slice(q["starts"], -1, 1)))

    def blocks(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / w).cast("int")), lambda k: along(F.slice(xs, k * w + 1, w)))
        return F.struct(let(width, cut).alias("blocks"))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array(F.lit(0))).otherwise(let(blocks(xs), joined)))


def spans_of(text: Column, kind: Kind, near: int, threshold: float) -> Column:
    """Confirmed spans of one kind, by start; code points, end exclusive."""
    parts = F.split(F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    words = rf"(?i)(?:^|[^\p{{L}}])(?:{'|'.join(CONTEXT[kind.name])})(?:$|[^\p{{L}}])"
    none = F.expr(f"cast(array() as {SPAN})")

    def placed(r: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            before, after = F.get(r["parts"], i - 1), F.get(r["parts"], i + 1)
            before = F.when(F.length(before) > near, F.substring(before, -near, near)).otherwise(before)
            score = F.lit(kind.prior + kind.checksum) + F.when(before.rlike(words) | F.substring(after, 1, near).rlike(words), 0.3).otherwise(0.0)
            fits = (i % 2 == 1) & confirmed(kind.name, part)
            if kind.name not in BASE:
                fits = fits & (score >= threshold)
            return F.when(fits, F.struct(F.lit(kind.name).alias("kind"), F.get(r["at"], i).alias("start"), F.get(r["at"], i + 1).alias("end"), F.least(score, F.lit(1.0)).alias("score")))

        return F.filter(F.transform(r["parts"], one), lambda x: x.isNotNull()).cast(SPAN)

    sized = lambda p: F.struct(p.alias("parts"), before_each(F.transform(p, F.length), lambda a, b: a + b).alias("at"))
    return let(parts, lambda p: F.when(F.size(p) > 1, let(sized(p), placed)).otherwise(none))


def find_pii(docs: DataFrame, text_col: str = "text", near: int = 40, threshold: float = 0.6) -> DataFrame:
    """Every row of ``docs`` with pii: spans (kind, start, end, score) by kind in the order of KINDS, then start.

    Null text is empty and has no spans; repeated rows each give a row; a column called pii gives way. Spans of one
    kind never overlap, spans of several kinds may. Nothing is shuffled, and whole texts are searched.
    """
    held = free_name(docs, "_marked")
    plain = docs.withColumn(held, F.replace(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), F.lit(MARK), F.lit(STAND_IN)))
    spans = F.concat(*[spans_of(F.col(held), k, near, threshold) for k in KINDS])
    return attach(plain, {"pii": spans}).drop(held)


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``found`` with every span of its text replaced by its kind in brackets; overlapping spans become one, named
    after the first. Null text stays null; text without spans stays as it is."""
    text, spans = F.col(quoted(text_col)), F.array_sort(F.transform(F.col(spans_col), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cleaned(r: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            """The text from ``start`` on up to ``end``, from the blocks that have it."""
            first = F.floor(start / r["width"]).cast("int")
            some = F.array_join(F.slice(r["blocks"], first + 1, F.floor(end / r["width"]).cast("int") - first + 1), "")
            return F.substring(some, start - first * r["width"] + 1, end - start)

        def piece(s: Column, i: Column) -> Column:
            start = F.get(r["open"], i)
            return F.when(s["start"] >= start, F.concat(cut(start, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(r["spans"], piece), ""), cut(F.element_at(r["open"], -1), F.length(text)))

    def held(s: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.length(text).cast("double"))).cast("int"), F.lit(256))
        blocks = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / w).cast("int")), lambda k: F.substring(text, k * w + 1, w))
        return F.struct(s.alias("spans"), before_each(F.transform(s, lambda x: x["end"]), F.greatest).alias("open"), width.alias("width"), let(width, blocks).alias("blocks"))

    clean = let(spans, lambda s: let(held(s), cleaned))
    return found.withColumn(text_col, F.when(text.isNotNull() & (F.size(spans_col) > 0), clean).otherwise(text))


def pii_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``find_pii`` found."""
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    pii = F.col("pii")
    base = F.filter(pii, lambda s: s["kind"].isin(*BASE))
    of_kind = lambda k: F.filter(pii, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col(quoted(id_col)), *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(pii).alias("spans"))
