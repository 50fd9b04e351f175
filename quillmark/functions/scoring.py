"""Facts, coverage, claims, style and the final score, as Column expressions over a function and a comment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import count_of, display_clean, folded, let, normalized


def shortest(terms: tuple[str, ...]) -> list[str]:
    """The terms that hold no other one; where any term occurs, one of these does."""
    return list(dict.fromkeys(t for t in terms if not any(o != t and o in t for o in terms)))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term occurs, as a substring."""
    found = F.lit(False)
    for t in shortest(terms):
        found = found | F.contains(text, F.lit(t))
    return found


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def present(items: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in items]).cast("array<string>"), lambda x: x.isNotNull())


def generator_facts(function: Column) -> dict[str, Column]:
    code = lowered(function)
    return {name: contains_any(code, terms) for name, terms in rules.GENERATOR_FACTS.items()}


def coverage_facts(function: Column) -> Column:
    """Types of the facts that a function shows, in their fixed order."""
    return let(lowered(function), lambda code: present([(name, contains_any(code, seen)) for name, (seen, _) in rules.COVERAGE_FACTS.items()]))


def covered_facts(facts: Column, comment: Column) -> Column:
    """Those of ``facts`` that the comment names; terms are substrings."""
    return let(lowered(comment), lambda text: present([(name, F.array_contains(facts, name) & contains_any(text, terms)) for name, (_, terms) in rules.COVERAGE_FACTS.items()]))


def coverage(facts: Column, covered: Column) -> Column:
    """Share of facts covered; 1 without facts."""
    return F.when(F.size(facts) == 0, F.lit(1.0)).otherwise(F.size(covered) / F.greatest(F.size(facts), F.lit(1)))


def claim_evidence(function: Column) -> Column:
    """Per flag, whether the function lets a claim of its kind stand against it; computed once a function."""

    def shown(code: Column) -> Column:
        out = []
        for flag, needed, evidence, _ in rules.CLAIM_FLAGS:
            has = contains_any(code, evidence)
            if flag == "unsupported_bool_return":
                has = has | code.rlike(rules.BOOL_RETURN)
            out.append(has if needed else ~has)
        return F.array(*out)

    return let(lowered(function), shown)


def function_facts(function: Column) -> Column:
    """Struct of found (per kind of negative's fact, whether it is shown), facts and evidence, as ``coverage_facts`` and
    ``claim_evidence`` have them. The tables share many terms; each is looked for once."""
    tables = [*rules.GENERATOR_FACTS.values(), *[seen for seen, _ in rules.COVERAGE_FACTS.values()], *[e for _, _, e, _ in rules.CLAIM_FLAGS]]
    place = {t: k for k, t in enumerate(dict.fromkeys(t for terms in tables for t in shortest(terms)))}

    def of(r: Column) -> Column:
        def shows(terms: tuple[str, ...]) -> Column:
            found = F.lit(False)
            for t in shortest(terms):
                found = found | F.get(r["has"], place[t])
            return found

        evidence = []
        for flag, needed, terms, _ in rules.CLAIM_FLAGS:
            has = shows(terms)
            if flag == "unsupported_bool_return":
                has = has | r["code"].rlike(rules.BOOL_RETURN)
            evidence.append(has if needed else ~has)
        found = F.array(*[shows(terms) for terms in rules.GENERATOR_FACTS.values()])
        return F.struct(found.alias("found"), present([(name, shows(seen)) for name, (seen, _) in rules.COVERAGE_FACTS.items()]).alias("facts"), F.array(*evidence).alias("evidence"))

    return let(lowered(function), lambda code: let(F.struct(code.alias("code"), F.array(*[F.contains(code, F.lit(t)) for t in place]).alias("has")), of))


def claim_flags(evidence: Column, comment: Column) -> Column:
    return let(lowered(comment), lambda text: present([(flag, F.get(evidence, k) & contains_any(text, claims)) for k, (flag, _, _, claims) in enumerate(rules.CLAIM_FLAGS)]))


def claim_penalty(flags: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.25) * F.size(flags))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def style(comment: Column) -> Column:
    """Struct of f_style and style_flags. Deductions are subtracted one after another, in double precision."""

    def judge(r: Column) -> Column:
        n, low, text = r["n"], r["low"], r["text"]
        parts = [
            (n < 5, 0.35, "too_short"),
            ((n >= 5) & (n < 8), 0.15, "slightly_short"),
            (n > 40, 0.35, "too_long"),
            ((n > 35) & (n <= 40), 0.15, "slightly_long"),
            (count_of(text, ".!?") > 2, 0.20, "multi_sentence"),
            (F.contains(low, F.lit("function ")) | contains_any(text, ("{", "}", "```")), 0.30, "contains_code_or_markdown"),
            (contains_any(low, rules.TEMPLATE_PHRASES), 0.25, "template_phrase"),
            (~F.substring(text, -1, 1).isin(".", "!", "?"), 0.05, "no_sentence_end"),
        ]
        empty = F.struct(F.lit(0.0).alias("f_style"), F.array(F.lit("empty")).alias("style_flags"))
        return F.when(text == "", empty).otherwise(let(F.array(*[holds for holds, _, _ in parts]), lambda told: added_up(told, parts)))

    def added_up(told: Column, parts: list) -> Column:
        # ((1 - a) - b) - c keeps the order of subtraction whatever applies
        score = F.lit(1.0)
        for k, (_, less, _) in enumerate(parts):
            score = score - F.when(F.get(told, k), less).otherwise(0.0)
        flags = present([(flag, F.get(told, k)) for k, (_, _, flag) in enumerate(parts)])
        return F.struct(clamp(score).alias("f_style"), flags.alias("style_flags"))

    return let(normalized(comment), lambda t: let(F.struct(t.alias("text"), F.lower(t).alias("low"), F.size(squeezed_words(t)).alias("n")), judge))


def squeezed_words(text: Column) -> Column:
    """The words of a text whose white space is squeezed already."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, " "))


@dataclass(frozen=True)
class Weights:
    """Shares of the final score. The defaults are the scorer's; PUBLISHED are those of the documented run."""

    code: float = 0.40
    sem: float = 0.20
    sec: float = 0.25
    style: float = 0.10
    claims: float = 0.15


PUBLISHED = Weights(0.45, 0.25, 0.15, 0.10, 0.25)


def final_score(f_code: Column, f_sem: Column, f_sec: Column, f_style: Column, penalty: Column, w: Weights = Weights()) -> Column:
    return clamp(F.lit(w.code) * f_code + F.lit(w.sem) * f_sem + F.lit(w.sec) * f_sec + F.lit(w.style) * f_style - F.lit(w.claims) * penalty)


def is_hard_negative(source: Column, role_hint: Column) -> Column:
    return F.coalesce(F.startswith(source, F.lit("hard_negative")), F.lit(False)) | (F.coalesce(role_hint, F.lit("")) == "negative_only")


def is_reference(source: Column) -> Column:
    return F.coalesce(source, F.lit("")) == "reference"


def is_anchor(role_hint: Column) -> Column:
    return F.coalesce(role_hint, F.lit("")) == "positive_anchor"


def has_claim_flags(flags: Column) -> Column:
    return F.coalesce(F.size(flags) > 0, F.lit(False))


def probably_english(text: Column) -> Column:
    """Letters, hardly any outside of ASCII, and no marker of another language. The dotted capital I and the Kelvin
    sign have ASCII lower case, so they count as ASCII."""

    def judge(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        ascii_letters = F.length(F.regexp_replace(t, r"[^A-Za-z\u0130\u212a]+", ""))
        return (letters > 0) & ~let(F.lower(t), lambda low: contains_any(low, rules.FOREIGN_MARKERS)) & (ascii_letters / F.greatest(letters, F.lit(1)) >= 0.95)

    return let(F.coalesce(text, F.lit("")), judge)


def has_artifact(text: Column) -> Column:
    return let(lowered(text), lambda t: contains_any(t, rules.ARTIFACTS))


def has_return_artifact(text: Column) -> Column:
    return let(F.concat(F.lit(" "), folded(text), F.lit(" ")), lambda t: contains_any(t, rules.RETURN_ARTIFACTS))


def is_too_generic(text: Column) -> Column:
    return F.regexp_replace(folded(text), r"\.+$", "").isin(*rules.TOO_GENERIC)


def is_valid_comment(comment: Column) -> Column:
    """Whether a comment may take part in a pair. Artifacts are looked for in the raw comment, all else as displayed."""
    return ~has_artifact(comment) & let(display_clean(comment), is_valid_display)


def is_valid_display(shown: Column) -> Column:
    """The part of validity that is judged by the displayed text, squeezed as it is."""

    def judge(r: Column) -> Column:
        t, low, own = r["t"], r["low"], r["own"]
        n = F.size(own)
        half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
        repeated = (n >= 8) & (F.array_join(F.slice(own, F.lit(1), half), " ") == F.array_join(F.slice(own, half + 1, n), " "))
        return n.between(3, 40) & ~contains_any(low, rules.BOILERPLATE) & ~is_too_generic(low) & ~has_return_artifact(low) & probably_english(t) & ~repeated

    return let(F.struct(shown.alias("t"), F.lower(shown).alias("low")), lambda x: let(F.struct(x["t"].alias("t"), x["low"].alias("low"), squeezed_words(x["low"]).alias("own")), judge))


def length_penalty(comment: Column) -> Column:
    return let(display_clean(comment), display_penalty)


def display_penalty(shown: Column) -> Column:
    return let(F.size(squeezed_words(shown)), lambda n: F.when(n < 5, 0.03).when(n <= 15, 0.0).when(n <= 25, 0.05).when(n <= 40, 0.10).otherwise(0.20))
