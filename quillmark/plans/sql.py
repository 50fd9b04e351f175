"""SQL for the queries of the catalog, for another engine to run over the same tables.

It is written apart from the Column expressions: steps over one text are nested selections, sets of terms are plain
conditions, ranking and selection are joins and windows. Only the fixed values are shared.
"""

from __future__ import annotations

from ..functions import rules
from ..functions import text as T
from . import corpus

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]"
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def steps(source: str, column: str, *exprs: str) -> str:
    """``source`` with ``column`` replaced by one expression after another, each naming it ``t``."""
    out = f"(SELECT *, coalesce({column}, '') AS t FROM {source})"
    for e in exprs:
        out = f"(SELECT * REPLACE ({e} AS t) FROM {out})"
    return f"(SELECT * REPLACE (t AS {column}) FROM {out})"


def drop_all(marks, by: str) -> list[str]:
    return [f"replace(t, {q(m)}, {q(by)})" for m in marks]


TAGS = [
    rf"regexp_replace(t, '^{WS}*\*{WS}*', '')",
    rf"regexp_replace(t, '^(?i){WS}*@dev{WS}+', '')",
    rf"regexp_replace(t, '^(?i){WS}*@notice{WS}+', '')",
    strip(rf"regexp_split_to_array(t, '(?i){WS}+@(?:param|return|returns)\b')[1]"),
]
DISPLAY = [strip("t"), *drop_all(T.COMMENT_MARKS + T.FENCES, " "), *TAGS, squeeze("t")]
FIRST_LINE = f"coalesce(list_filter(list_transform(regexp_split_to_array(t, '{LINE_END}'), lambda x: {strip('x')}), lambda x: x <> '')[1], t)"
UNQUOTED = f"CASE WHEN length(t) >= 2 AND left(t, 1) IN ('\"', '''') AND right(t, 1) = left(t, 1) THEN {strip('substr(t, 2, length(t) - 2)')} ELSE t END"


def peeled(prefixes) -> list[str]:
    return [strip("t"), *[f"CASE WHEN starts_with(t, {q(p)}) THEN {strip(f'substr(t, {len(p) + 1})')} ELSE t END" for p in prefixes]]


SENTENCE = "CASE " + " ".join(f"WHEN contains(t, '{m} ') THEN {strip(f'''split_part(t, '{m} ', 1)''')} || '{m}'" for m in ".?!") + " ELSE t END"
PREDICTION = [*peeled(T.FULL_PREFIXES), *drop_all(T.FENCES, ""), strip("t"), FIRST_LINE, UNQUOTED, *drop_all(T.COMMENT_MARKS, ""), *TAGS, SENTENCE, squeeze("t")]
BASIC = [*peeled(T.BASIC_PREFIXES), FIRST_LINE, *drop_all(T.FENCES, ""), strip("t"), UNQUOTED]


def folded(x: str) -> str:
    return f"lower({squeeze(f'''coalesce({x}, '')''')})"


# --- texts with what model output may carry around it -----------------------------------------------------------------

BEFORE = ("", "assistant", "Comment: ", "### Comment: ", "  Output:\n", "```solidity\n", "/** @dev ", "* @notice ", '"', "Here is the comment: Answer: ")
AFTER = ("", "\n```", ' @param x y', '"', " */", "\n\nmore", " @returns z")


def affixed() -> str:
    before = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in enumerate(BEFORE))
    after = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in enumerate(AFTER))
    return f"(SELECT conv_id, turn, (CASE (conv_id * 7 + turn) % {len(BEFORE)} {before} END) || text || (CASE (conv_id * 5 + turn) % {len(AFTER)} {after} END) AS raw FROM conversations)"


# --- the corpus over orders -------------------------------------------------------------------------------------------


def function_sql() -> str:
    parts = [q(t) if m == 1 else f"(CASE WHEN o_orderkey % {m} = {r} THEN {q(t)} ELSE '' END)" for m, r, t in corpus.FRAGMENTS]
    return "'function f' || o_orderkey || '(address to, uint256 amount) public ' || " + " || ".join(parts)


def choice(values, index: str) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in enumerate(values)) + " END)"


POOL = f"(SELECT o_orderkey AS k, {function_sql()} AS function, {choice(corpus.REFERENCES, 'o_orderkey % 8')} AS reference FROM orders)"


def output_sql(stage: int) -> str:
    return choice(corpus.OUTPUTS, f"(k * 31 + {17 * stage}) % 10")


STAGED = "(" + " UNION ALL ".join(f"SELECT k, function, {s} AS stage, {output_sql(s)} AS comment FROM {POOL}" for s in (0, 1, 2)) + ")"


# --- facts, claims, style ---------------------------------------------------------------------------------------------


def listed(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


def facts_list(code: str) -> str:
    return listed([(n, any_of(code, seen)) for n, (seen, _) in rules.COVERAGE_FACTS.items()])


def covered_list(code: str, text: str) -> str:
    return listed([(n, f"{any_of(code, seen)} AND {any_of(text, terms)}") for n, (seen, terms) in rules.COVERAGE_FACTS.items()])


def flags_list(code: str, text: str) -> str:
    out = []
    for flag, needed, evidence, claims in rules.CLAIM_FLAGS:
        has = any_of(code, evidence)
        if flag == "unsupported_bool_return":
            has = rf"({has} OR regexp_matches({code}, 'returns{WS}*\([^)]*bool'))"
        out.append((flag, f"{has if needed else f'NOT {has}'} AND {any_of(text, claims)}"))
    return listed(out)


def style_parts(t: str) -> list[tuple[str, str, str]]:
    n, low = n_words(t), f"lower({t})"
    marks = f"length({t}) - length(translate({t}, '.!?', ''))"
    return [
        (f"{n} < 5", "0.35", "too_short"),
        (f"{n} BETWEEN 5 AND 7", "0.15", "slightly_short"),
        (f"{n} > 40", "0.35", "too_long"),
        (f"{n} BETWEEN 36 AND 40", "0.15", "slightly_long"),
        (f"{marks} > 2", "0.2", "multi_sentence"),
        (f"(contains({low}, 'function ') OR {any_of(t, ('{', '}', '```'))})", "0.3", "contains_code_or_markdown"),
        (any_of(low, rules.TEMPLATE_PHRASES), "0.25", "template_phrase"),
        (f"right({t}, 1) NOT IN ('.', '!', '?')", "0.05", "no_sentence_end"),
    ]


def style_score(t: str) -> str:
    s = "1::DOUBLE"
    for holds, less, _ in style_parts(t):
        s = f"({s} - CASE WHEN {holds} THEN {less}::DOUBLE ELSE 0::DOUBLE END)"
    return f"CASE WHEN {t} = '' THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, {s})) END"


def style_flags(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN ['empty'] ELSE {listed([(n, c) for c, _, n in style_parts(t)])} END"


def clamp(x: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"


def scored(source: str) -> str:
    """Rows with function, comment, side and sem, and all that the score is made of."""
    one = f"(SELECT *, lower(function) AS code, lower(comment) AS low, {squeeze('comment')} AS shown FROM {source})"
    two = f"(SELECT *, {facts_list('code')} AS facts, {covered_list('code', 'low')} AS covered, {flags_list('code', 'low')} AS flags, {style_score('shown')} AS f_style, {style_flags('shown')} AS style_flags, {clamp('side')} AS f_code, {clamp('sem')} AS f_sem FROM {one})"
    three = f"(SELECT *, CASE WHEN len(facts) = 0 THEN 1::DOUBLE ELSE len(covered) / len(facts) END AS f_sec, least(1::DOUBLE, 0.25::DOUBLE * len(flags)) AS penalty FROM {two})"
    return f"(SELECT *, {clamp('0.4::DOUBLE * f_code + 0.2::DOUBLE * f_sem + 0.25::DOUBLE * f_sec + 0.1::DOUBLE * f_style - 0.15::DOUBLE * penalty')} AS score FROM {three})"


# --- validity ---------------------------------------------------------------------------------------------------------


def validity(source: str) -> str:
    """Rows with comment, and shown (as displayed), english, artifact, return_artifact, generic, valid and penalty."""
    shown = steps(f"(SELECT *, comment AS shown FROM {source})", "shown", *DISPLAY)
    one = f"(SELECT * EXCLUDE (t), {words('shown')} AS w, lower(shown) AS low_shown, {folded('shown')} AS key, length(regexp_replace(shown, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(shown, '[^A-Za-z]', '', 'g')) AS ascii FROM {shown})"
    two = f"(SELECT *, letters > 0 AND NOT {any_of('low_shown', rules.FOREIGN_MARKERS)} AND ascii >= 0.95 * letters AS english, {any_of('lower(comment)', rules.ARTIFACTS)} AS artifact, {any_of("' ' || key || ' '", rules.RETURN_ARTIFACTS)} AS return_artifact, regexp_replace(key, '\\.+$', '') IN ({', '.join(map(q, rules.TOO_GENERIC))}) AS generic FROM {one})"
    half = "array_to_string(w[1:len(w) // 2], ' ')"
    rest = "array_to_string(w[len(w) // 2 + 1:], ' ')"
    return f"(SELECT *, len(w) BETWEEN 3 AND 40 AND NOT artifact AND english AND NOT return_artifact AND NOT generic AND NOT {any_of('low_shown', rules.BOILERPLATE)} AND NOT (len(w) >= 8 AND lower({half}) = lower({rest})) AS valid, CASE WHEN len(w) < 5 THEN 0.03::DOUBLE WHEN len(w) <= 15 THEN 0::DOUBLE WHEN len(w) <= 25 THEN 0.05::DOUBLE WHEN len(w) <= 40 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS length_penalty FROM {two})"


# --- candidates -------------------------------------------------------------------------------------------------------


def negatives() -> str:
    """(k, function, ord, source, comment, kind): negatives of the pool after cleaning, deduplication and the cut to four."""
    cleaned = steps(f"(SELECT k, function, reference AS ref FROM {POOL})", "ref", *PREDICTION)
    pool = f"(SELECT k, function, ref, lower(ref) AS low, lower(function) AS code FROM {cleaned})"
    has = {n: any_of("code", terms) for n, terms in rules.GENERATOR_FACTS.items()}
    owner = r"regexp_replace(regexp_replace(ref, '(?i)\bonly the owner\b', 'any user', 'g'), '(?i)\bowner\b', 'user', 'g')"
    reversal = rf"CASE WHEN contains(low, 'owner') THEN {owner} WHEN contains(low, 'admin') THEN regexp_replace(ref, '(?i)\badmin\b', 'user', 'g') ELSE {q(rules.ANY_USER)} END"
    left = squeeze(rf"regexp_replace(ref, '(?i)\b(?:{'|'.join(rules.REMOVED_TERMS)})\b', '', 'g')")
    omission = f"CASE WHEN {n_words(left)} < 3 THEN {q(rules.GENERIC_SENTENCE)} ELSE {left} END"
    rows = [("TRUE", rules.GENERIC_NEGATIVE[0], rules.GENERIC_NEGATIVE[1], q(rules.GENERIC_NEGATIVE[2])), (has["access_control"], "hard_negative_access_control", "access_control_reversal", reversal), (has["access_control"], "hard_negative_access_omission", "access_control_omission", omission)]
    rows += [(has[f], s, kind, q(text)) for f, s, kind, text in rules.FIXED_NEGATIVES]
    union = " UNION ALL ".join(f"SELECT k, function, {i} AS ord, {q(s)} AS source, {c} AS comment, {q(kind)} AS kind FROM {pool} WHERE {h}" for i, (h, s, kind, c) in enumerate(rows))
    clean = steps(f"({union})", "comment", *PREDICTION)
    first = f"(SELECT *, row_number() OVER (PARTITION BY k, {folded('comment')} ORDER BY ord) AS again FROM {clean} WHERE comment <> '')"
    return f"(SELECT k, function, ord, source, comment, kind, row_number() OVER (PARTITION BY k ORDER BY ord) AS place FROM {first} WHERE again = 1 QUALIFY place <= 4)"


def candidates() -> str:
    """(k, function, pos, source, comment, role_hint, reference)."""
    parts = [f"SELECT k, function, 0 AS ord, 'reference' AS source, reference AS comment, 'positive_anchor' AS role_hint FROM {POOL}", f"SELECT k, function, 100 + place, source, comment, 'negative_only' FROM {negatives()}"]
    names = ("base_zero_shot", "sft_greedy", "sft_temp_0.3_1")
    parts += [f"SELECT k, function, {200 + s}, {q(n)}, {output_sql(s)}, 'model_candidate' FROM {POOL}" for s, n in enumerate(names)]
    clean = steps("(" + " UNION ALL ".join(parts) + ")", "comment", *PREDICTION)
    first = f"(SELECT *, row_number() OVER (PARTITION BY k, {folded('comment')} ORDER BY ord) AS again FROM {clean} WHERE comment <> '')"
    return f"(SELECT k, function, source, comment, role_hint, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS pos FROM {first} WHERE again = 1)"


def similar(kind: str) -> tuple[str, str]:
    """SQL of the stand-in similarities side and sem of a candidate."""
    if kind == "flat":
        return "((k * 37 + pos * 53) % 1200 - 200) / 1000::DOUBLE", "((k * 41 + pos * 59) % 1200 - 200) / 1000::DOUBLE"
    by = lambda a, b, c: f"(CASE WHEN source = 'reference' THEN {a} WHEN starts_with(source, 'hard_negative') THEN {b} ELSE {c} END)::DOUBLE"
    return f"{by(0.9, 0.35, 0.75)} - ((k * 37 + pos * 53) % 300) / 1000::DOUBLE", f"{by(1.0, 0.3, 0.8)} - CASE WHEN source = 'reference' THEN 0::DOUBLE ELSE ((k * 41 + pos * 59) % 300) / 1000::DOUBLE END"


def scored_candidates(kind: str = "by_source") -> str:
    side, sem = similar(kind)
    return scored(f"(SELECT *, {side} AS side, {sem} AS sem FROM {candidates()})")


# --- selection --------------------------------------------------------------------------------------------------------

SELECTION_CTES = f"""
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, pos) AS place FROM {scored_candidates()}),
v AS MATERIALIZED (SELECT *, score - length_penalty AS adj, starts_with(source, 'hard_negative') OR role_hint = 'negative_only' AS hard FROM {validity('s')} WHERE valid QUALIFY row_number() OVER (PARTITION BY k, key ORDER BY place) = 1),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY adj DESC, place) AS rank FROM v WHERE NOT hard AND score >= 0.7 AND penalty <= 0 AND f_style >= 0.6),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY adj, place) AS rank, row_number() OVER (PARTITION BY k, hard ORDER BY adj, place) AS own_rank FROM v WHERE source <> 'reference' AND role_hint <> 'positive_anchor' AND score <= 0.55),
ok AS MATERIALIZED (SELECT c.k, c.rank AS c_rank, r.rank AS r_rank, r.own_rank, r.hard, c.shown AS chosen, r.shown AS rejected, c.source AS chosen_source, r.source AS rejected_source, c.role_hint AS chosen_role_hint, r.role_hint AS rejected_role_hint, c.adj - r.adj AS margin, c.score AS chosen_score, r.score AS rejected_score
  FROM c JOIN r ON c.k = r.k AND c.rank <= 2 AND c.key <> r.key AND c.adj - r.adj >= 0.2),
p1 AS (SELECT *, 1 AS phase, row_number() OVER (PARTITION BY k ORDER BY r_rank) AS ord, 'top_vs_hard_negative' AS pair_type FROM ok WHERE c_rank = 1 AND hard QUALIFY ord <= 1),
p2 AS (SELECT *, 2 AS phase, own_rank AS ord, 'top_vs_low_model_' || own_rank AS pair_type FROM ok WHERE c_rank = 1 AND NOT hard AND own_rank <= 5),
p3 AS (SELECT *, 3 AS phase, r_rank AS ord, 'second_top_vs_low_' || r_rank AS pair_type FROM ok WHERE c_rank = 2 AND r_rank <= 5
  AND (NOT hard OR (k NOT IN (SELECT k FROM p1) AND r_rank = (SELECT min(o.r_rank) FROM ok o WHERE o.k = ok.k AND o.c_rank = 2 AND o.hard AND o.r_rank <= 5)))),
pairs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY phase, ord) - 1 AS pair_index FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) QUALIFY pair_index < 3)
"""
