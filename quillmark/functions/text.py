"""Text functions as Column expressions: whitespace, cleaning of displayed and of generated comments, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is the same 29 code points everywhere; trim() and \s of the engines at hand know fewer or others.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACE}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: What model output may start with, in the order in which it is taken off.
FULL_PREFIXES = ("assistant", "Assistant:", "Comment:", "### Comment:", "Here is the comment:", "The comment is:", "Generated comment:", "Output:", "Answer:")
BASIC_PREFIXES = FULL_PREFIXES[:6]
#: Marks of comments and code fences.
FENCES = ("```solidity", "```")
COMMENT_MARKS = ("/**", "/*", "*/", "///", "//")

#: Prompts. The pairing prompt differs from the one used for training and prediction.
PAIRING_SYSTEM_PROMPT = (
    "You are an expert Solidity developer. Generate one short human-written style comment for the given Solidity function. "
    "The comment should be concise, natural, and faithful to the function behavior. Use 5 to 15 words when possible. "
    "Mention security-related constraints only when they are explicitly present in the function. "
    "Do not infer ownership, permissions, return values, emergency behavior, or safety guarantees unless they are explicitly shown in the function."
)
SYSTEM_PROMPT = (
    "You are an expert Solidity developer. Generate one short human-written style comment for the given Solidity function. "
    "The comment should be concise, natural, and faithful to the function behavior. Use 5 to 15 words when possible. "
    "Do not add explanations, return descriptions, ownership claims, emergency behavior, or security guarantees unless they are explicitly shown in the function."
)
PAIRING_TAIL = (
    "Generate exactly one short comment. Use 5 to 15 words when possible. Describe only the main behavior of the function. "
    "Do not include code, markdown, explanations, return descriptions, ownership claims, emergency behavior, or security guarantees unless they are explicitly supported by the code."
)
CHAT_TAIL = "Generate exactly one short comment. Do not include code, markdown, or additional explanation."
POOL_INSTRUCTION = "Generate a concise, faithful, and security-aware comment for the given Solidity function."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """White space at the ends goes, other runs become one blank."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def normalized(text: Column) -> Column:
    """Squeezed, null as empty; case stays."""
    return squeeze(F.coalesce(text, F.lit("")))


def folded(text: Column) -> Column:
    """The key by which comments count as equal: squeezed and lower-cased, null as empty."""
    return F.lower(normalized(text))


def exploded(rows, keep: list, array: Column, place: str, item: str):
    """One row per element, with its place. The outer form and a filter after it: for the plain form the optimizer
    infers a filter on the array's size, which it moves below, and so computes the array a second time."""
    return rows.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def drop_all(text: Column, marks: tuple[str, ...], by: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(by))
    return text


def without_tags(text: Column) -> Column:
    """No leading star, @dev or @notice, and nothing from @param or @return on."""
    text = F.regexp_replace(text, rf"^{WS}*\*{WS}*", "")
    for tag in ("dev", "notice"):
        text = F.regexp_replace(text, rf"(?i)^{WS}*@{tag}{WS}+", "")
    return strip(F.get(F.split(text, rf"(?i){WS}+@(?:param|return|returns)\b", 2), 0))


def display_clean(text: Column) -> Column:
    """A comment as it is shown: comment marks and fences become blanks, tags go."""
    text = strip(F.coalesce(text, F.lit("")))
    return squeeze(without_tags(drop_all(text, COMMENT_MARKS + FENCES, " ")))


def peel(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Takes each prefix off once, in their order, stripping after each."""
    start = F.array(*map(F.lit, prefixes))
    return F.aggregate(start, strip(text), lambda t, p: F.when(F.startswith(t, p), strip(F.substring(t, F.length(p) + 1, F.length(t)))).otherwise(t))


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped; the text itself where all are."""
    lines = F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")
    return F.coalesce(F.get(lines, 0), text)


def unquoted(text: Column) -> Column:
    """Without a pair of equal quotes around it."""
    first = F.substring(text, 1, 1)
    return F.when((F.length(text) >= 2) & first.isin('"', "'") & (F.substring(text, -1, 1) == first), strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def first_sentence(text: Column) -> Column:
    """Up to a full stop, else a question mark, else an exclamation mark, before a blank: kinds in order, not places."""
    cut = lambda mark: F.concat(strip(F.substring_index(text, f"{mark} ", 1)), F.lit(mark))
    return F.when(F.contains(text, F.lit(". ")), cut(".")).when(F.contains(text, F.lit("? ")), cut("?")).when(F.contains(text, F.lit("! ")), cut("!")).otherwise(text)


def prediction_clean(text: Column) -> Column:
    """One sentence from a model's output."""
    text = peel(F.coalesce(text, F.lit("")), FULL_PREFIXES)
    text = let(strip(drop_all(text, FENCES, "")), first_line)
    text = drop_all(let(text, unquoted), COMMENT_MARKS, "")
    return squeeze(let(without_tags(text), first_sentence))


def prediction_clean_basic(text: Column) -> Column:
    """The lighter cleaning of predictions that are stored: the first line is taken before fences go."""
    text = let(peel(F.coalesce(text, F.lit("")), BASIC_PREFIXES), first_line)
    return let(strip(drop_all(text, FENCES, "")), unquoted)


def without_terms(text: Column, terms: tuple[str, ...], generic: str) -> Column:
    """The text without some words, in any case; a fixed sentence where fewer than three words are left."""
    left = squeeze(F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(terms)})\b", ""))
    return let(left, lambda t: F.when(word_count(t) < 3, F.lit(generic)).otherwise(t))


def pair_prompt(instruction: Column, function: Column) -> Column:
    return F.concat(instruction, F.lit("\n\nSolidity function:\n"), function, F.lit("\n\n" + PAIRING_TAIL))


def chat_messages(instruction: Column, function: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System and user messages as an array of (role, content)."""
    user = F.concat(instruction, F.lit("\n\nSolidity function:\n"), function, F.lit("\n\n" + CHAT_TAIL))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def render_chat(messages: Column, generation: bool = True, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Messages in a chat template, ending with the assistant's head where a generation is asked for."""
    turns = F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n")))
    return F.concat(F.array_join(turns, ""), F.lit(f"{start}assistant\n" if generation else ""))
