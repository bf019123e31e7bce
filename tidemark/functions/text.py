"""Text rules as Columns: classification, clauses, negation, snippets, masking.

Rule packs are data (name, pattern) in order; the engine holds no vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.spans import spans

CLAUSE_END = "[。；;！!？?\\n]+"


def compact(text: Column, most: int | None = None) -> Column:
    """White space runs as one blank, trimmed, cut to ``most`` characters."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return out if most is None else F.left(out, F.lit(most))


def truthy(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def classify(text: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule whose pattern occurs in the text; null texts are ``other``."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(other) if out is None else out.otherwise(other)


def tags(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The names of all rules whose pattern occurs, in rule order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]))


def clauses(text: Column) -> Column:
    """The non-blank clauses of a text."""
    return F.filter(F.transform(F.split(text, CLAUSE_END), lambda c: F.trim(c)), lambda c: c != "")


def affirmed(text: Column, pattern: str, negation: str) -> Column:
    """Whether some clause holds the pattern and no negation; null texts do not."""
    return F.coalesce(F.exists(clauses(text), lambda c: c.rlike(pattern) & ~c.rlike(negation)), F.lit(False))


def clauses_with(text: Column, pattern: str, most: int) -> Column:
    """The first ``most`` clauses that hold the pattern, joined by ``|``."""
    return F.array_join(F.slice(F.filter(clauses(text), lambda c: c.rlike(pattern)), 1, most), "|")


def safe_sentences(text: Column, forbidden: str) -> Column:
    """The text without the clauses that hold the forbidden pattern; null where none is left."""
    return F.nullif(F.array_join(F.filter(clauses(text), lambda c: ~c.rlike(forbidden)), "。"), F.lit(""))


def snippet(text: Column, literal: str, before: int, behind: int) -> Column:
    """The text around the first occurrence of a literal; null where it does not occur."""
    at = F.instr(text, literal)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + len(literal) + behind - start))


def masked(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The text with each pattern's occurrences replaced, in order."""
    for pattern, mark in rules:
        text = F.regexp_replace(text, pattern, mark)
    return text


def without_literals(text: Column, literals: Sequence[str], mark: str) -> Column:
    """The text with literals replaced by a mark, the longest first."""
    for literal in sorted(literals, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(literal), F.lit(mark))
    return text


def largest_number(text: Column, pattern: str) -> Column:
    """The largest number that the first group of a pattern captures; null where there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("double")))


def tag_text(markup: Column) -> Column:
    """The text of a markup document, tags stripped and blanks compacted."""
    return compact(F.regexp_replace(markup, "<[^>]*>", " "))


def strict_json(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else: no duplicate keys, no NaN, no fence, nothing behind it.

    The parser stops after a value and accepts anything behind it. With a
    sentinel behind the text in one array, the sentinel is only reached if the
    text is exactly one value.
    """
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\u241e"]')))
    whole = F.try_variant_get(held, "$[1]", "string") == "\u241e"
    return F.coalesce(whole & text.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))


DATE = r"(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}"


def first_number(text: Column) -> Column:
    """The first number in a text; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def date_before(text: Column, literal: str) -> Column:
    """The last written date before the first occurrence of a literal, as it is written."""
    at = F.instr(text, literal)
    dates = F.regexp_extract_all(F.substring(text, F.lit(1), at - 1), F.lit(f"({DATE})"), F.lit(1))
    return F.when(at > 0, F.try_element_at(dates, F.lit(-1)))


def date_behind(text: Column, literal: str) -> Column:
    """The first written date behind the first occurrence of a literal, as it is written."""
    at = F.instr(text, literal)
    rest = F.substring(text, at + len(literal), F.length(text))
    return F.when(at > 0, F.nullif(F.regexp_extract(rest, f"({DATE})", 1), F.lit("")))


def affirmed_within(text: Column, pattern: str, negation: str, before: int) -> Column:
    """Whether some match of the pattern has no negation in the ``before`` characters in front of it; null texts have none."""
    window = lambda s: F.right(F.substring(text, F.lit(1), s["start"]), F.lit(before))
    return F.exists(spans(text, pattern), lambda s: ~window(s).rlike(negation))


def certainty(text: Column, pattern: str, doubt: str) -> Column:
    """strong if some clause with the pattern holds no doubt, uncertain if all hold one, none without such a clause."""
    held = F.filter(clauses(F.coalesce(text, F.lit(""))), lambda c: c.rlike(pattern))
    return F.when(F.exists(held, lambda c: ~c.rlike(doubt)), "strong").when(F.size(held) > 0, "uncertain").otherwise("none")


def snippets(text: Column, pattern: str, before: int, behind: int, mark: str, most: int) -> Column:
    """The text around every match of a pattern, repeated ones once, joined by a mark and cut to ``most`` characters."""
    start = lambda s: F.greatest(s["start"] - before, F.lit(0))
    around = F.transform(spans(text, pattern), lambda s: F.substring(text, start(s) + 1, s["end"] + behind - start(s)))
    return F.left(F.array_join(F.array_distinct(around), mark), F.lit(most))


def size_mm(text: Column) -> Column:
    """The largest measure of a text in millimetres, centimetres converted; of ``a×b×c unit`` the largest side. Null where there is none."""
    sides = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?(?:×[0-9]+(?:\.[0-9]+)?)*\s?[cm]m)"), F.lit(1)),
            lambda m: F.transform(F.split(F.regexp_replace(m, r"\s?[cm]m$", ""), "×"), lambda x: x.try_cast("double") * F.when(m.endswith("cm"), 10.0).otherwise(1.0)),
        )
    )
    return F.array_max(sides)


def number_of(numeric: Column, text: Column) -> Column:
    """A number column where it holds a number, else the first number of the text; NaN counts as none."""
    return F.coalesce(F.when(~F.isnan(numeric), numeric), first_number(text))


def citation(ident: Column, at: Column, quote: Column) -> Column:
    """``id@time:quote``; null where a part is missing."""
    return F.concat(ident, F.lit("@"), at, F.lit(":"), quote)


def redacted(text: Column, forbidden: str, most: int) -> Column:
    """The clauses without the forbidden pattern; where none is left, what stands before its first occurrence, up to ``most`` characters; else null."""
    first = F.try_element_at(F.split(text, forbidden, 2), F.lit(1))
    return F.coalesce(safe_sentences(text, forbidden), F.nullif(F.left(first, F.lit(most)), F.lit("")))


def holds_any(text: Column, markers: Column) -> Column:
    """Whether a text holds any of an array's markers; null and empty markers are in no text."""
    return F.coalesce(F.exists(F.filter(markers, lambda m: m != ""), lambda m: F.contains(text, m)), F.lit(False))


def all_of(text: Column, patterns: Sequence[str]) -> Column:
    """Whether a text holds every pattern, the cheapest first; null texts hold none."""
    out = F.lit(True)
    for pattern in patterns:
        out = out & text.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def without_null_words(text: Column, words: Sequence[str]) -> Column:
    """A text with blanks compacted; null where it is blank or a word that stands for nothing."""
    plain = compact(text)
    return F.when((plain != "") & ~plain.isin(*words), plain)
