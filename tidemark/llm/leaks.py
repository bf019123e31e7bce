"""Evaluation texts leaking into training text.

One Aho-Corasick automaton is built over the normalised test items and scans
every text once. Its patterns are the aligned blocks of each item, half as long
as the shortest run that counts: any such run holds a whole block. Each hit is
extended to both sides to the longest common run, so runs are found exactly and
the automaton stays as small as the test set itself.

A text is normalised piece by piece, a piece being a character and the marks that
combine with it, so that every normalised character knows its place in the
original, and the one scan gives the spans there.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least length of a run in normalised characters, by the language of the item.
LEAST_RUN = {"zh": 25, "en": 60}
#: The automaton holds the test set; a larger one must be scanned in several passes.
MOST_ITEM_CHARS = 1 << 26
_DROP = re.compile(r"[\W_]+")
#: Texts of these characters only fold character by character: nothing in them combines.
_SIMPLE = re.compile(r"[\x00-\x7f\u2010-\u2027\u3000-\u3029\u3400-\u4dbf\u4e00-\u9fff\uff01-\uff5e]*\Z")


def normalised(text: str) -> str:
    """Letters, digits and ideographs only, width folded (NFKC), in lower case."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).casefold())


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch whose normal form does not depend on its neighbours.

    A stretch begins at a character that neither combines with what stands before
    it nor is the second half of a composition (marks, Hangul vowels and finals).
    """
    start = 0
    for at in range(1, len(text)):
        c = text[at]
        if c < "\u0300":
            joins = False
        else:
            first = unicodedata.normalize("NFKD", c)[:1]
            joins = unicodedata.combining(c) != 0 or unicodedata.combining(first) != 0 or "\u1160" <= first <= "\u11ff" or first in _SECOND
        if not joins:
            yield start, at
            start = at
    if text:
        yield start, len(text)


# Characters that compose with the one before them although they are no combining marks (UAX 15).
_SECOND = frozenset("\u09be\u09d7\u0b3e\u0b56\u0b57\u0bbe\u0bd7\u0cc2\u0cd5\u0cd6\u0d3e\u0d57\u0dcf\u0ddf\u102e\u1b35")


def with_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """The normalised text and, for each of its characters, start and end of its piece in the original."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end in _pieces(text):
        plain = normalised(text[start:end])
        if plain:
            chars.append(plain)
            starts.extend([start] * len(plain))
            ends.extend([end] * len(plain))
    return "".join(chars), starts, ends


def kept_places(text: str, wanted: list[int]) -> list[int]:
    """Of a text that folds character by character, the places of the wanted letters and digits, counted from 0."""
    at, seen, out = -1, -1, []
    marks = sorted(set(wanted))
    for w in marks:
        while seen < w:
            at += 1
            seen += len(normalised(text[at]))
        out.append(at)
    where = dict(zip(marks, out))
    return [where[w] for w in wanted]


class Scanner:
    """The automaton over the items and the scan of one text."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], least: dict[str, int]):
        import ahocorasick

        self.items: list[tuple[list[int], str, int]] = []
        blocks: dict[str, list[tuple[int, int]]] = {}
        alike: dict[tuple[str, int], list[int]] = {}
        for item_id, lang, text in items:
            plain = normalised(text or "")
            run = least.get((lang or "").lower()[:2]) or (least["zh"] if sum("一" <= c <= "鿿" for c in plain) * 2 > len(plain) else least["en"])
            if len(plain) >= run:
                alike.setdefault((plain, run), []).append(item_id)
        # items that read alike are one
        for (plain, run), ids in alike.items():
            size = (run + 1) // 2
            for at in range(0, len(plain) - size + 1, size):
                blocks.setdefault(plain[at : at + size], []).append((len(self.items), at))
            self.items.append((ids, plain, run))
        self.automaton = ahocorasick.Automaton()
        for block, places in blocks.items():
            self.automaton.add_word(block, (len(block), places))
        if blocks:
            self.automaton.make_automaton()

    def runs(self, plain: str) -> dict[int, tuple[int, int]]:
        """For each item that leaked into a normalised text, start and end of its longest run, by one pass of the automaton."""
        found: dict[int, tuple[int, int]] = {}
        if not len(self.automaton):
            return found
        covered: dict[tuple[int, int], int] = {}
        for end, (size, places) in self.automaton.iter(plain):
            start = end - size + 1
            for k, at in places:
                # on one diagonal, a later block inside a known run tells nothing new
                if covered.get((k, start - at), -1) >= end:
                    continue
                ids, item, run = self.items[k]
                a, b = start, at
                while a and b and plain[a - 1] == item[b - 1]:
                    a, b = a - 1, b - 1
                c, d = end + 1, at + size
                while c < len(plain) and d < len(item) and plain[c] == item[d]:
                    c, d = c + 1, d + 1
                covered[k, start - at] = c - 1
                if c - a >= run:
                    for item_id in ids:
                        if c - a > found.get(item_id, (0, 0))[1] - found.get(item_id, (0, 0))[0]:
                            found[item_id] = (a, c)
        return found

    def spans(self, text: str) -> dict[int, tuple[int, int]]:
        """The longest run of each leaked item as positions in the text itself."""
        plain = normalised(text)
        runs = self.runs(plain)
        if not runs:
            return {}
        if _SIMPLE.match(text):
            places = iter(kept_places(text, [x for a, b in runs.values() for x in (a, b - 1)]))
            return {item: (next(places), next(places) + 1) for item in runs}
        again, starts, ends = with_offsets(text)
        # the same characters, since pieces fold alone as they do in the whole
        runs = runs if again == plain else self.runs(again)
        return {item: (starts[a], ends[b - 1]) for item, (a, b) in runs.items()}


_built: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[int, str | None, str | None]], least: dict[str, int]) -> Scanner:
    """The automaton of a test set, built once in a worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(items, least)
    return _built[key]


def leaks(docs: DataFrame, items: DataFrame, least: dict[str, int] = LEAST_RUN) -> DataFrame:
    """Documents with passages of test items.

    ``docs`` has (doc_id, text), ``items`` (item_id, lang, text). Returns
    (doc_id, item_id, at, until): the longest run of the item in the document as
    positions in the original text. Null and empty texts hold nothing; items
    shorter than the least run cannot leak; an item given twice counts once.
    The items come to the driver once their size is found to be within
    ``MOST_ITEM_CHARS``.
    """
    wanted = items.select("item_id", "lang", "text").dropna(subset=["item_id", "text"]).distinct()
    if (wanted.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_ITEM_CHARS:
        raise ValueError("the test set is larger than one automaton may be; scan it in parts")
    known = sorted((tuple(r) for r in wanted.collect()), key=lambda r: (r[0], r[1] or "", r[2]))
    key = hashlib.sha256(repr((known, sorted(least.items()))).encode("utf-8", "surrogatepass")).hexdigest()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(key, known, least)
        for batch in batches:
            out = [(doc_id, item, a, b) for doc_id, text in zip(batch["doc_id"], batch["text"]) if text for item, (a, b) in scanner.spans(text).items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "at", "until"])

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id bigint, item_id bigint, at int, until int")
