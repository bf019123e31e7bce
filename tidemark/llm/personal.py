"""Personal information in free text, found and replaced by typed placeholders.

Numbers, mail addresses and street addresses have a written form; names have
none. Which terms reveal a person is estimated from the corpus: in slots that
hold a protected entity (beside a title, a relation, a signature, a telephone
number) every term is counted, and counted again wherever it stands. The share
of a term's occurrences that fall into slots, against the share expected by
chance, is the information the term discloses about a protected entity. Terms
above the disclosure threshold make up the lexicon by which names are found
anywhere in the text, slot or not. For Chinese text the terms are family names
and characters of given names, for Latin script capitalised words.

A name that stands once in the whole corpus has no statistics. Behind a label
that introduces nothing but names it is found all the same, and wherever else it
stands in that text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import keep

KINDS = ("name", "phone", "email", "id_number", "address")
#: A term is disclosing if it stands in a slot at least this many bits more often than chance, and in this share of its occurrences.
DISCLOSURE_BITS, DISCLOSURE_SHARE, LEAST_SEEN = 4.0, 0.08, 2
#: A Latin word seen less often than ``LEAST_SEEN`` is disclosing if this share of its occurrences stands in slots.
SELDOM_SHARE = 0.5
#: Terms and full names in slots that may come to the driver; the lexicon of a larger corpus must be learned from parts of it.
MOST_TERMS = 5_000_000
#: A family name needs no such share, since most of its characters are common words; it must fill slots with disclosing given names this often.
LEAST_FAMILY = 2
#: A term seen in this many slots of distinct texts must have partners of so much entropy.
SET_PHRASE_SEEN, SET_PHRASE_BITS = 4, 1.0

_HAN = "[一-鿿]"
_D = r"[0-9０-９]"
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+\-'’])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]|['’](?=[A-Za-z0-9]))*(?:\s?[@＠]\s?|\s?[(\[（](?:at|AT)[)\]）]\s?|\s(?:at|AT)\s)(?:[A-Za-z0-9\-]+(?:\.|\s?[(\[](?:dot|DOT)[)\]]\s?))+[A-Za-z]{2,}(?![A-Za-z0-9])"
)
_HOUSE = rf"(?:{_HAN}{{1,6}}?(?:路|街|大道|巷|弄|胡同|里){_D}+(?:弄{_D}+)?号院?(?:{_D}+(?:栋|幢|座|号楼)(?:{_D}+单元)?(?:{_D}+室?)?)?|{_HAN}{{1,4}}[镇乡]第?{_D}+村{_D}+组{_D}+号)"
_ADDRESS_HAN = re.compile(rf"{_HAN}{{2}}(?:市(?:{_HAN}{{2}}[区县])?|[区县]){_HOUSE}")
_ADDRESS_EN = re.compile(
    r"(?<![\w.])(?:\d{1,5}[A-Za-z]?(?:[-–]\d{1,5})? (?:[A-Z][a-z'’]+ ){1,3}(?:(?:St|Rd|Ave|Ln|Dr|Ct|Blvd|Sq|Pl|Ter)\.?(?![\w.])|(?:Avenue|Street|Lane|Drive|Road|Court|Close|Way|Crescent|Terrace|Place|Square|Row|Hill|Gardens|Mews|Quay|Walk|Parade|Grove|Boulevard)\b)|P\.? ?O\.? Box \d{1,6}\b)"
    r"(?:, (?:Flat|Apt\.?|Unit|Suite|Apartment|Room) \w+)?(?:, [A-Z][a-z]+(?: (?:Bay|[A-Z][a-z]+))?(?:,? (?:(?:[A-Z]{2,3} )?\d{4,6}\b|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b))?)?"
)
_ADDRESS_FR = re.compile(r"(?<![\w.])\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|quai|allée|impasse|chemin|cours)(?: (?:de la|de l[’']|des|du|de|d[’']))?(?: ?[A-ZÀ-Þ][\wÀ-ÿ'’\-]+){1,4}, \d{5} [A-ZÀ-Þ][a-zà-ÿ\-]+(?:[ -][A-ZÀ-Þ][a-zà-ÿ\-]+)*")
_ADDRESS_DE = re.compile(
    r"(?:\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der) )?\b[A-ZÄÖÜ][a-zäöüß\-]+(?: [A-ZÄÖÜ][a-zäöüß]+)? \d{1,4}[a-z]?, \d{5} [A-ZÄÖÜ][a-zäöüß]+(?: (?:am|an der|im|bei|ob der) [A-ZÄÖÜ][a-zäöüß]+)?"
)
_ID = re.compile(
    rf"(?<![0-9０-９A-Za-z])(?:{_D}{{6}}[ -]?(?:19|20|１９|２０){_D}{{6}}[ -]?{_D}{{3}}[0-9０-９XxＸｘ]|[A-Z]{{2}}{_D}{{7,8}}|{_D}{{3}}([ -]){_D}{{2}}\1{_D}{{4}})(?![0-9０-９A-Za-z])"
    rf"|(?<=[Pp]assport: )[A-Z0-9]{{6,10}}(?![0-9A-Za-z])|(?<=[Pp]assport (?:no|No)\. )[A-Z0-9]{{6,10}}(?![0-9A-Za-z])|(?<=[Pp]assport )(?=[A-Z0-9]*\d)[A-Z0-9]{{6,10}}(?![0-9A-Za-z])|(?<=护照号[:：])[A-Z0-9]{{6,10}}(?![0-9A-Za-z])"
)
_PHONE = re.compile(
    rf"(?<![0-9０-９A-Za-z.\-+])(?:"
    rf"[+＋]86[ .-]?1{_D}{{2}}[ .-]?{_D}{{4}}[ .-]?{_D}{{4}}"
    rf"|[+＋](?!86){_D}{{1,3}}[ .-]?(?:\({_D}{{1,4}}\)|{_D}{{2,5}})(?:[ .-]{_D}{{3,6}}){{1,3}}"
    rf"|[1１]{_D}{{2}}[ .-]?{_D}{{4}}[ .-]?{_D}{{4}}"
    rf"|[(（]{_D}{{3,4}}[)）][ -]?{_D}{{3,4}}[ .-]?{_D}{{3,4}}"
    rf"|[0０]{_D}{{2,3}}[ -]{_D}{{7,8}}"
    rf"|0{_D}{{4}} {_D}{{6}}"
    rf"|[+＋](?!86){_D}{{1,3}}(?:[ .-]{_D}{{1,2}}){{4,6}}|0{_D}(?:[ .]{_D}{{2}}){{4}}"
    rf"|0{_D}{{2}} {_D}{{4}} {_D}{{4}}|0{_D}{{3}} {_D}{{3}} {_D}{{4}}"
    rf"|0{_D}{{1,4}}/{_D}{{3,6}}-{_D}{{1,5}}"
    rf"|{_D}{{3}}([.-]){_D}{{3}}\1{_D}{{4}}"
    rf")(?![0-9０-９A-Za-z])"
)
# Words that a protected person's name follows or precedes.
_BEFORE_HAN = "联系人|患者姓名[:：]|姓名[:：]|经办人[:：]|护工|家属|值班护士|责任护士|主治医师|主任医师|曾用名|昨日|由其女|由其子|由其妻|由其夫|转诊联系[:：]|入院登记[:：]|会诊由|签字[:：]|记录者[:：]"
_BEHIND_HAN = "[，,/／（(：:；;。]|教授|医师|医生|护士|主任|先生|女士|来电|留电|代取|与|已向|陪同| 邮箱|签署"
_SLOT_HAN = re.compile(rf"(?:{_BEFORE_HAN})({_HAN}{{2,4}}?)(?={_BEHIND_HAN})")
_SLOT_HAN_BRACKET = re.compile(rf"(?:{_D})[（(]({_HAN}{{2,4}})[）)]|(?:^|[。；;\n：:])({_HAN}{{2,4}})（患者之")
# Common family names of two characters.
_DOUBLE = ("欧阳", "司徒", "尉迟", "令狐", "澹台", "上官", "诸葛", "司马", "皇甫", "东方", "慕容", "公孙", "夏侯", "长孙", "端木", "轩辕", "宇文", "独孤", "南宫", "百里")
# The commonest family names of one character.
_FAMILIES = frozenset("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文欧柳闻蓝温庄柯葛")
# Labels behind which nothing but a person's name stands, and forms of address that are no given names.
_LABEL_HAN = re.compile(rf"(?:联系人|患者姓名[:：]|姓名[:：]|经办人[:：]|曾用名|签字[:：]|签名[:：]|记录者[:：])({_HAN}{{2,4}}?)(?={_BEHIND_HAN}|[\s\d]|$)")
_NO_GIVEN = re.compile("先生|女士|医生|医师|护士|主任|教授|电话|未|无|不|已|待")
_WORD = r"[A-Z][a-zäöüß]+(?:-[A-Z][a-zäöüß]+)*"
_LATIN = re.compile(rf"\b{_WORD}\b")
_FULL = rf"{_WORD}(?:,? {_WORD})|[A-Z]\. {_WORD}"
_SLOT_LATIN = re.compile(
    rf"(?:Next of kin is |ask for |Spoke with |shown by |Signed,? |signed by |Seen by |seen by |(?:Mr|Mrs|Ms|Dr|Prof)\. )({_FULL})|({_FULL})(?= wrote from |, who[’']ll phone| asked that the report)"
)
_LABEL_LATIN = re.compile(rf"(?:Next of kin is |Next of kin: |Spoke with |Signed,? |\b(?:Mr|Mrs|Ms|Dr|Prof)\. )((?:{_WORD}),? (?:{_WORD}))(?![A-Za-z'’\-])")
_NAME_LATIN = re.compile(rf"\b(?:{_WORD}, {_WORD}|{_WORD} {_WORD}|[A-Z]\. {_WORD})")
# Capitalised words that stand behind a title or a call without being names.
_NO_NAMES = frozenset("The Next Radiology Pathology Surgery Oncology Nutrition Pharmacy Laboratory Department Ward Clinic Team Desk Hospital Unit Office Registry Gastroenterology Anaesthesia Nursing Emergency Cardiology Endocrinology Medicine Records Patient Family".split())
_PLACE = {"address": "〔ADDRESS〕", "email": "〔EMAIL〕", "phone": "〔PHONE〕", "id_number": "〔ID〕", "name": "〔NAME〕"}


_AT = re.compile(r"[@＠]|[(\[（ ](?:at|AT)[)\]） ][A-Za-z0-9\-]+(?:\.|\s?[(\[])")
_NUMBER_ROW = re.compile(rf"{_D}[0-9０-９ .\-/()（）]{{5,}}{_D}|[A-Z]{{2}}{_D}{{7}}|[Pp]assport|护照号")
_POSTED = re.compile(r"\d, \d{5} ")
_NUMBERED = re.compile(r"\d[A-Za-z]? [A-Z][a-z]|Box \d")
_STREET_FR = re.compile(r"\d,? (?:bis |ter )?(?:rue|avenue|boulevard|place|quai|allée|impasse|chemin|cours) ")
#: Kind, cheap test whether the form can occur at all, pattern.
_FORMS = (
    ("email", lambda t: _AT.search(t) is not None, _EMAIL),
    ("address", lambda t: "号" in t, _ADDRESS_HAN),
    ("address", lambda t: _NUMBERED.search(t) is not None, _ADDRESS_EN),
    ("address", lambda t: _STREET_FR.search(t) is not None, _ADDRESS_FR),
    ("address", lambda t: _POSTED.search(t) is not None, _ADDRESS_DE),
    ("id_number", lambda t: _NUMBER_ROW.search(t) is not None, _ID),
    ("phone", lambda t: _NUMBER_ROW.search(t) is not None, _PHONE),
)


def structured(text: str) -> list[tuple[int, int, str]]:
    """Spans of written forms, none overlapping: mail before addresses before identity numbers before telephone numbers."""
    spans: list[tuple[int, int, str]] = []
    taken = text
    for kind, possible, pattern in _FORMS:
        if not possible(taken):
            continue
        found = [m.span() for m in pattern.finditer(taken)]
        # what is found is blanked, so later forms neither start inside nor touch it
        for start, end in found:
            spans.append((start, end, kind))
            taken = taken[:start] + "\u0000" * (end - start) + taken[end:]
    return spans


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    for start, end, _ in spans:
        text = text[:start] + "0" * (end - start) + text[end:]
    return text


def _split_han(name: str) -> tuple[str, str] | None:
    family = 2 if name[:2] in _DOUBLE and len(name) > 2 else 1
    return (name[:family], name[family:]) if 1 <= len(name) - family <= 2 else None


def term_counts(texts: list[str], copies: list[int] | None = None) -> Counter:
    """Occurrences of terms in distinct texts: (kind, term, where) with where ``slot``, ``all`` or ``rows`` (slots again, each as often as its text has ``copies``).

    Kinds are given (a character of a given name), word (a capitalised Latin
    word), and name (a family name and the given name that follows it in a slot).
    """
    parts = [_masked(text, structured(text)) for text in texts]
    masked = "\n".join(parts)
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    counts: Counter = Counter()

    def seen(kind: str, term: str, place: int) -> None:
        counts[kind, term, "slot"] += 1
        counts[kind, term, "rows"] += copies[bisect_right(starts, place) - 1] if copies else 1

    for m in [*_SLOT_HAN.finditer(masked), *_SLOT_HAN_BRACKET.finditer(masked)]:
        group = next(i for i, g in enumerate(m.groups(), 1) if g)
        if name := _split_han(m[group]):
            for c in name[1]:
                seen("given", c, m.start(group))
            seen("name", " ".join(name), m.start(group))
    for m in _SLOT_LATIN.finditer(masked):
        for word in _LATIN.findall(m[1] or m[2]):
            seen("word", word, m.end())
    for c, n in Counter(masked).items():
        if "一" <= c <= "鿿":
            counts["given", c, "all"] += n
    for word, n in Counter(_LATIN.findall(masked)).items():
        counts["word", word, "all"] += n
    return counts


def _bits(counts: list[int]) -> float:
    """Entropy of a distribution given by counts."""
    total = sum(counts)
    return -sum(n / total * math.log2(n / total) for n in counts)


def disclosing_terms(rows: list[tuple[str, str, int, int, int]]) -> dict[str, frozenset[str]]:
    """The lexicon from (kind, term, in slots, everywhere, rows): terms whose co-occurrence with protected entities exceeds the threshold.

    Slots and everywhere count distinct texts, rows counts slots of all texts with
    their copies. A family name combines with many given names and the other way
    round; a term seen in several slots with one partner only is part of a set
    phrase. How often one full name is repeated has no bearing on that: partners
    are varied if they are so with every full name counted once, or with the most
    frequent one counted as often as the next.
    """
    total = {kind: (sum(r[2] for r in rows if r[0] == kind), sum(r[3] for r in rows if r[0] == kind)) for kind in ("given", "word")}
    names: dict[str, dict[str, list[tuple[str, int]]]] = {"family": {}, "given": {}}
    filled: dict[str, Counter] = {}
    for kind, term, slots, _, copies in rows:
        if kind == "name":
            family, given = term.split(" ")
            names["family"].setdefault(family, []).append((given, slots))
            for c in set(given):
                names["given"].setdefault(c, []).append((family, slots))
            for c in given:
                filled.setdefault(family, Counter())[c] += copies

    def partners(kind: str, term: str, most: int) -> list[int]:
        """How often each partner fills slots with the term, no full name counting more than ``most``."""
        counts: Counter = Counter()
        for partner, n in names[kind].get(term, []):
            for c in partner if kind == "family" else [partner]:
                counts[c] += min(n, most)
        return list(counts.values())

    def varied(kind: str, term: str) -> bool:
        often = sorted((n for _, n in names[kind].get(term, [])), reverse=True)
        counts = partners(kind, term, often[min(1, len(often) - 1)] if often else 0)
        return sum(counts) < SET_PHRASE_SEEN or _bits(counts) >= SET_PHRASE_BITS or _bits(partners(kind, term, 1)) >= SET_PHRASE_BITS

    chosen: dict[str, set[str]] = {"family": set(), "given": set(), "word": set()}
    for kind, term, slots, everywhere, copies in rows:
        if kind == "name" or not everywhere or not total[kind][0]:
            continue
        share = slots / everywhere
        if copies < LEAST_SEEN and (kind == "given" or share < SELDOM_SHARE or term in _NO_NAMES):
            continue
        bits = math.log2(share * total[kind][1] / total[kind][0])
        # where nearly every term is a name, chance explains much: the share alone decides
        if share >= DISCLOSURE_SHARE and (bits >= DISCLOSURE_BITS or share >= 0.25) and (kind == "word" or varied("given", term)):
            chosen[kind].add(term)
    for family, givens in filled.items():
        if sum(n for given, n in givens.items() if given in chosen["given"]) >= LEAST_FAMILY and varied("family", family):
            chosen["family"].add(family)
    return {kind: frozenset(terms) for kind, terms in chosen.items()}


def learn_lexicon(texts: DataFrame) -> dict[str, frozenset[str]]:
    """Count terms over all distinct texts of ``texts`` (text) and keep the disclosing ones.

    Only terms and full names that stand in a slot come to the driver, once they are
    counted and no more than ``MOST_TERMS``. Null texts count as empty.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            total.update(term_counts(batch["text"].tolist(), batch["copies"].tolist()))
        yield pd.DataFrame([(k, t, *(n if w == x else 0 for x in ("slot", "all", "rows"))) for (k, t, w), n in total.items()], columns=["kind", "term", "slots", "everywhere", "rows"])

    distinct = texts.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    counted = distinct.mapInPandas(count, "kind string, term string, slots bigint, everywhere bigint, rows bigint")
    summed = keep(counted.groupBy("kind", "term").agg(*(F.sum(c).alias(c) for c in ("slots", "everywhere", "rows"))).where("slots > 0"))
    if summed.count() > MOST_TERMS:
        raise ValueError("more names stand in slots than one lexicon may hold; learn it from parts of the corpus")
    terms = [tuple(r) for r in summed.collect()]
    summed.unpersist()
    return disclosing_terms(terms)


def name_pattern(lexicon: dict[str, frozenset[str]]) -> re.Pattern | None:
    """Chinese names of the lexicon's terms, as one pattern."""
    if not lexicon["family"] or not lexicon["given"]:
        return None
    families = "|".join(sorted(map(re.escape, lexicon["family"]), key=lambda f: (-len(f), f)))
    given = "".join(sorted(lexicon["given"]))
    return re.compile(f"(?:{families})[{given}]{{1,2}}")


def spans_of(text: str, lexicon: dict[str, frozenset[str]], pattern: re.Pattern | None) -> list[tuple[int, int, str]]:
    """All spans of personal information in a text, in order, none overlapping."""
    spans = structured(text)
    masked = _masked(text, spans)
    names: list[tuple[int, int]] = []
    if pattern is not None:
        names += [m.span() for m in pattern.finditer(masked)]
    words, at = lexicon["word"], 0
    while m := _NAME_LATIN.search(masked, at):
        known = [w in words for w in _LATIN.findall(m[0])]
        initial = masked[m.start() + 1 : m.start() + 3] == ". "
        beyond = initial and (n := re.compile(rf"(?:,? ){_WORD}").match(masked, m.end())) and n[0].lstrip(", ") in words
        if all(known) and not beyond:
            names.append(m.span())
            at = m.end()
        else:
            at = m.start() + (3 if initial else len(re.match(_WORD, m[0])[0]))
    names += _labelled(masked, names, lexicon["word"])
    return sorted(spans + [(a, b, "name") for a, b in names])


def _labelled(masked: str, names: list[tuple[int, int]], words: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of names that the lexicon does not hold: those behind a label, and where else they stand in the text."""
    taken = masked
    for start, end in names:
        taken = taken[:start] + "\u0000" * (end - start) + taken[end:]
    found = []
    for m in _LABEL_HAN.finditer(taken):
        parts = _split_han(m[1])
        if parts and (parts[0] in _FAMILIES or parts[0] in _DOUBLE) and not _NO_GIVEN.search(parts[1]):
            found.append(m[1])
    found.extend(m[1] for m in _LABEL_LATIN.finditer(taken) if not any(w in _NO_NAMES for w in _LATIN.findall(m[1])))
    out = []
    for name in sorted(set(found), key=lambda n: (-len(n), n)):
        for m in re.finditer(re.escape(name), taken):
            out.append(m.span())
        taken = taken.replace(name, "\u0000" * len(name))
    return out


def _worker(lexicon: dict[str, frozenset[str]]):
    pattern = name_pattern(lexicon)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row_id, text in zip(batch["row_id"], batch["text"]):
                if text:
                    out.extend((row_id, kind, text[a:b]) for a, b, kind in spans_of(text, lexicon, pattern))
            yield pd.DataFrame(out, columns=["row_id", "kind", "hit"]).drop_duplicates()

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clean = []
            for text in batch["text"]:
                if text:
                    for a, b, kind in reversed(spans_of(text, lexicon, pattern)):
                        text = text[:a] + _PLACE[kind] + text[b:]
                clean.append(text)
            yield pd.DataFrame({"row_id": batch["row_id"], "text": clean})

    return find, replace


def find_personal(df: DataFrame, lexicon: dict[str, frozenset[str]]) -> DataFrame:
    """(row_id, kind, hit) of each distinct string of each kind in every text of ``df`` (row_id bigint, text); null and empty texts have none."""
    return df.select("row_id", "text").mapInPandas(_worker(lexicon)[0], "row_id bigint, kind string, hit string")


def sanitise(df: DataFrame, lexicon: dict[str, frozenset[str]]) -> DataFrame:
    """(row_id, text) with each hit replaced by its typed placeholder and the rest unchanged; null and empty texts stay as they are."""
    return df.select("row_id", "text").mapInPandas(_worker(lexicon)[1], "row_id bigint, text string")
