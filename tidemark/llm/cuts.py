"""Text cut off by field limits.

What a system prints behind a text (page marks, export lines, an ellipsis) is
set aside first. Intact values are texts shorter than every length limit of
their source; they are cut artificially at positions drawn from their whole
length, half of the cuts as by a limit and half as by a broken transfer. Whether
a cut is a positive follows from where it was made: inside a sentence or entry
of the intact value, or between two. A logistic regression over hashed features
of the closing characters, the punctuation, the last line and the distance to
the limit is trained on both and alone decides on every record.

One statistic covers the whole corpus: how many distinct texts of a source have
a length, since a limit shows as one length that many texts share. Copies count
once, since copies of a broken text share its length too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hashed features; distinct texts taken for training (about so many, by a hash of the text); cuts made of each.
FEATURES, TRAIN_ROWS, CUTS = 1 << 16, 8000, 1
#: A length is a limit at so large a share of the distinct texts of its source, and at so many of them, if no more texts are longer.
LIMIT_SHARE, LEAST_SEEN = 0.02, 4
CUT_AT = 0.5
#: Times that values broken in transfer are sought among those taken as intact, and the log odds below which one stays.
CLEANINGS, SURELY_INTACT = 3, -1.0

# Marks that systems print behind a text.
_MARKS = (
    r"(?:\s*(?:\[[^\[\]\n]{0,12}\d{4}[-./]\d{1,2}[-./]\d{1,2}[^\[\]\n]{0,12}\]|（[^（）\n]{0,8}\d{4}[-./]\d{1,2}[-./]\d{1,2}[^（）\n]{0,12}）|--? ?\d{4}[-./]\d{1,2}[-./]\d{1,2} ?/ ?\d+ ?--?"
    r"|\((?:page|p\.) ?\d+ (?:of|/) ?\d+\)|(?:[Pp]age|PAGE) \d+(?: of \d+)?|第\d+页(?:/?共\d+页)?|【以下空白】|——+|-- ?end ?--|END OF REPORT))+\s*$"
)
_ADDED, _REACH = re.compile(_MARKS), 64
_ELLIPSIS = re.compile(r"(?:…+|\.{3,})\s*$")
_SENTENCE = re.compile(r"[。！？!?]['\"”’）)\]】]*\s*|\.['\"”’)\]]*(?:\s+|$)|\n\s*")
_MASK = re.compile(r"\d+|[a-zà-ÿ]+|[A-ZÀ-Þ]|[一-鿿]")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[一-鿿]+|[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'\-]*|\s+|.")
_ENTRY = re.compile(r"\s*[^：:\n]{1,24}[：:]\s*(?=[-<>]?\d)")
_DECIMAL = re.compile(r"\d+\.\d+")
_NUMBERED = re.compile(r"(\S+)\s?\d+\.$")
_CLAUSE = re.compile(r"[，,；;：:。.！？!?\n]")


def _mask(text: str) -> str:
    return _MASK.sub(lambda m: "0" if m[0][0].isdigit() else "汉" if "一" <= m[0] <= "鿿" else "W" if m[0].isupper() else "w", text)


class Tail(NamedTuple):
    """The end of a text: what is left without additions, the ellipsis behind it, its last line, its line before."""

    body: str
    ellipsis: str
    line: str
    before: str


def tail_of(text: str) -> Tail:
    """Set additions aside and take the end of a text apart."""
    body = text
    # a mark is shorter than the reach, and what is longer goes in several rounds
    while m := _ADDED.search(body, max(0, len(body.rstrip()) - _REACH)):
        if m.start() == len(body):
            break
        body = body[: m.start()]
        if not body.strip():
            break
    ellipsis = ""
    if m := _ELLIPSIS.search(body):
        body, ellipsis = body[: m.start()], m[0].strip()
    lines = body.rstrip("\n\r").rsplit("\n", 2)
    return Tail(body, ellipsis, lines[-1], lines[-2].rstrip() if len(lines) > 1 else "")


def shapes(line: str) -> list[str]:
    """Shapes of a short line: its lead, or its first or last token verbatim with digits as 0 and other words masked. Long lines have none."""
    line = line.strip()
    if not line or len(line) > 40:
        return []
    tokens = _TOKEN.findall(line)
    masked = ["0" if t[0].isdigit() else "汉" if "一" <= t[0] <= "鿿" else "W" if t[0].isalpha() and t[0].isupper() else "w" if t[0].isalpha() else " " if t.isspace() else t for t in tokens]
    out = [f"m:{''.join(masked)}"]
    if len(tokens) > 1:
        if tokens[1] in "：:,，" and masked[0] != "0":
            out.append(f"l:{tokens[0]}{tokens[1]}")
        out.append(f"a:{tokens[0] if masked[0] != '0' else '0'}{''.join(masked[1:])}")
        out.append(f"z:{''.join(masked[:-1])}{tokens[-1] if masked[-1] != '0' else '0'}")
    return out


def entry_shape(line: str) -> str:
    """Shape of a list entry: its name left out, digits as 0, the rest verbatim; blank for lines that are no entry."""
    m = _ENTRY.match(line)
    return "" if m is None or len(line) > m.end() + 24 else _DECIMAL.sub("0.0", line[m.end() :])


def limit_distance(text: str, tail: Tail, limits: frozenset[int]) -> str:
    """How far the text lies below the nearest limit of its source it could have met: at, 1 to 8, more, or none."""
    lengths = {len(text), len(tail.body), len(text.rstrip()), len(tail.body.rstrip())}
    if lengths & limits:
        return "at"
    below = [limit - len(tail.body) for limit in limits if limit > len(tail.body)]
    return "none" if not limits else "beyond" if not below else "near" if min(below) <= 8 else "far"


def features(text: str, tail: Tail, limits: frozenset[int], with_limit: bool = True) -> list[int]:
    """Hashed features of the end of a text; ``with_limit`` leaves out the distance to the limit if false."""
    body = tail.body.rstrip()
    limit = limit_distance(text, tail, limits) if with_limit else ""
    masked = _mask(body[-12:])
    ell = "…" if tail.ellipsis else ""
    entry = entry_shape(tail.line)
    entries = {entry_shape(x) for x in tail.body.split("\n")[:-1]} - {""} if entry or _ENTRY.match(tail.before) else set()
    opened = sum(body.count(c) for c in "（(【[“「") - sum(body.count(c) for c in "）)】]”」")
    script = "汉" if re.search(r"[一-鿿]", body[-30:]) else "w"
    clause = min(8, len(_CLAUSE.split(body[-60:])[-1]) // 4)
    last = body[-1:]
    prior = _mask(tail.before[-1:])
    names = [
        "bias", f"limit={limit}", f"limit={limit}&m1={masked[-1:]}", f"limit={limit}&m2={masked[-2:]}", f"limit={limit}&entry={entry}", f"ell={ell}&c2={body[-2:]}", f"ell={ell}&m1={masked[-1:]}&limit={limit}",
        f"open={opened > 0}", f"c1={last}{script}", f"c1={last}{script}{ell}&limit={limit}", f"c2={body[-2:]}", f"m3={masked[-3:]}{script}", f"m4={masked[-4:]}", f"m6={masked[-6:]}", f"m3={masked[-3:]}{script}&limit={limit}",
        f"blank={tail.body[len(body):][:1]!r}&m1={masked[-1:]}", f"clause={clause}&m1={masked[-1:]}", f"lines={len(tail.line) // 10 if len(tail.line) < 60 else 'long'}&m1={masked[-1:]}&prior={prior}", f"empty={not body}",
        f"word={body.split()[-1] if body and last.isascii() and last.isalpha() else ''}", 
        f"entry={bool(entry)}&seen={entry in entries}", f"entry={entry}&seen={entry in entries}", f"entries={bool(entries)}&entry={bool(entry)}&m1={masked[-1:]}",
    ]
    names.extend(f"{s}&prior={prior}" for s in shapes(tail.line))
    if ell:
        names.append(f"ell&c6={body[-6:].lower()}")
    if m := _NUMBERED.search(body[-40:]):
        names.append(f"before={m[1].lower()}&limit={limit}")
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def make_cuts(text: str, limits: frozenset[int] = frozenset(), many: int = CUTS) -> list[tuple[str, int, frozenset[int]]]:
    """Artificial cuts of an intact text: (piece, 1 if the cut lies inside a sentence or entry and 0 if between two, the limits to look at).

    Positions are drawn evenly; every eighth is moved to the next end of a
    sentence. Half of the cuts are made as by a field limit, so that their own
    length is one. Systems drop blanks at the end of a piece, and sometimes add
    some or an ellipsis. Cuts at the end of a line without a closing mark may be
    either and are left out.
    """
    body = tail_of(text).body.rstrip()
    marks = [(m.start() + len(m[0].rstrip()), bool(m[0].strip())) for m in _SENTENCE.finditer(body)]
    ends = {at for at, marked in marks if marked}
    unsure = {at for at, marked in marks if not marked}
    key, out = zlib.crc32(text.encode("utf-8", "surrogatepass")), []
    for k in range(many):
        draw = zlib.crc32(f"{key}/{k}".encode())
        at = 1 + draw % max(1, len(body) - 1)
        if draw // 32 % 8 == 0:
            at = min((end for end in ends if end >= at), default=at)
        piece = body[:at].rstrip()
        if at >= len(body) or not piece or len(piece) in unsure:
            continue
        behind = {0: "……", 1: "…", 2: "...", 3: "  ", 4: "\n"}.get(draw // 512 % 40, "")
        out.append((piece + behind, int(len(piece) not in ends), limits | {len(piece)} if draw // 16 % 2 else limits))
    return out


def train(rows: list[tuple[list[int], int]], rounds: int = 12, rate: float = 0.5, batch: int = 32) -> np.ndarray:
    """Logistic regression by gradient descent with a rate of its own for each feature, over small batches in a fixed order."""
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    if not rows:
        return weights
    width = max(len(r[0]) for r in rows)
    # rows have different numbers of features: the rest points at a cell that stays zero
    active = np.full((len(rows), width), FEATURES)
    for i, (names, _) in enumerate(rows):
        active[i, : len(names)] = names
    weights, squares = np.append(weights, 0.0), np.append(squares, 1.0)
    labels = np.array([r[1] for r in rows], dtype=float)
    order = np.random.default_rng(9)
    for _ in range(rounds):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = shuffled[at : at + batch]
            columns = active[part]
            error = labels[part] - 1.0 / (1.0 + np.exp(-np.clip(weights[columns].sum(axis=1), -30, 30)))
            touched, where = np.unique(columns, return_inverse=True)
            gradient = np.bincount(where.ravel(), np.repeat(error, width), len(touched))
            gradient[touched == FEATURES] = 0.0
            squares[touched] += gradient**2
            weights[touched] += rate * gradient / np.sqrt(squares[touched])
    return weights[:FEATURES]


class Model(NamedTuple):
    """What scoring needs: weights, limits by source."""

    weights: np.ndarray
    limits: dict[str, frozenset[int]]


def find_limits(docs: DataFrame) -> dict[str, frozenset[int]]:
    """The length limits of each source, from all distinct texts of ``docs`` (text, source).

    Counted inside the JVM. Of a source at most 1 / ``LIMIT_SHARE`` limits come
    to the driver, three lengths a text.
    """
    texts = docs.where("text IS NOT NULL AND trim(text) <> ''").select(F.coalesce("source", F.lit("")).alias("source"), "text")
    # marks stand at the very end, so the pattern is tried on no more than that
    end = F.right("text", F.lit(6 * _REACH))
    body = F.length("text") - F.length(end) + F.length(F.regexp_replace(end, _MARKS, ""))
    lengths = texts.select("source", F.xxhash64("text").alias("h"), body.alias("body"), F.array_distinct(F.array(F.length("text"), F.length(F.rtrim("text")), body)).alias("n"))
    distinct = lengths.dropDuplicates(["source", "h"])
    counts = distinct.select("source", "body", F.explode("n").alias("n")).groupBy("source", "n").agg(F.count("*").alias("c"), F.count_if(F.col("body") == F.col("n")).alias("bodies"))
    # of a source and length there is one row by now
    longer = Window.partitionBy("source").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("longer", F.coalesce(F.sum("bodies").over(longer), F.lit(0))).withColumn("of", F.sum("bodies").over(Window.partitionBy("source")))
    limits: dict[str, set[int]] = {}
    for r in ranked.where((F.col("c") >= LEAST_SEEN) & (F.col("c") >= LIMIT_SHARE * F.col("of")) & (F.col("longer") <= F.col("c"))).collect():
        limits.setdefault(r["source"], set()).add(int(r["n"]))
    return {source: frozenset(v) for source, v in limits.items()}


def training_sample(docs: DataFrame, most: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """About ``most`` distinct (text, source), chosen by a hash of the text whatever the size of the corpus."""
    texts = docs.where("text IS NOT NULL AND trim(text) <> ''").select("text", F.coalesce("source", F.lit("")).alias("source"))
    total = texts.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]
    cells = 1 << 30
    share = cells if total <= most else max(1, cells * most // total)
    sample = texts.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(cells)) < share).groupBy("text").agg(F.min("source").alias("source"))
    return sorted((r["text"], r["source"]) for r in sample.collect())


def examples(sample: list[tuple[str, str]], limits: dict[str, frozenset[int]], with_limit: bool = True) -> list[tuple[list[int], int]]:
    """Features and labels: values shorter than every limit of their source as intact ones, and their artificial cuts."""
    rows = []
    for text, source in sample:
        own = limits.get(source, frozenset())
        tail = tail_of(text)
        if not tail.body.strip() or (own and len(tail.body) >= min(own)):
            continue
        rows.append((features(text, tail, own, with_limit), 0))
        rows.extend((features(piece, tail_of(piece), at, with_limit), label) for piece, label, at in make_cuts(text, own))
    return rows


def fit(docs: DataFrame) -> Model:
    """Learn the limits from all distinct texts of ``docs`` (doc_id, text, source), and the regression from a bounded sample of them."""
    limits = find_limits(docs)
    return Model(learn(training_sample(docs), limits), limits)


def learn(sample: list[tuple[str, str]], limits: dict[str, frozenset[int]], with_limit: bool = True) -> np.ndarray:
    """The weights from a sample.

    Some values taken as intact were broken in transfer. Each half of the sample
    is scored by a regression trained on the other half, and those that it calls
    cut are left out of the last training.
    """
    # edited copies of one text end alike and stay together
    side = lambda text: zlib.crc32(tail_of(text).body.rstrip()[-24:].encode("utf-8", "surrogatepass")) % 2
    halves = [[r for r in sample if side(r[0]) == k] for k in (0, 1)]
    rows = [examples(half, limits, with_limit) for half in halves]
    kept = list(rows)
    for _ in range(CLEANINGS):
        weights = [train(half, rounds=6) for half in kept]
        kept = [[r for r in rows[k] if r[1] or weights[1 - k][r[0]].sum() < SURELY_INTACT] for k in (0, 1)]
    return train(kept[0] + kept[1])


def chance_of(text: str | None, source: str | None, model: Model) -> float:
    """The chance that a text is cut; null, empty and blank texts have none."""
    tail = tail_of(text) if text and text.strip() else None
    if tail is None or not tail.body.strip():
        return 0.0
    active = features(text, tail, model.limits.get(source or "", frozenset()))
    return float(1.0 / (1.0 + np.exp(-np.clip(model.weights[active].sum(), -30, 30))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, chance) of being cut, for every row of ``docs``; null, empty and blank texts have chance 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [chance_of(text, source, model) for text, source in zip(batch["text"], batch["source"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "chance": pd.Series(out, dtype="float64")})

    return docs.select("doc_id", "text", "source").mapInPandas(run, "doc_id bigint, source string, chance double")


def by_source(scored: DataFrame) -> DataFrame:
    """(source, documents, cut, cut_per_10000): how often each source truncates."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("chance") >= CUT_AT).cast("bigint")).alias("cut")).withColumn("cut_per_10000", F.expr("cut * 10000 div documents"))
