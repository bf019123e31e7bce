"""Encoding of a corpus with a byte-level BPE vocabulary.

Ordinary texts are encoded whole. A text beyond ``split_chars`` is halved until
its pieces are short enough; the pieces are encoded in parallel tasks and then
joined pairwise up the tree. A cut between character classes is a boundary of
the pre-tokenizer, where the ids simply follow one another. A cut inside a run
of one class (long unsplit text) severs a pre-token: there a growing window of
tokens around the join is encoded again until both sides agree, that is, until
the token pairs at both edges of the window are ones that BPE itself would
leave side by side. A sequence all of whose neighbouring pairs are such is the
encoding, so the result equals that of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer pattern that belongs to the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
_CLASS = regex.compile(r"(\p{L})|(\p{N})|(\s)|(.)", regex.DOTALL)
#: Texts of more characters go through the tree.
SPLIT_CHARS = 1 << 18


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public vocabulary file, from the installed package of public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file; one per worker. A worker without the file takes the one shipped with the job."""
    import tiktoken

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _class(c: str) -> int:
    return _CLASS.match(c).lastindex


def cut_between(text: str, at: int) -> bool:
    """Whether the pre-tokenizer always has a boundary between ``text[at - 1]`` and ``text[at]``, whatever surrounds them."""
    a, b = _class(text[at - 1]), _class(text[at])
    # A space joins what follows it, white space looks ahead, and an apostrophe may start a contraction.
    return a != b and a != 3 and text[at - 1] != "'"


def may_sever(text: str, at: int) -> bool:
    """Whether a cut between ``text[at - 1]`` and ``text[at]`` leaves the two parts of one pre-token on its sides and all others whole."""
    kind = _class(text[at])
    if kind != _class(text[at - 1]):
        return False
    if kind == 1:  # a contraction takes up to two letters behind its apostrophe
        return "'" not in text[max(0, at - 3) : at]
    if kind == 3:  # the last space of a run goes to what follows it
        return at + 1 < len(text) and _class(text[at + 1]) == 3
    return text[at] != "'"


def halves(text: str, limit: int) -> list[tuple[str, bool]]:
    """Pieces of at most ``limit`` characters, each with whether the cut before it severs a pre-token.

    Every half is cut at a boundary near its middle if one lies within an eighth
    of its length, else as near to the middle as a pre-token can be severed. A
    text that can be cut nowhere stays whole.
    """
    if len(text) <= limit:
        return [(text, False)]
    middle, reach = len(text) // 2, max(1, len(text) // 8)

    def around(most: int) -> Iterator[int]:
        for d in range(most):
            yield from (at for at in dict.fromkeys((middle + d, middle - d)) if 0 < at < len(text))

    cut, severed = next((at for at in around(reach) if cut_between(text, at)), None), False
    if cut is None:
        cut, severed = next((at for at in around(len(text)) if may_sever(text, at)), None), True
    if cut is None:
        cut, severed = next((at for at in around(len(text)) if cut_between(text, at)), None), False
    if cut is None:
        return [(text, False)]
    right = halves(text[cut:], limit)
    return halves(text[:cut], limit) + [(right[0][0], severed), *right[1:]]


class Encoded:
    """Ids of a piece, and how many of them its first and its last pre-token take."""

    def __init__(self, ids: list[int], head: int, tail: int, single: bool):
        self.ids, self.head, self.tail, self.single = ids, head, tail, single


def encode_piece(enc, text: str) -> Encoded:
    """The ids of a piece by itself, with the extent of its outer pre-tokens."""
    ids = enc.encode_ordinary(text)
    first = _PRE.match(text)
    if first is None or first.end() == len(text):
        return Encoded(ids, len(ids), len(ids), True)
    last = first
    # The last pre-token starts at or behind a boundary; scanning from the last safe one suffices.
    start = next((at for at in range(len(text) - 1, first.end(), -1) if cut_between(text, at)), first.end())
    for m in _PRE.finditer(text, start):
        last = m
    head, tail = len(enc.encode_ordinary(first[0])), len(enc.encode_ordinary(text[last.start() :]))
    return Encoded(ids, head, tail, False)


def _stays(enc, a: int, b: int) -> bool:
    pair = enc.decode_single_token_bytes(a) + enc.decode_single_token_bytes(b)
    return enc._encode_single_piece(pair) == [a, b]


def join(enc, left: Encoded, right: Encoded, severed: bool) -> Encoded:
    """The encoding of two neighbouring pieces from those of its parts."""
    if not left.ids or not right.ids:
        return right if not left.ids else left
    if not severed:
        return Encoded(left.ids + right.ids, left.head, right.tail, False)
    width = 1
    while True:
        i, j = min(width, left.tail), min(width, right.head)
        before, after = left.ids[: len(left.ids) - i], right.ids[j:]
        window = enc._encode_single_piece(b"".join(map(enc.decode_single_token_bytes, left.ids[len(left.ids) - i :] + right.ids[:j])))
        agree_left = i == left.tail or _stays(enc, before[-1], window[0])
        agree_right = j == right.head or _stays(enc, window[-1], after[0])
        if agree_left and agree_right:
            break
        width *= 2
    ids = before + window + after
    joined = left.tail - i + len(window) + right.head - j
    single = left.single and right.single
    return Encoded(ids, joined if left.single else left.head, joined if right.single else right.tail, single)


def join_tree(enc, parts: list[Encoded], severed: list[bool]) -> list[int]:
    """Join neighbouring pieces pairwise, level by level."""
    while len(parts) > 1:
        parts, severed = (
            [join(enc, parts[k], parts[k + 1], severed[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)],
            severed[::2],
        )
    return parts[0].ids if parts else []


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """Token ids (id, ids) of every row, without special tokens.

    Empty and null texts give an empty list; strings that look like special
    tokens are ordinary text. Repeated rows are repeated in the result. The rank
    file at ``path`` is shipped to the executors.
    """
    df.sparkSession.sparkContext.addFile(path)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = [enc.encode_ordinary(text) if text else [] for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(ids) for ids in lists], out=offsets[1:])
            flat = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(offsets[-1]))
            column = batch.column(0) if id_type is None else batch.column(0).cast(id_type)
            yield pa.RecordBatch.from_arrays([column, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    short = docs.where(f"text IS NULL OR length(text) <= {split_chars}").mapInArrow(whole, f"id {kind}, ids array<int>")

    @F.pandas_udf("array<struct<piece:string,severed:boolean>>")
    def split(column: pd.Series) -> pd.Series:
        return column.map(lambda text: [{"piece": piece, "severed": severed} for piece, severed in halves(text, split_chars)])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            done = [encode_piece(enc, piece) for piece in batch["piece"]]
            yield pd.DataFrame({
                "digest": batch["digest"], "place": batch["place"], "severed": batch["severed"],
                "ids": [d.ids for d in done], "head": [d.head for d in done], "tail": [d.tail for d in done], "single": [d.single for d in done],
            })

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path)
        pdf = pdf.sort_values("place")
        encoded = [Encoded(list(map(int, ids)), h, t, s) for ids, h, t, s in zip(pdf["ids"], pdf["head"], pdf["tail"], pdf["single"])]
        return pd.DataFrame({"digest": [pdf["digest"].iloc[0]], "ids": [join_tree(enc, encoded, list(pdf["severed"]))]})

    long = docs.where(f"length(text) > {split_chars}").withColumn("digest", F.sha2("text", 256))
    texts = long.groupBy("digest").agg(F.first("text").alias("text"))
    pieces = texts.select("digest", F.posexplode(split("text")).alias("place", "p")).select("digest", "place", "p.piece", "p.severed")
    # A piece is hashed to its own task, so the halves of one text are encoded side by side.
    spread = pieces.repartition(F.col("digest"), F.col("place"))
    encoded = spread.mapInPandas(parts, "digest string, place int, severed boolean, ids array<int>, head int, tail int, single boolean")
    joined = encoded.groupBy("digest").applyInPandas(tree, "digest string, ids array<int>")
    return short.unionByName(long.select("id", "digest").join(joined, "digest").select("id", "ids"))
