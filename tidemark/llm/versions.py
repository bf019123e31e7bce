"""Near-duplicate records with small edits.

Every text gets a fingerprint of MinHash symbols over its character pieces: in
each of a few passes all pieces are hashed once into as many bins as there are
blocks, and a bin's symbol is its least hash (an empty bin takes the symbol of
another, drawn by a fixed table). A block holds one symbol of each pass. Two
texts of resemblance J agree in a share J of the symbols, so the Hamming distance
of fingerprints, taken on one bit of each symbol, estimates J, and the blocks are
so many that a pair of the least resemblance the share allows agrees in a whole
block with near certainty. Pairs are found by equal blocks, verified by the
Hamming distance of their fingerprints, and then checked exactly on their pieces.

Pairs that share a block by chance grow with the square of the texts, so they are
never written: fingerprints are laid down once in chunks, every two chunks meet in
a task that reads them where they lie, and only pairs within the Hamming distance
leave it. What is written grows with the texts and with the near pairs.

Identical texts are one class with one representative before that, so a group of
copies costs one text whatever its size. A fingerprint moves once; texts move only
for pairs within the Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Blocks, and symbols of a block. At the least resemblance of a share of 0.7 (7/13) a pair misses all blocks with probability 9e-4.
BLOCKS, PER_BLOCK = 80, 4
SYMBOLS = BLOCKS * PER_BLOCK
#: Words of the fingerprint for each of the two bits of a symbol that are compared.
WORDS = SYMBOLS // 64
#: Fingerprints of a chunk, 408 bytes each; a task holds two chunks. Chunks at least, so that their pairs are tasks enough for a small table.
CHUNK, LEAST_CHUNKS = 1 << 17, 4
#: Pairs that share a block whose Hamming distances are taken at once: what they need stays in a core's cache.
PAIRS_AT_ONCE = 1 << 12
#: Near pairs of a task that are gathered before repeated ones are dropped.
NEAR_AT_ONCE = 1 << 18
#: Pairs up to which they are sent to the texts, and not the texts to them: two ids each, 16 MB in all.
MOST_SENT = 1 << 20
#: Characters fingerprinted at once, which bounds the memory of a task; a longer text is taken alone.
AT_ONCE = 1 << 20

_draw = np.random.default_rng(20)
_SEEDS = _draw.integers(1, 1 << 63, PER_BLOCK, dtype=np.uint64)
_BORROW = _draw.integers(0, BLOCKS, (256, PER_BLOCK, BLOCKS))
_EMPTY = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashed(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pieces of ``size`` characters, repeated ones too, and the text that each is from."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    n = max(0, len(codes) - size + 1)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value = _mix(value * np.uint64(0x100000001B3) + codes[k : k + n] + np.uint64(1))
    owner = np.repeat(np.arange(len(texts)), lengths)[:n]
    whole = np.arange(n) + size <= np.cumsum(lengths)[owner] if n else np.empty(0, dtype=bool)
    return value[whole], owner[whole]


def distinct_pieces(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct pieces of ``size`` characters."""
    out: list[np.ndarray] = []
    for part in _parts(texts):
        value, owner = _hashed(texts[part], size)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
        bounds = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
        out.extend(value[i:j] for i, j in zip(bounds, bounds[1:]))
    return out


def fingerprints(texts: list[str], size: int) -> np.ndarray:
    """The symbols of each text, (texts, PER_BLOCK, BLOCKS). Texts shorter than a piece have empty symbols only."""
    value, owner = _hashed(texts, size)
    found = np.empty((len(texts), PER_BLOCK, BLOCKS), dtype=np.uint32)
    for k in range(PER_BLOCK):
        h = _mix(value ^ _SEEDS[k])
        bins = ((h >> np.uint64(32)) * np.uint64(BLOCKS)) >> np.uint64(32)
        least = np.full(len(texts) * BLOCKS, _EMPTY, dtype=np.uint32)
        np.minimum.at(least, owner * BLOCKS + bins.astype(np.int64), np.minimum(h.astype(np.uint32), _EMPTY - np.uint32(1)))
        found[:, k] = least.reshape(len(texts), BLOCKS)
    out = found.copy()
    for table in _BORROW:
        empty = np.nonzero(out == _EMPTY)
        if not len(empty[0]):
            break
        out[empty] = found[empty[0], empty[1], table[empty[1], empty[2]]]
    return out


def block_keys(symbols: np.ndarray) -> np.ndarray:
    """One key of 32 bits for each block, the number of the block mixed in."""
    key = np.broadcast_to(np.arange(1, BLOCKS + 1, dtype=np.uint64), (len(symbols), BLOCKS))
    for k in range(PER_BLOCK):
        key = _mix(key * np.uint64(0x100000001B3) + symbols[:, k])
    return key.astype(np.uint32).view(np.int32)


def marks(symbols: np.ndarray) -> np.ndarray:
    """Two bits of each symbol, first all the one and then all the other, in words of 64."""
    flat = symbols.reshape(len(symbols), SYMBOLS)
    bits = [np.packbits(((flat >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1) for k in (0, 1)]
    return np.ascontiguousarray(np.concatenate(bits, axis=1)).view(np.int64)


def _sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the texts that they are from."""
    both = np.sort((keys.view(np.uint32).astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))
    return (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each index of ``size`` with each position of its run from ``first``, ``PAIRS_AT_ONCE`` at a time, a longer run in pieces."""
    some = np.nonzero(size)[0]
    ends = np.cumsum(size[some])
    shift = first[some] + size[some] - ends
    for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        stop = min(start + PAIRS_AT_ONCE, int(ends[-1]))
        i, j = np.searchsorted(ends, (start, stop - 1), "right")
        times = np.diff(np.minimum(ends[i : j + 1], stop), prepend=start)
        yield np.repeat(some[i : j + 1], times), np.repeat(shift[i : j + 1], times) + np.arange(start, stop)


def near_in(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, blocks: Iterable[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts in two chunks that agree in one of ``blocks`` and differ in ``most`` symbols at the most, each pair once.

    A chunk is its block keys, (BLOCKS, texts), and its marks, (texts, 2 * WORDS). Without ``right``, the pairs within ``left``.
    """
    (keys_a, marks_a), (keys_b, marks_b) = left, right or left
    n = max(1, len(marks_b))
    found, loose, count = np.empty(0, dtype=np.int64), [], 0
    for block in blocks:
        key_a, text_a = _sorted_keys(keys_a[block])
        if right is None:
            key_b, text_b = key_a, text_a
            first = np.arange(1, len(key_a) + 1)
            size = np.searchsorted(key_a, key_a, "right") - first
        else:
            key_b, text_b = _sorted_keys(keys_b[block])
            first = np.searchsorted(key_a, key_b)
            there = np.nonzero(key_a[np.minimum(first, len(key_a) - 1)] == key_b)[0] if len(key_a) else np.empty(0, dtype=np.int64)
            text_b, first = text_b[there], first[there]
            size = np.searchsorted(key_a, key_b[there], "right") - first
        for own, place in _runs(first, size):
            x, y = text_a[place], text_b[own]
            differing = np.zeros(len(x), dtype=np.uint16)
            other = np.take(marks_a, x, axis=0) ^ np.take(marks_b, y, axis=0)
            bits = np.bitwise_count(other[:, :WORDS] | other[:, WORDS:])
            for k in range(WORDS):
                differing += bits[:, k]
            near = np.nonzero(differing <= most)[0]
            x, y = x[near], y[near]
            if right is None:
                x, y = np.minimum(x, y), np.maximum(x, y)
            loose.append(x * n + y)
            count += len(x)
            if count > max(NEAR_AT_ONCE, len(found)):
                found, loose, count = np.unique(np.concatenate([found, *loose])), [], 0
    found = np.unique(np.concatenate([found, *loose]))
    return found // n, found % n


def largest_distance(share: float) -> int:
    """The differing symbols up to which a pair is looked at: four standard deviations beyond those of the least resemblance.

    Two bits of differing symbols are equal in a quarter of them. If a share s of the pieces of either text stands in the other, J is at least s / (2 - s).
    """
    j = share / (2 - share)
    differing = (1 - j) * 3 / 4
    return int(np.ceil(SYMBOLS * differing + 4 * np.sqrt(SYMBOLS * differing * (1 - differing))))


def _parts(texts: list[str]) -> Iterator[slice]:
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > AT_ONCE:
            yield slice(start, i)
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def close_versions(df: DataFrame, id_col: str, text_col: str, share: float = 0.7, size: int = 4, least_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """Classes of identical texts, and the close pairs between their representatives.

    Two texts are close if at least ``share`` of the distinct pieces of ``size``
    characters of each occur in the other. Returns ``(members, pairs)``:
    ``members`` (id, class_id) has a row for every text of at least
    ``least_chars`` characters, its class being the smallest id with that text;
    ``pairs`` (class_a, class_b) has each close pair of classes once, the smaller
    first. Null and shorter texts are left out; ids are taken as unique.

    The fingerprints are checkpointed here in chunks of about ``CHUNK``, and so are
    the pairs within the Hamming distance, which are counted, so that they are
    broadcast only up to ``MOST_SENT``.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") >= max(least_chars, size))
    keyed = docs.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    words = [f"{bit}{k}" for bit in "wv" for k in range(WORDS)]
    schema = "id bigint, digest binary, keys array<int>, " + ", ".join(f"{w} bigint" for w in words)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _parts(texts):
                symbols = fingerprints(texts[part], size)
                bits, n = marks(symbols), len(symbols)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BLOCKS), pa.array(block_keys(symbols).ravel()))
                own = batch.slice(part.start, n)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("digest"), keys, *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(words))]], names=["id", "digest", "keys", *words])

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        texts = pd.unique(pd.concat([a, b], ignore_index=True))
        known = dict(zip(texts, distinct_pieces(list(texts), size)))
        least = round(share * 1000)

        def one(p: np.ndarray, q: np.ndarray) -> bool:
            if min(len(p), len(q)) * 1000 < least * max(len(p), len(q)):
                return False
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            return int(np.count_nonzero(q[at] == p)) * 1000 >= least * max(len(p), len(q))

        return pd.Series([one(known[x], known[y]) for x, y in zip(a, b)], dtype=bool)

    classes = keyed.groupBy("digest").agg(F.min("id").alias("class_id"))
    members = keyed.select("id", "digest").join(classes, "digest").select("id", "class_id")
    # one fingerprint of each text; copies are dropped before the shuffle
    sketches = keyed.mapInArrow(sketch, schema).groupBy("digest").agg(F.min("id").alias("id"), F.min("keys").alias("keys"), *[F.min(w).alias(w) for w in words]).drop("digest")
    distinct = docs.agg(F.approx_count_distinct(F.xxhash64("text"))).head()[0]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(batches, pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int32())), *[(w, pa.int64()) for w in words]])) if (first := next(batches, None)) is None else pa.Table.from_batches([first, *batches])
        n = len(own)
        if n:
            keys = np.concatenate([c.flatten().to_numpy() for c in own.column("keys").chunks]).reshape(n, BLOCKS)
            bits = np.stack([own.column(w).to_numpy() for w in words], axis=1)
            whole = [own.column("id").to_numpy(), np.ascontiguousarray(keys.T), bits]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in whole]], names=["chunk", "ids", "keys", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), dtype=kind)  # noqa: B023, E731
                i, j = batch.column("chunk_a")[row].as_py(), batch.column("chunk_b")[row].as_py()
                ids_a, ids_b = read("ids_a", np.int64), read("ids_b", np.int64)
                left, right = ((read("keys_" + side, np.int32).reshape(BLOCKS, -1), read("bits_" + side, np.uint64).reshape(-1, len(words))) for side in "ab")
                # two chunks meet twice, the one way for the even blocks and the other for the odd
                x, y = near_in(left, None, range(BLOCKS), most) if i == j else near_in(left, right, range(int(i > j), BLOCKS, 2), most)
                x, y = ids_a[x], ids_b[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    most = largest_distance(share)
    chunks = cut(sketches.coalesce(max(LEAST_CHUNKS, -(-distinct // CHUNK))).mapInArrow(gather, "chunk int, ids binary, keys binary, bits binary"))
    one, two = (chunks.select(*[F.col(c).alias(f"{c}_{side}") for c in chunks.columns]) for side in "ab")
    near = cut(one.hint("shuffle_replicate_nl").crossJoin(two).mapInArrow(meet, "a bigint, b bigint").distinct())
    sent = near.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    if near.count() <= MOST_SENT:
        sent = F.broadcast(sent)
    # the two texts of a pair meet under the pair
    met = docs.join(sent, "id").groupBy("a", "b").agg(F.max(F.when(F.col("id") == F.col("a"), F.col("text"))).alias("ta"), F.max(F.when(F.col("id") == F.col("b"), F.col("text"))).alias("tb"))
    pairs = met.where(close("ta", "tb")).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
    return members, pairs


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links): every text's class of identical texts and how many other classes are close to it."""
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All close pairs of ids (id_a, id_b), smaller first: those of each class and those between close classes."""
    left, right = members.select(F.col("id").alias("x"), F.col("class_id").alias("cx")), members.select(F.col("id").alias("y"), F.col("class_id").alias("cy"))
    inner = left.join(right, F.col("cx") == F.col("cy")).where("x < y").select("x", "y")
    outer = pairs.join(left, F.col("class_a") == F.col("cx")).join(right, F.col("class_b") == F.col("cy")).select("x", "y")
    return inner.unionByName(outer).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
