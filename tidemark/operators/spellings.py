"""Alias dictionaries: distinct spellings mapped to a reference list.

Only the distinct spellings are compared. A character n-gram inverted index over
the reference forms proposes candidates, a weighted edit distance verifies them,
and the resulting dictionary is joined to all rows. Slips of the pen (look-alike
characters, doubled characters, swapped neighbours) weigh less than other edits,
a changed digit weighs more, since digits tell most reference entries apart.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.width import narrow

# Groups of characters that are taken for one another.
LOOK_ALIKES = (
    "0o", "1li", "5s", "uv", "ea", "cse", "zs", "pb", "tr", "nm", "蛋旦", "抗坑", "原源", "胆担", "红虹", "素索", "细纽", "胞包", "体休", "酶梅", "酯脂",
    "脱托", "氢轻", "碱咸", "磷鳞", "凝疑", "计记", "数教", "板扳", "压庒", "尿屎", "糖塘", "转专", "小少", "癌岩", "甘廿", "纤千", "报抱", "录绿", "记纪",
    "病丙", "术木", "查察", "程成", "院完", "理里", "乳孔",
)
SLIP, SWAP, EDIT, DIGIT = 0.5, 0.75, 1.0, 3.0


def _pairs(groups: Iterable[str]) -> frozenset[str]:
    return frozenset(a + b for group in groups for a in group for b in group if a != b)


@dataclass(frozen=True)
class Slips:
    """What a slip is in one kind of spellings.

    ``alike`` are pairs taken for one another, ``light`` characters that come and
    go easily, ``letters`` the cost of another letter; ``prefixed`` makes the
    first character and one behind a slash weigh most, and ``cut_off`` lets a
    form of at least three characters stand for the one it begins. ``allowance``
    gives the largest distance for a reference form's length.
    """

    alike: frozenset[str]
    allowance: tuple[tuple[int, float], ...]
    light: str = ""
    letters: float = EDIT
    prefixed: bool = False
    cut_off: bool = False

    def most(self, length: int) -> float:
        return next(limit for upto, limit in self.allowance if length <= upto)


#: Names of things: the longer the name, the more may differ.
NAMES = Slips(_pairs(LOOK_ALIKES), ((2, 0.5), (3, 0.75), (5, 1.5), (8, 2.0), (1 << 30, 3.0)))
#: Units: another letter or prefix is another unit, powers and plurals are written in many ways.
UNITS = Slips(_pairs(("1li|", "0o", "^*e", "/\\")), ((5, 0.5), (1 << 30, 1.0)), light="x^*s.", letters=DIGIT, prefixed=True, cut_off=True)


def folded(col: Column) -> Column:
    """The form in which spellings are compared: narrow, lower case, without blanks and separators, ``rn`` as ``m``. Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(narrow(col)), r"[\s_\-./\\|,·\[\]()（）*{}]+", ""), "rn", "m")


def weighted_distance(a: str, b: str, limit: float, slips: Slips = NAMES) -> float:
    """Weighted edit distance of a spelling ``a`` from a reference form ``b``; any value above ``limit`` means more than that."""
    if slips.cut_off and len(a) >= 3 and b.startswith(a):
        return SLIP if a != b else 0.0

    def single(s: str, i: int) -> float:
        c = s[i]
        if (i and s[i - 1] == c) or (i + 1 < len(s) and s[i + 1] == c):
            return SLIP
        if c in slips.light:
            return SLIP
        if slips.prefixed and (i == 0 or s[i - 1] == "/"):
            return DIGIT
        return DIGIT if c.isdigit() else EDIT

    m, n, far = len(a), len(b), limit + DIGIT
    # every step off the diagonal costs a slip at least
    band = int(limit / SLIP)
    if abs(m - n) > band:
        return far
    drop, add = [single(a, i) for i in range(m)], [single(b, j) for j in range(n)]
    alike, letters = slips.alike, slips.letters
    older: list[float] = []
    row = [0.0] * (n + 1)
    for j in range(n):
        row[j + 1] = row[j] + add[j]
    for i in range(m):
        x, cost = a[i], drop[i]
        new = [far] * (n + 1)
        new[0] = row[0] + cost
        least = new[0]
        for j in range(max(0, i - band), min(n, i + band + 1)):
            y = b[j]
            change = 0.0 if x == y else SLIP if x + y in alike else DIGIT if x.isdigit() or y.isdigit() else letters
            best = min(row[j] + change, row[j + 1] + cost, new[j] + add[j])
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, older[j - 1] + SWAP)
            new[j + 1] = best
            least = min(least, best)
        # a swap reaches back two rows
        if least > limit and min(row) > limit:
            return far
        older, row = row, new
    return row[-1]


def edits(length: Column) -> Column:
    """How many edits of any weight a form of that length may have: one in three characters, at least one and at most three."""
    return F.least(F.greatest(F.expr("1"), F.floor(length / 3)), F.lit(3)).cast("int")


def _grams(col: str, n: int) -> Column:
    padded = F.concat(F.lit("\u0002"), F.col(col), F.lit("\u0003"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))


def candidates(rest: DataFrame, right: DataFrame, n: int = 2, slips: Slips = NAMES) -> DataFrame:
    """The pairs of (spelling, form) and (key, ref) that may lie within the allowed edits, by an inverted index of n-grams.

    An edit touches at most n grams of the reference form and a swap n + 1, so a
    form within k edits shares all but k (n + 1) of the reference's distinct
    grams. Every pair within k edits is found where that leaves at least one.
    What the plain edit distance puts out of reach of the allowance is dropped.
    """
    length = F.length("ref")
    # a slip is one plain edit and a swap two
    reach = F.coalesce(*[F.when(length <= upto, int(max(limit / SLIP, 2 * limit / SWAP) + 1e-9)) for upto, limit in slips.allowance])
    count = F.size(_grams("ref", n))
    index = right.withColumn("least", F.greatest(count - edits(length) * (n + 1), F.lit(1))).withColumn("gram", F.explode(_grams("ref", n)))
    return (
        rest.withColumn("gram", F.explode(_grams("form", n))).join(index, "gram")
        .groupBy("spelling", "form", "key", "ref", "least").agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= F.col("least"))
        .where((F.levenshtein("form", "ref") <= F.least(2 * edits(length), reach)) | (F.lit(slips.cut_off) & (F.length("form") >= 3) & F.startswith("ref", "form")))
        .select("spelling", "form", "key", "ref")
    )


def alias_dictionary(spellings: DataFrame, reference: DataFrame, n: int = 2, slips: Slips = NAMES) -> DataFrame:
    """Map spellings to reference keys.

    ``spellings`` has (spelling, form): the distinct spellings with each folded
    form to try; ``reference`` has (key, form) with folded forms. Returns
    (spelling, key, distance), one row per spelling that stands for exactly one
    key: the nearest form decides, a tie between different keys decides nothing.
    Null and empty forms match nothing; repeated forms count once.
    """
    left = spellings.where("form IS NOT NULL AND form <> ''").select("spelling", "form").distinct()
    right = reference.where("form IS NOT NULL AND form <> ''").select("key", F.col("form").alias("ref")).distinct()
    met = left.join(right, F.col("form") == F.col("ref"), "left").withColumn("met", F.max(F.col("ref").isNotNull()).over(Window.partitionBy("spelling")))
    exact = met.where("ref IS NOT NULL").select("spelling", "key", F.lit(0.0).alias("distance"))
    rest = met.where("NOT met").select("spelling", "form")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            limit = slips.most(len(y))
            d = weighted_distance(x, y, limit, slips)
            out.append(d if d <= limit else None)
        return pd.Series(out, dtype="float64")

    # few bytes but much work: spread over all cores before the distance
    width = int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = candidates(rest, right, n, slips).repartition(width, "form", "ref")
    # a generator keeps the filter from being pushed below, where the distance would be worked out twice
    near = spread.withColumn("distance", distance("form", "ref")).select("spelling", "key", F.explode(F.array_compact(F.array("distance"))).alias("distance"))
    return (
        exact.unionByName(near)
        .groupBy("spelling", "key").agg(F.min("distance").alias("distance"))
        .groupBy("spelling")
        .agg(F.min(F.struct("distance", "key")).alias("best"), F.collect_list("distance").alias("all"))
        .where(F.size(F.filter("all", lambda d: d == F.col("best.distance"))) == 1)
        .select("spelling", F.col("best.key").alias("key"), F.col("best.distance").alias("distance"))
    )
