"""Free entries mapped to a canonical list by a partition-based pigeonhole join.

A reference form that differs from an entry by at most ``k`` edits, cut into
``k + 1`` segments, shares at least one segment with it unchanged, shifted by no
more than the edits before or behind it allow. So equality on (length, segment,
text) finds every candidate; the built-in ``levenshtein`` verifies it. All steps
are SQL expressions over the distinct entries, and the dictionary of distinct
entries is joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "NONE"
# Full-width forms follow from a rule; other blanks and dashes.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　 –—‐−"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  ----"
# Decorations that entries carry and list forms do not.
_BEFORE = r"^(?:\s|\*|【[^】]{0,6}】|serum\b|plasma\b|final\b|draft\b)+"
_BEHIND = r"(?:\s*(?:\*|【[^】]{0,6}】|\((?:血清|血浆|复查|急|终|电子版|修订|补)\)|测定|定量|检测|-修订|_v\d+|\.))+\s*$"
_NUMBERED = r"\s+\d\s*$"
# What is typed where there is no value.
_NO_VALUE = r"^[\s\[(*]*(?:n\s*/\s*a|n\.a\.|null|none|nil|-+|\?+)[\s\])*]*(?:\(急\))?$"


def edits_allowed(length: str) -> str:
    """SQL for the number of edits within which an entry stands for a form of ``length`` characters."""
    return f"CASE WHEN {length} <= 3 THEN 1 WHEN {length} <= 5 THEN 2 WHEN {length} <= 7 THEN 3 ELSE 4 END"


def _plain(col: Column) -> Column:
    return F.trim(F.lower(F.translate(col, _WIDE, _NARROW)))


def _bare(col: Column) -> Column:
    return F.regexp_replace(col, r"[\s_\-./\\|,·\[\]()*#]+", "")


def _digits(col: str) -> str:
    """SQL for the distinct digits of a text, without those that stand in for letters."""
    return f"array_sort(array_distinct(split(regexp_replace({col}, '[^2-9]', ''), '')))"


def _single(col: str) -> str:
    """SQL for a text with doubled characters as one."""
    return f"regexp_replace({col}, r'(.)\\1+', '$1')"


def _letters(col: str) -> str:
    """SQL for the characters of a text, sorted."""
    return f"array_sort(split({col}, ''))"


def _segments(length: str, k: str) -> str:
    """SQL for the segments of a form: array of (i, start from 0, size); the last segments are longer by one."""
    size, longer = f"({length} div ({k} + 1))", f"({length} % ({k} + 1))"
    start = f"(i * {size} + greatest(0, i - ({k} + 1 - {longer})))"
    return f"transform(sequence(0, {k}), i -> struct(i AS i, cast({start} AS INT) AS start, cast({size} + if(i >= {k} + 1 - {longer}, 1, 0) AS INT) AS size))"


def map_entries(entries: DataFrame, reference: DataFrame) -> DataFrame:
    """Map distinct free entries to reference codes.

    ``entries`` has (entry); ``reference`` has (code, form). Returns (entry,
    code, edits) with one row for each distinct entry that is not blank: the
    code of the form with the fewest edits (the smaller code on a tie), or
    ``NONE`` and null where no form lies within its allowance. Null and blank
    entries have no row; null and blank forms match nothing; repeated forms
    count once.
    """
    distinct = entries.select("entry").where(F.trim(F.translate(F.col("entry"), _WIDE, _NARROW)) != "").distinct()
    plain = _plain(F.col("entry"))
    stripped = F.regexp_replace(F.regexp_replace(plain, _BEFORE, ""), _BEHIND, "")
    unnumbered = F.regexp_replace(stripped, _NUMBERED, "")
    forms = F.array_distinct(F.array(_bare(plain), _bare(stripped), _bare(unnumbered), F.regexp_replace(_bare(stripped), "^血清", "")))
    left = distinct.where(~plain.rlike(_NO_VALUE)).select("entry", F.explode(forms).alias("e")).where("e <> ''").withColumn("n", F.length("e"))
    right = reference.select("code", _bare(_plain(F.col("form"))).alias("r")).where("r <> ''").distinct().withColumn("n", F.length("r"))
    k, length = edits_allowed("n"), "n"
    # forms too short for k + 1 segments keep empty segments, which meet every entry of a near length
    pieces = right.select("code", "r", "n", F.explode(F.expr(_segments(length, f"({k})"))).alias("s")).select(
        "code", "r", "n", F.col("s.i").alias("i"), F.expr("substr(r, s.start + 1, s.size)").alias("piece")
    )
    # An entry asks, for each length within reach, each segment at each shift that the edits around it allow.
    reach = left.select("entry", "e", F.col("n").alias("m"), F.explode(F.expr("sequence(greatest(1, n - 4), n + 4)")).alias("n")).where(f"abs(m - n) <= {k}")
    asked = reach.select("entry", "e", "n", "m", F.expr(f"({k})").alias("k"), F.explode(F.expr(_segments(length, f"({k})"))).alias("s"))
    low, high = "greatest(-s.i, (m - n) - (k - s.i), -s.start)", "least(s.i, (m - n) + (k - s.i))"
    probes = (
        asked.where(f"{low} <= {high}")
        .select("entry", "e", "n", F.col("s.i").alias("i"), F.explode(F.expr(f"array_distinct(transform(sequence({low}, {high}), d -> substr(e, s.start + d + 1, s.size)))")).alias("piece"))
        .where("piece IS NOT NULL")
    )
    candidates = probes.join(pieces, ["n", "i", "piece"]).select("entry", "e", "code", "r", "n").distinct()
    edits = candidates.withColumn("edits", F.levenshtein("e", "r")).where(f"edits <= {k}")
    # Of short forms, one more character is admitted (of the shortest a doubled one), then one edit besides doubling or a swap; digits tell entries apart.
    sure = edits.where(
        f"""edits = 0
        OR (n <= 2 AND regexp_replace(e, '(.)\\\\1+', '$1') = regexp_replace(r, '(.)\\\\1+', '$1'))
        OR (n = 3 AND length(e) = 4)
        OR (n > 3 AND {_digits('e')} = {_digits('r')} AND (n > 5 OR edits = 1 OR levenshtein({_single('e')}, {_single('r')}) <= 1 OR {_letters('e')} = {_letters('r')}))"""
    )
    best = Window.partitionBy("entry").orderBy("edits", F.abs(F.length("e") - F.col("n")), "code")
    found = sure.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("entry", "code", F.col("edits").cast("bigint").alias("edits"))
    unmatched = distinct.join(found, "entry", "left_anti").select("entry", F.lit(NONE).alias("code"), F.lit(None).cast("bigint").alias("edits"))
    return found.unionByName(unmatched)


def canonical_rows(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Codes for all rows whose entry is not exactly a listed form.

    ``rows`` has (row_id, entry), ``reference`` (code, form). Returns (row_id,
    code); rows with a null, blank or exactly listed entry have no row here, and
    entries that match nothing have the code ``NONE``. Only distinct entries are
    compared, so repeated entries cost one lookup.
    """
    listed = reference.select(F.col("form").alias("entry")).where("entry IS NOT NULL").distinct()
    free = rows.where("entry IS NOT NULL").join(listed, "entry", "left_anti")
    return free.join(map_entries(free.select("entry"), reference).select("entry", "code"), "entry").select("row_id", "code")
