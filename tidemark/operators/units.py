"""Quantities recorded in different units converted to one unit per item.

The number and the unit text are cut out of the result by built-in expressions.
The distinct unit spellings and item names, not the rows, are mapped to the unit
table and the item list by :mod:`tidemark.operators.spellings`; both
dictionaries are then joined to all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.width import narrow
from tidemark.operators.spellings import UNITS, alias_dictionary, folded
from tidemark.session import keep

# Metric prefixes, and what units are made of, in Latin and Chinese spelling.
_PREFIXES = (("", "", 1.0), ("k", "千", 1e3), ("d", "分", 1e-1), ("m", "毫", 1e-3), ("u", "微", 1e-6), ("n", "纳", 1e-9), ("p", "皮", 1e-12))
_QUANTITIES = (("amount", "mol", "摩尔", 1.0), ("amount", "eq", "当量", 1.0), ("mass", "g", "克", 1.0), ("activity", "u", "单位", 1.0), ("activity", "iu", "国际单位", 1.0), ("activity", "unit", "", 1.0), ("activity", "kat", "卡塔尔", 6e7))
_VOLUMES = (("l", "升", 1.0), ("dl", "分升", 1e-1), ("ml", "毫升", 1e-3), ("ul", "微升", 1e-6), ("mm3", "立方毫米", 1e-6))
_COUNTS = (("", 1.0), ("个", 1.0), ("cell", 1.0), ("k", 1e3), ("千", 1e3), ("万", 1e4), *((f"10^{n}", 10.0**n) for n in (3, 4, 6, 9, 12)))
# Names of the units that are not made by the rule, as (dimension, factor to the base, names).
_NAMES = (
    ("share", 1.0, ("%", "percent")), ("share", 0.1, ("‰", "permille")), ("share", 100.0, ("g/g",)),
    ("time", 1.0, ("s", "second", "秒")), ("time", 60.0, ("min", "minute", "分", "分钟")), ("time", 1e-3, ("ms", "millisecond", "毫秒")), ("time", 3600.0, ("h", "hour", "小时")),
    ("warmth", 1.0, ("cel", "celsius", "°c", "摄氏度")), ("warmth_f", 1.0, ("°f", "fahrenheit", "华氏度")),
    ("pressure", 1.0, ("mmhg", "torr", "毫米汞柱")), ("pressure", 7.50062, ("kpa", "千帕")), ("pressure", 0.00750062, ("pa", "帕")),
    ("volume", 1.0, ("cc", "cm3")),
)


def unit_table() -> list[tuple[str, str, float]]:
    """The canonical units, made by rule, as (folded spelling, dimension, factor to the base of the dimension)."""
    table: dict[str, tuple[str, float]] = {}
    for prefix, han, scale in _PREFIXES:
        for dimension, unit, name, base in _QUANTITIES:
            for volume, vessel, litres in _VOLUMES:
                table.setdefault(f"{prefix}{unit}/{volume}", (dimension, scale * base / litres))
                if name:
                    table.setdefault(f"{han}{name}/{vessel}", (dimension, scale * base / litres))
        table.setdefault(f"{prefix}g%", ("mass", scale * 10))
        if prefix:  # molar; M alone says nothing
            table.setdefault(f"{prefix}m", ("amount", scale))
    for volume, vessel, litres in _VOLUMES:
        for count, number in _COUNTS:
            for place in (volume, vessel):
                table.setdefault(f"{count}/{place}", ("count", number / litres / 1e9))
        for other, _, more in _VOLUMES:
            table.setdefault(f"{volume}/{other}", ("share", 100 * litres / more))
        for place in (volume, vessel):
            table.setdefault(place, ("volume", litres * 1e3))
    for dimension, factor, names in _NAMES:
        for name in names:
            table[name] = (dimension, factor)
    return [(spelling, dimension, factor) for spelling, (dimension, factor) in table.items()]


def folded_unit(col: Column) -> Column:
    """A unit spelling narrow, in lower case, without blanks and outer brackets, micro as ``u``, degrees as ``°``, raised digits as ``^n``."""
    text = F.regexp_replace(F.lower(narrow(col)), "([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", "^$1")
    text = F.replace(F.replace(F.translate(text, "µμ×⁰¹²³⁴⁵⁶⁷⁸⁹", "uux0123456789"), F.lit("℃"), F.lit("°c")), F.lit("℉"), F.lit("°f"))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"^[\[(](.*)[\])]$", "$1")
    return F.regexp_replace(F.regexp_replace(text, "^deg", "°"), "^mc(?=mol|kat|g|m$)", "u")


_RAISED = "([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)"
_PLAIN = r"^\d{1,12}(?:\.\d{1,12})?$"
_UNIT = r"^(?!H$|ref|偏?[低高]|参考|正常|范围|已复核|复查|重测)[A-Za-z%µμ℃℉‰\u4e00-\u9fff]{1,8}(?:/[A-Za-z\u4e00-\u9fff]{1,4})?$"
_WITH_UNIT = rf"^(\d{{1,12}}(?:\.\d{{1,12}})?) ?({_UNIT[1:-1]})$"
_RESULT = r"^(?:结果|约|测得|result|about|[=≈~:]|\s)*(?:[<>]=?|[≤≥])?\s*([-+]?\d[\d.,]*(?<![.,]))(?:(?:[eE]|\s*[x×*]\s*10\^)([-+]?\d{1,3})(?!\d*/))?\s*(.*)$"
_BEHIND_UNIT = r"\s*(?:[(\[]?\s*(?:参考|正常|范围|ref).*|[,;]?\s*(?:已复核|复查|重测)\s*|\(\s*(?:复查|已复核|重测)?\s*\)\s*|(?:[↑↓*]+|偏?低|偏?高|(?<=\s|^)H)\s*)+$"


def read_results(df: DataFrame, result: str) -> DataFrame:
    """Add ``_number`` (double) and ``_inline`` (the unit text behind it) of a result; both null where it holds no number.

    A bound gives its number. Numbers may have a decimal comma, thousands marks,
    an exponent or full-width digits. Flags, remarks and a printed reference
    range behind the number are dropped. Plain numbers meet one short pattern
    only; the long ones are for the rest.
    """
    raw = F.col(f"`{result}`")
    text = F.when(raw.rlike(r"^\p{ASCII}*$"), F.trim(raw)).otherwise(F.translate(F.regexp_replace(narrow(raw), _RAISED, "^$1"), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-"))
    # Three forms of growing length: a number, a number and a unit, anything. The groups of a match come out as one array.
    kind = F.when(raw.rlike(_PLAIN), 0).when(raw.rlike(_WITH_UNIT), 1).when(raw.rlike("[0-9０-９]"), 2)
    out = df.withColumn("_kind", kind).withColumn("_groups", F.when(F.col("_kind") == 2, F.split(F.regexp_replace(text, _RESULT, "$1\u0001$2\u0001$3"), "\u0001")))
    hit, power, rest = (F.col("_groups")[i] for i in range(3))
    digits = (
        F.when(~F.contains(hit, F.lit(",")), hit)
        .when(hit.rlike(r"^[-+]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$"), F.regexp_replace(hit, ",", ""))
        .when(hit.rlike(r"^[-+]?\d{1,3}(\.\d{3})+,\d+$"), F.translate(hit, ",.", "."))
        .otherwise(F.replace(hit, F.lit(","), F.lit(".")))
    )
    read = F.size("_groups") == 3
    number = F.when(F.col("_kind") == 0, raw).when(F.col("_kind") == 1, F.regexp_extract(raw, _WITH_UNIT, 1)).when(read, F.when(power == "", digits).otherwise(F.concat(digits, F.lit("e"), power)))
    inline = (
        F.when(F.col("_kind") == 0, "").when(F.col("_kind") == 1, F.regexp_extract(raw, _WITH_UNIT, 2))
        .when(read, F.when((rest == "") | rest.rlike(_UNIT), rest).otherwise(F.trim(F.regexp_replace(rest, _BEHIND_UNIT, ""))))
    )
    return out.select(*[F.col(f"`{c}`") for c in df.columns], number.try_cast("double").alias("_number"), inline.alias("_inline"))


def item_forms(name: Column) -> Column:
    """Folded forms to try for a free item name: as it stands, and without the usual decorations."""
    text = narrow(name)
    bare = F.regexp_replace(text, r"^(?:\s*(?:【[^】]{0,6}】|\*|\[|(?i)serum\s+|(?i)plasma\s+))+", "")
    bare = F.regexp_replace(bare, r"(?:\s*(?:【[^】]{0,6}】|[（(](?:血清|复查|急|血浆)[)）]|测定|定量|检测|\*|\]))+\s*$", "")
    forms = F.array_distinct(F.array(folded(text), folded(bare), folded(F.regexp_replace(bare, "^血清", ""))))
    # "n/a" is no name, though folding would make it one
    return F.when(~text.rlike(r"(?i)^[\s\[(*]*n\s*/\s*a\b"), forms)


def common_units(df: DataFrame, items: DataFrame, id_col: str, name_col: str, result_col: str, unit_col: str) -> DataFrame:
    """Each numeric result in its item's common unit.

    ``items`` has item_code, item_name, name_en, aliases (separated by ``|``),
    common_unit and molar_mass. Returns (id, item_code, number, unit, value,
    changed): ``unit`` is the unit as spelled, ``value`` the number in the common
    unit, ``changed`` whether conversion changed the number. Rows whose name
    stands for no item, whose result is no number or whose unit is missing,
    unknown or of another dimension have no row here. Repeated rows are kept.
    The results are read here and kept in memory and on disk until ``session.release``.
    """
    spark = df.sparkSession
    units = spark.createDataFrame(unit_table(), "form string, dimension string, factor double")
    forms = items.select(
        "item_code", F.explode(F.concat(F.array("item_name", "name_en"), F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")))).alias("name"),
    )
    reference = forms.select(F.col("item_code").alias("key"), folded(F.col("name")).alias("form"))
    rows = read_results(
        df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{name_col}`").alias("name"), F.col(f"`{result_col}`").alias("result"), F.col(f"`{unit_col}`").alias("own")), "result"
    ).select("id", "name", F.col("_number").alias("number"), F.col("_inline").alias("inline"), "own")
    names = df.select(F.col(f"`{name_col}`").alias("spelling")).where("spelling IS NOT NULL").distinct()
    item_map = alias_dictionary(names.select("spelling", F.explode(item_forms(F.col("spelling"))).alias("form")), reference).select(F.col("spelling").alias("name"), F.col("key").alias("item_code"))
    # Of the pairs of what stands in the result and in the unit field there are few; each gets its unit once.
    pair = F.concat_ws("\u0001", F.coalesce("inline", F.lit("")), F.coalesce("own", F.lit(""))).alias("pair")
    rows = keep(rows.where("number IS NOT NULL AND name IS NOT NULL").select("id", "name", "number", pair), now=True)
    pairs = rows.select("pair").distinct().select("pair", F.posexplode(F.split("pair", "\u0001")).alias("place", "spelling")).where("spelling <> ''")
    written = pairs.select("spelling").distinct()
    unit_map = alias_dictionary(written.withColumn("form", folded_unit(F.col("spelling"))), units.select(F.concat_ws("|", "dimension", "factor").alias("key"), "form"), slips=UNITS)
    unit_of = pairs.join(unit_map, "spelling").groupBy("pair").agg(F.min(F.struct("place", "spelling", "key")).alias("u")).select(
        "pair", F.col("u.spelling").alias("unit"), F.split_part("u.key", F.lit("|"), F.lit(1)).alias("dimension"), F.split_part("u.key", F.lit("|"), F.lit(2)).cast("double").alias("factor")
    )
    common = (
        items.select("item_code", folded_unit(F.col("common_unit")).alias("form"), F.col("molar_mass").cast("double").alias("molar_mass"))
        .join(F.broadcast(units), "form")
        .select("item_code", F.col("dimension").alias("to_dimension"), F.col("factor").alias("to_factor"), "molar_mass")
    )
    joined = rows.join(item_map.join(common, "item_code"), "name").join(unit_of, "pair")
    same = F.col("dimension") == F.col("to_dimension")
    ratio = F.col("number") * (F.col("factor") / F.col("to_factor"))
    value = (
        F.when(same & (F.col("factor") == F.col("to_factor")), F.col("number"))
        .when(same, ratio)
        .when((F.col("dimension") == "warmth_f") & (F.col("to_dimension") == "warmth"), (F.col("number") - 32) / 1.8)
        .when((F.col("dimension") == "mass") & (F.col("to_dimension") == "amount"), ratio / F.col("molar_mass"))
        .when((F.col("dimension") == "amount") & (F.col("to_dimension") == "mass"), ratio * F.col("molar_mass"))
        # G/L on a cell count is giga per litre
        .when((F.col("dimension") == "mass") & (F.col("to_dimension") == "count") & (F.col("factor") == 1), F.col("number"))
    )
    changed = F.abs(F.col("value") - F.col("number")) > F.abs(F.col("number")) * 1e-9
    return joined.withColumn("value", value).where("value IS NOT NULL").select("id", "item_code", "number", "unit", "value", changed.alias("changed"))
