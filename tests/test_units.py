import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.spellings import NAMES, UNITS, alias_dictionary, weighted_distance
from tidemark.operators.units import common_units, folded_unit, unit_table

ITEMS = [
    ("I1", "葡萄糖", "Glucose", "GLU|血糖", "mmol/L", 180.16), ("I2", "血清钠", "Sodium", "Na", "mmol/L", None), ("I3", "体温", "Body temperature", None, "Cel", None),
    ("I4", "白细胞计数", "White blood cell count", "WBC", "10^9/L", None), ("I5", "氧分压", "Oxygen partial pressure", "pO2", "mmHg", None), ("I6", "C反应蛋白", "C-reactive protein", "CRP", "mg/L", None),
    ("I7", "糖类抗原125", "Carbohydrate antigen 125", "CA125", "U/mL", None),
]
CASES = [
    ("葡萄糖", "117,4", "mg/dL", "I1", 6516), ("Glcuose*", "117.4 mg/dL (参考 70-110)", None, "I1", 6516), ("血糖", "> 1.174E2", "[mg/dl]", "I1", 6516),
    ("血清钠", "143,688", "umol/L", "I2", 143688), ("serum Soduim", "１４３", "mEq/L", "I2", None), ("Na", "0.137 mol/L ↑", "见结果", "I2", 137000),
    ("体温", "98.6", "℉", "I3", 37000), ("体温", "37.0", "°C", "I3", None), ("WBCC", "4477/uL", "-", "I4", 4477), ("WBC", "4.5×10^9/L", "", "I4", None), ("WBC", "4.5", "G/L", "I4", None),
    ("PO2", "10 kPa", None, "I5", 75006), ("CRP", "约0.0148 g/L，已复核", "", "I6", 14800), ("C反应旦白", "1.2", "mg/dL", "I6", 12000), ("CRP", "0", "g/L", "I6", None),
    ("CA15-3", "5", "U/L", None, None), ("N/A", "5", "mol/L", None, None), (None, "5", "g/L", None, None), ("CRP", None, "g/L", None, None), ("CRP", "溶血 (参考 2-5)", "g/L", None, None),
    ("CRP", "5", None, None, None), ("CRP", "5", "mmol/L", None, None), ("CRP", "", "", None, None), ("CRP", "x" * 50_000, "g/L", None, None),
]


def test_cases(spark):
    rows = [(i, n, r, u, "clash") for i, (n, r, u, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row bigint, n string, r string, u string, form string")
    items = spark.createDataFrame(ITEMS, "item_code string, item_name string, name_en string, aliases string, common_unit string, molar_mass double")
    got = {r["id"]: r for r in common_units(df, items, "row", "n", "r", "u").collect()}
    for i, (_, _, _, item, milli) in enumerate(CASES):
        assert (got[i]["item_code"] if i in got else None) == item, CASES[i]
        if item:
            assert (round(got[i]["value"] * 1000) if got[i]["changed"] else None) == milli, CASES[i]
    assert common_units(df.where("false"), items, "row", "n", "r", "u").count() == 0
    assert common_units(df.where("row = 0").unionByName(df.where("row = 0")), items, "row", "n", "r", "u").count() == 2


def test_every_unit_has_one_meaning():
    table = unit_table()
    assert len({u for u, _, _ in table}) == len(table)
    known = {u: (d, f) for u, d, f in table}
    assert known["mg/dl"] == ("mass", pytest.approx(1e-2)) and known["10^9/l"] == ("count", pytest.approx(1)) and known["ml/dl"] == ("share", pytest.approx(1)) and known["ukat/l"] == ("activity", pytest.approx(60)) and known["毫摩尔/升"] == ("amount", 1e-3)


def test_weighted_distance():
    assert weighted_distance("sodium", "sodium", 2) == 0
    assert weighted_distance("sodlum", "sodium", 2) == 0.5  # look-alike
    assert weighted_distance("soodium", "sodium", 2) == 0.5  # doubled
    assert weighted_distance("soduim", "sodium", 2) == 0.75  # swapped
    assert weighted_distance("ca153", "ca125", 2) > 2  # digits tell entries apart
    assert weighted_distance("", "abc", 9) == 3


def grams(text):
    padded = f"\u0002{text}\u0003"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_index_against_every_pair(spark):
    draw = random.Random(6)
    forms = sorted({"".join(draw.choice("abcdos12") for _ in range(draw.randint(1, 12))) for _ in range(60)})
    reference = [(f"K{i // 2}", f) for i, f in enumerate(forms)]
    typed = set()
    for _ in range(300):
        word = list(draw.choice(forms))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "o", "1"])
        typed.add("".join(word))
    left = spark.createDataFrame([(t, t, "x") for t in typed], "spelling string, form string, key string")
    got = {r["spelling"]: r["key"] for r in alias_dictionary(left, spark.createDataFrame(reference, "key string, form string")).collect()}
    expected = {}
    for t in typed - {""}:
        best = {}
        for key, ref in reference:
            k = min(3, max(1, len(ref) // 3))
            if t != ref and (len(grams(t) & grams(ref)) < max(1, len(grams(ref)) - 3 * k) or plain(t, ref) > 2 * k):
                continue
            if (d := weighted_distance(t, ref, NAMES.most(len(ref)))) <= NAMES.most(len(ref)):
                best[key] = min(best.get(key, 9), d)
        nearest = [k for k, d in best.items() if d == min(best.values())]
        if len(nearest) == 1:
            expected[t] = nearest[0]
    assert got == expected


def test_misspelt_units(spark):
    """Recall and precision on misspelt units; README gives the figures."""
    meaning = {u: (d, f) for u, d, f in unit_table()}
    draw, cases = random.Random(2), {}
    for unit in sorted(u for u in meaning if len(u) >= 5 and u.isascii()):
        for _ in range(3):
            at = draw.randrange(1, len(unit))
            kind = draw.choice(["double", "swap", "look", "drop", "power"])
            if kind == "double":
                typed = unit[:at] + unit[at] + unit[at:]
            elif kind == "swap" and at + 1 < len(unit) and unit[at] != unit[at + 1] and "/" not in unit[at : at + 2]:
                typed = unit[:at] + unit[at + 1] + unit[at] + unit[at + 2 :]
            elif kind == "look" and "l" in unit:
                typed = unit.replace("l", draw.choice("1|i"), 1)
            elif kind == "drop" and unit[at] != "/" and unit[at - 1] != "/":
                typed = unit[:at] + unit[at + 1 :]
            elif "^" in unit:
                typed = draw.choice(["x", ""]) + unit.replace("^", draw.choice(["*", "e", ""]))
            else:
                continue
            if typed not in meaning:
                cases[typed] = unit
    table = spark.createDataFrame([(f"{d}|{f}", u) for u, d, f in unit_table()], "key string, form string")
    typed = spark.createDataFrame([(t,) for t in cases], "spelling string").select("spelling", folded_unit(F.col("spelling")).alias("form"))
    got = {r["spelling"]: r["key"] for r in alias_dictionary(typed, table, slips=UNITS).collect()}
    want = {t: "|".join(map(str, meaning[u])) for t, u in cases.items()}
    right = sum(got.get(t) == k for t, k in want.items())
    print(f"misspelt units: {len(want)}, mapped {len(got)}, right {right}")
    assert right >= 0.65 * len(want) and right >= 0.95 * len(got)
    for typed, unit in (("x10e9/l", "10^9/l"), ("10*3/ul", "10^3/ul"), ("units/ml", "unit/ml"), ("sec", "second"), ("mmoll/l", "mmol/l")):
        assert weighted_distance(typed, unit, 1.0, UNITS) <= 1.0
    for typed, unit in itertools.permutations(("mg/l", "ng/l", "ug/l", "g/l", "mg/dl", "mg/ml"), 2):
        assert weighted_distance(typed, unit, 1.0, UNITS) > 1.0
