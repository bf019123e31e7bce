import random

import pytest

from tidemark.llm.entries import canonical_rows, edits_allowed, map_entries

FORMS = [("A", "Triglycerides"), ("A", "甘油三酯"), ("B", "CA125"), ("B", "糖类抗原125"), ("C", "Na"), ("D", "血清钠"), ("E", "白蛋白"), ("F", "Frozen section report"), ("F", None), ("G", "LPS")]


def mapped(spark, entries):
    df = spark.createDataFrame([(e,) for e in entries], "entry string")
    return {r["entry"]: r["code"] for r in map_entries(df, spark.createDataFrame(FORMS, "code string, form string")).collect()}


def test_cases(spark):
    cases = {
        "Trglyceride": "A", "ＴＲＩＧＬＹＣＥＲＩＤＥＳ（复查）": "A", "甘三油酯": "A", "CA15-3": "NONE", "CA 50": "NONE", "Ca-125*": "B", "CA1225": "B", "N/A": "NONE", "na": "C", "血清血清钠": "D", "铁蛋白": "NONE",
        "白蛋白测定": "E", "fr0zen sectoin_rep ort-修订": "F", "LPSS": "G", "LPT": "NONE", "其他": "NONE", "x" * 20_000: "NONE",
    }
    got = mapped(spark, [*cases, None, "", "  ", "　", *cases])
    assert got == cases


def test_empty_and_clashing_names(spark):
    assert mapped(spark, []) == {}
    rows = spark.createDataFrame([(1, "LPS", "z"), (2, "lps ", "z"), (2, "lps ", "z"), (3, None, "z")], "row_id bigint, entry string, code string")
    got = canonical_rows(rows.select("row_id", "entry"), spark.createDataFrame(FORMS, "code string, form string")).collect()
    assert sorted(map(tuple, got)) == [(2, "G"), (2, "G")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_the_join_misses_nothing(spark, seed):
    """Every entry within its allowance of a long form is found, whatever the edits."""
    draw = random.Random(seed)
    letters = "abcdefgh"
    forms = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 14))) for _ in range(12)]
    entries = set()
    for _ in range(150):
        word = list(draw.choice(forms))
        for _ in range(draw.randint(1, 5)):
            at, kind = draw.randrange(len(word)), draw.randrange(3)
            word[at : at + (kind != 0)] = [] if kind == 1 else [draw.choice(letters)]
        entries.add("".join(word))
    allowed = lambda n: 3 if n <= 7 else 4
    assert "ELSE 4" in edits_allowed("n")
    df = spark.createDataFrame([(e,) for e in sorted(entries)], "entry string")
    got = {r["entry"]: r["edits"] for r in map_entries(df, spark.createDataFrame([(f, f) for f in forms], "code string, form string")).collect()}
    for e in entries:
        best = min((d for f in forms if (d := distance(e, f)) <= allowed(len(f))), default=None)
        assert got[e] == best
