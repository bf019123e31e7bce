import datetime as dt
import itertools
import random

import pytest

from tidemark.operators.timestamps import AGAINST_DECLARED, BACKWARD_JUMP, FORMAT_SWITCH, _viterbi, normalise_times

SOURCES = [("shanghai", "Asia/Shanghai", "ymd"), ("york", "America/New_York", "mdy"), ("berlin", "Europe/Berlin", "dmy"), ("open", "UTC", None), ("chicago", "America/Chicago", "mdy")]


def us(*when):
    return int((dt.datetime(*when) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def run(spark, rows, block=1 << 18):
    df = spark.createDataFrame(rows, "id bigint, source_system string, v string, seq string, field string, zone string, us string")
    sources = spark.createDataFrame(SOURCES, "source_system string, time_zone string, date_order string")
    return {(r["id"]): (r["us"], r["dated"]) for r in normalise_times(df, "id", "source_system", ["v"], sources, block=block).collect()}


CASES = [
    ("shanghai", "2030-01-02 03:04:05", us(2030, 1, 1, 19, 4, 5)),
    ("shanghai", " ２０３０-０１-０２ ０３：０４：０５\n", us(2030, 1, 1, 19, 4, 5)),
    ("shanghai", "2030年1月2日下午3点04分", us(2030, 1, 2, 7, 4)),
    ("shanghai", "2030年1月2日上午12点04分", us(2030, 1, 1, 16, 4)),
    ("shanghai", "202903260603", us(2029, 3, 25, 22, 3)),
    ("shanghai", "1865813774", 1865813774 * 1_000_000),
    ("shanghai", "1866980958639", 1866980958639 * 1000),
    ("york", "03/04/2030 5:26 PM", us(2030, 3, 4, 22, 26)),
    ("york", "Aug 28, 2029 12:21:21 AM", us(2029, 8, 28, 4, 21, 21)),
    ("york", "2030-11-03 01:30:00", us(2030, 11, 3, 5, 30)),  # occurred twice: the earlier one
    ("york", "2030-11-03 01:30:00 EST", us(2030, 11, 3, 6, 30)),
    ("york", "2030-03-10 02:30:00", None),  # never occurred
    ("york", "2030-03-10 02:30:00 EST", us(2030, 3, 10, 7, 30)),
    ("berlin", "03.04.2030 05:26", us(2030, 4, 3, 3, 26)),
    ("berlin", "23 Jun 2029 01:54:35 CEST", us(2029, 6, 22, 23, 54, 35)),
    ("berlin", "2029-07-31 17:57:36.914254+08", us(2029, 7, 31, 9, 57, 36) + 914254),
    ("berlin", "2029-07-31T17:57:36-0330", us(2029, 7, 31, 21, 27, 36)),
    ("berlin", "2029-02-30 10:15:00", None),
    ("berlin", "2029-02-28 25:15:00", None),
    ("berlin", "N/A", None),
    ("berlin", "", None),
    ("berlin", None, None),
    ("unknown", "2030-01-02 03:04:05", None),  # no zone to place it by
    ("unknown", "2030-01-02 03:04:05Z", us(2030, 1, 2, 3, 4, 5)),
    (None, "2030-01-02T03:04Z", us(2030, 1, 2, 3, 4)),
    ("shanghai", "x" * 100_000, None),
]


def test_values(spark):
    # other columns clash with the operator's own names and are ignored
    got = run(spark, [(i, s, v, "x", "y", "z", "w") for i, (s, v, _) in enumerate(CASES)])
    assert {i: got.get(i, (None,))[0] for i in range(len(CASES))} == {i: e for i, (_, _, e) in enumerate(CASES)}


def test_dates_end_with_their_day(spark):
    got = run(spark, [(1, "shanghai", "2029-12-13", *"abcd"), (2, "berlin", "23.10.2029", *"abcd")])
    assert got == {1: (us(2029, 12, 13, 16), True), 2: (us(2029, 10, 23, 22), True)}


def test_undeclared_order_follows_its_neighbours(spark):
    rows = [(1, "open", "25/01/2030 10:00", *"abcd"), (2, "open", "02/03/2030 10:00", *"abcd"), (3, "open", "05/04/2030 11:00", *"abcd"), (4, "open", "28/06/2030 10:00", *"abcd")]
    got = run(spark, rows)
    assert got[2][0] == us(2030, 3, 2, 10) and got[3][0] == us(2030, 4, 5, 11)
    rows = [(1, "open", "01/25/2030 10:00", *"abcd"), (2, "open", "02/03/2030 10:00", *"abcd"), (3, "open", "06/28/2030 10:00", *"abcd")]
    assert run(spark, rows)[2][0] == us(2030, 2, 3, 10)


@pytest.mark.parametrize("block", [1, 2, 5, 16])
def test_blocks_change_nothing(spark, block):
    draw = random.Random(4)
    rows = [(i, draw.choice(["open", "york"]), f"{draw.randint(1, 14):02d}/{draw.randint(1, 12):02d}/2030 10:{draw.randint(10, 59)}", *"abcd") for i in range(60)]
    assert run(spark, rows, block) == run(spark, rows)


def test_no_anchor_at_all(spark):
    # every value of the source has two interpretations: the last level sees one matrix for a block and no rows
    draw = random.Random(7)
    rows = [(i, "open", f"{draw.randint(1, 12):02d}/{draw.randint(1, 12):02d}/2030 10:{draw.randint(10, 59)}", *"abcd") for i in range(400)]
    lists = []
    for _, _, v, *_ in rows:
        a, b, minute = int(v[:2]), int(v[3:5]), int(v[14:16])
        lists.append([(us(2030, b, a, 10, minute), 3, 0), (us(2030, a, b, 10, minute), 4, 0)])
    path = _viterbi(lists, list(range(400)))
    got = run(spark, rows, 32)
    # the rows' own numbers break ties; where day and month are equal both mean the same
    assert [got[i][0] for i in range(400)] == [c[k][0] for c, k in zip(lists, path)]
    assert set(path) == {0, 1} or len(set(path)) == 1


def test_abbreviations_of_several_zones(spark):
    rows = [(1, "shanghai", "2030-01-02 03:04:05 CST", *"abcd"), (2, "chicago", "2030-01-02 03:04:05 CST", *"abcd"), (3, "chicago", "2030-07-02 03:04:05 CST", *"abcd"), (4, "berlin", "2030-01-02 03:04:05 CST", *"abcd")]
    got = run(spark, rows)
    assert got[1][0] == us(2030, 1, 1, 19, 4, 5) and got[2][0] == us(2030, 1, 2, 9, 4, 5) and got[3][0] == us(2030, 7, 2, 9, 4, 5) and got[4][0] == us(2030, 1, 1, 19, 4, 5)


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "york", "2030-01-02 03:04:05")] * 2, "id bigint, source_system string, v string")
    sources = spark.createDataFrame(SOURCES * 2, "source_system string, time_zone string, date_order string")
    assert normalise_times(df, "id", "source_system", ["v"], sources).count() == 2


def test_viterbi_is_the_cheapest_path():
    draw = random.Random(1)
    for _ in range(200):
        lists = [[(draw.randint(0, 9), draw.randint(0, 2), draw.randint(0, 1)) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(1, 6))]

        def cost(path):
            steps = [c[k] for c, k in zip(lists, path)]
            return sum(s[2] * AGAINST_DECLARED for s in steps) + sum((a[1] != b[1]) * FORMAT_SWITCH + (b[0] < a[0]) * BACKWARD_JUMP for a, b in zip(steps, steps[1:]))

        paths = list(itertools.product(*[range(len(c)) for c in lists]))
        assert cost(_viterbi(lists, list(range(len(lists))))) == min(map(cost, paths))
        first, last = draw.randrange(len(lists[0])), draw.randrange(len(lists[-1]))
        if len(lists) > 1:
            assert cost(_viterbi(lists, list(range(len(lists))), first, last)) == min(cost(p) for p in paths if p[0] == first and p[-1] == last)
