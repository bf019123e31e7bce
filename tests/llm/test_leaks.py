import random
import unicodedata

from tidemark.llm.leaks import LEAST_RUN, Scanner, leaks, normalised, with_offsets


def runs(doc, item, least):
    d, t = normalised(doc), normalised(item)
    return any(t[k : k + least] in d for k in range(len(t) - least + 1))


def test_against_every_window(spark):
    draw = random.Random(8)
    han = "胰腺头部可见低密度灶与门静脉关系切面"
    items = [(i, "zh", "".join(draw.choice(han) for _ in range(60))) for i in range(6)] + [(i, "en", " ".join("".join(draw.choice("abcdef") for _ in range(5)) for _ in range(30))) for i in range(6, 10)]
    docs = []
    for n in range(150):
        _, lang, text = draw.choice(items)
        least = 25 if lang == "zh" else 72
        a = draw.randrange(len(text) - 10)
        part = text[a : a + least + draw.randint(-4, 4)]
        if draw.random() < 0.5:
            part = " ".join(part[k : k + 7] for k in range(0, len(part), 7)).upper().replace("可", "可，\n")
        docs.append((n, "前缀" * draw.randint(0, 3) + part + "尾"))
    docs += [(900, None), (901, ""), (902, items[0][2] * 500), (903, "ＡＢ" + items[7][2])]
    extra = [(50, "zh", "短"), (51, "zh", None), items[0], (None, "zh", "x" * 99)]
    got = leaks(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, at int"), spark.createDataFrame(items + extra, "item_id bigint, lang string, text string")).collect()
    expected = {(d, i) for d, t in docs if t for i, lang, text in items if runs(t, text, 25 if lang == "zh" else 60)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    by_id, texts = {i: t for i, _, t in items}, dict(docs)
    for r in got:
        passage = normalised(texts[r["doc_id"]][r["at"] : r["until"]])
        assert passage in normalised(by_id[r["item_id"]]) and len(passage) >= 25


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, lang string, text string")
    assert leaks(docs, items).count() == 0
    assert leaks(docs.where("false"), spark.createDataFrame([(1, "zh", "胰" * 40)], "item_id bigint, lang string, text string")).count() == 0


def test_pieces_fold_as_the_whole():
    draw = random.Random(4)
    letters = ["a", "e", "\u0301", "\u0323", "가", *unicodedata.normalize("NFD", "각한"), "ﬁ", "ｶ", "ﾞ", "が", "\u3099", "℃", "İ", "ß", " ", "，", "…", "①", "肝", "\u0cc6", "\u0cc2", "\u09c7", "\u09be"]
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 12)))
        plain, starts, ends = with_offsets(text)
        assert plain == normalised(text), ascii(text)
        assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends)) and starts == sorted(starts)


def test_decomposed_text():
    item = "".join(chr(0xAC00 + 588 * i + 28 * (i % 21) + 1 + i % 27) for i in range(19)) * 3
    body = unicodedata.normalize("NFD", item)
    found = Scanner([(1, "ko", item)], LEAST_RUN | {"ko": 25}).spans("앞 café " + body + " 뒤")
    assert found == {1: (7, 7 + len(body))}


def test_many_items_in_one_text():
    # 50 items share their first block; one scan tells them all apart
    draw = random.Random(2)
    shared = "".join(draw.choice("胰腺头部可见低密度灶与门静脉关系切面") for _ in range(13))
    items = [(i, "zh", shared + "".join(draw.choice("肝胆脾胃肠肾肺心脑血骨皮") for _ in range(30))) for i in range(50)]
    scanner = Scanner(items + [(99, "zh", items[0][2])], LEAST_RUN)
    text, at = "", {}
    for i, _, passage in items:
        text += "ＸＹ。"
        at[i] = (len(text), len(text) + len(passage))
        text += passage
    assert scanner.spans(text) == at | {99: at[0]}
