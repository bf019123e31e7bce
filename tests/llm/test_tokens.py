import os
import random

import pytest

from tidemark.llm import tokens

PATH = tokens.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary here")
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aaab", "ab 1,'", "'sltre", "  \n\t a", "胰腺头部可见", "01 23", "é\U0001f600ñ-", "!?.'\"", "acaaagcttgacc"]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(PATH)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_tree_equals_whole(enc, alphabet):
    draw = random.Random(alphabet)
    for limit in (1, 2, 3, 5, 17):
        for _ in range(25):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 160)))
            parts = tokens.halves(text, limit)
            assert "".join(p for p, _ in parts) == text
            got = tokens.join_tree(enc, [tokens.encode_piece(enc, p) for p, _ in parts], [s for _, s in parts])
            assert got == enc.encode_ordinary(text), (text, limit)


def test_corpus(spark, enc):
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefgh") for _ in range(3000))
    texts = [None, "", " ", "plain text, 12.5 mg", "<|endoftext|> 胰腺", long, long, "word " * 900, "胰" * 2500, "\n" * 2100]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "n bigint, t string, ids array<int>")
    rows = tokens.encode_corpus(df, "n", "t", PATH, split_chars=500).collect()
    assert {r["id"]: list(r["ids"]) for r in rows} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert all(enc.decode(r["ids"]) == (texts[r["id"]] or "") for r in rows)
    assert tokens.encode_corpus(df.where("false"), "n", "t", PATH).count() == 0
    assert tokens.encode_corpus(df.where("n = 5").unionByName(df.where("n = 5")), "n", "t", PATH, 500).count() == 2
