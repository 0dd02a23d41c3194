import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import encode

signs = st.sampled_from(["'", " ", "  ", "\n", " \n", "r", "re", "'re", "'s", "l", "'ll", "é", "12", "3", "!", "--", "a", "bc", " ", "日本", "😀", "\t", "x'", "<|endoftext|>"])


def tree(text, leaf):
    return encode.join_tree(text, [encode.encode_leaf(text[i : i + leaf], i) for i in range(0, len(text), leaf)])


@settings(max_examples=1500, deadline=None)
@given(st.lists(signs, min_size=1, max_size=60).map("".join), st.integers(1, 14))
def test_tree_is_the_whole(text, leaf):
    assert np.array_equal(tree(text, leaf), encode.encode_whole(text))


@pytest.mark.parametrize("text", ["a" * 70_000, " " * 50_000 + "x", "12" * 30_000, "ab cd " * 9_000])
def test_long_runs(text):
    assert np.array_equal(tree(text, 1 << 12), encode.encode_whole(text))


def test_other_library_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for s in ("Cour d'appel, n° 12 — « été »", "<|endoftext|>", "  \n\n x", "Ünïcödé 日本 😀"):
        assert t.encode(s, add_special_tokens=False).ids == encode.encode_whole(s).tolist()


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "x y" * 40), (5, "l'été " * 300), (5, "l'été " * 300), (6, "ab" * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as ids", "3 as whole")
    got = encode.encode_texts(df, leaf=100).collect()
    assert len(got) == len(rows)
    want = {i: encode.encode_whole(t).tolist() if t else [] for i, t in rows}
    assert all(r.ids == want[r.doc_id] for r in got)
    assert encode.encode_texts(df.limit(0)).count() == 0
