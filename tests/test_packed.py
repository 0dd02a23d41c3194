import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.operators.packed import parse_packed, split_packed

CASES = {
    "  D858, A 420, A 245 (2,7434 ha), 107 ZM 520 ": ["D858", "A 420", "A 245 (2,7434 ha)", "107 ZM 520"],
    '"F 790 ""Les Crayère, bas"""|"G 947 | Haut de Rochotte"': ['F 790 "Les Crayère, bas"', "G 947 | Haut de Rochotte"],
    '«G 688 Champ Pâtis et Épinette» et "A 416 Haut et bas" et ZA641': ["G 688 Champ Pâtis et Épinette", "A 416 Haut et bas", "ZA641"],
    "ZG 463;037 ZR 490": ["ZG 463", "037 ZR 490"], "ZA 12/13": ["ZA 12/13"], "ZB 12 à 15, ZC1": ["ZB 12 à 15", "ZC1"], "a,, ;b": ["a", "b"], "BETE et ÉTET": ["BETE", "ÉTET"],
    "": [], "  \t ": [], '""': [], "A1\net B2": ["A1", "B2"], "« ZP 134 »; H n° 353": ["ZP 134", "H n° 353"], "ZA 5 / ZB 6+ZC 7": ["ZA 5", "ZB 6", "ZC 7"],
}


@pytest.mark.parametrize("text", list(CASES))
def test_values(text):
    assert [v for v, bad in parse_packed(text)] == CASES[text]
    assert not any(bad for _, bad in parse_packed(text))


def test_malformed_quotes_backtrack():
    assert parse_packed('"ZC 1, ZD 2; A 3') == [("ZC 1", True), ("ZD 2", False), ("A 3", False)]
    assert parse_packed("A (b, c") == [("A (b", True), ("c", False)]


value = st.text("ABZ0189 °é", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=300, deadline=None)
@given(st.lists(value, min_size=1, max_size=6), st.sampled_from([";", " | ", "\n", "\t", " + "]))
def test_round_trip_quoted(values, sep):
    packed = sep.join('"' + v.replace('"', '""') + ' , x"' for v in values)
    assert [v for v, _ in parse_packed(packed)] == [f"{v} , x" for v in values]


@settings(max_examples=300, deadline=None)
@given(st.text('ab"«»(),;1 et\n', max_size=60))
def test_any_text(text):
    for v, _ in parse_packed(text):
        assert v and v == v.strip()


def test_long_texts_take_linear_time():
    for text in ("1," * 200_000, '"a,' * 60_000, "(a," * 60_000, "«" * 60_000, '"' * 60_001):
        began = time.time()
        parse_packed(text)
        assert time.time() - began < 5


def test_split(spark):
    df = spark.createDataFrame([(1, "a, b", 9), (2, None, 9), (3, " ", 9), (1, "a, b", 9)], "doc_id bigint, parcelles string, pos int").withColumnRenamed("pos", "value")
    assert sorted((r.doc_id, r.pos, r.value) for r in split_packed(df, "doc_id", "parcelles").collect()) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_packed(df.limit(0), "doc_id", "parcelles").count() == 0
