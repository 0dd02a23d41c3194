import random

import numpy as np
import pyarrow as pa
import pytest

from parcelforge.llm import format_dups as fd

A = "{'code_insee':'10630','section':'ZK','numero':'0172','lieudit':'La Maladière','contenance':'0.9074'}"
SAME = [
    "CODE_INSEE: 10630\nSECTION: zk\nNUMERO: 0172\nLIEUDIT: LA-MALADIÈRE\nCONTENANCE: 0,9074",
    ' contenance = 0.9074; lieudit = (La  Maladière).; code insee = 10630; numero = 0172; section = ZK ;',
    "contenance=0,9074\tlieudit=LaMaladière\tnumero=0172\tsection=Z K\tcode_insee=10630",
    A.replace("La Maladière", "La Maladière"),
    A[:-1] + ",'nature':''}",
]
OTHER = [
    A.replace("Maladière", "Maladiere"), A.replace("0.9074", "09.074"), A.replace("0172", "172"), A.replace("0.9074", "0.90740"),
    A.replace("'section':'ZK','numero':'0172'", "'section':'0172','numero':'ZK'"), A.replace(",'contenance':'0.9074'", ""), A[:-1] + ",'nature':'sol'}",
]


@pytest.mark.parametrize("text", SAME)
def test_same(text):
    assert fd.same_record(A, text) and spelt(A) == spelt(text)
    one, two, _ = fd.record_hashes([A, text])
    assert one[0] == one[1] and two[0] == two[1]


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert not fd.same_record(A, text)
    one, _, _ = fd.record_hashes([A, text])
    assert one[0] != one[1]


def test_hashes_agree_with_spelt_out_records():
    rnd = random.Random(2)
    sign = ["section", "=", ":", " ", "numero", ";", "a", "B", "é", "1", ",", ".", '"', "\n", "code_insee", "2", "-", "{"]
    texts = ["".join(rnd.choice(sign) for _ in range(rnd.randrange(12))) for _ in range(4000)] + [None, "", "  ", "--"]
    one, two, real = fd.record_hashes(texts)
    forms = [tuple(sorted(spelt(t))) if t else () for t in texts]
    assert list(real) == [bool(s) for s in forms]
    by = {}
    for s, a, b in zip(forms, one, two, strict=True):
        if s:
            assert by.setdefault(s, (a, b)) == (a, b)
    assert len(set(by.values())) == len(by)


def test_batches_do_not_matter():
    texts = [A, *SAME, *OTHER, "x" * 100_000]
    whole = np.stack(fd.record_hashes(texts)[:2])
    assert (whole == np.concatenate([np.stack(fd.record_hashes([t])[:2]) for t in texts], axis=1)).all()


def test_copies(spark):
    rows = [(i, t) for i, t in enumerate([A, *SAME, *OTHER, None, "", " ", "''"])] + [(0, A), (None, A)] + [(100 + i, A.upper()) for i in range(50)]
    df = spark.createDataFrame(rows, "rec_id bigint, parcelles string").selectExpr("*", "1 as id", "2 as body", "3 as h1", "4 as keep_id")
    got = sorted(tuple(r) for r in fd.record_copies(df).select("keep_id", "rec_id").collect())
    assert got == [(0, i) for i in range(1, 6)] + [(0, 100 + i) for i in range(50)]
    counts = {r.rec_id: r.n_copies for r in fd.copy_counts(df).collect()}
    assert counts == {0: 56, **{i: 1 for i in range(6, 13)}}
    assert fd.record_copies(df.limit(0)).count() == 0


def test_collisions_are_told_apart(monkeypatch):
    """Rows of one hash that are different records stay apart, within a slice and over slices."""
    texts = [A, SAME[0], OTHER[0], OTHER[0].upper(), OTHER[1], A.lower(), OTHER[1].upper()]
    real = fd.record_hashes
    monkeypatch.setattr(fd, "record_hashes", lambda t, f: (np.zeros(len(t), np.int64), np.zeros(len(t), np.int64), real(t, f)[2]))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "body": texts})
    for size in (2, 3, 100):
        monkeypatch.setattr(fd, "SLICE", size)
        met = pa.Table.from_batches(fd._collapse_batches(fd.FIELDS)(iter([batch]))).to_pylist()
        first = sorted((r for r in met if r["rep"] is None), key=lambda r: r["id"])
        rows = pa.RecordBatch.from_pylist([{k: r[k] for k in ("id", "h1", "h2", "body")} for r in first])
        keep = {r["id"]: r["keep_id"] for r in pa.Table.from_batches(fd._stream_groups(fd.FIELDS)(iter([rows]))).to_pylist()}
        got = {r["id"]: keep[r["id"] if r["rep"] is None else r["rep"]] for r in met}
        assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 0, 6: 4}


def spelt(text):
    """The record in one form."""
    text, table = fd.composed(text), fd.fold_table()
    out = []
    for name, i, stop in fd._segments(text, fd.key_pattern()):
        code, i = fd._next(text, i, stop, table)
        value = []
        while code:
            value.append(chr(code))
            code, i = fd._next(text, i, stop, table)
        if value:
            out.append((name, "".join(value)))
    return sorted(out, key=lambda f: f[0])


def test_pointers_agree_with_spelt_out_records():
    rnd = random.Random(3)
    sign = ["section", "=", ":", " ", "numero", ";", "a", "B", "é", "É", "1", "2", ",", ".", '"', "\n", "-", "{", "Ω", "²", "_", "İ"]
    texts = ["".join(rnd.choice(sign) for _ in range(rnd.randrange(10))) for _ in range(3000)]
    pairs = [(a, b) for a, b in zip(texts, texts[1:], strict=False)] + [(a, a.replace(" ", "-").swapcase()) for a in texts] + [(a, a.replace(",", ".")) for a in texts]
    for a, b in pairs:
        assert fd.same_record(a, b) == (spelt(a) == spelt(b)), (a, b)
