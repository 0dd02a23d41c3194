import random
from datetime import datetime, timedelta

from parcelforge.operators import orphans

KID = "src_table string, row_id bigint, ref string, key string, t timestamp"
SPAN = "ref string, key string, t timestamp, until timestamp"
FOREVER = datetime(9999, 12, 31)


def brute(kids, spans):
    out = set()
    for src, row, ref, key, t in kids:
        own = [(a, b) for r, k, a, b in spans if (r, k) == (ref, key)]
        if t is None:
            if not own:
                out.add((src, row, ref, "missing", None))
        elif not any(a <= t < b for a, b in own):
            reason = "missing" if not own else "late" if all(a > t for a, _ in own) else "deleted"
            out.add((src, row, ref, reason, t.strftime("%Y-%m")))
    return out


def test_against_brute_force(spark):
    rnd, day = random.Random(1), datetime(2022, 1, 1)
    for _ in range(3):
        when = lambda: day + timedelta(days=rnd.randrange(200), hours=rnd.randrange(3))
        spans = []
        for _ in range(60):
            a = when()
            spans.append((rnd.choice(["idu", "parcel"]), f"k{rnd.randrange(12)}", a, rnd.choice([FOREVER, a + timedelta(days=rnd.randrange(1, 90))])))
        spans += spans[:10]
        kids = [(rnd.choice("ab"), rnd.randrange(500), rnd.choice(["idu", "parcel"]), rnd.choice([None, *[f"k{i}" for i in range(16)]]), rnd.choice([None, *[when() for _ in range(9)]])) for _ in range(400)]
        kids += [("a", 1000 + i, "idu", "k3", when()) for i in range(300)]  # a hot key
        got = {tuple(r) for r in orphans.orphan_refs(spark.createDataFrame(kids, KID), spark.createDataFrame(spans, SPAN)).collect()}
        assert got == brute([(a, b, c, d, e) for a, b, c, d, e in kids], spans)


def test_bounds_are_half_open(spark):
    a, b = datetime(2022, 5, 1), datetime(2022, 5, 20)
    spans = spark.createDataFrame([("idu", "k", a, b)], SPAN)
    kids = spark.createDataFrame([("s", 1, "idu", "k", a), ("s", 2, "idu", "k", b), ("s", 3, "idu", "k", a - timedelta(seconds=1))], KID)
    assert {(r.row_id, r.reason) for r in orphans.orphan_refs(kids, spans).collect()} == {(2, "deleted"), (3, "late")}


def test_reading_of_references(spark):
    rows = [
        (1, "  10113000ay851 ", "8425", "b", "12", datetime(2022, 1, 1)),
        (2, "", "08425", None, "12", datetime(2022, 1, 1)),
        (3, "ABC?", None, " zb ", " 0012 ", datetime(2022, 1, 1)),
        (4, None, "08425", "", "", datetime(2022, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "verif_id bigint, idu string, code_insee string, section string, numero string, t timestamp").selectExpr("*", "'x' as key", "'y' as ref", "1 as row_id")
    got = {(r.row_id, r.ref): r.key for r in orphans.child_refs(df, "v", "verif_id", "t", "idu", ("code_insee", "section", "numero")).collect()}
    assert got == {(1, "idu"): "10113|AY|0851", (1, "parcel"): "08425|0B|0012", (3, "idu"): None, (3, "parcel"): None, (4, "parcel"): "08425||0000"}


def test_empty(spark):
    kids = spark.createDataFrame([("s", 1, "idu", "k", datetime(2022, 1, 1))], KID)
    none = spark.createDataFrame([], SPAN)
    assert [r.reason for r in orphans.orphan_refs(kids, none).collect()] == ["missing"]
    assert orphans.orphan_refs(kids.limit(0), none).count() == 0


def test_parent_columns_fall_through(spark):
    rows = [("08425", "0B", "0012", None, "084250000B0012"), (None, None, None, "", "084250000C0013"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "code_insee string, section string, numero string, idu string, code_parcelle string").selectExpr("*", "timestamp'2020-01-01' as loaded_at", "cast(null as timestamp) as deleted_at")
    got = sorted((r.ref, r.key) for r in orphans.parent_spans(df).collect())
    assert got == [("idu", "08425|0B|0012"), ("idu", "08425|0C|0013"), ("parcel", "08425|0B|0012"), ("parcel", "08425|0C|0013")]
