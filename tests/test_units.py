from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelforge.operators import units

TEXTS = {
    "0 ha 76 a 02 ca": 7602, "3ha36a36ca": 33636, "01HA 38A 94CA": 13894, "O ha 31 a O4 ca": 3104, "O ha 4O a O6 ca": 4006, "2 ha O9 a 95 ca": 20995,
    "ha : 0 / a : 33 / ca : 19": 3319, "0 ha 75 a 39 ca (soit 7 539 m²)": 7539, "0,1463 ha, soit 14 a 63 ca": 1463, "1.1998 ha, soit 119 a 98 ca": 11998,
    "15 ares 64 centiares": 1564, "1 are 97 centiares": 197, "2339 ca": 2339, "0,001130 km2": 1130, "0.002079 km²": 2079, "62,83a": 6283, "26,87 ares": 2687,
    "8912 mètres carrés": 8912, "1006 M2": 1006, "634m²": 634, "5 006 m²": 5006, "1 620 m²": 1620, "14 868 m²": 14868, "671 m² env.": 671,
    "1 hectare 70 ares 90 centiares": 17090, "11,7202 hectares": 117202, "Cont. 0ha 32a 86ca": 3286, "contenance : 0ha 27a 27ca": 2727, "3 ha 64 ca": 30064, "22 a": 2200,
    "  58 a 98 ca ": 5898, "voir plan": None, "néant": None, "?": None, "": None, None: None, "0,0693": None, "à mesurer": None,
}


def test_texts(spark):
    df = spark.createDataFrame([(k,) for k in TEXTS], "t string")
    got = {r.t: r.a for r in df.select("t", units.text_area(units.clean_quantity(F.col("t"))).alias("a")).collect()}
    assert {k: None if v is None else round(v) for k, v in got.items()} == TEXTS


ROWS = "verif_id bigint, source string, contenance_ha double, contenance string, verified_at timestamp"
UNITS = "source string, unit string, valid_from timestamp, valid_to timestamp"
JUL = datetime(2023, 7, 1)
SOURCES = [("n", "ha", None, JUL), ("n", "m2", JUL, None), ("l", "1000 m2", None, None), ("x", "furlong", None, None)]


def run(spark, rows, **k):
    u = spark.createDataFrame(SOURCES, UNITS)
    return {r.verif_id: r for r in units.common_areas(spark.createDataFrame(rows, ROWS).selectExpr("*", "'a' as area", "1 as factor"), u, **k).collect()}


def test_source_units_at_the_time(spark):
    before, after = datetime(2023, 6, 30, 23), datetime(2023, 7, 1)
    rows = [
        (1, "n", 0.5, None, before), (2, "n", 5000.0, None, after), (3, "l", None, "2,5", after), (4, "l", 9.9, "30 a", after), (5, "n", None, "voir plan", after),
        (6, "n", None, None, after), (7, "n", float("nan"), " 1 200 ", after), (1, "n", 0.5, None, before), (8, "n", 0.0, None, after), (9, "n", -3.0, None, after),
    ]
    got = {k: v.area_m2 for k, v in run(spark, rows).items()}
    assert got == {1: 5000, 2: 5000, 3: 2500, 4: 3000, 7: 1200, 8: 0}


def test_missing_units_are_fitted(spark):
    rng = np.random.default_rng(1)
    areas = np.exp(rng.normal(8.0, 0.5, 3000))
    known = [(i, "n", float(a) / 1e4, None, datetime(2022, 1, 1)) for i, a in enumerate(areas[:2000])]
    open_ = [(10_000 + i, "who", float(a) / (1e4 if i % 2 else 1.0), None, datetime(2022, 1, 1)) for i, a in enumerate(areas[2000:])]
    got = run(spark, known + open_)
    right = [abs(got[10_000 + i].area_m2 - a) < 0.02 * a + 1 for i, a in enumerate(areas[2000:])]
    assert np.mean(right) > 0.97
    assert all(got[10_000 + i].unit_from == "fitted" for i in range(1000))
    wrong = [got[10_000 + i] for i, ok in enumerate(right) if not ok]
    assert all(w.posterior < 0.999 for w in wrong)


def test_null_source_is_fitted_and_flagged(spark):
    got = run(spark, [(1, None, 7.0, None, None), (2, "n", 1.0, None, datetime(2022, 1, 1))])
    assert got[1].unit_from == "fitted" and got[2].area_m2 == 10000


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("name", ["ha", "HA", " a ", "m²", "1000  m²", "km2"])
def test_unit_names(spark, name):
    assert spark.createDataFrame([(name,)], "u string").select(units.unit_factor(F.col("u"))).first()[0]
