import pytest
from pyspark.sql import functions as F

from parcelforge.operators import communes as C
from parcelforge.operators import features as N

SQUARE = "[[[{0},{0}],[{1},{0}],[{1},{1}],[{0},{1}],[{0},{0}]]]"
ROWS = [
    ("a", "10", 0, 1), ("b", "10", 2, 3), ("c", "11", 2, 4), ("d", "", 1, 2), ("e", None, 9, 10), ("f", None, 2, 2), ("b", "10", 2, 3),
]


@pytest.fixture(scope="module")
def parcels(spark):
    rows = [(i, i, c, ("Polygon", SQUARE.format(x, y))) for i, c, x, y in ROWS] + [("g", "g", "10", ("Point", "[1,1]")), ("h", "h", "10", None)]
    df = spark.createDataFrame(rows, "idu string, code_parcelle string, code_insee string, geometry struct<type:string,coordinates:string>")
    return N.with_envelope(df.withColumn("c_min_x", F.lit(1)))


def idus(df):
    return [r.idu for r in df.collect()]


def test_box(parcels):
    assert sorted(idus(N.in_box(parcels, (1.5, 1.5, 2.5, 2.5)))) == ["b", "b", "c", "d", "f"]
    assert idus(N.in_box(parcels, (1.5, 1.5, 2.5, 2.5), ("idu",), 3)) == ["b", "b", "c"]
    assert idus(N.in_box(parcels, (50, 50, 51, 51))) == [] and idus(N.in_box(parcels, (0, 0, 9, 9), most=0)) == []
    with pytest.raises(ValueError):
        N.in_box(parcels, (2, 0, 1, 1))
    with pytest.raises(ValueError):
        N.in_box(parcels, (0, 0, 1, 1), most=-1)


def test_commune(parcels):
    assert sorted(idus(N.of_commune(parcels, "10"))) == ["a", "b", "b", "d", "f"]
    assert idus(N.of_commune(parcels, "10", ("idu",), 2)) == ["a", "b"]
    assert idus(N.of_commune(parcels, "99")) == []
    assert idus(N.of_commune(parcels.limit(0), "10")) == []


def test_layer(parcels):
    assert idus(N.layer(parcels, {"code_insee": "11"}, columns=("idu",))) == ["c"]
    assert idus(N.layer(parcels, {"code_insee": "10' OR 1=1 --"})) == []
    assert idus(N.layer(parcels, {"code_insee": "10"}, (0, 0, 1, 1), ("idu",), order=("idu",))) == ["a"]
    assert len(idus(N.layer(parcels, most=None))) == 9


def test_commune_details(spark):
    communes = spark.createDataFrame([("1", "A", "52"), ("2", "B", "10")], "code string, nom string, dep string")
    asked = spark.createDataFrame([("2",), ("2",), ("3",), (None,)], "c string")
    assert [tuple(r) for r in C.commune_details(communes, asked, "c").collect()] == [("2", "B", "10")]
