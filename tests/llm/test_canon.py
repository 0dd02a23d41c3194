import random

from pyspark.sql import functions as F

from parcelforge.llm import canon

REF = "nom string, code string, dep string, list_pos int"
LIST = [("Fercereuil-sur-Suippelle", "1", "52", 0), ("Fercereuil", "2", "52", 1), ("Sainte-Barmauroy", "3", "10", 2), ("Barpozac", "4", "08", 3), ("Barpozac", "5", "51", 4), ("L'Édomlacourt", "6", "52", 5), ("Orsforoy-le-Grand", "7", "08", 6), ("Orsforoy-le-Petit", "8", "08", 7)]
CASES = [
    ("Fercereuil-sur-Suippell", None, "1"), ("fercereuil s/ suippelle", None, "1"), ("LA COMMUNE DE FERCEREUIL", None, "2"), ("Mairie de Ste.-Barmauroy (chef-lieu)", None, "3"),
    ("Sainte-Barrnauroy", None, "3"), ("Sainte-Barmau", None, "3"), ("Barp0zac", "51", "5"), ("Barpozac", "08", "4"), ("Barpozac (51)", None, "5"), ("Barpozac", None, "4"), ("  L'Ed0mlacourt ", None, "6"),
    ("Orsforoy-le-Gd", None, "7"), ("Orsforoy - le - Pt", None, "8"), ("Uhalezenigoity-sur-Suippelle", None, "unmatched"), ("LA SECTION ZA", None, "unmatched"), ("Kergadoret-sur-Barpoza", None, "4"), ("Kergadoret-sur-Barpaz", None, "unmatched"), ("Orsf0roiii-le-Pt, représentée par son maire", None, "8"), ("9444", None, "unmatched"), ("?", "52", "unmatched"),
    ("mot " * 3000 + "Sainte-Barmauroy", None, "3"),
]


def run(spark, cands, ref=LIST):
    df = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(cands)], "cand_id bigint, candidate string, dep string").selectExpr("*", "'x' as code", "'y' as w", "1 as n")
    rows = canon.map_names(df, spark.createDataFrame(ref, REF)).collect()
    assert len({r.cand_id for r in rows}) == len(rows)
    return {r.cand_id: r.code for r in rows}


def test_cases(spark):
    got = run(spark, [(c, d) for c, d, _ in CASES] + [(None, "52"), ("", None), ("  ", None)])
    assert got == {i: code for i, (_, _, code) in enumerate(CASES)}


def test_long_names(spark):
    """Entries of more words than usual, and a name broken into its letters."""
    long = [("Chef de projet du service des archives de la ville de Barmauroy le Grand", "9", "52", 8), *LIST]
    got = run(spark, [("chef de projet du service des archives de la vi1le de Barmauroy-le-Grand", None), ("S A I N T E B A R M A U R O Y", None), ("S A I N T E   B A R M A U R Z Z Z Z Z Z", None)], long)
    assert got == {0: "9", 1: "3", 2: "unmatched"}


def test_empty(spark):
    assert run(spark, [("Barpozac", None)], []) == {0: "unmatched"}
    df = spark.createDataFrame([], "cand_id bigint, candidate string, dep string")
    assert canon.map_names(df, spark.createDataFrame(LIST, REF)).count() == 0


def test_pigeonhole_loses_no_pair(spark):
    """Every (span, entry) pair within the allowed edits shares a probe with a segment."""
    rnd = random.Random(7)
    entries = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 22))) for _ in range(60)]
    spans = []
    for e in entries:
        for _ in range(8):
            s = list(e)
            for _ in range(rnd.randrange(5)):
                p = rnd.randrange(len(s) + 1)
                s[p : p + rnd.randrange(2)] = rnd.choice(["", "a", "d"])
            spans.append("".join(s))
    spans = [s for s in spans if s]
    ents = spark.createDataFrame(list(enumerate(entries)), "e_id bigint, e_fold string").withColumn("e_len", F.length("e_fold")).withColumn("e_k", canon.edits_of(F.col("e_len")))
    longest = max(map(len, entries))
    sp = spark.createDataFrame([(s,) for s in set(spans)], "s_fold string").withColumn("n", F.length("s_fold"))
    probes = sp.join(canon.probe_plan(spark, longest), "n").withColumn("p_text", F.expr("substring(s_fold, pos, size)"))
    met = {(r.s_fold, r.e_id) for r in probes.join(canon.segment_index(ents), ["p_len", "p_seg", "p_text"]).select("s_fold", "e_id").distinct().collect()}
    near = sp.crossJoin(ents).where("levenshtein(s_fold, e_fold) <= e_k").select("s_fold", "e_id").collect()
    assert len(near) > 300
    assert {(r.s_fold, r.e_id) for r in near} <= met
