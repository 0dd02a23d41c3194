import random

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import files, geometry
from parcelforge.functions.text import alnum_count, normalize_label, normalize_match, strip_accents
from parcelforge.operators import communes as C
from parcelforge.operators import layout as Y
from parcelforge.operators import lines as L
from parcelforge.operators import pages as G
from parcelforge.operators import parcels as P
from parcelforge.operators import verify as V
from parcelforge.plans.document import document_records


def docs(spark, *texts, filename="52003_BE_19900817.pdf"):
    return spark.createDataFrame([(i, filename, t) for i, t in enumerate(texts)], "doc_id bigint, filename string, text string")


def parcels(spark, text):
    rows = P.document_parcels(docs(spark, text)).orderBy("ord").collect()
    return [(r.section, r.number) for r in rows]


FOUND = [
    ("Cadastrée Section V N° 12.", [("V", "12")]),
    ("cadastrée section A n° 38", []),
    ("A1 / A2", []),
    ("A1, A2", [("A", "1"), ("A", "2")]),
    ("Section ZB 12A", []),
    ("Section ZB 12345", [("ZB", "1234")]),
    ("Section ZB 00 et section ZB 0", [("ZB", "00")]),
    ("ZA1, ZA3 et BS55", [("ZA", "1"), ("ZA", "3"), ("BS", "55")]),
    ("B132 / B133 et\nZS10", [("B", "132"), ("B", "133"), ("ZS", "10")]),
    ("parcelle cadastrée A 38, et parcelles cadastrées zb 7", [("A", "38"), ("ZB", "7")]),
    ("Références cadastrales\nZA 15,6790 ha", []),
    ("Références cadastrales\n078 ZA 15,6790 ha", [("ZA", "1")]),
    ("Références cadastrales\nA 38 LES TRIOTS\nTOTAL DE LA SURFACE\nB 793 X", [("A", "38")]),
    ("Article 2 - Références cadastrales\nZW 22 4 ha", [("ZW", "22")]),
    ("Références cadastrales\n\nZW 22 PRE\n\n\nZX 23 PRE", [("ZW", "22")]),
    ("[TABLEAU DETECTE]\nZA 12 LES GRANDS PRES\n[FIN TABLEAU]\nZB 13 PRE", [("ZA", "12")]),
    ("[TABLEAU DETECTE]\nx\n..\nZA 12\n[FIN TABLEAU]", []),
    ("FIGURANT AU CADASTRE\n[TABLEAU DETECTE]\nZA 12 LES GRANDS PRES\n[FIN TABLEAU]\nZB 13 PRE", [("ZA", "12")]),
    ("", []),
]


@pytest.mark.parametrize("text, want", FOUND)
def test_parcels(spark, text, want):
    assert parcels(spark, text) == want


def test_invalid_sections():
    assert len(P.NO_SECTIONS) == 27


def test_null_and_empty(spark):
    assert P.document_parcels(docs(spark, None)).count() == 0
    assert P.document_parcels(docs(spark, "x").limit(0)).count() == 0


def scan(lines):
    """Line by line model of the context."""
    norm = [x for x in lines]
    out, ctx, block, blanks = [], False, False, 0
    for i, x in enumerate(norm):
        if x == "TABLEAU DETECTE":
            inside = []
            for y in norm[i + 1 : i + 200]:
                if y == "FIN TABLEAU":
                    break
                if y:
                    inside.append(sum(c.isalnum() for c in y))
            block, ctx, blanks = True, bool(inside) and sum(inside) / len(inside) >= 8, 0
        elif x == "FIN TABLEAU":
            block, ctx, blanks = False, False, 0
        elif not block and "REFERENCE CADASTRALE" in x:
            ctx, blanks = True, 0
        elif "SURFACE TOTALE" in x:
            ctx, blanks = False, 0
        elif ctx and not block and not x:
            blanks += 1
            ctx = blanks < 2
        else:
            blanks = 0
            if ctx and not block and x.startswith("ARTICLE "):
                ctx = False
            elif ctx:
                out.append(i)
    return out


def test_context_is_the_sequential_one(spark):
    rnd = random.Random(3)
    pick = ["TABLEAU DETECTE", "FIN TABLEAU", "REFERENCE CADASTRALE", "SURFACE TOTALE", "", "", "ARTICLE 3", "ZA 12 LES PRES", "X", "ZB 1"]
    texts = [[rnd.choice(pick) for _ in range(rnd.randrange(1, 14))] for _ in range(1500)]
    texts = [t if t[-1] else [*t, "X"] for t in texts]
    got = {}
    for r in L.line_context(L.text_lines(docs(spark, *("\n".join(t) for t in texts)))).where("scanned").select("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == scan(t), t


def clean(lines):
    keep, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and 1 <= len(lines[j].strip()) <= 3:
            j += 1
        if j - i >= 3:
            i = j
            continue
        keep += range(i, max(j, i + 1))
        i = max(j, i + 1)
    keep = [k for k in keep if not lines[k].strip() or any(c.isalnum() for c in lines[k])]
    return [k for n, k in enumerate(keep) if lines[k].strip() or n == 0 or lines[keep[n - 1]].strip()]


def test_cleaning_is_the_sequential_one(spark):
    rnd = random.Random(4)
    texts = [[rnd.choice(["", "", "ab", "x", "--", "long line", "*****", " "]) for _ in range(rnd.randrange(1, 14))] for _ in range(1500)]
    rows = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t)]
    got = {}
    for r in L.clean_lines(spark.createDataFrame(rows, "doc_id bigint, line_no int, raw string")).collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == clean(t), t


def table(words):
    ws = sorted((w for w in words if w[2].strip() and w[3] >= 20), key=lambda w: (w[5] + w[7] // 2, w[4], w[1]))
    if not ws:
        return []
    tol, rows, anchor = max(sorted(w[7] for w in ws)[len(ws) // 2] // 2, 10), [], None
    for w in ws:
        cy = w[5] + w[7] // 2
        if anchor is None or abs(cy - anchor) > tol:
            rows.append([])
            anchor = cy
        rows[-1].append(w)
    out = []
    for row in rows:
        s, right = "", 0
        for w in sorted(row, key=lambda w: (w[4], w[5] + w[7] // 2, w[1])):
            s += ("" if right <= 0 else "    " if w[4] - right > 40 else " ") + w[2].strip()
            right = w[4] + w[6]
        out.append(s)
    return out


def test_table_rows_are_the_greedy_ones(spark):
    rnd, rows = random.Random(5), []
    for d in range(200):
        for i in range(rnd.randrange(1, 12)):
            rows.append((d, i, rnd.choice(["a", "b", " ", "c d"]), rnd.randrange(100), rnd.randrange(200), rnd.randrange(60), rnd.randrange(5, 60), rnd.randrange(4, 40)))
    df = spark.createDataFrame(rows, "doc_id bigint, word_idx int, text string, conf int, lft int, top int, width int, height int").withColumn("page_no", F.lit(1))
    got = {}
    for r in Y.table_rows(df).orderBy("doc_id", "row_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    for d in range(200):
        assert got.get(d, []) == table([r for r in rows if r[0] == d])


def commune(spark, text):
    r = C.document_communes(L.text_lines(docs(spark, text))).collect()
    return r[0].candidate if r else None


@pytest.mark.parametrize(
    "text, want",
    [
        ("LA COMMUNE DE LATRECEY-ORMOY-SUR-AUBE", "LATRECEY-ORMOY-SUR-AUBE"),
        ("commune d'Ormoy", None),
        ("commune d' Ormoy", "ORMOY"),
        ("LA COMMUNE DE\n\nOrmoy-sur-Aube, AU CONSERVATOIRE\nCOMMUNE DE ORMOY", "ORMOY-SUR-AUBE"),
        ("COMMUNE DE\n\n\nOrmoy", None),
        ("COMMUNE DE Vaudry - chef-lieu", "VAUDRY"),
        ("COMMUNE DE abc", None),
        ("rien", None),
    ],
)
def test_commune(spark, text, want):
    assert commune(spark, text) == want


def test_containment_and_ties(spark):
    c = spark.createDataFrame([("Bar", "1", "10", 0), ("Bar-sur-Aube", "2", "10", 1), ("Épernay", "3", "51", 2), ("Epernay", "4", "51", 3), ("", "5", "51", 4)], "nom string, code string, dep string, list_pos int")
    names = spark.createDataFrame([("commune de BAR SUR AUBE et Bar",), ("ÉPERNAY",), ("ar",), ("",), (None,), ("Reims",)], "candidate string")
    got = {r.candidate: r.code for r in C.match_names(names, c).collect()}
    assert got == {"commune de BAR SUR AUBE et Bar": "2", "ÉPERNAY": "3", "ar": "2"}


def test_french_order(spark):
    c = spark.createDataFrame([(n, n, "51", i) for i, n in enumerate(["Zola", "epinal", "Épernay", "Aube"])], "nom string, code string, dep string, list_pos int")
    assert [r.nom for r in C.commune_list_collated(c).orderBy("ord").collect()] == ["Aube", "Épernay", "epinal", "Zola"]
    assert [r.nom for r in C.commune_list(c).orderBy("ord").collect()] == ["Aube", "Zola", "epinal", "Épernay"]


def test_filename(spark):
    df = docs(spark, "x", filename="/a/52003_be_99999999.tar.PDF").unionByName(docs(spark, "x", filename="52003_SCAN_SANS_TYPE_19900817.pdf"))
    got = [tuple(r)[3:] for r in files.with_filename(df).collect()]
    assert got == [("52003", "BE", "9999-99-99", "52003_be_99999999.tar.PDF"), (None, None, None, "52003_SCAN_SANS_TYPE_19900817.pdf")]


def test_labels(spark):
    df = spark.createDataFrame([("[TABLEAU  DETECTE]", "Nº ½ œuvre É"), (" a - b. ", "é")], "a string, b string")
    r = df.select(normalize_label(F.col("a")), normalize_match(F.col("b")), strip_accents(F.col("b")), alnum_count(F.col("a"))).collect()
    assert r[0][0] == "TABLEAU DETECTE" and r[1][0] == "A-B"
    assert r[0][2] == "No 1⁄2 œuvre E" and r[1][1] == "E" and r[0][3] == 14


def test_image_pages(spark):
    rows = [(1, 1, 1), (2, 1, 1), (2, 2, 0), (3, 1, 1), (3, 2, 1), (3, 3, 0), (3, 3, 0), (4, 1, None)]
    got = {r.doc_id: r.usable for r in G.digital_usable(spark.createDataFrame(rows, "doc_id bigint, page_no int, n_images int")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_skip_limit(spark):
    df = spark.createDataFrame([("annexe 1 " + "a" * 293,), ("annexe 1 " + "a" * 294,), ("Annexe 2 plan de situation",)], "t string")
    assert [r[0] for r in df.select(G.skip_reason(F.col("t"))).collect()] == ["annexe 1", None, "plan de situation"]


def test_bbox(spark):
    df = spark.createDataFrame([("1,2,3,4",), (",2,3,4",), ("1,2,3",), ("a,2,3,4",)], "t string").select(geometry.parse_bbox(F.col("t")).alias("b"))
    got = [None if r.b is None else tuple(r.b) for r in df.collect()]
    assert got == [(1, 2, 3, 4), (0, 2, 3, 4), None, None]
    b = spark.range(1).select(geometry.adjust_bbox(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("b"), geometry.adjust_bbox(*map(F.lit, (1.0, 0.0, 1.0, 1.0))).alias("n")).first()
    assert b.n is None and abs((b.b.max_x - b.b.min_x) * (b.b.max_y - b.b.min_y) - 0.1) < 1e-9


def test_none_confirmed_keeps_all(spark):
    df = spark.createDataFrame([(1, "a", False), (1, "b", False), (2, "a", True), (2, "b", False), (3, "a", None)], "doc_id bigint, section string, ign_verified boolean")
    got = sorted((r.doc_id, r.section) for r in V.confirmed_or_all(df).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (3, "a")]


def test_record(spark):
    c = spark.createDataFrame([("Ormoy-sur-Aube", "52370", "52", 0)], "nom string, code string, dep string, list_pos int")
    ref = spark.createDataFrame(
        [("52370", "0V", "0012", "523700000V0012", None, "Ormoy", None, 12345, ("Polygon", "[[[1.0,2.0],[3.0,4.5],[1.0,2.0]]]"))],
        "code_insee string, section string, numero string, idu string, code_parcelle string, nom_com string, nom_commune string, contenance bigint, geometry struct<type:string,coordinates:string>",
    ).selectExpr("*", "timestamp'2020-01-01' as loaded_at", "cast(null as timestamp) as deleted_at")
    text = "BAIL\n EMPHYTÉOTIQUE\nLA COMMUNE DE ORMOY SUR AUBE\nCadastrée Section V N° 12. Section ZB n° 9"
    r = {x.doc_id: x for x in document_records(docs(spark, text, None, filename="x.pdf"), c, ref).collect()}
    assert (r[0].commune, r[0].code_insee, r[0].document_type, r[0].document_type_label) == ("Ormoy-sur-Aube", "52370", "BE", "BAIL EMPHYTEOTIQUE")
    assert [tuple(p) for p in r[0].cadastral_parcels] == [("V", "12", True, "523700000V0012", "Ormoy", 1.2345, "1.0,2.0,3.0,4.5")]
    assert r[1].cadastral_parcels == [] and r[1].commune is None


def test_spaces_of_any_kind(spark):
    """No-break spaces separate in the section rules; a line of tabs is blank to the commune rule and to cleaning."""
    nb = "\u00a0"
    df = spark.createDataFrame([(1, f"Section{nb}ZB{nb}12"), (2, f"cadastrée{nb}Section{nb}AB{nb}n°{nb}7")], "doc_id bigint, text string")
    got = {(r.doc_id, r.section, r.number) for r in P.document_parcels(df).collect()}
    assert got == {(1, "ZB", "12"), (2, "AB", "7")}
    text = spark.createDataFrame([(1, f"LA COMMUNE DE\n \t{nb}\nOrmoy-sur-Aube")], "doc_id bigint, text string")
    assert [r.candidate for r in C.document_communes(L.text_lines(text)).collect()] == ["ORMOY-SUR-AUBE"]


CLEANED = {
    "a\nb\t\n\u00a0cd\nDu texte": "Du texte", "a\nb\nDu texte": "a\nb\nDu texte", "Du texte\n \t\n\n\u00a0\nfin": "Du texte\n\nfin", "--\nDu texte\n..": "Du texte", "": "", "x\ny\nz": "",
    "Un\nde\n\nla\nle mot\na\nb\nc\nd\nfin du texte": "Un\nde\n\nla\nle mot\nfin du texte",
}


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(CLEANED)), "doc_id int, text string")
    got = {r.text: r.c for r in df.select("text", L.clean_text(F.col("text")).alias("c")).collect()}
    assert got == CLEANED
    rows = L.clean_lines(df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))).orderBy("doc_id", "line_no").collect()
    texts = list(CLEANED)
    for i, t in enumerate(texts):
        assert "\n".join(r.raw for r in rows if r.doc_id == i) == CLEANED[t]


def test_display_is_cleaned_and_analysis_is_raw(spark):
    pages = spark.createDataFrame([(1, 1, "--\nDu texte"), (1, 2, None), (1, 3, "...")], "doc_id bigint, page_no int, text string")
    tables = spark.createDataFrame([(1, 1, 1, "ZA 1")], "doc_id bigint, page_no int, table_no int, text string")
    other = spark.createDataFrame([(1, 2, 0, "un"), (1, 2, 1, "deux"), (1, 2, 2, "trois"), (1, 3, 0, "quatre")], "doc_id bigint, page_no int, pos int, text string")
    r = G.dual_texts(pages, tables, other).first()
    assert r.display_text == "--- Page 1 ---\nDu texte\n\n[TABLEAU DETECTE]\nZA 1\n[FIN TABLEAU]"
    assert r.analysis_text == "--- Page 1 ---\n--\nDu texte\n\nZA 1\n\n--- Page 2 ---\nun\n\ndeux\n\n--- Page 3 ---\n..."


def test_coordinates_in_full(spark):
    values = [4.1234567, 48.0, 0.00052, -0.0001234567, 0.0, 12345678.25]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "x double").select(geometry.coordinate_text(F.col("x")).alias("t")).collect()]
    assert got == ["4.1234567", "48.0", "0.00052", "-0.0001234567", "0.0", "12345678.25"]


def test_word_signs_and_line_ends(spark):
    s = spark.createDataFrame([("a_b\r\x0b c\u2028\u00a0\u2028d",)], "t string").select(Y.text_score(F.col("t")).alias("s")).first().s
    assert (s.alnum, s.filled_lines) == (5, 3)
