import random

from parcelforge.llm import scan

TEXT = "Les parties conviennent que tout différend relatif aux clauses sera soumis à une tentative de conciliation. Le propriétaire déclare transmettre les immeubles désignés ci-après à la commune de Saint-Vignisart qui accepte les biens dans leur état actuel. La contenance indiquée résulte des documents fournis par le géomètre en 1984."


def run(spark, pages, lexicon=("Saint-Vignisart",)):
    df = spark.createDataFrame(pages, "doc_id bigint, page_no int, text string").selectExpr("*", "1 as n", "'x' as word", "2 as line_no")
    rows = scan.scan_noise(df, spark.createDataFrame([(x,) for x in lexicon], "nom string")).collect()
    got = [tuple(r[c] for c in ("doc_id", "page_no", "line_no", "kind", "word")) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def corpus(rnd, docs=40):
    """Pages of running text in lines of several widths, so that what is frequent is known."""
    out = []
    for d in range(1000, 1000 + docs):
        words = (TEXT + " ") * 3
        lines, line = [], ""
        width = rnd.randrange(40, 80)
        for w in words.split():
            if len(line) + len(w) > width:
                lines.append(line.strip())
                line = ""
            line += w + " "
        lines.append(line.strip())
        out.append((d, 1, "\n".join(lines)))
    return out


def test_kinds(spark):
    base = corpus(random.Random(9))
    one = "ÉTUDE SABLON - BAIL 2021\n- 1 -\n\nLes parties conviennent que tout différ-\nend relatif aux clauses sera s0umis à une\ncommune de Saint-\nVignisart qui accepte les bicns -\nen l984 et la tentative de conci­"
    two = "liation. Le géomètre déclare les biens\n\nETUDF SABLON - BAIL 2021   2\n— 2 —"
    got = run(spark, [*base, (1, 1, one), (1, 2, two), (1, 2, two), (1, 3, None), (1, 4, " \n ")])
    own = {r for r in got if r[0] == 1}
    assert own == {
        (1, 1, 1, "header", ""), (1, 1, 2, "folio", ""), (1, 1, 4, "hyphen", "différend"), (1, 1, 5, "misread", "soumis"), (1, 1, 6, "hyphen", "Saint-Vignisart"),
        (1, 1, 7, "misread", "biens"), (1, 1, 8, "misread", "1984"), (1, 1, 8, "hyphen", "conciliation"), (1, 2, 3, "header", ""), (1, 2, 4, "folio", ""),
    }
    assert not {r for r in got if r[0] >= 1000}


def test_page_numbers(spark):
    forms = ["3", "- 3 -", "— 3 —", "[3]", "Page 3", "Page 3/7", "3/7", "Folio 3", "page 3 sur 7", "   (3)"]
    body = "Les parties conviennent que tout\ndifférend relatif aux clauses sera\nsoumis à une tentative"
    pages = [(i, 3, f"{body}\n{f}") for i, f in enumerate(forms)] + [(50, 3, f"{body}\n1984"), (51, 3, f"{body}\n2003."), (52, 3, "3\n" + body)]
    got = {r[:4] for r in run(spark, corpus(random.Random(1)) + pages) if r[3] == "folio"}
    assert got == {(i, 3, 4, "folio") for i in range(len(forms))} | {(52, 3, 1, "folio")}


def test_empty_and_nulls(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, 1, None), (1, 2, ""), (None, 1, "x"), (2, None, "x")]) == set()


def test_anagram_values(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("soumis", "s0umis", "muosis")], "a string, b string, c string").select(*[scan.anagram_value(F.col(c)).alias(c) for c in "abc"], (scan.anagram_value(F.lit("0")) - scan.anagram_value(F.lit("o"))).alias("d")).first()
    assert r.a == r.c and r.b - r.a == r.d


def test_repaired_pages(spark):
    base = corpus(random.Random(9))
    one = "ÉTUDE SABLON - BAIL 2021\n- 1 -\n\nLes parties conviennent que tout différ-\nend, relatif aux clauses, sera s0umis à une\n\ncommune de Saint-\nVignisart, qui accepte les bicns -\nen l984 et la tentative de conci­"
    two = "liation. Le géomètre déclare les biens\n\nETUDF SABLON - BAIL 2021   2\n— 2 —"
    df = spark.createDataFrame([*base, (1, 1, one), (1, 2, two), (1, 2, two), (1, 3, None), (1, 4, " ")], "doc_id bigint, page_no int, text string")
    rows = scan.repaired_pages(df, spark.createDataFrame([("Saint-Vignisart",)], "nom string")).where("doc_id = 1").orderBy("page_no").collect()
    assert [(r.page_no, r.text, r.goes_on) for r in rows] == [
        (1, "Les parties conviennent que tout différend, relatif aux clauses, sera soumis à une\n\ncommune de Saint-Vignisart, qui accepte les biens - en 1984 et la tentative de conciliation", True),
        (2, ". Le géomètre déclare les biens", True),
    ]


def test_copies_of_a_page_count_once(spark):
    """A page copied to a third of the corpus is repaired like a single one, in all its copies."""
    base = corpus(random.Random(9))
    page = "Les parties conviennent que tout\ncommune qui accepte les bicns dans\nleur état actuel"
    got = run(spark, base + [(d, 1, page) for d in range(1, 21)] + [(d, 1, f"{page}\nAffaire numéro {d}") for d in range(21, 41)])
    assert got == {(d, 1, 2, "misread", "biens") for d in range(1, 41)}


def test_two_versions_of_a_page(spark):
    """Each text under a page's number is repaired by itself."""
    base = corpus(random.Random(9))
    one = "- 1 -\nLes parties conviennent que tout\ndifférend relatif aux clauses"
    two = "Les parties conviennent que tout\ndifférend relatif aux bicns\n1"
    df = spark.createDataFrame([*base, (1, 1, one), (1, 1, two), (1, 1, two)], "doc_id bigint, page_no int, text string")
    rows = scan.repaired_pages(df, spark.createDataFrame([("Saint-Vignisart",)], "nom string")).where("doc_id = 1").collect()
    assert sorted(r.text for r in rows) == ["Les parties conviennent que tout différend relatif aux biens", "Les parties conviennent que tout différend relatif aux clauses"]


def test_short_running_line_and_top_of_page(spark):
    """A running line of two words comes on three pages at one edge; the end of a broken word spares its own line only."""
    body = "Les parties conviennent que tout\ndifférend relatif aux clauses"
    pages = [(1, n, f"Bail emphytéotique\n{body}") for n in (1, 2, 3)] + [(2, n, f"Bail emphytéotique\n{body}") for n in (1, 2)]
    pages += [(3, 1, "la contenance indiquée résulte des im-"), (3, 2, "bicns du propriétaire\nqui accepte les bicns dans")]
    got = run(spark, corpus(random.Random(9)) + pages)
    assert {r[:4] for r in got if r[3] == "header"} == {(1, n, 1, "header") for n in (1, 2, 3)}
    assert {r for r in got if r[3] == "misread"} == {(3, 2, 2, "misread", "biens")}
