import os
import random
import re

import pyarrow.parquet as pq
import pytest

from parcelforge.llm import residue

PARTS = ["La cour retient que la servitude de passage n'est établie qu'à hauteur de 81880 euros.", "Le premier juge observe à bon droit que la facture ne suffisait pas.", "The judge below found that the invoice was not enough, given the time elapsed.", "Die Kammer erinnert daran, dass nur 1388 Euro belegt sind, nach Aktenlage.", "M. Durand verse aux débats le constat ainsi que 343 pièces relatives au bornage litigieux."]
HEAD = "Cour d'appel de Poiszelquin, 8 février 1998, n° F 98/0000267\n\n"


def prose(n, seed=1):
    rnd = random.Random(seed)
    return HEAD + "\n\n".join(f"[{i}] {rnd.choice(PARTS)}" for i in range(1, n + 1))


@pytest.fixture(scope="module")
def models():
    return residue.fit_models([prose(12, i) for i in range(60)] + ["Error 404: the page you requested could not be found."] * 3)


@pytest.mark.parametrize(
    "text",
    [
        "Erreur 404 : la page demandée est introuvable.",
        HEAD + "Contenu à venir.",
        "Aller au contenu principal\n\nDelai d'attente depasse lors de la connexion a la base.\n\nPlan du site - Mentions légales",
        "Please enable JavaScript in your browser to continue. Skip to main content",
        "Lorem ipsum dolor sit amet exemple texte titre factice ici paragraphe provisoire.",
        prose(5).replace("M. Durand", "{{nom_partie}}") + " {{nom_partie}} soutient",
        prose(4) + "\n\n[5] ........ (date_audience)",
        prose(4) + "\n\nde l'adresse [ADRESSE À COMPLÉTER], à Paris",
        prose(4) + " ${montant} euros", prose(4) + " «avocat ici» soutient", prose(4) + " <enter case_number> relies", prose(4) + " %(montant)s euros",
    ],
)
def test_residue(models, text):
    assert residue.is_residue(residue.judge(text, models))


@pytest.mark.parametrize(
    "text",
    [
        prose(6),
        HEAD + "Rejette la requête de M. Durand. Dépens réservés.",
        "County Court of Barley, 2 May 2001, RG 01/2\nApplication of Mr Smith refused. Hearing moved to 15 January 2016.",
        prose(6) + "\n\nLe site affichait alors « Erreur 404 - page introuvable », ce qui empêchait toute commande.",
        prose(6) + "\n\nLe contrat type laissait en blanc la mention « [nom du client à compléter] », dont il est tiré argument.",
        prose(6) + "\n\nLa clause modèle portait encore le champ « {{date_effet}} » que les parties n'ont jamais rempli.",
        prose(6) + "\n\nThe standard form still bore the blank '[insert name of tenant]', on which he relies.",
        prose(6) + "\n\nIm Mustervertrag stand noch „[Name einsetzen]“, worauf sich Frau Kurz beruft.",
        prose(6).replace("M. Durand", "A.________").replace("81880", "[...]") + " demeurant [Adresse 2], M. X... et Mme Y....",
    ],
)
def test_decisions(models, text):
    assert not residue.is_residue(residue.judge(text, models))


def test_windows_localise(models):
    text = prose(8) + "\n\nVotre navigateur bloque les scripts : le contenu ne peut pas être affiché.\n\n" + prose(8, 2)
    k, _ = models.classes(text)
    at = text.index("Votre navigateur")
    inside = (k[at // residue.STEP : (at + 70) // residue.STEP] == residue.NOTICE).mean()
    assert inside > 0.7 and (k[: (at - 30) // residue.STEP] == residue.NOTICE).mean() < 0.02


def test_field_windows_localise(models):
    """Only the parts near signs are looked at, and only windows of fields are told."""
    text = prose(40) + " de {{nom du lieu}} à " + prose(40, 2)
    near = residue.near_signs(text)
    assert "{{nom du lieu}}" in near
    assert 2 <= residue.judge(text, models).field_chars <= 40
    assert residue.judge(prose(40), models).field_chars == 0
    assert residue.near_signs("Aucun signe ici.") == "" and residue.judge("Aucun signe ici.", models).field_chars == 0


def test_symbols_by_bytes():
    """The ways to a text's symbols agree."""
    for text in ("Été n° 12 – « où » …\n", "l’œuvre — „Zitat“ €", "█ 日本 ß", "", "a\t\x0b\x85\xa0b"):
        codes = [ord(c) for c in text]
        assert residue.symbols(text).tolist() == [int(residue.symbol_table()[c]) for c in codes]


def test_texts_together_or_alone(models):
    """Texts looked at together are judged as alone."""
    texts = [prose(6), "", prose(3) + " ${lieu du bien} euros", "x {{", "nom du lieu}} y", "{{a b}}", prose(2) + " [12] <<", ">> et [X]"] * 9
    assert residue.judge_all(texts, models) == [residue.judge(t, models) for t in texts]


def _normal(text):
    return re.sub(r"\s+", " ", text.lower())


@pytest.mark.parametrize("table", ["documents", "eval_items"])
def test_seeds_are_no_test_texts(sf, table):
    """No seed wording shares a run of 25 characters with a text of the test tables."""
    n, runs = 25, set()
    lines = [line for _, s, _ in residue._seed_wordings() for line in s.splitlines()]
    for s in [*lines, *residue.ORDER_SEEDS.splitlines(), *residue.REDACTION_SEEDS.splitlines(), *residue.HEADING_SEEDS.splitlines()]:
        s = _normal(s)
        runs |= {s[i : i + n] for i in range(len(s) - n + 1)}
    for size in ("sf0.001", "sf0.01"):
        path = f"{os.path.dirname(sf)}/{size}/{table}.parquet"
        for text in pq.read_table(path, columns=["text"]).column("text").to_pylist() if os.path.exists(path) else []:
            t = _normal(text or "")
            assert runs.isdisjoint(t[i : i + n] for i in range(len(t) - n + 1))


def test_learns_a_corpus_own_wordings():
    """A notice that no seed resembles is learnt from texts in which it stands beside one that is told."""
    strange = "Kontrakt w trakcie odnawiania, zapraszamy ponownie jutro rano."
    texts = [prose(12, i) for i in range(60)] + [f"Page introuvable. Le serveur a rencontré une erreur interne. {strange}", f"{strange} Accès non autorisé : vous devez être connecté."]
    assert not residue.is_residue(residue.judge(strange, residue.models_of()))
    models = residue.fit_models(texts)
    assert all(residue.is_residue(residue.judge(t, models)) for t in texts[60:])


def test_frame(spark):
    rows = [(i, prose(6, i)) for i in range(30)] + [(100, None), (101, ""), (102, " \n"), (103, "Page not found. Access denied."), (103, "Page not found. Access denied."), (104, prose(4000)), (105, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as residue", "2 as n_prose")
    got = [r.doc_id for r in residue.residue_docs(df).collect()]
    assert got == [103]
    assert residue.residue_docs(df.limit(0)).count() == 0


FILLER = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_frequent_copies_stay_residue(spark):
    """Long copies of one text with a third of all rows aren't learnt as prose."""
    texts = [prose(30, i) for i in range(60)] + [FILLER * 60] * 30
    assert {r.doc_id for r in residue.residue_docs(frame(spark, texts)).collect()} == set(range(60, 90))


def test_copies_count_once(spark):
    rows = [(prose(5), 1.0), (prose(6), 0.25)]
    got = residue.different_texts(frame(spark, [prose(5)] + [prose(6)] * 4 + [None, " "])).distinct().collect()
    assert {(r.text, r.weight) for r in got} == set(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_or_long_texts_to_learn_from(spark, n):
    """Decisions are kept in small tables, beside rows without text, and where all texts are long; rows of residue are not."""
    for size in (3, 400):
        texts = [prose(size, i) for i in range(n)] + ["Page not found. Access denied."] + [None, ""] * 20
        assert [r.doc_id for r in residue.residue_docs(frame(spark, texts)).collect()] == [n]


def test_seeds_alone_keep_decisions():
    models = residue.models_of()
    assert not any(residue.is_residue(residue.judge(t, models)) for t in [prose(3), prose(3000), *(HEAD + p for p in PARTS)])
    assert residue.is_residue(residue.judge(FILLER * 200, models))
