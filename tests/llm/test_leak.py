import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import leak


def words(s):
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return [w.encode() for w in re.findall(r"[^\W_]+", bare(bare(s).casefold()))]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aÉé ßœ’–²½İ_9͏ﬁ中α­…€éͅǰ. "), max_size=14))
def test_words(text):
    assert leak.words_of(text) == words(text)


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t or "")
        runs = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        out |= {(d, i) for i, u in items if any(tuple(v[k : k + run]) in runs for v in [words(u or "")] for k in range(len(v) - run + 1))}
    return out


def test_search_is_exact():
    rnd = random.Random(8)
    for run, block in ((5, 2), (12, 3), (2, 3)):
        items = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(30)))) for i in range(12)]
        p = leak.Patterns(items, run, block)
        docs = []
        for d in range(300):
            text = [rnd.choice("abcdxyz") for _ in range(rnd.randrange(60))]
            src = rnd.choice(items)[1].split()
            a = rnd.randrange(len(src) + 1)
            text[len(text) // 2 : len(text) // 2] = src[a : a + rnd.randrange(run + 4)]
            docs.append((d, " ".join(text)))
        assert {(d, i) for d, t in docs for i in p.find(t)} == brute(docs, items, run)


def test_frame(spark):
    passage = " ".join(f"mot{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, passage.upper().replace(" ", " -\n")), (3, passage), (4, " ".join(passage.split()[:11])), (5, "x " + " ".join(passage.split()[4:16]) + " y"), (6, "é " * 100_000 + passage)]
    items = [(10, passage), (11, passage), (10, passage), (12, "trop court"), (13, None), (None, passage)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    want = {(k, j) for k in (3, 5, 6) for j in (10, 11)}
    for words_a_pass in (leak.PASS_WORDS, 1):
        got = [tuple(r) for r in leak.leaked_items(d, i, pass_words=words_a_pass).select("doc_id", "item_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leak.leaked_items(d, i.limit(0)).count() == 0 and leak.leaked_items(d.limit(0), i).count() == 0
