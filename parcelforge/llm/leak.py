"""Held-out passages inside a corpus, found by Wu-Manber search over words.

The patterns are all runs of `run` words of the test items. A window of that length slides over a text and looks only at its
last block of words: the shift table tells how far the window may jump because no pattern holds that block nearer to its end; on
a jump of zero the bucket of the block's hash names the item positions that end in it, and they are compared word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.sources.blocks import blocks_of_rows

#: Words of a run that counts as a leak.
RUN = 12
#: Words of a block.
BLOCK = 3
#: Words of test items searched in one pass; more items are searched in several passes over all rows.
PASS_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


def _marks() -> re.Pattern:
    """Runs of combining marks, from the Unicode tables."""
    codes = [c for c in range(0x300, 0x1EA00) if unicodedata.combining(chr(c))]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]+")


_MARKS = _marks()


#: Marks of the Latin, Greek and Cyrillic scripts, and signs that are neither letters, digits nor marks; a text of nothing else
#: beyond ASCII takes the short way.
_COMMON_MARKS = re.compile("[\u0300-\u034e\u0350-\u036f]+")
_UNCOMMON = re.compile("[^\x00-\x7f\u0300-\u034e\u0350-\u036f\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u205e\u20a0-\u20bf]")
_BYTES = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters and digits after compatibility decomposition, without marks and case, as UTF-8."""
    if text.isascii():
        return text.encode().translate(_BYTES).split()
    text = unicodedata.normalize("NFKD", text)
    if not _UNCOMMON.search(text):  # no letter or digit beyond ASCII: all that is left there separates words
        return _COMMON_MARKS.sub("", text).encode("ascii", "replace").translate(_BYTES).split()
    text = _MARKS.sub("", text).casefold()
    if not text.isascii():  # folding case may have made new compositions
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text)]


class Patterns:
    """Tables of the test items: vocabulary, shift of each block, bucket of each block that ends a pattern."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, block: int = BLOCK) -> None:
        self.run, self.block = run, min(block, run)
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, tuple[int, ...]]] = []
        self.shift: dict[tuple[int, ...], int] = {}
        self.bucket: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.furthest = run - self.block + 1
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or ""))
            if len(ids) < run:  # too short to hold a run
                continue
            n = len(self.items)
            self.items.append((item_id, ids))
            for end in range(self.block, len(ids) + 1):
                b = ids[end - self.block : end]
                gap = max(0, run - end)
                if gap < self.shift.get(b, self.furthest):
                    self.shift[b] = gap
                if not gap:
                    self.bucket.setdefault(b, []).append((n, end))

    def find(self, text: str) -> set[int]:
        """Ids of the items of which the text holds a run."""
        found: set[int] = set()
        look = self.vocabulary.get
        doc = [look(w, 0) for w in words_of(text)]
        run, block, furthest, shift, n = self.run, self.block, self.furthest, self.shift, len(doc)
        end = run
        while end <= n:
            if not doc[end - 1]:  # a word of no item: no window that holds it can match
                end += run
                continue
            step = shift.get(tuple(doc[end - block : end]), furthest)
            if step:
                end += step
                continue
            window = tuple(doc[end - run : end])
            for k, at in self.bucket[window[-block:]]:
                item_id, ids = self.items[k]
                if item_id not in found and ids[at - run : at] == window:
                    found.add(item_id)
            end += 1
        return found


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, item_id), without repeats, of every document that holds at least `run` consecutive words of an item.

    Null, empty and blank texts and items shorter than a run match nothing; items with equal passages are all reported; several
    rows of one id count together. Whole texts are searched, in one pass over their words.

    The test items are the query set: they are read in blocks of at most `pass_words` words (or one item), each block is sent to
    the workers with the search, and every block runs over all rows. Documents meet no other documents: there is no shuffle but
    that of the pairs found, and a document's size is the only thing a task's memory depends on."""
    out = None
    searched = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    for block in blocks_of_rows(items.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null"), "text", pass_words * 6):
        patterns = Patterns(block, run)
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = shared.value.find
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                pairs = [(d, i) for d, t in zip(ids, texts, strict=True) for i in find(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "item_id"])

        part = searched.mapInArrow(search, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
