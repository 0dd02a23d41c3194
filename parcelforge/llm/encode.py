"""Token ids of whole texts by a public byte-level BPE.

Ordinary texts are encoded where they are read. A text longer than a leaf is cut into leaves that are encoded in parallel in any
order and joined like a tree: around each join a window is split and encoded again, growing until its boundaries agree with those
of the right half; what lies outside is taken over unchanged. The result is exactly that of encoding the text in one piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file is read from on every executor; a parameter of all functions here.
VOCABULARY = os.environ.get("PARCELFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pattern by which this vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a leaf.
LEAF_CHARS = 1 << 14

#: Pieces at the end of a half that text after it could still change: the last, and the two before it when they start a
#: contraction such as 're.
OPEN_PIECES = 3


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a vocabulary file, once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def encode_whole(text: str, path: str = VOCABULARY) -> np.ndarray:
    return encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class Node:
    """Encoded part of a text: `ends` are the ends of its pieces in the text, `upto` the number of ids up to each end."""

    __slots__ = ("ends", "ids", "start", "upto")

    def __init__(self, start: int, ends: np.ndarray, upto: np.ndarray, ids: np.ndarray) -> None:
        self.start, self.ends, self.upto, self.ids = start, ends, upto, ids


def encode_leaf(text: str, start: int, path: str = VOCABULARY) -> Node:
    enc, seen = encoder(path), {}
    ends, upto, ids = [], [], []
    for m in splitter().finditer(text):
        piece = m.group()
        got = seen.get(piece)
        if got is None:
            got = seen[piece] = enc.encode_ordinary(piece)
        ids.extend(got)
        ends.append(start + m.end())
        upto.append(len(ids))
    return Node(start, np.array(ends, np.int64), np.array(upto, np.int64), np.array(ids, np.int32))


def join_nodes(text: str, left: Node, right: Node, path: str = VOCABULARY, window: int = 64) -> Node:
    """One node for two neighbours. `text` is the whole text, of which only the window is read."""
    keep = max(0, len(left.ends) - OPEN_PIECES)
    at = int(left.ends[keep - 1]) if keep else left.start
    kept = int(left.upto[keep - 1]) if keep else 0
    seam, end = right.start, int(right.ends[-1])
    while True:
        stop = min(end, seam + window)
        middle = encode_leaf(text[at:stop], at, path)
        closed = len(middle.ends) if stop == end else max(0, len(middle.ends) - OPEN_PIECES)
        sure = middle.ends[:closed]
        agree = np.flatnonzero((sure >= seam) & np.isin(sure, right.ends))
        if len(agree):
            n = int(agree[0])
            break
        window *= 2
    meet = int(sure[n])
    r = int(np.searchsorted(right.ends, meet))
    drop, mid = int(right.upto[r]), int(middle.upto[n])
    return Node(
        left.start,
        np.concatenate([left.ends[:keep], middle.ends[: n + 1], right.ends[r + 1 :]]),
        np.concatenate([left.upto[:keep], middle.upto[: n + 1] + kept, right.upto[r + 1 :] - drop + kept + mid]),
        np.concatenate([left.ids[:kept], middle.ids[:mid], right.ids[drop:]]),
    )


def join_tree(text: str, nodes: list[Node], path: str = VOCABULARY) -> np.ndarray:
    """Ids of the text of neighbouring leaves, joined pair by pair."""
    while len(nodes) > 1:
        nodes = [join_nodes(text, *nodes[i : i + 2], path) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0].ids if nodes else np.empty(0, np.int32)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, leaf: int = LEAF_CHARS, parts: int | None = None) -> DataFrame:
    """(id, ids) of every row, repeated rows included: an empty list for a null and for an empty text, blank texts encoded as
    they are. Strings that look like special tokens are ordinary text. Only the two columns named are read.

    Texts up to `leaf` characters never leave their task. Longer ones are spread leaf by leaf over `parts` tasks (the session's shuffle
    partitions, at least one a core); what comes together again for a text is its own result row. Texts are shorter than 2^31."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                ids = [encode_whole(t, path) if t else np.empty(0, np.int32) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), _lists(ids, pa.int32())], ["id", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, 16):
                nodes = [encode_leaf(t, s, path) for t, s in zip(b.column("part").to_pylist(), b.column("start").to_pylist(), strict=True)]
                arrays = [*(b.column(c) for c in ("id", "whole", "start", "part")), *(_lists([getattr(n, c).astype(np.int32) for n in nodes], pa.int32()) for c in ("ends", "upto", "ids"))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "whole", "start", "part", "ends", "upto", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        text = "".join(group.column("part").to_pylist())
        column = {c: group.column(c).combine_chunks() for c in ("ends", "upto", "ids")}
        nodes = [Node(s, *(column[c][i].values.to_numpy(zero_copy_only=False) for c in ("ends", "upto", "ids"))) for i, s in enumerate(group.column("start").to_pylist())]
        return pa.table({"id": group.column("id").slice(0, 1), "ids": _lists([join_tree(text, nodes, path)], pa.int32())})

    short = docs.where(size <= leaf).mapInArrow(whole, "id bigint, ids array<int>")
    # the row's own number keeps two rows under one id apart
    long = docs.where(size > leaf).select("id", F.monotonically_increasing_id().alias("whole"), "text")
    long = long.select("id", "whole", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(leaf))).alias("start"))
    long = long.select("id", "whole", "start", F.expr(f"substring(text, start + 1, {leaf})").alias("part"))
    # a number of partitions that adaptive execution leaves alone: leaves are small for the work they are
    spark = docs.sparkSession
    tasks = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    long = long.repartition(tasks, "whole", "start")
    tree = long.mapInArrow(leaves, "id bigint, whole bigint, start int, part string, ends array<int>, upto array<int>, ids array<int>")
    tree = tree.groupBy("id", "whole").applyInArrow(joined, "id bigint, ids array<int>")
    return short.unionByName(tree).withColumnRenamed("id", id_col)
