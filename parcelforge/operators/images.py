"""Pages as pixels: table regions, text zones and recognition, one Arrow batch of pages at a time.

Images are rows (doc_id, page_no, width, height, pixels) of grey bytes. Recognition and text detection are interfaces: their
engines are native programs or devices that a cluster may or may not have."""

from __future__ import annotations

import pathlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import pixels

BOX = "doc_id bigint, page_no int, box_idx int, x int, y int, w int, h int"


class OcrEngine(Protocol):
    def read(self, image: np.ndarray, language: str, layout: int) -> str: ...


class TextRegionDetector(Protocol):
    def probabilities(self, image: np.ndarray) -> np.ndarray: ...


def _image(row) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)


def _boxes(images: DataFrame, find: Callable[[np.ndarray], list[tuple[int, int, int, int]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.doc_id, r.page_no, k, *b) for r in pdf.itertuples() for k, b in enumerate(find(_image(r)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "box_idx", "x", "y", "w", "h"])

    return images.where("pixels is not null").mapInPandas(run, BOX)


def table_boxes(images: DataFrame) -> DataFrame:
    return _boxes(images, pixels.table_regions)


def text_boxes(images: DataFrame, detector: TextRegionDetector, threshold: float = 0.3, least_area: int = 500) -> DataFrame:
    return _boxes(images, lambda im: pixels.text_boxes(detector.probabilities(im), im.shape[1], im.shape[0], threshold, least_area))


def readings(images: DataFrame, engine: OcrEngine, language: str = "fra", layouts: tuple[int, ...] = (3, 4, 6)) -> DataFrame:
    """(doc_id, page_no, pos, text): the sharpened and the black-and-white page, each read under every layout."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                forms = pixels.prepared(_image(r))
                rows += [(r.doc_id, r.page_no, i * len(layouts) + j, engine.read(f, language, lay)) for i, f in enumerate(forms) for j, lay in enumerate(layouts)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "pos", "text"])

    return images.where("pixels is not null").mapInPandas(run, "doc_id bigint, page_no int, pos int, text string")


CROP = "doc_id bigint, page_no int, box_idx int, width int, height int, pixels binary"


def _with_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with the array of their boxes; a page's boxes are few."""
    listed = boxes.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("box_idx", "x", "y", "w", "h"))).alias("boxes"))
    return images.where("pixels is not null").join(listed, ["doc_id", "page_no"])


def _cut(image: np.ndarray, b: dict, padding: int) -> np.ndarray:
    return image[max(0, b["y"] - padding) : b["y"] + b["h"] + padding, max(0, b["x"] - padding) : b["x"] + b["w"] + padding]


def crops(images: DataFrame, boxes: DataFrame, padding: int = 5) -> DataFrame:
    """The parts of the images inside their boxes, with a margin clamped to the image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(r.doc_id, r.page_no, b["box_idx"], _cut(_image(r), b, padding)) for r in pdf.itertuples() for b in r.boxes]
            yield pd.DataFrame([(d, p, i, c.shape[1], c.shape[0], c.tobytes()) for d, p, i, c in parts], columns=["doc_id", "page_no", "box_idx", "width", "height", "pixels"])

    return _with_boxes(images, boxes).mapInPandas(run, CROP)


def zone_texts(images: DataFrame, zones: DataFrame, engine: OcrEngine, language: str = "fra", padding: int = 10) -> DataFrame:
    """(doc_id, page_no, text): each zone sharpened, enlarged if it is narrow, read as one block; zones in reading order, blank lines
    between, empty readings left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                texts = []
                for b in sorted(r.boxes, key=lambda b: (b["y"], b["x"])):
                    sharp, _ = pixels.prepared(_cut(_image(r), b, padding), pixels.SMALL_ZONE)
                    texts.append(engine.read(sharp, language, 6).strip())
                rows.append((r.doc_id, r.page_no, "\n\n".join(t for t in texts if t)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    return _with_boxes(images, zones).mapInPandas(run, "doc_id bigint, page_no int, text string")


def write_crops(parts: DataFrame, path: str) -> None:
    """One PGM file for each part under a folder that all executors see."""

    def save(rows: Iterator) -> None:
        folder = pathlib.Path(path)
        folder.mkdir(parents=True, exist_ok=True)
        for r in rows:
            (folder / f"{r.doc_id}_{r.page_no}_{r.box_idx}.pgm").write_bytes(b"P5\n%d %d\n255\n" % (r.width, r.height) + bytes(r.pixels))

    parts.foreachPartition(save)
