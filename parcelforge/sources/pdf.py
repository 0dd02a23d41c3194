"""Text of digital PDF files; needs pypdf on the executors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGES = "path string, page_no int, text string, n_images int"


def digital_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text, n_images) of every page of the PDF files under a path; pages count from 1 and keep their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                for k, page in enumerate(PdfReader(io.BytesIO(f.content)).pages, 1):
                    rows.append((f.path, k, page.extract_text() or "", len(page.images)))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "n_images"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, PAGES)
