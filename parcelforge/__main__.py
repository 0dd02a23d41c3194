"""spark-submit entry: check-env, extract-text, process."""

from __future__ import annotations

import argparse
import sys

from parcelforge import diagnostics


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parcelforge")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("check-env", help="what is installed")
    text = sub.add_parser("extract-text", help="text of the PDF files under a folder, one folder a document")
    record = sub.add_parser("process", help="records of the deeds of a data folder as JSON lines")
    for p in (text, record):
        p.add_argument("source")
        p.add_argument("output")
    a = parser.parse_args(args)
    if a.command == "check-env":
        results = diagnostics.run_checks()
        for r in results:
            print(f"{'ok ' if r.ok else 'no '} {r.name}: {r.details}")
        return 0 if all(r.ok for r in results[:4]) else 1

    from pyspark.sql import SparkSession

    from parcelforge.session import prepared

    spark = prepared(SparkSession.builder.appName("parcelforge").getOrCreate())
    if a.command == "extract-text":
        from parcelforge.operators.pages import assembled
        from parcelforge.sources.pdf import digital_pages
        from parcelforge.sources.sinks import write_texts

        texts = assembled(digital_pages(spark, a.source).withColumnRenamed("path", "doc_id"))
        write_texts(texts, a.output)
        return 1 if texts.isEmpty() else 0

    from parcelforge.plans.document import document_records
    from parcelforge.sources.sinks import write_records
    from parcelforge.sources.tables import table

    deeds, communes, reference = (table(spark, a.source, t) for t in ("deeds", "communes", "parcel_ref"))
    write_records(document_records(deeds, communes, reference), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
