"""python -m lectern: run a book of block rows, list, export, import or reset its stages."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.blocks import from_spans
from lectern.operators.progress import latest, progress_events
from lectern.plans import curriculum
from lectern.sources.store import StageStore, export_rows, pdf_path, read_blocks, read_export, read_pdf, read_progress, write_export


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block rows of a PDF file or of a table of them."""
    if not path.lower().endswith(".pdf"):
        return read_blocks(spark, path)
    return from_spans(read_pdf(spark, f"file://{pdf_path(path)}"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the book's stages")
    p.add_argument("--run", metavar="BLOCKS", help="PDF file or block rows (Parquet or JSON lines) to run through the pending stages")
    p.add_argument("--posts", metavar="JSON", help="reading progress to keep: JSON lines of posted objects, in order")
    p.add_argument("--export", metavar="FOLDER", help="write sessions and progress as JSON")
    p.add_argument("--import", dest="take", metavar="EXPORT", help="read sessions from an export")
    p.add_argument("--reset", nargs="?", const="", metavar="STAGE", help="remove one stage, or all")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    store = StageStore(spark, a.store)
    if a.run:
        print("ran:", ", ".join(curriculum.run(store, blocks(spark, a.run))) or "nothing")
    if a.take:
        store.save("SessionGen", read_export(spark, a.take))
        if not a.take.endswith(".json"):
            rows = read_progress(spark, a.take)
            store.save("Progress", rows.withColumns({"ts": F.lit(datetime.now()), "ord": F.monotonically_increasing_id(), "deleted": F.lit(False)}))
    if a.posts:
        posts = spark.read.text(a.posts).select(F.col("value").alias("body"), F.lit(datetime.now()).alias("ts"), F.monotonically_increasing_id().alias("ord"))
        events = progress_events(posts)
        before = store.load("Progress")
        store.save("Progress", events if before is None else before.unionByName(events))
    if a.export:
        kept = store.load("Progress")
        rows = spark.createDataFrame([], "session_id string, key string, value string") if kept is None else latest(kept)
        print(write_export(export_rows(store.load("SessionGen")), rows, a.export, datetime.now()))
    if a.reset is not None:
        store.reset(a.reset or None)
    else:
        print(store.progress())


if __name__ == "__main__":
    main()
