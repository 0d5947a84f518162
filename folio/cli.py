"""Command line: ``python -m folio.cli translate BOOK --from en --to es --size standard --out FOLDER``; also ``fix BOOK --draft FILE`` and ``polish DRAFT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import assemble
from folio.plans import pipeline
from folio.session import PRESETS, session
from folio.sources import files


def main(argv: list[str] | None = None) -> int:
    """0: all done, 1: wrong arguments, 2: some chunks are flagged or pending."""
    parser = argparse.ArgumentParser(prog="folio")
    parser.add_argument("verb", choices=["translate", "fix", "polish"])
    parser.add_argument("book", help="the original; for polish the draft itself")
    parser.add_argument("--draft", help="for fix: the translation to correct")
    parser.add_argument("--from", dest="source", default="en")
    parser.add_argument("--to", dest="target", default="es")
    parser.add_argument("--size", choices=sorted(PRESETS), default="standard")
    parser.add_argument("--out", default="out")
    parser.add_argument("--log", help="the folder of the run's log, from which it resumes; by default beside the output, by the contents")
    args = parser.parse_args(argv)
    try:
        files.check_arguments(args.book, args.source, args.target)
        files.reader_of(args.book)
        if args.verb == "fix":
            files.check_arguments(args.draft or "", args.source, args.target)
            files.reader_of(args.draft)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = session()
    book = files.read_book(spark, args.book).withColumn("book_id", F.lit(1).cast("long"))
    chunks = pipeline.book_chunks(book, args.size)
    if args.verb == "fix":
        chunks = assemble.fix_chunks(chunks, files.read_book(spark, args.draft).select(F.lit(1).cast("long").alias("book_id"), "sections"))
    else:
        chunks = chunks.withColumn("source", F.lit(None).cast("string"))
    asked = [F.lit(x) for x in (args.verb, args.source, args.target, args.size)]
    contents = chunks.agg(F.sha2(F.concat_ws("|", *asked, F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("|", F.col("book_index").cast("string"), "original", "source"), 256))), "|")), 256)).first()[0]
    log = args.log or f"{args.out.rstrip('/')}-log/{contents}"
    before = pipeline.logged(spark, log)
    done = pipeline.run(chunks, pipeline.offline, log, task=args.verb, source=args.source, target=args.target)
    counts = pipeline.summary(done, before).first()
    if before is not None and counts.done == counts.total == before.count():
        print("this book is done already")
    named = pipeline.finished(done).join(book, "book_id").select(F.concat(T.slug(F.col("title")), F.lit(f"_{args.target}")).alias("name"), "text")
    assemble.write_books(named, args.out)
    print(f"{counts.total} chunks: {counts.done} done, {counts.flagged} flagged, {counts.pending} pending" + (", resumed" if counts.resumed else ""))
    return 0 if counts.done == counts.total else 2


if __name__ == "__main__":
    sys.exit(main())
