"""python -m glossaflow run|eval|version"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossaflow import __version__, config
from glossaflow.operators import evaluation
from glossaflow.pipeline import Pipeline


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glossaflow")
    verbs = parser.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run", help="annotate files")
    run.add_argument("pointers", nargs="*")
    run.add_argument("-s", "--settings", nargs="+", default=[])
    run.add_argument("-t", "--pointer-type", choices=["glob", "id"])
    run.add_argument("-i", "--input-directory")
    run.add_argument("-f", "--article-format")
    run.add_argument("-b", "--fallback-format")
    run.add_argument("-o", "--output-directory")
    run.add_argument("-e", "--export-format", nargs="+")
    run.add_argument("-p", "--postfilter", nargs="+")
    run.add_argument("-j", "--jobs", type=int, help="cores of a local run")
    run.add_argument("-m", "--index-cache", help="folder that keeps the indices of dictionaries")
    run.add_argument("-v", "--verbose", action="store_true")
    run.add_argument("-q", "--quiet", action="store_true")
    run.add_argument("-c", "--config", nargs=2, action="append", default=[], metavar=("NAME", "VALUE"))
    score = verbs.add_parser("eval", help="score tab-separated annotations against a gold standard")
    score.add_argument("gold")
    score.add_argument("annotations")
    score.add_argument("--gold-fields", default="1,3-5")
    score.add_argument("--fields", default="1,3-4,7")
    score.add_argument("-o", "--output", help="folder for the scores and for each record with its verdict")
    score.add_argument("--measure", choices=["strict", "lenient", "average"], default="strict")
    verbs.add_parser("version")
    args = parser.parse_args(arguments)
    if args.verb == "version":
        print(__version__)
        return
    builder = SparkSession.builder.appName("glossaflow")
    spark = (builder.master(f"local[{args.jobs}]") if getattr(args, "jobs", None) else builder).getOrCreate()
    if args.verb == "run":
        logging.basicConfig(level=logging.INFO if args.verbose else logging.ERROR if args.quiet else logging.WARNING)
        given = {k: v for k, v in vars(args).items() if k not in ("verb", "settings", "config", "jobs", "verbose", "quiet") and v}
        settings = config.load(args.settings, **dict(args.config), **given)
        for path in Pipeline(spark, settings).run():
            if not args.quiet:
                print(path)
        return
    names = ["doc_id", "start", "end", "native_id"]
    sides = [evaluation.selected(spark.read.text(path), [selector], "value").select(*[F.get("record", F.lit(i)).cast("int" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(names)]) for path, selector in ((args.gold, args.gold_fields), (args.annotations, args.fields))]
    verdicts = evaluation.judged(*sides, names)
    if args.measure != "strict":
        verdicts = evaluation.partial_positives(verdicts, ["doc_id", "native_id"])
    micro, macro = evaluation.scores(evaluation.counts(verdicts, measure=args.measure)), evaluation.macro(evaluation.counts(verdicts, ["doc_id"], args.measure))
    if args.output:
        evaluation.write(verdicts, micro, macro, args.output)
    micro.show()
    macro.show()


if __name__ == "__main__":
    main()
