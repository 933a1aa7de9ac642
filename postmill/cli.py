"""Command line: python -m postmill.cli COMMAND --help."""

from __future__ import annotations

import argparse
import importlib
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .plans import pipeline
from .plans.session import ship
from .sources import io


def _session() -> SparkSession:
    return ship(SparkSession.builder.appName("postmill").getOrCreate())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="postmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "train", "run-all"):
        c = commands.add_parser(name)
        c.add_argument("--input")
        c.add_argument("--out", default="out")
        c.add_argument("--mode", choices=("fast", "precise"))
    c = commands.add_parser("dq-report")
    c.add_argument("--before", required=True)
    c.add_argument("--after", required=True)
    c.add_argument("--out", default="out")
    c = commands.add_parser("select-uncertain")
    c.add_argument("--kept", required=True)
    c.add_argument("--dropped", required=True)
    c.add_argument("--out", default="out")
    c.add_argument("-n", type=int, default=5000)
    c.add_argument("--min-p", type=float, default=0.2)
    c.add_argument("--max-p", type=float, default=0.9)
    c = commands.add_parser("export-uncertain")
    c.add_argument("--dropped", required=True)
    c.add_argument("--out", default="out")
    c.add_argument("-n", type=int, default=500)
    c.add_argument("--min-p", type=float, default=0.2)
    c.add_argument("--max-p", type=float, default=0.9)
    c = commands.add_parser("extract-skills")
    c.add_argument("--input", required=True)
    c.add_argument("--out", default="out")
    c = commands.add_parser("run-topics")
    c.add_argument("--input", required=True, help="scored rows with a vector column")
    c.add_argument("--vector", default="embedding")
    c.add_argument("--row-id", default="uid")
    c.add_argument("--topics", type=int, default=50)
    c.add_argument("--domain")
    c.add_argument("--most", type=int, help="rows to sample at most")
    c.add_argument("--out", default="out")
    c = commands.add_parser("label-topics")
    c.add_argument("--topics", required=True)
    c.add_argument("--rows", required=True)
    c.add_argument("--row-id", default="uid")
    c.add_argument("--labeller", help="module:function from a JSON payload to an answer; none gives the fallback")
    c.add_argument("--out", default="out")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    began, spark, cfg = time.time(), _session(), Config.from_env()
    cfg.out_dir = args.out
    cfg.input_path = getattr(args, "input", None) or cfg.input_path
    cfg.mode = getattr(args, "mode", None) or cfg.mode
    if args.command == "preprocess":
        io.write_csv(io.public_columns(pipeline.preprocess(pipeline.load(spark, cfg), cfg)), f"{args.out}/preprocessed")
    elif args.command == "train":
        rows = pipeline.weakly_labeled(pipeline.preprocess(pipeline.load(spark, cfg), cfg), cfg)
        pipeline.train_and_score(rows, cfg)[1].save(f"{args.out}/model")
    elif args.command == "run-all":
        pipeline.run_all(spark, cfg)
    elif args.command == "dq-report":
        before = io.union_by_name([io.read_any(spark, args.before)], "row_id")
        for name, table in pipeline.quality_report(before, io.read_any(spark, args.after)).items():
            io.write_csv(table, f"{args.out}/{name}")
    elif args.command == "select-uncertain":
        rows = pipeline.select_uncertain(io.read_any(spark, args.kept), io.read_any(spark, args.dropped), args.n, args.min_p, args.max_p).persist()
        io.write_csv(rows, f"{args.out}/uncertain_csv")
        io.write_jsonl(rows, f"{args.out}/uncertain_jsonl", compressed=False)
    elif args.command == "export-uncertain":
        from .operators.labels import uncertain_dropped

        io.write_csv(uncertain_dropped(io.read_any(spark, args.dropped), args.n, args.min_p, args.max_p), f"{args.out}/uncertain_dropped")
    elif args.command == "run-topics":
        found = pipeline.run_topics(io.read_any(spark, args.input), cfg, args.vector, args.topics, args.domain, args.most, args.row_id)
        pipeline.export_topics(found, args.out)
    elif args.command == "label-topics":
        call = None
        if args.labeller:
            module, _, name = args.labeller.partition(":")
            call = getattr(importlib.import_module(module), name)
        table = io.read_any(spark, args.topics).withColumn("topic_id", F.col("topic_id").cast("int"))
        rows = io.read_any(spark, args.rows).withColumn("topic_id", F.col("topic_id").cast("int"))
        for name, df in pipeline.label_topics(table, rows, cfg, call, args.row_id).items():
            io.write_csv(df, f"{args.out}/{name}")
    else:
        rows, metrics = pipeline.extract_skills(io.read_any(spark, args.input))
        io.write_csv(rows, f"{args.out}/skills")
        io.write_csv(metrics, f"{args.out}/skill_metrics")
    logging.info("%s took %.1f s", args.command, time.time() - began)


if __name__ == "__main__":
    main()
