"""Command line: logs to sessions, and what is done with them afterwards.

sessions  logs in, documents or flat records out (the default)
train     statistics of flat records, as a detector's file
review    score records and send outliers to reviewers; labelled records out
retry     ask again for sessions that no reviewer answered for, and merge the answers into a new file
report    disagreements, patterns and costs of labelled records, as one JSON document
sample    a stratified sample for annotators: blind and full records, and their metadata
evaluate  both labellings against annotators' votes
check     records against the required fields; fails if one has a problem
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.columns import tactic_plain
from vigilspark.operators import agents, anomaly, evaluation, joins, reports, sampling, schema_check
from vigilspark.operators.documents import flat, labelled, nested
from vigilspark.session import Settings, load_env, make_session
from vigilspark.sources import records
from vigilspark.sources.geo import read_geo
from vigilspark.sources.logs import read_logs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vigilspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[SparkSession, argparse.Namespace], int], **flags: dict) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--master", help="Spark master")
        for flag, options in flags.items():
            c.add_argument("--" + flag.replace("_", "-"), **options)
        return c

    c = command("sessions", run_sessions, data_dir={"help": "folder that has a folder for each sensor"}, pattern={"default": "*.gz", "help": "names of log files"}, limit={"type": int, "help": "first files of each sensor by date"}, dry_run={"action": "store_true", "help": "count, write nothing"})
    who = c.add_mutually_exclusive_group()
    who.add_argument("--location", help="one sensor")
    who.add_argument("--all", action="store_true", help="every sensor of the settings")
    c.add_argument("--print-docs", type=int, default=0, metavar="N", help="with --dry-run: print the first N")
    c.add_argument("--table", help="Parquet folder for the nested documents")
    c.add_argument("--replace", action="store_true", help="replace the table")
    c.add_argument("--export", help="folder for flat records as JSON lines")
    c.add_argument("--geo", help="a city database (.mmdb), or its blocks as CSV")
    c.add_argument("--geo-names", help="the locations that go with blocks")
    source = {"required": True, "help": "records as JSON lines"}
    out = {"required": True, "help": "where the result goes"}
    limit = {"type": int, "help": "first sessions of the input"}
    reviewer = {
        "client": {"default": "vigilspark.operators.agents:ScriptedClient", "help": "module:factory of a client; the default is a stand-in"}, "preset": {"default": "fast", "choices": sorted(agents.PRESETS)},
        "rpm": {"type": int, "help": "requests a minute, all together"}, "partitions": {"type": int, "default": 8},
    }
    command("train", run_train, input=source, model=out, z_threshold={"type": float, "default": 3.0}, min_samples={"type": int, "default": 100}, limit=limit)
    command("review", run_review, input=source, output=out, model={"help": "a detector's file; without one all sessions are flagged"}, limit=limit, dry_run={"action": "store_true", "help": "label as if nobody was asked"}, **reviewer)
    command("retry", run_retry, input=source, output=out, limit=limit, again={"action": "store_true", "help": "the thorough look again at relevant sessions, instead"}, **reviewer)
    command("report", run_report, input=source, output=out)
    command("sample", run_sample, input=source, output=out, total={"type": int, "default": sampling.Quotas().total()}, seed={"type": int, "default": 42})
    command("evaluate", run_evaluate, full={"required": True, "help": "the full records of a sample"}, votes={"required": True, "nargs": "+", "help": "annotators' files"}, output=out, resamples={"type": int, "default": evaluation.RESAMPLES})
    command("check", run_check, input=source)
    return p


def _read(spark: SparkSession, path: str, labeled: bool = False) -> DataFrame:
    """Records by the schema of all features, with their place in the input as ``seq``."""
    schema = records.labeled_schema(feature_types()) if labeled else records.session_schema(feature_types())
    return records.read_records(spark, path, schema)


def feature_types():
    """Of the features of a flat record, from an empty log."""
    from vigilspark.sources.adapter import as_log

    spark = SparkSession.active()
    none = as_log(spark.createDataFrame([], "event_id long, user_id long, event_type string, value double, ts timestamp"))
    return flat(labelled(none)).schema["features"].dataType


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _reviewers(args: argparse.Namespace) -> tuple[Callable[[], agents.Client], agents.AgentConfig]:
    module, _, name = args.client.partition(":")
    config = agents.PRESETS[args.preset]
    if args.rpm:
        config = agents.replace(config, requests_per_minute=args.rpm)
    return getattr(importlib.import_module(module), name), config


def run_sessions(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = Settings()
    if args.data_dir:
        settings.data_dir = args.data_dir
    places = [args.location] if args.location else settings.locations if args.all else []
    if not places:
        parser().error("give --location or --all")
    ranges = read_geo(spark, args.geo or settings.geo_path, args.geo_names)
    events = reduce(DataFrame.unionByName, [read_logs(spark, settings.path_of(x), x, args.pattern, args.limit) for x in places])
    rows = labelled(events, ranges)
    if args.export:
        records.write_json(flat(rows, with_geo=ranges is not None), args.export, tell=lambda done, all_: print(f"{done} of {all_} tasks", file=sys.stderr))
    elif args.dry_run or not args.table:
        print(records.dry_run(nested(rows), args.print_docs))
    else:
        records.write_table(nested(rows), args.table, args.replace)
    return 0


def run_train(spark: SparkSession, args: argparse.Namespace) -> int:
    detector = anomaly.train(records.first_rows(_read(spark, args.input), args.limit), args.z_threshold, args.min_samples)
    detector.save(args.model, spark)
    print(detector.summary())
    return 0


def run_review(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = records.first_rows(_read(spark, args.input), args.limit)
    scored = anomaly.score(rows, anomaly.Detector.load(args.model, spark) if args.model else None)
    if args.dry_run:
        records.write_json(agents.unreviewed(scored).drop("seq"), args.output)
        return 0
    factory, config = _reviewers(args)
    done = agents.run_reviewers(scored, factory, config, partitions=args.partitions)
    print(json.dumps(agents.run_stats(done).first().asDict()))
    records.write_json(done.drop("seq", "review_detail"), args.output)
    return 0


def run_retry(spark: SparkSession, args: argparse.Namespace) -> int:
    rows, (factory, config) = _read(spark, args.input, labeled=True), _reviewers(args)
    if args.again:
        chosen = records.first_rows(rows.where("labels_agentic.hunter_verdict = 'RELEVANT'"), args.limit)
        again = agents.reanalyze(chosen, factory, config, args.partitions).where("review_error is null")
    else:
        failed = F.coalesce("labels_agentic.pipeline_metrics.sent_to_hunter", F.lit(False)) & F.col("labels_agentic.hunter_verdict").isNull()
        again = agents.retry(records.first_rows(rows.where(failed), args.limit), factory, config, partitions=args.partitions)
    again = agents.durable(again.select("session_id", "labels_agentic", "seq"))
    print(json.dumps(joins.merge_report(rows, again).first().asDict()))
    records.write_json(joins.update_join(rows, again).drop("seq", "merged"), args.output)
    return 0


def run_report(spark: SparkSession, args: argparse.Namespace) -> int:
    dual = agents.durable(reports.dual_columns(_read(spark, args.input, labeled=True)))
    made = {
        "funnel": reports.funnel(dual), "distributions": reports.distributions(dual), "confusion": reports.confusion(dual), "samples": reports.samples(dual), "cells": reports.cell_profiles(dual),
        "cell_counters": reports.cell_counters(dual), "cell_samples": reports.cell_samples(dual), "costs": reports.costs(dual), "cost_percentiles": reports.floor_percentiles(reports.relevant_costs(dual), "cost_usd"),
    }
    _write_text(spark, args.output, json.dumps(records.report_json(made), indent=2))
    return 0


def run_sample(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = _read(spark, args.input, labeled=True)
    dual, quotas = agents.durable(reports.dual_columns(rows)), sampling.Quotas().scaled(args.total)
    picked = agents.durable(sampling.stratified(dual, quotas, args.seed))
    for name, blind in (("blind", True), ("full", False)):
        records.write_json(sampling.sample_records(rows, picked, blind).coalesce(1).sortWithinPartitions("annotation_id"), f"{args.output}/{name}")
    made = sampling.metadata(dual, picked, quotas, args.seed, args.input, f"{args.output}/blind", f"{args.output}/full")
    _write_text(spark, f"{args.output}/metadata.json", json.dumps(made, indent=2))
    return 0


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    schema = "annotation_id int, bucket string, rule_based_label struct<level:int,primary_tactic:string>, agent_label struct<level:int,primary_tactic:string>"
    full = records.read_records(spark, args.full, schema).select(
        "annotation_id", "bucket", "seq", *[F.col(f"{side}_label.{x}").alias(f"{k}_{y}") for k, side in (("a", "rule_based"), ("b", "agent")) for x, y in (("level", "level"), ("primary_tactic", "tactic"))]
    )
    votes = records.read_annotations(spark, args.votes)
    rows, c = agents.durable(evaluation.aligned(evaluation.ground_truth(votes), full)), F.col
    right = lambda k: tactic_plain(c(k)) == tactic_plain(c("tactic"))
    made: dict[str, DataFrame] = {}
    for k in ("a", "b"):
        made |= {f"{k}_classes": evaluation.class_report(rows, c(f"{k}_tactic"), c("tactic")), f"{k}_overall": evaluation.overall_report(rows, c(f"{k}_tactic"), c("tactic")), f"{k}_confusion": evaluation.confusion_counts(rows, c(f"{k}_tactic"), c("tactic"))}
        made[f"{k}_errors"] = rows.agg(evaluation.mean_absolute_error(c(f"{k}_level"), c("level")).alias("mae"), evaluation.fn_rate(c(f"{k}_tactic"), c(f"{k}_level"), c("fn_risk")).alias("fn_rate"))
    made |= {
        "mcnemar": evaluation.mcnemar(rows, right("a_tactic"), right("b_tactic")), "bootstrap": evaluation.bootstrap(rows, c("a_tactic"), c("b_tactic"), c("tactic"), args.resamples),
        "annotators": evaluation.annotator_agreement(votes), "novel": evaluation.novel_validation(rows, c("b_tactic"), c("tactic")),
    }
    _write_text(spark, args.output, json.dumps(records.report_json(made), indent=2))
    return 0


def run_check(spark: SparkSession, args: argparse.Namespace) -> int:
    found: dict[str, Any] = schema_check.check_summary(spark.read.text(args.input)).first().asDict()
    print(json.dumps(found))
    return 1 if found["bad"] else 0


def main(argv: list[str] | None = None) -> int:
    load_env()
    argv = sys.argv[1:] if argv is None else list(argv)
    if argv and argv[0].startswith("-") and argv[0] not in ("-h", "--help"):
        argv = ["sessions", *argv]
    args = parser().parse_args(argv)
    return args.run(make_session(args.master), args)


if __name__ == "__main__":
    raise SystemExit(main())
