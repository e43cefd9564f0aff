"""The registered queries of the session engine: each operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.catalog import DECODE_BARE, DECODE_PIPE, ESCAPE, ESCAPE_PIPE, KEYWORDS, RULES, TOTALS
from vigilspark.functions.columns import decoded_payloads, hits, is_private, is_suspicious, looks_like_typo, occurrences, tactic_plain
from vigilspark.operators import anomaly, documents, evaluation, features, joins, labeler, reports, sampling, sessionize
from vigilspark.sources import adapter, logs, records

from . import cases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ("session_id", "seg")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sessions(spark: SparkSession, sf_dir: str, **more: bool) -> DataFrame:
    return sessionize.sessions(adapter.log_events(spark, sf_dir), **more)


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines give one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# -- scans


@query
def o001_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = logs.parse_lines(cases.raw_lines(spark, sf_dir))
    return p.select("seq", "session", "kind", "src_ip", _micros("ts"), F.col("src_port").cast("long").alias("src_port"), "duration", "input", "bad", "ts_bad")


@query
def o006_parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_counts(logs.parse_lines(cases.raw_lines(spark, sf_dir)))


@query
def o088_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(logs.with_line_numbers(cases.raw_lines(spark, sf_dir)).select("source_file", "seq", "line_number"))


@query
def o015_upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    late = docs.where("event_id % 3 = 0")
    return records.upsert(late, records.upsert(docs, None, F.concat("user_id", F.lit("_"), "event_type"), "event_id"), F.concat("user_id", F.lit("_"), "event_type"), "event_id").select("_id", "user_id", "event_type", "value")


# -- sessions


@query
def o031_event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.log_events(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(sessionize.command_text()).alias("commands"))


@query
def o051_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.segments(adapter.log_events(spark, sf_dir)).groupBy("session", "seg").agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query
def o053_bounds_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    counts = ("event_count", "n_logins", "n_failed_logins", "n_commands", "n_failed_commands", "n_unique_commands", "n_downloads", "n_uploads", "n_forwards")
    return s.select(*KEY, _micros("start_ts"), _micros("end_ts"), "is_closed", F.array_join("source_files", ",").alias("files"), F.round("duration_s", 3).alias("duration_s"), *counts)


@query
def o054_last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_sessions(spark, sf_dir).select(*KEY, "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ssh_version", "hassh", "final_username", "final_password", "duration"))


@query
def o055_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    text = lambda name, f: F.array_join(F.transform(name, f), "\n").alias(name)
    none = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return s.select(
        *KEY, text("logins", lambda x: F.concat(none(x["username"]), F.lit(":"), none(x["password"]), F.lit(":"), F.when(x["success"], "y").otherwise("n"))), text("commands", lambda x: F.concat(F.when(x["success"], "+").otherwise("-"), x["input"])),
        text("downloads", lambda x: F.concat(none(x["url"]), F.lit("|"), none(x["shasum"]))), text("uploads", lambda x: none(x["destfile"])), text("forwards", lambda x: F.concat(none(x["dst_ip"]), F.lit(":"), none(x["dst_port"]))),
    )


@query
def o032_session_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).groupBy("session_type", "is_closed").agg(F.count(F.lit(1)).alias("n"))


@query
def o057_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.session_counts(_sessions(spark, sf_dir))


@query
def o028_nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.nested(documents.labelled(adapter.log_events(spark, sf_dir), adapter.geo_ranges(spark)))
    join = lambda c: F.array_join(c, "\n")
    return _long(d.select(
        "session_id", F.col("connection.dst_port").alias("dst_port"), F.col("timing.start_ts").alias("start_ts"), F.col("authentication.attempts").alias("attempts"), F.col("authentication.success_count").alias("logins"),
        join("authentication.usernames_tried").alias("users"), F.col("commands.total_count").alias("commands"), join("commands.inputs").alias("inputs"), join("downloads.urls").alias("urls"), F.col("uploads.count").alias("uploads"),
        F.col("meta.event_count").alias("events"), F.col("geo.country_iso").alias("country"), F.col("labels_rule_based.level").alias("level"), F.col("features.F37_message_length").alias("length"),
    ))


@query
def o030_flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.flat(documents.labelled(adapter.log_events(spark, sf_dir)), stamp=False)
    return _long(d.select("session_id", "location", "start_ts", "end_ts", "src_port", "dst_port", "protocol", "auth_success", F.size("commands").alias("commands"), F.size("login_attempts").alias("attempts"), "session_type", "event_count", F.col("labels_rule_based.primary_tactic").alias("tactic")))


# -- features


@query
def o103_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_sessions(spark, sf_dir, keywords=True).select(*KEY, *KEYWORDS, F.col("n_pipe").alias("extra_has_pipe"), F.col("n_redirect").alias("extra_has_redirect")))


@query
def o104_match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_sessions(spark, sf_dir, keywords=True).select(*KEY, *TOTALS))


@query
def o105_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    return _long(s.select(*KEY, features.total_length().alias("message_length"), "n_commands", "n_unique_commands", "max_length", F.floor(features.total_length() * 1000 / F.greatest("n_commands", F.lit(1))).alias("milli_avg_length")))


@query
def o111_min_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select(*KEY, F.coalesce(F.round(sessionize.min_gap(F.col("commands")) * 1e6).cast("long"), F.lit(-1).cast("long")).alias("gap_us"))


@query
def o115_host_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = features.host_columns()
    skip = ("F44_duration", "F45_received_size_avg")
    return _long(_sessions(spark, sf_dir).select(*KEY, *[c.alias(k) for k, c in h.items() if k not in skip]))


@query
def o039_private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapter.log_events(spark, sf_dir)
    return e.select("seq", "src_ip", is_private(F.col("src_ip")).alias("private"))


@query
def o047_geo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = features.with_geo(adapter.log_events(spark, sf_dir).select("seq", "src_ip"), adapter.geo_ranges(spark))
    return _long(g.select("seq", "src_ip", *features.GEO_FIELDS))


# -- rules


@query
def o126_threat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(cases.rule_labels(spark, sf_dir).groupBy("level", "primary_tactic").agg(F.count(F.lit(1)).alias("sessions")))


@query
def o130_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir, rules=True)
    names = F.expr("array_compact(array(" + ", ".join(f"if({labeler.rule_sql(r.bit)}, named_struct('tactic', '{r.tactic}', 'rule', '{r.name}'), null)" for r in RULES) + "))")
    return s.select(F.explode(names).alias("r")).groupBy("r.tactic", "r.rule").agg(F.count(F.lit(1)).alias("sessions"))


@query
def o133_rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cases.rule_labels(spark, sf_dir)
    return _long(r.select(*KEY, *[F.array_join(c, ",").alias(c) if c in ("all_tactics", "matched_patterns") else F.col(c) for c in labeler.LABEL_FIELDS]))


@query
def o128_obfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.log_events(spark, sf_dir).select("seq", sessionize.command_text().alias("cmd")).where("cmd is not null")
    x = F.col("cmd")
    return _long(c.select("seq", hits(x, DECODE_PIPE).alias("pipe"), hits(x, DECODE_BARE).alias("bare"), hits(x, ESCAPE_PIPE).alias("escape_pipe"), occurrences(x, ESCAPE).alias("escapes")))


@query
def o129_decoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.log_events(spark, sf_dir).select(sessionize.command_text().alias("cmd")).where("cmd is not null").distinct()
    return c.where(hits(F.col("cmd"), DECODE_PIPE)).select("cmd", F.array_join(decoded_payloads(F.col("cmd")), "\n").alias("payload"))


@query
def o131_unknown_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.log_events(spark, sf_dir).select(sessionize.command_text().alias("cmd")).where("cmd is not null").distinct()
    return c.select("cmd", is_suspicious(F.col("cmd")).alias("suspicious"), looks_like_typo(F.col("cmd")).alias("typo"))


@query
def o132_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", looks_like_typo(F.col("word")).alias("typo"))


# -- outliers


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir, keywords=True)
    cols = {**features.message_columns(), **features.host_columns()}
    return s.select(*KEY, *[cols[k].alias(k) for k in anomaly.WATCHED])


@query
def o058_detector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = anomaly.feature_stats(_watched(spark, sf_dir), src="", names=tuple(k for k in anomaly.WATCHED if "keyword" in k or k in ("extra_num_commands", "extra_unique_commands", "F46_download_count")))
    return st.select("name", "count", F.round("mean", 9).alias("mean"), F.round("m2", 9).alias("m2"))


# -- joins


def _retried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    original = o.select(F.col("o_custkey").alias("session_id"), "o_orderkey", F.col("o_orderstatus").alias("labels_agentic"))
    again = o.where("o_orderkey % 7 = 0").select((F.col("o_custkey") * 2).alias("session_id"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END").alias("labels_agentic"), F.col("o_orderkey").alias("seq"))
    return original, again


@query
def o041_update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.update_join(*_retried(spark, sf_dir)).select("session_id", "o_orderkey", "labels_agentic", "merged")


@query
def o042_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge_report(*_retried(spark, sf_dir))


@query
def o043_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluation.ground_truth(cases.votes(spark, sf_dir))
    return _long(evaluation.aligned(t, cases.sample_full(spark, sf_dir)).select("annotation_id", "tactic", "level", "a_tactic", "b_tactic", "a_level", "b_level", "bucket"))


@query
def o154_label_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cases.dual_rows(spark, sf_dir)
    c = joins.label_comparison(*[F.col(x) for x in ("rule_level", "rule_tactic", "agent_level", "agent_tactic")])
    return _long(d.select(*KEY, *[v.alias(k) for k, v in c.items()]))


@query
def o040_errored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.errored(cases.dual_rows(spark, sf_dir)).select(*KEY)


# -- reports


@query
def o062_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(reports.funnel(cases.dual_rows(spark, sf_dir)))


@query
def o063_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(reports.distributions(cases.dual_rows(spark, sf_dir)))


@query
def o064_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion(cases.dual_rows(spark, sf_dir))


@query
def o089_disagreement_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(reports.samples(cases.dual_rows(spark, sf_dir)))


@query
def o066_cell_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cell_profiles(cases.dual_rows(spark, sf_dir)).withColumn("avg_duration_s", F.round("avg_duration_s", 4))


@query
def o067_cell_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cell_counters(cases.dual_rows(spark, sf_dir))


@query
def o068_cell_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cell_samples(cases.dual_rows(spark, sf_dir)).withColumn("session_ids", F.array_join("session_ids", ","))


@query
def o070_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.costs(cases.dual_rows(spark, sf_dir))
    return _long(c.select(*[F.round(k, 6).alias(k) if t == "double" else F.col(k) for k, t in c.dtypes]))


@query
def o071_cost_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.floor_percentiles(reports.relevant_costs(cases.dual_rows(spark, sf_dir)), "cost_usd")


@query
def o073_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overview(cases.rule_labels(spark, sf_dir))


@query
def o073_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports.overview_averages(cases.rule_labels(spark, sf_dir))
    return a.select("sessions", F.round("avg_duration_s", 4).alias("avg_duration_s"), F.round("avg_commands", 6).alias("avg_commands"))


# -- sampling


@query
def o101_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.populations(cases.dual_rows(spark, sf_dir))


# -- evaluation


@query
def o074_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluation.ground_truth(cases.votes(spark, sf_dir))
    return _long(t.withColumn("tactic_agreement_rate", F.round("tactic_agreement_rate", 6)).withColumn("level_agreement_rate", F.round("level_agreement_rate", 6)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aligned(evaluation.ground_truth(cases.votes(spark, sf_dir)), cases.sample_full(spark, sf_dir))


@query
def o076_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_counts(_scored(spark, sf_dir), F.col("b_tactic"), F.col("tactic"))


@query
def o077_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.class_report(_scored(spark, sf_dir), F.col("b_tactic"), F.col("tactic"))
    return r.select("label", "tp", "predicted", "support", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")])


@query
def o077_overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.overall_report(_scored(spark, sf_dir), F.col("b_tactic"), F.col("tactic"))
    return r.select("n", *[F.round(k, 6).alias(k) for k in ("accuracy", "macro_f1", "weighted_f1")])


@query
def o078_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _scored(spark, sf_dir).agg(
        F.round(evaluation.mean_absolute_error(c("a_level"), c("level")), 6).alias("a_mae"), F.round(evaluation.mean_absolute_error(c("b_level"), c("level")), 6).alias("b_mae"),
        F.round(evaluation.fn_rate(c("a_tactic"), c("a_level"), c("fn_risk")), 6).alias("a_fn_rate"), F.round(evaluation.fn_rate(c("b_tactic"), c("b_level"), c("fn_risk")), 6).alias("b_fn_rate"),
    )


@query
def o080_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = lambda k: tactic_plain(F.col(k)) == tactic_plain(F.col("tactic"))
    return evaluation.mcnemar(_scored(spark, sf_dir), right("a_tactic"), right("b_tactic")).withColumn("p_value", F.round("p_value", 6))


@query
def o081_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(_scored(spark, sf_dir), F.col("a_tactic"), F.col("b_tactic"), F.col("tactic"))


@query
def o083_annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = evaluation.annotator_agreement(cases.votes(spark, sf_dir))
    return a.select("n_overlap", *[F.round(k, 6).alias(k) for k in a.columns[1:]])


@query
def o085_novel_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluation.novel_validation(_scored(spark, sf_dir), F.col("b_tactic"), F.col("tactic"))
    return v.withColumn("agent_precision", F.round("agent_precision", 6)).withColumn("human_real_threat_rate", F.round("human_real_threat_rate", 6))


