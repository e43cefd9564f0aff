"""Registered queries over files and stored records: each writes what it needs into the shared folder, then reads it as a user would."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.columns import fixed
from vigilspark.operators import agents, anomaly, documents, evaluation, features, joins, reports, sampling, schema_check
from vigilspark.sources import adapter, geo, logs, records
from vigilspark.streaming.sessions import flush_sessions, stream_sessions

from . import cases
from .queries import KEY, Query, _long, _retried, _sessions, _watched, table

QUERIES: dict[str, Query] = {}
TOTAL = 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def folder(spark: SparkSession, name: str) -> str:
    return f"{agents.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> str:
    """A small file of the caller's, on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


# -- logs


def write_logs(spark: SparkSession, sf_dir: str, base: str) -> None:
    """The lines of ``cases.raw_lines`` as three sensors' files of four days, gzipped on even days, with blank lines among them."""
    lines = cases.raw_lines(spark, sf_dir).withColumn("day", (F.col("seq") % 4 + 1).cast("int")).withColumn("place", F.concat(F.lit("ssh-"), F.col("seq") % 3))
    value = F.when(F.col("seq") % 10 == 9, F.concat(F.lit("  \n"), "value", F.lit(" \n"))).otherwise(F.col("value"))
    lines = lines.select("place", "day", "seq", value.alias("value"))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for gz in (0, 1):
        some = lines.where(F.col("day") % 2 == 1 - gz).repartition("place", "day").sortWithinPartitions("place", "day", "seq").drop("seq")
        some.write.partitionBy("place", "day").option("compression", "gzip" if gz else "none").text(f"{base}/raw{gz}")
        root = fs_path(f"{base}/raw{gz}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for d in fs.globStatus(fs_path(f"{base}/raw{gz}/place=*/day=*")):
            place, day = d.getPath().getParent().getName().partition("=")[2], d.getPath().getName().partition("=")[2]
            fs.mkdirs(fs_path(f"{base}/{place}"))
            for k, f in enumerate(x for x in fs.listStatus(d.getPath()) if x.getPath().getName().startswith("part-")):
                assert k == 0, "one file a day"
                fs.rename(f.getPath(), fs_path(f"{base}/{place}/decoy.json.2024_1_{day}" + ".gz" * gz))


@query
def o002_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three files by date of each sensor: lines, events, errors, and where its events are in the sensor's order."""
    base, out = folder(spark, "logs"), None
    write_logs(spark, sf_dir, base)
    for k in range(3):
        place = f"ssh-{k}"
        lines = logs.read_lines(spark, logs.list_logs(spark, f"{base}/{place}", "decoy*", 3), place)
        parsed = logs.parse_lines(lines).select("location", "source_file", "seq", "bad", "ts", F.col("kind").startswith("command.").alias("command"))
        one = parsed.groupBy("location", "source_file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("bad")).alias("events"), F.count_if("bad").alias("errors"), F.count_if(~F.col("bad") & F.col("command")).alias("commands"), F.max(F.unix_micros("ts")).alias("last_us"))
        out = one if out is None else out.union(one)
    return out


@query
def o006_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = folder(spark, "logs")
    write_logs(spark, sf_dir, base)
    rows = None
    for k in range(3):
        one = logs.parse_lines(logs.read_lines(spark, logs.list_logs(spark, f"{base}/ssh-{k}", "*"), f"ssh-{k}"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("location").agg(F.countDistinct("source_file").alias("files"), F.count_if(~F.col("bad")).alias("events"), F.count_if("bad").alias("errors"))


@query
def o005_time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of a time, of one instant to the microsecond, the millisecond or the second."""
    e, ts = adapter.log_events(spark, sf_dir), F.col("ts")
    at = lambda form, x=ts: F.date_format(x, form)
    k = F.col("seq") % 8
    text = (
        F.when(k == 0, at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", ts + F.expr("interval 2 hours")), F.lit("+02:00"))).when(k == 2, at("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(k == 3, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 4, at("yyyy-MM-dd HH:mm:ss")).when(k == 5, at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 6, F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", ts - F.expr("interval 330 minutes")), F.lit("-05:30"))).otherwise("soon")
    )
    return e.select("seq", F.unix_micros(logs.parse_time(text)).alias("us"))


# -- records


def _records(spark: SparkSession, sf_dir: str, **more: bool) -> DataFrame:
    return documents.flat(documents.labelled(adapter.log_events(spark, sf_dir)), stamp=False, keep=("seg",), **more)


@query
def o007_record_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records written, a file of bad lines beside them, and read back by schema."""
    rows, path = _records(spark, sf_dir).drop("seg"), folder(spark, "records")
    records.write_json(rows, path)
    put(spark, f"{path}/bad.json", 'no json\n{"session_id": 5, "event_count": "many"\n[1]\n\n')
    back = records.read_records(spark, path, records.session_schema(rows.schema["features"].dataType))
    level = F.col("labels_rule_based.level")
    return _long(back.groupBy("session_type", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("commands")).alias("commands"), F.sum("event_count").alias("events"), F.sum("features.F37_message_length").alias("lengths")))


@query
def o008_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three policies over one file: skipped, kept, and failing."""
    rows, path = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("annotation_id"), F.lit("a").alias("annotator")), folder(spark, "votes")
    records.write_json(rows, path)
    bad = put(spark, f"{path}/bad.json", "no json\n{\"annotation_id\": \n")
    skip, keep = (records.read_records(spark, path, records.ANNOTATION, policy) for policy in ("skip", "keep"))
    try:
        failed = records.read_records(spark, bad, records.ANNOTATION, "fail").count() < 0
    except Exception:  # noqa: BLE001 - whatever the reader raises is the failure that is asked for
        failed = True
    # a reader refuses to be asked for the bad lines alone
    counts = keep.agg(F.count(F.lit(1)).alias("kept_lines"), F.count("bad_line").alias("bad_lines"), F.count("annotation_id").alias("good_lines"))
    return skip.agg(F.count("annotation_id").alias("read")).crossJoin(F.broadcast(counts)).withColumn("fails", F.lit(failed))  # one row each


@query
def o009_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in two files, some without identifier, up to the ground truth."""
    v, path = cases.votes(spark, sf_dir), folder(spark, "votes")
    v = v.withColumn("annotation_id", F.when(F.col("seq") % 7 != 0, F.col("annotation_id")))
    for k in (0, 1):
        records.write_json(v.where(F.col("annotation_id").isNull() | (F.col("annotation_id") % 2 == k)).coalesce(1).sortWithinPartitions("seq").drop("seq"), f"{path}/{k}")
    read = records.read_annotations(spark, [f"{path}/0", f"{path}/1"])
    t = evaluation.ground_truth(read)
    return _long(t.withColumn("tactic_agreement_rate", F.round("tactic_agreement_rate", 6)).withColumn("level_agreement_rate", F.round("level_agreement_rate", 6)))


@query
def o010_last_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a repeated identifier of the full sample the last record counts."""
    s = cases.sample_full(spark, sf_dir)
    again = s.where("annotation_id % 4 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "a_tactic": F.lit("Impact"), "bucket": F.lit("again")})
    t = evaluation.ground_truth(cases.votes(spark, sf_dir))
    return _long(evaluation.aligned(t, s.unionByName(again)).select("annotation_id", "tactic", "a_tactic", "bucket"))


@query
def o012_geo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup from published CSV files instead of a table of ranges; without a file, empty fields."""
    base = folder(spark, "geo")
    ids = {row: i for i, row in enumerate(adapter.GEO, 1)}
    nets = {1: ["81.2.0.0/17"], 2: ["20.0.0.0/6", "24.0.0.0/6", "28.0.0.0/7"], 3: ["100.0.0.0/6", "104.0.0.0/5", "112.0.0.0/5"]}
    blocks = ["network,geoname_id,latitude,longitude,accuracy_radius"] + [f"{n},{i},{row[8]},{row[7]},{row[10]}" for row, i in ids.items() for n in nets[i]] + ["2001:db8::/32,1,0,0,1"]
    names = ["geoname_id,continent_code,country_name,country_iso_code,subdivision_1_name,city_name,time_zone"] + [f"{i},{r[2]},{r[3]},{r[4]},{r[5]},{r[6]},{r[9]}" for r, i in ids.items()]
    ranges = geo.read_geo(spark, put(spark, f"{base}/blocks.csv", "\n".join(blocks)), put(spark, f"{base}/names.csv", "\n".join(names)))
    assert geo.read_geo(spark, f"{base}/none.mmdb") is None
    g = features.with_geo(adapter.log_events(spark, sf_dir).select("seq", "src_ip"), ranges)
    return _long(g.select("seq", "src_ip", *features.GEO_FIELDS))


@query
def o019_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made with its mapping, documents inserted twice over, replaced once: what the sink counted beside what a reader finds."""
    d, path = agents.durable(documents.nested(documents.labelled(adapter.log_events(spark, sf_dir)))), folder(spark, "table")
    records.create_table(spark, path, d.schema)
    records.insert(d, path)
    records.create_table(spark, path, d.schema, replace=True)
    said = records.insert(d, path)
    back = records.read_table(spark, path)
    assert records.fields_of(back.schema) == records.fields_of(d.schema)
    dry = records.dry_run(d)
    found = back.agg(F.count(F.lit(1)).alias("found"), F.sum("meta.event_count").alias("events"), F.count_distinct("location").alias("places"))
    return found.select("*", *[F.lit(v).cast("long").alias(k) for k, v in (("written", said["written"]), ("unnamed", said["unnamed"]), ("locations", said["locations"]), ("dry_run", dry))])


@query
def o016_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and types of a stored mapping, outside of the features."""
    d, path = documents.nested(documents.labelled(adapter.log_events(spark, sf_dir))), folder(spark, "table")
    records.create_table(spark, path, d.schema)
    rows = [(k, t) for k, t in records.fields_of(records.mapping_of(spark, path)) if not k.startswith(("features.", "geo."))]
    return spark.createDataFrame(rows, "field string, kind string")


@query
def o017_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.flat(documents.labelled(adapter.log_events(spark, sf_dir)))
    at = F.to_timestamp("ingested_at")
    return d.agg(F.count(F.lit(1)).alias("records"), F.count_if((at <= F.current_timestamp()) & (at > F.current_timestamp() - F.expr("interval 1 day"))).alias("stamped"))


@query
def o020_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records exported with a progress callback: rows told by the writer, rows found, and whether progress came to its end."""
    told: list[tuple[int, int]] = []
    path = folder(spark, "export")
    n = records.write_json(_records(spark, sf_dir), path, tell=lambda done, all_: told.append((done, all_)))
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("found")).select("found", F.lit(n).cast("long").alias("written"), F.lit(told[-1][0] == told[-1][1]).alias("ended"))


@query
def o021_record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's JSON has its bounds in one form and its commands' times in another."""
    j = _records(spark, sf_dir).select("session_id", "seg", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return j.select("session_id", "seg", at("$.start_ts").alias("start_ts"), at("$.end_ts").alias("end_ts"), at("$.commands[0].timestamp").alias("first_command"), at("$.commands[0].input").alias("input"))


@query
def o022_labelled_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records scored, labelled as in a dry run, written, and read back by the labelled schema."""
    rows = _records(spark, sf_dir).drop("seg")
    out = agents.unreviewed(anomaly.score(rows, anomaly.train(rows)))
    path = folder(spark, "labelled")
    records.write_json(out, path)
    back = records.read_records(spark, path, records.labeled_schema(rows.schema["features"].dataType))
    m = "labels_agentic.pipeline_metrics"
    return _long(back.groupBy(F.col("statistical_anomaly.is_anomaly").alias("is_anomaly"), F.col("labels_agentic.was_anomaly").alias("was_anomaly"), F.col(f"{m}.sent_to_hunter").alias("sent")).agg(F.count(F.lit(1)).alias("n"), F.count("labels_agentic.hunter_verdict").alias("verdicts"), F.sum(f"{m}.total_latency_ms").alias("ms")))


@query
def o025_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as one JSON document and read back."""
    made = records.report_json({"overview": reports.overview(cases.rule_labels(spark, sf_dir))})
    path = put(spark, f"{folder(spark, 'report')}/report.json", json.dumps(made))
    back = spark.read.schema("overview array<struct<section:string,value:string,n:bigint>>").json(path)
    return back.select(F.explode("overview").alias("r")).select("r.*")


@query
def o026_merged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retried labels merged into a new file; the input stays."""
    path = folder(spark, "merged")
    n = records.write_json(joins.update_join(*_retried(spark, sf_dir)), path)
    back = spark.read.schema("session_id bigint, o_orderkey bigint, labels_agentic string, merged boolean").json(path)
    return back.groupBy("merged", "labels_agentic").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.lit(n).cast("long").alias("written"))


@query
def o038_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with planted defects: a field, a label or a feature missing, a level as text, commands as text, no JSON."""
    rows = _records(spark, sf_dir).withColumn("k", F.substring("session_id", 2, 20).cast("long") % 8)
    cols = [c for c in rows.columns if c not in ("seg", "k")]
    made = lambda *without, **other: F.to_json(F.struct(*[(other[c].alias(c) if c in other else F.col(c)) for c in cols if c not in without]), {"ignoreNullFields": "false"})
    rule, k = F.col("labels_rule_based"), F.col("k")
    text = (
        F.when(k == 1, made("src_ip", "location")).when(k == 2, made(labels_rule_based=rule.withField("level", rule["level"].cast("string")))).when(k == 3, made(commands=F.lit("none")))
        .when(k == 4, made(features=F.col("features").dropFields("F44_duration"))).when(k == 5, "no json").when(k == 6, made(labels_rule_based=rule.dropFields("level", "matched_patterns"))).when(k == 7, "[1, 2]").otherwise(made())
    )
    c = schema_check.checked(rows.select("session_id", "seg", text.alias("value")))
    return c.select("session_id", "seg", "ok_json", F.array_join("errors", "; ").alias("errors"))


@query
def o094_list_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sessions of very many commands, so that every cap is reached."""
    e = adapter.log_events(spark, sf_dir).where("kind != 'session.closed'").withColumn("session", F.concat(F.lit("big"), F.col("user_id") % 3))
    d = documents.nested(documents.labelled(e))
    n = lambda c: F.size(c).cast("long")
    return _long(d.select("session_id", F.col("commands.total_count").alias("commands"), n("commands.inputs").alias("inputs"), F.array_join("commands.inputs", "\n").alias("first"), F.col("downloads.count").alias("downloads"), n("downloads.urls").alias("urls"), n("downloads.shasums").alias("sums"), n("labels_rule_based.matched_patterns").alias("patterns")))


# -- features and outliers


@query
def o106_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = features.message_columns()
    s = _sessions(spark, sf_dir, keywords=True)
    return _long(s.select(*KEY, *[m[k].alias(k) for k in ("F38_messages_per_sec", "extra_chars_per_sec", "extra_avg_cmd_length", "extra_command_diversity_ratio", "extra_min_inter_command_gap", "extra_max_cmd_length", "extra_unique_commands")]))


@query
def o120_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = features.host_columns()
    return _sessions(spark, sf_dir).select(*KEY, *[h[k].alias(k) for k in ("F44_duration", "F45_received_size_avg")])


@query
def o058_all_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = anomaly.feature_stats(_watched(spark, sf_dir), src="")
    return st.select("name", "count", fixed(F.col("mean"), 6).alias("mean"), fixed(F.col("m2") / F.greatest(F.col("count") - 1, F.lit(1)), 3).alias("variance"))


def _stored_detector(spark: SparkSession, sf_dir: str) -> anomaly.Detector:
    path = f"{folder(spark, 'detector')}/model.json"
    anomaly.train(_watched(spark, sf_dir), src="").save(path, spark)
    return anomaly.Detector.load(path, spark)


@query
def o023_detector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector trained, saved and loaded."""
    d = _stored_detector(spark, sf_dir)
    rows = [(k, n, f"{mean:.6f}", f"{d.std(k):.6f}", d.trained, d.z_threshold, d.min_samples) for k, (n, mean, _) in d.stats.items()]
    return spark.createDataFrame(rows, "name string, count long, mean string, std string, trained boolean, z_threshold double, min_samples long")


@query
def o060_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _stored_detector(spark, sf_dir).summary().split("\n")], "line string")


@query
def o141_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored by a loaded detector: flag, score, reasons, and z of every feature in thousandths."""
    found = anomaly.score(_watched(spark, sf_dir), _stored_detector(spark, sf_dir), src="")
    a = F.col("statistical_anomaly")
    z = F.array_join(F.transform(F.array(*[F.lit(k) for k in anomaly.WATCHED]), lambda k: F.coalesce(F.round(F.try_element_at(a["z_scores"], k) * 1000).cast("long").cast("string"), F.lit("-"))), ",")
    return found.select(*KEY, a["is_anomaly"].alias("is_anomaly"), a["score"].alias("score"), F.array_join(a["reasons"], "; ").alias("reasons"), z.alias("z"))


@query
def o142_flag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a detector, and with one of too few samples, every session is flagged."""
    rows = _watched(spark, sf_dir)
    few = anomaly.train(rows, min_samples=10**9, src="")
    out = None
    for name, detector in (("none", None), ("untrained", few)):
        a = F.col("statistical_anomaly")
        one = anomaly.score(rows, detector, src="").groupBy(F.lit(name).alias("detector"), a["is_anomaly"].alias("is_anomaly"), a["score"].alias("score"), F.array_join(a["reasons"], ";").alias("reasons")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(a["z_scores"])).cast("long").alias("z_scores"))
        out = one if out is None else out.union(one)
    return out


# -- reviewers


def _scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agents.durable(documents.flat(documents.labelled(adapter.log_events(spark, sf_dir)), stamp=False, keep=("seg", "first_seq")))
    return anomaly.score(rows, anomaly.train(rows))


def _partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


QUICK = agents.AgentConfig(attempts=1, delay_s=0.0, requests_per_minute=10**9)


def _failing() -> agents.ScriptedClient:
    return agents.ScriptedClient(fail_on="crontab")


def _verdicts(done: DataFrame) -> DataFrame:
    l, m, d = "labels_agentic", "labels_agentic.pipeline_metrics", "review_detail"
    return _long(done.select(
        "session_id", "seg", F.col(f"{l}.was_anomaly").alias("was_anomaly"), F.col(f"{l}.hunter_verdict").alias("hunter_verdict"), F.col(f"{l}.analyst_verdict.level").alias("level"), F.col(f"{l}.analyst_verdict.primary_tactic").alias("tactic"),
        F.col(f"{m}.sent_to_hunter").alias("to_hunter"), F.col(f"{m}.sent_to_analyst").alias("to_analyst"), F.col(f"{d}.skipped").alias("skipped"), F.col(f"{d}.stage").alias("stage"),
    ))


@query
def o149_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch: passed by, failed at the first look, noise, and looked at in depth."""
    return _verdicts(agents.run_reviewers(_scored_records(spark, sf_dir), _failing, QUICK, partitions=_partitions(spark)))


@query
def o061_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = agents.run_stats(agents.run_reviewers(_scored_records(spark, sf_dir), _failing, QUICK, partitions=_partitions(spark)))
    names = ("sessions_processed", "sessions_anomalous", "sent_to_hunter", "marked_relevant", "sessions_fully_analyzed", "errors", "anomaly_rate", "hunter_filter_rate")
    return s.select(*[F.round(n, 6).alias(n) if n.endswith("rate") else F.col(n) for n in names])


@query
def o152_retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without an answer asked again with the gate off, and merged by their identifier."""
    first = agents.durable(agents.run_reviewers(_scored_records(spark, sf_dir), _failing, QUICK, partitions=_partitions(spark)))
    again = agents.retry(first, agents.ScriptedClient, QUICK, partitions=_partitions(spark)).select("session_id", "labels_agentic", F.col("first_seq").alias("seq"))
    merged = joins.update_join(first.drop("review_detail"), again)
    return _long(merged.select("session_id", "seg", "merged", F.col("labels_agentic.hunter_verdict").alias("hunter_verdict"), F.col("labels_agentic.analyst_verdict.level").alias("level")))


@query
def o153_reanalyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thorough look again at sessions that were found relevant."""
    first = agents.run_reviewers(_scored_records(spark, sf_dir), agents.ScriptedClient, QUICK, partitions=_partitions(spark)).where("labels_agentic.hunter_verdict = 'RELEVANT'")
    done = agents.reanalyze(first, agents.ScriptedClient, QUICK, partitions=_partitions(spark))
    m = "labels_agentic.pipeline_metrics"
    return _long(done.select("session_id", "seg", F.col("labels_agentic.hunter_verdict").alias("hunter_verdict"), F.col("labels_agentic.analyst_verdict.level").alias("level"), F.col(f"{m}.sent_to_analyst").alias("to_analyst"), F.col("review_error").isNull().alias("answered")))


@query
def o144_dry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agents.unreviewed(_scored_records(spark, sf_dir))
    m = "labels_agentic.pipeline_metrics"
    return _long(d.select("session_id", "seg", F.col("labels_agentic.was_anomaly").alias("was_anomaly"), F.col("labels_agentic.hunter_verdict").alias("hunter_verdict"), F.col(f"{m}.sent_to_hunter").alias("to_hunter"), F.col(f"{m}.total_latency_ms").alias("ms"), F.col(f"{m}.total_cost_usd").alias("usd")))


@query
def o093_first_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir, rules=True)
    return records.first_rows(s, 25, "first_seq").select(*KEY, "first_seq", "event_count")


@query
def o082_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four verdicts over intervals around 0."""
    d = table(spark, sf_dir, "labels").select((F.col("doc_id") % 41 - 20).alias("k")).distinct()
    low = F.col("k").cast("double") / 100 - 0.04
    return d.select("k", evaluation.verdict(low, low + 0.05, 0.05).alias("verdict"))


# -- samples


@query
def o098_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(cases.dual_rows(spark, sf_dir))


@query
def o100_scaled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(cases.dual_rows(spark, sf_dir), sampling.Quotas().scaled(TOTAL), seed=7)


@query
def o102_sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotators' records, blind and full, of the scaled sample: their fields beside what they say."""
    picked = agents.durable(sampling.stratified(cases.dual_rows(spark, sf_dir), sampling.Quotas().scaled(TOTAL), seed=7))
    rows = agents.unreviewed(_scored_records(spark, sf_dir)).withColumnRenamed("first_seq", "seq")
    out = None
    for blind in (True, False):
        r = sampling.sample_records(rows, picked, blind)
        fields = F.lit(",".join(c for c in r.columns if c.endswith(("label", "verdict", "anomaly"))))
        one = r.select("annotation_id", "session_id", "bucket", "bucket_key", F.col("commands.total_count").alias("commands"), F.array_join("commands.inputs", "\n").alias("inputs"), F.col("login_attempts.attempts").alias("attempts"), F.array_join("login_attempts.usernames_tried", ",").alias("users"), "ssh_version", F.lit(blind).alias("blind"), fields.alias("labels"))
        out = one if out is None else out.union(one)
    return _long(out)


@query
def o024_sample_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agents.durable(cases.dual_rows(spark, sf_dir))
    q = sampling.Quotas().scaled(TOTAL)
    m = sampling.metadata(rows, agents.durable(sampling.stratified(rows, q, seed=7)), q, 7, "in", "blind", "full")
    path = put(spark, f"{folder(spark, 'sample')}/metadata.json", json.dumps(m))
    schema = "seed long, total_sessions_scanned long, dual_labeled_sessions long, populations map<string,map<string,long>>, final_sample struct<total:long,by_bucket:map<string,long>>"
    back = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")
    return back.select("seed", "total_sessions_scanned", "dual_labeled_sessions", F.col("final_sample.total").alias("drawn"), F.explode("final_sample.by_bucket").alias("bucket", "n"), "populations").select(
        "seed", "total_sessions_scanned", "dual_labeled_sessions", "drawn", "bucket", "n", F.aggregate(F.map_values(F.element_at("populations", F.col("bucket"))), F.lit(0).cast("long"), lambda a, x: a + x).alias("population")
    )


# -- streams


@query
def o155_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream with their labels and a feature, the unclosed ones flushed at its end."""
    base = folder(spark, "stream")
    stream_sessions(adapter.events_stream(spark, sf_dir), f"{base}/rows", f"{base}/state").awaitTermination()
    flush_sessions(spark, f"{base}/rows", f"{base}/state")
    s = spark.read.parquet(f"{base}/rows")
    inputs = F.array_join(F.transform("commands", lambda c: c["input"]), "\n")
    return _long(s.select(*KEY, "event_count", "is_closed", "n_logins", "n_failed_logins", "n_commands", inputs.alias("commands"), "session_type", F.col("features.F37_message_length").alias("length"), "level", "primary_tactic"))
