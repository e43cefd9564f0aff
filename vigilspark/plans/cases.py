"""Inputs that the registered queries share: second labels, votes, raw lines, made from the tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.operators.agents import durable
from vigilspark.operators.labeler import labels
from vigilspark.operators.reports import heads
from vigilspark.operators.sessionize import sessions
from vigilspark.sources.adapter import log_events, pick

AGENT_TACTICS = ("Initial Access", "Discovery", "Execution", "persistence", "Command and Control", " Impact", "", "Initial Access")
SKILLS = ("SCRIPT_KIDDIE", "INTERMEDIATE", "")
RULE_VOTES = ("Discovery", "Impact", "No Action", "Execution")

#: Of session columns user_id, seg and rule_tactic; both engines read these.
K = "(user_id + seg)"
HUNTER = f"CASE WHEN {K} % 4 = 0 OR {K} % 7 = 0 THEN NULL WHEN {K} % 7 < 3 THEN 'NOISE' ELSE 'RELEVANT' END"
VERDICT = f"({K} % 4 <> 0 AND {K} % 7 > 2 AND {K} % 11 <> 0)"


def second_labels(spark: bool) -> dict[str, str]:
    return {
        "is_anomaly": f"{K} % 4 <> 0", "hunter_verdict": HUNTER, "sent_to_hunter": f"{K} % 4 <> 0", "sent_to_analyst": f"{K} % 4 <> 0 AND {K} % 7 > 2", "has_verdict": VERDICT,
        "agent_level": f"CASE WHEN {VERDICT} AND {K} % 13 <> 0 THEN CAST(1 + {K} % 3 AS INT) END",
        "agent_tactic": f"CASE WHEN {VERDICT} THEN CASE WHEN {K} % 3 = 0 THEN rule_tactic ELSE {pick(AGENT_TACTICS, K + ' * 3 + seg', spark)} END END",
        "agent_sophistication": f"CASE WHEN {VERDICT} THEN {pick(SKILLS, K, spark)} END", "agent_confidence": f"CASE WHEN {VERDICT} THEN CAST({K} % 5 AS DOUBLE) / 10 END",
        "cost_usd": f"CAST({K} % 23 AS DOUBLE)", "latency_ms": f"CAST({K} % 100 * 10 AS BIGINT)",
    }


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(sessions(log_events(spark, sf_dir), rules=True))


def dual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat shape of the reports over rule labels and made-up second ones, stored first as it is in use."""
    rows = rule_labels(spark, sf_dir).withColumnRenamed("first_seq", "seq").withColumns({"rule_level": F.col("level"), "rule_tactic": F.col("primary_tactic")})
    rows = rows.withColumn("heads", heads(F.transform("commands", lambda c: c["input"])))
    keep = ("session_id", "seg", "seq", "user_id", "location", "session_type", "n_commands", "heads", "duration_s", "auth_success", "n_downloads", "n_uploads", "rule_level", "rule_tactic", "matched_patterns", "sophistication_score")
    return durable(rows.select(*keep)).withColumns({k: F.expr(v) for k, v in second_labels(True).items()})


#: Three votes on each labelled document, of columns doc_id, quality, toxic and voter.
VOTES = {
    "annotation_id": "doc_id", "seq": "doc_id * 3 + voter", "threat_level": "CAST(1 + (doc_id * (voter + 1) + quality) % 3 AS INT)",
    "confidence": "CASE WHEN (doc_id + voter) % 6 <> 0 THEN CAST(1 + (doc_id + voter) % 5 AS INT) END", "is_false_negative_risk": "(doc_id + voter + toxic) % 9 = 0",
}


def vote_columns(spark: bool) -> dict[str, str]:
    return VOTES | {"primary_tactic": f"CASE WHEN (doc_id + voter) % 31 <> 0 THEN {pick(RULE_VOTES, 'doc_id + voter * toxic', spark)} END"}


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("voter", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    return rows.select(*[F.expr(x).alias(k) for k, x in vote_columns(True).items()])


#: The sample that the votes are compared with, of the same columns without voter.
SAMPLE = {"annotation_id": "doc_id", "seq": "doc_id", "a_level": "CAST(1 + (doc_id + quality) % 3 AS INT)", "b_level": "CASE WHEN doc_id % 10 <> 0 THEN CAST(1 + (doc_id * 2 + toxic) % 3 AS INT) END", "bucket": "CASE WHEN doc_id % 4 = 0 THEN 'novel' ELSE 'agreement' END"}


def sample_columns(spark: bool) -> dict[str, str]:
    return SAMPLE | {"a_tactic": pick(RULE_VOTES, "doc_id + quality", spark), "b_tactic": f"CASE WHEN doc_id % 12 <> 0 THEN {pick(RULE_VOTES, 'doc_id * 2 + toxic', spark)} END"}


def sample_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id % 5 <> 0")
    return rows.select(*[F.expr(x).alias(k) for k, x in sample_columns(True).items()])


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written from the log, with every kind of bad line among them."""
    rows = log_events(spark, sf_dir)
    vendor = F.concat(F.lit("sensor."), "kind")
    at = F.when(F.col("seq") % 19 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    whole = F.struct(vendor.alias("eventid"), "session", "src_ip", at.alias("timestamp"), "src_port", "input", "duration")
    bare = F.struct(at.alias("timestamp"), "input")
    odd = F.concat(F.lit('{"eventid": "sensor.session.closed", "session": "x", "timestamp": '), F.col("seq"), F.lit("}"))
    value = F.when(F.col("seq") % 50 == 0, "no json").when(F.col("seq") % 50 == 1, "[1, 2]").when(F.col("seq") % 50 == 2, odd).when(F.col("seq") % 50 == 3, F.to_json(bare)).otherwise(F.to_json(whole))
    return rows.select("location", "seq", "source_file", value.alias("value"))
