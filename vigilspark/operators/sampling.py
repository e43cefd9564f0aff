"""Stratified samples for annotation: buckets, quotas, priorities, records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.columns import tactic_plain

from .reports import is_novel

OTHER = "_other"
PRIORITY = ("disagreement", "novel", "level_only", "agreement")


def pair_key(rule: str, agent: str) -> str:
    return f"{rule} -> {agent}"


@dataclass
class Quotas:
    agreement: dict[str, int] = field(default_factory=lambda: {"Impact": 15, "Execution": 10, "Persistence": 10, "Command and Control": 20, "Initial Access": 20, "Discovery": 30, OTHER: 15})
    disagreement: dict[str, int] = field(default_factory=lambda: {
        pair_key("No Action", "Execution"): 10, pair_key("No Action", "Initial Access"): 30, pair_key("Impact", "Persistence"): 10, pair_key("Command and Control", "Execution"): 25,
        pair_key("Command and Control", "Initial Access"): 35, pair_key("Unknown Activity (Low)", "Initial Access"): 20, pair_key("Unknown Activity (High)", "Persistence"): 15,
        pair_key("Discovery", "Initial Access"): 40, pair_key("Discovery", OTHER): 10, pair_key(OTHER, OTHER): 25,
    })
    novel: int = 40
    level_only: int = 20

    def total(self) -> int:
        return sum(self.agreement.values()) + sum(self.disagreement.values()) + self.novel + self.level_only

    def as_dict(self) -> dict[str, dict[str, int] | int]:
        return {"agreement": self.agreement, "disagreement": self.disagreement, "novel": self.novel, "level_only": self.level_only}

    def scaled(self, total: int) -> Quotas:
        """All quotas in proportion, rounded half to even, at least 1."""
        by = lambda v: max(1, round(v * total / self.total()))
        return Quotas({k: by(v) for k, v in self.agreement.items()}, {k: by(v) for k, v in self.disagreement.items()}, by(self.novel), by(self.level_only))


def buckets(quotas: Quotas) -> Column:
    """array of (bucket, bucket_key) that a dual-labelled row belongs to."""
    rt, at = tactic_plain(F.col("rule_tactic")), tactic_plain(F.col("agent_tactic"))
    rl, al = F.col("rule_level"), F.col("agent_level")
    entry = lambda b, k: F.struct(F.lit(b).alias("bucket"), k.alias("bucket_key"))
    same = (F.lower(rt) == F.lower(at)) & (rt != "")
    level = F.coalesce(rl == al, F.lit(True))
    pair = F.concat(rt, F.lit(" -> "), at)
    key = F.when(pair.isin(*quotas.disagreement), pair).when(rt == "Discovery", pair_key("Discovery", OTHER)).otherwise(pair_key(OTHER, OTHER))
    agreed = F.when(rt.isin(*quotas.agreement), rt).otherwise(OTHER)
    return F.array_compact(F.array(
        F.when(is_novel(), entry("novel", F.lit("novel"))), F.when(same & level, entry("agreement", agreed)),
        F.when(same & ~level, entry("level_only", F.concat(rt, F.lit("|L"), rl, F.lit("->L"), al))), F.when(~same, entry("disagreement", key)),
    ))


def classified(rows: DataFrame, quotas: Quotas | None = None) -> DataFrame:
    """A row of each dual-labelled session for each of its buckets."""
    return rows.where("has_verdict").withColumn("b", F.explode(buckets(quotas or Quotas()))).select("*", "b.*").drop("b")


def populations(rows: DataFrame, quotas: Quotas | None = None) -> DataFrame:
    """(bucket, bucket_key, n)."""
    return classified(rows, quotas).groupBy("bucket", "bucket_key").agg(F.count(F.lit(1)).alias("n"))


def stratified(rows: DataFrame, quotas: Quotas | None = None, seed: int = 42) -> DataFrame:
    """(annotation_id, seq, session_id, bucket, bucket_key): a sample without replacement by quota.

    Rows are drawn in the order of a seeded hash, so the sample is the same on every run and however
    the data are split. Sessions that differ in level only share one quota. A session in several
    buckets keeps the first of disagreement, novel, level_only, agreement. Identifiers are 1, 2, ... in
    input order.
    """
    q = quotas or Quotas()
    limits = {("agreement", k): v for k, v in q.agreement.items()} | {("disagreement", k): v for k, v in q.disagreement.items()} | {("novel", "novel"): q.novel, ("level_only", "*"): q.level_only}
    each = classified(rows, q).withColumn("pool", F.when(F.col("bucket") == "level_only", "*").otherwise(F.col("bucket_key")))
    limit = F.lit(0)
    for (b, k), n in limits.items():
        limit = F.when((F.col("bucket") == b) & (F.col("pool") == k), n).otherwise(limit)
    w = Window.partitionBy("bucket", "pool").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("seq").cast("string"))), "seq")
    # the plain bound lets Spark cut each partition before the shuffle
    drawn = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(limits.values())).where(F.col("rank") <= limit)
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("bucket"))
    one = drawn.groupBy("seq").agg(F.min_by(F.struct("session_id", "bucket", "bucket_key"), rank).alias("s")).select("seq", "s.*")
    # at most the sum of the quotas: one partition is enough
    return one.withColumn("annotation_id", F.row_number().over(Window.orderBy("seq")).cast("long")).select("annotation_id", "seq", "session_id", "bucket", "bucket_key")


def metadata(rows: DataFrame, selection: DataFrame, quotas: Quotas | None = None, seed: int = 42, source: str = "", blind: str = "", full: str = "") -> dict:
    """What goes with a sample: how it was drawn, from how many, and what is in it. Counts alone come to the driver."""
    q = quotas or Quotas()
    seen = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("has_verdict").alias("dual")).first()
    there: dict[str, dict[str, int]] = {}
    for r in populations(rows, q).orderBy("bucket", "bucket_key").collect():
        there.setdefault(r["bucket"], {})[r["bucket_key"]] = r["n"]
    drawn = {r["bucket"]: r["n"] for r in selection.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()}
    return {
        "seed": seed, "input": source, "total_sessions_scanned": seen["total"], "dual_labeled_sessions": seen["dual"], "quotas": q.as_dict(), "populations": there,
        "final_sample": {"total": sum(drawn.values()), "by_bucket": drawn, "blind_path": blind, "full_path": full},
    }


def sample_records(labeled: DataFrame, selection: DataFrame, blind: bool = True, show_key: bool = True, client: bool = False) -> DataFrame:
    """The annotators' records of the selected sessions; ``blind`` leaves the labels out.

    ``show_key`` keeps bucket_key, which for a disagreement names both labels. ``client`` fills
    ssh_version and hassh, which the stored records have at the top and the usual sample leaves null.
    """
    a = "login_attempts"
    users = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda x: x["username"]), lambda u: u.isNotNull() & (u != "")))), 1, 20)
    ok = F.size(F.filter(a, lambda x: x["success"]))
    none = F.lit(None).cast("string")
    cols = [
        "session_id", "location", "session_type", "duration_s", "start_ts", "end_ts", "auth_success",
        F.struct(F.size(a).alias("attempts"), (F.size(a) - ok).alias("failed_count"), ok.alias("success_count"), "final_username", "final_password", users.alias("usernames_tried")).alias("login_attempts"),
        (F.col("ssh_version") if client else none).alias("ssh_version"), (F.col("hassh") if client else none).alias("hassh"),
        F.struct(F.size("commands").alias("total_count"), F.transform("commands", lambda c: c["input"]).alias("inputs")).alias("commands"), "downloads", "uploads", "features",
        "annotation_id", "bucket", *(["bucket_key"] if show_key else []),
    ]
    if not blind:
        cols += [F.col("labels_rule_based").alias("rule_based_label"), F.col("labels_agentic.analyst_verdict").alias("agent_label"), F.col("labels_agentic.hunter_verdict").alias("hunter_verdict"), "statistical_anomaly"]
    picked = selection.select("seq", "annotation_id", "bucket", "bucket_key")
    return labeled.join(F.broadcast(picked), "seq").select(*cols)  # the selection is bounded by the quotas
