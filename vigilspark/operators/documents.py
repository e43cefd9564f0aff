"""The two shapes in which sessions are stored: a nested document and a flat record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.columns import iso

from .features import GEO_FIELDS, features
from .labeler import label_struct, labels
from .sessionize import sessions

KEPT_COMMANDS, KEPT_DOWNLOADS = 100, 20
TELNET_PORT = 23


def _kept(name: str, field: str, n: int) -> Column:
    return F.transform(F.slice(name, 1, n), lambda x: x[field])


def labelled(events: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Sessions with features and labels, still flat columns."""
    return labels(features(sessions(events, keywords=True, rules=True), ranges))


def nested(rows: DataFrame) -> DataFrame:
    """The document: of commands and downloads the first 100 and 20, empty names left out after that cut."""
    some = lambda x: F.filter(x, lambda v: v.isNotNull() & (v != ""))
    users = F.array_sort(F.array_distinct(some(F.transform("logins", lambda x: x["username"]))))
    return rows.select(
        "session_id", "location",
        F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol").alias("connection"),
        F.struct(iso(F.col("start_ts")).alias("start_ts"), iso(F.col("end_ts")).alias("end_ts"), "duration_s").alias("timing"),
        F.struct("ssh_version", "hassh", "hassh_algorithms").alias("client"),
        F.struct(F.col("n_logins").alias("attempts"), F.col("auth_success").alias("success"), F.col("n_failed_logins").alias("failed_count"), (F.col("n_logins") - F.col("n_failed_logins")).alias("success_count"), users.alias("usernames_tried"), "final_username", "final_password").alias("authentication"),
        F.struct(F.col("n_commands").alias("total_count"), (F.col("n_commands") - F.col("n_failed_commands")).alias("success_count"), F.col("n_failed_commands").alias("failed_count"), _kept("commands", "input", KEPT_COMMANDS).alias("inputs"), F.col("n_unique_commands").alias("unique_commands")).alias("commands"),
        F.struct(F.col("n_downloads").alias("count"), some(_kept("downloads", "url", KEPT_DOWNLOADS)).alias("urls"), some(_kept("downloads", "shasum", KEPT_DOWNLOADS)).alias("shasums")).alias("downloads"),
        F.struct(F.col("n_uploads").alias("count")).alias("uploads"), F.struct(F.col("n_forwards").alias("count")).alias("tcpip_forwards"),
        F.struct("event_count", "source_files", "is_closed", "session_type").alias("meta"),
        "features", "geo", label_struct("session_type").alias("labels_rule_based"),
    )


def flat(rows: DataFrame, with_geo: bool = False, stamp: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The record of the analytics table; ``geo`` only where ranges were given, and never among the features. ``keep`` passes columns on."""
    at = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'")
    whole = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'")
    text = lambda ts: F.when(F.unix_micros(ts) % 1_000_000 == 0, whole(ts)).otherwise(at(ts))
    geo = F.struct(*[F.col(f"geo.{v}").alias(k) for k, v in GEO_FIELDS.items()])
    return rows.select(
        "session_id", "location", iso(F.col("start_ts")).alias("start_ts"), iso(F.col("end_ts")).alias("end_ts"), "duration_s", "src_ip", "src_port", "dst_port",
        F.when(F.col("dst_port") == TELNET_PORT, "telnet").otherwise("ssh").alias("protocol"), "auth_success", F.col("logins").alias("login_attempts"), "final_username", "final_password",
        F.transform("commands", lambda c: F.struct(text(c["timestamp"]).alias("timestamp"), c["input"].alias("input"), c["success"].alias("success"))).alias("commands"),
        "downloads", "uploads", "ssh_version", "hassh", F.col("features").dropFields(*GEO_FIELDS).alias("features"), label_struct().alias("labels_rule_based"),
        (geo if with_geo else F.lit(None).cast(_geo_type())).alias("geo"), "session_type", "event_count",
        *([iso(F.current_timestamp()).alias("ingested_at")] if stamp else []), *keep,
    )


def _geo_type() -> str:
    kinds = {"F51_longitude": "double", "F52_latitude": "double", "extra_accuracy_radius": "int"}
    return "struct<" + ",".join(f"{k}:{kinds.get(k, 'string')}" for k in GEO_FIELDS) + ">"
