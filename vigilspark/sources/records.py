"""Readers and writers of stored records: explicit schemas, keyed upserts, dry runs, reports."""

from __future__ import annotations

import contextlib
import json
import threading
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.operators.agents import LABELS
from vigilspark.operators.anomaly import RESULT

ANNOTATION = "annotation_id int, annotator string, primary_tactic string, threat_level int, confidence int, is_false_negative_risk boolean, notes string, _timestamp string"
_RULE = "struct<level:int,primary_tactic:string,all_tactics:array<string>,matched_patterns:array<string>,behavior_tag:string,kill_chain_detected:boolean,obfuscation_detected:boolean,sophistication_score:int,tactic_count:int,has_download:boolean,has_upload:boolean>"


def session_schema(features: T.StructType | None = None) -> T.StructType:
    """Of a flat record; ``features`` as ``documents.flat`` makes them, by default a map of texts."""
    kind = features.simpleString() if features else "map<string,string>"
    return T._parse_datatype_string(
        "session_id string, location string, start_ts string, end_ts string, duration_s double, src_ip string, src_port int, dst_port int, protocol string, auth_success boolean,"
        "login_attempts array<struct<username:string,password:string,success:boolean>>, final_username string, final_password string, commands array<struct<timestamp:string,input:string,success:boolean>>,"
        "downloads array<struct<url:string,shasum:string,outfile:string>>, uploads array<struct<shasum:string,destfile:string>>, ssh_version string, hassh string,"
        f"features {kind}, labels_rule_based {_RULE}, geo map<string,string>, session_type string, event_count bigint, ingested_at string"
    )


def labeled_schema(features: T.StructType | None = None) -> T.StructType:
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in (("statistical_anomaly", RESULT), ("labels_agentic", LABELS))]
    return T.StructType([*session_schema(features).fields, *more])


def read_records(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, bad_lines: str = "skip") -> DataFrame:
    """JSON lines by an explicit schema, with ``seq`` in file and line order. Bad lines are skipped, or 'fail', or kept in ``bad_line``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("mode", "FAILFAST" if bad_lines == "fail" else "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line")
    rows = reader.schema(kind if bad_lines == "fail" else T.StructType([*kind.fields, T.StructField("bad_line", T.StringType())])).json(paths)
    seq = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", seq.alias("seq"))
    return rows.where("bad_line is null").drop("bad_line") if bad_lines == "skip" else rows


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Votes of several files; records without identifier are dropped."""
    return read_records(spark, paths, ANNOTATION).where("annotation_id is not null")


def document_id(nested: bool = True) -> Column:
    """Key of a stored document: identifier and start. Flat records have no start there, so a reused identifier collapses."""
    return F.concat(F.coalesce("session_id", F.lit("")), F.lit("_"), F.coalesce("timing.start_ts", F.lit("")) if nested else F.lit(""))


def upsert(new: DataFrame, old: DataFrame | None, key: Column, order: str) -> DataFrame:
    """Of each key the last row of ``new`` by ``order``, and the rows of ``old`` whose key isn't in ``new``."""
    cols = [c for c in new.columns if c != order]
    last = new.groupBy(key.alias("_id")).agg(F.max_by(F.struct(*cols), order).alias("d")).select("_id", "d.*")
    return last if old is None else last.unionByName(old.join(last.select("_id"), "_id", "left_anti"), allowMissingColumns=True)


@contextlib.contextmanager
def progress(spark: SparkSession, tell: Callable[[int, int], None] | None, every_s: float = 1.0) -> Iterator[None]:
    """Meanwhile call ``tell(tasks done, tasks known)`` now and then, and once at the end."""
    if tell is None:
        yield
        return
    over, status, last = threading.Event(), spark.sparkContext.statusTracker(), [0, 0]

    def look() -> None:
        stages = [x for i in status.getActiveStageIds() if (x := status.getStageInfo(i))]
        if stages:
            last[:] = [sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages)]
            tell(*last)

    def run() -> None:
        while not over.wait(every_s):
            look()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        tell(last[1], last[1])


def write_json(df: DataFrame, path: str, codec: str = "none", tell: Callable[[int, int], None] | None = None) -> int:
    """To a new folder: input is never overwritten. Nulls are written. Returns the rows, counted on the way."""
    seen = Observation()
    with progress(df.sparkSession, tell):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").option("compression", codec).mode("errorifexists").json(path)
    return seen.get["n"]


def create_table(spark: SparkSession, path: str, schema: T.StructType, replace: bool = False) -> None:
    """An empty table of documents with its mapping, ``schema``, by location; ``replace`` removes one that is there."""
    spark.createDataFrame([], schema).write.mode("overwrite" if replace else "errorifexists").parquet(f"{path}/mapping")
    if replace:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mapping_of(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path}/mapping").schema


def fields_of(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of all fields of a mapping, nested ones by points."""
    out: list[tuple[str, str]] = []
    for f in schema.fields:
        kind = f.dataType
        out += fields_of(kind, f"{prefix}{f.name}.") if isinstance(kind, T.StructType) else [(prefix + f.name, kind.simpleString())]
    return out


def insert(df: DataFrame, path: str) -> dict[str, int]:
    """Append documents to a table that has a mapping, cast to it; unknown fields raise. Returns the sink's counts: written, without identifier, locations."""
    schema = mapping_of(df.sparkSession, path)
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"not in the mapping: {sorted(unknown)}")
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("written"), F.count_if(F.col("session_id").isNull()).alias("unnamed"), F.size(F.collect_set("location")).alias("locations"))
    rows.write.mode("append").partitionBy("location").parquet(f"{path}/rows")
    return dict(seen.get)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``insert`` wrote, by the mapping; a later reader sees all of it at once, so there is nothing to refresh."""
    schema = mapping_of(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def write_table(df: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet by location, so that readers prune files."""
    df.write.mode("overwrite" if replace else "errorifexists").partitionBy("location").parquet(path)


def first_rows(df: DataFrame, n: int | None, order: str = "seq") -> DataFrame:
    """The first ``n`` in input order; all for None or 0."""
    return df.orderBy(order).limit(n) if n else df


def dry_run(df: DataFrame, show: int = 0) -> int:
    """Rows that would be written; prints the first ``show``."""
    for row in df.limit(show).toJSON().collect() if show else ():
        print(row)
    return df.count()


def report_json(reports: dict[str, DataFrame]) -> dict[str, Any]:
    """Small reports as one JSON document."""
    return {name: [json.loads(x) for x in df.toJSON().collect()] for name, df in reports.items()}
