"""JSON-lines logs of decoy sensors, plain or gzipped, as typed events."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event kinds, without the vendor's prefix.
KINDS = (
    "session.connect", "client.version", "client.kex", "login.success", "login.failed", "command.input", "command.failed",
    "session.file_download", "session.file_upload", "session.closed", "direct-tcpip.request",
)
NO_DATE = (9999, 99, 99)
_DATE = r"json\.(\d{4})_(\d{1,2})_(\d{1,2})"
_TEXT = {
    "src_ip": "src_ip", "dst_ip": "dst_ip", "protocol": "protocol", "version": "ssh_version", "hassh": "hassh", "hasshAlgorithms": "hassh_algorithms",
    "username": "username", "password": "password", "input": "input", "url": "url", "shasum": "shasum", "outfile": "outfile", "destfile": "destfile", "message": "message",
}
_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")


def date_of(name: str) -> tuple[int, int, int]:
    """Year, month and day in a file's name; names without one come last."""
    m = re.search(_DATE, name)
    return (int(m[1]), int(m[2]), int(m[3])) if m else NO_DATE


def list_logs(spark: SparkSession, directory: str, pattern: str = "*.gz", limit: int | None = None) -> list[str]:
    """Files of one sensor in order of date, then path; the first ``limit``. No folder, or no match: none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    files = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    files = [f for f in files if fnmatch.fnmatch(f.rsplit("/", 1)[-1], pattern)]
    return sorted(files, key=lambda f: (date_of(f.rsplit("/", 1)[-1]), f))[:limit]


def read_lines(spark: SparkSession, files: list[str], location: str) -> DataFrame:
    """(location, seq, source_file, value): trimmed lines that aren't blank. ``seq`` orders by date in the file's name, path and place."""
    if not files:
        return spark.createDataFrame([], "location string, seq struct<y:int,m:int,d:int,path:string,block:bigint,row:bigint>, source_file string, value string")
    lines = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    part = [F.regexp_extract("file", _DATE, i).try_cast("int") for i in (1, 2, 3)]
    seq = F.struct(*[F.coalesce(p, F.lit(n)).alias(k) for p, n, k in zip(part, NO_DATE, "ymd")], "path", "block", "row")
    return lines.select(F.lit(location).alias("location"), seq.alias("seq"), F.col("file").alias("source_file"), F.trim("value").alias("value")).where("value != ''")


def parse_time(s: Column) -> Column:
    """ISO 8601 and four older forms, UTC where there is no offset; null where none fits."""
    return F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in _FORMATS])


def kind_of(eventid: Column) -> Column:
    """Without the vendor's prefix if a known kind follows."""
    return F.regexp_replace(eventid, r"^[A-Za-z0-9_]+\.(?=(?:session|client|login|command|direct-tcpip)\.)", "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed events, a row for each line; ``bad`` marks lines that aren't JSON objects or whose time isn't text.

    A key that is absent gets its default (session and kind 'unknown', address 0.0.0.0); a JSON null
    stays null. A time that can't be read leaves ``ts`` null and sets ``ts_bad``: unlike the usual
    stand-in, the present, it gives the same result on every run.
    """
    v = F.try_parse_json("value")
    get = lambda key, kind: F.try_variant_get("v", f"$['{key}']", kind)
    absent = lambda key: get(key, "variant").isNull()
    parsed = lines.withColumn("v", v)
    at = get("timestamp", "string")
    shape = F.schema_of_variant(get("timestamp", "variant"))
    falsy = absent("timestamp") | at.isNull() | at.isin("", "0", "false")
    bad = F.col("v").isNull() | ~F.col("value").startswith("{") | (~falsy & (shape != "STRING"))
    cols = {name: get(key, "string") for key, name in _TEXT.items()}
    cols["src_ip"] = F.when(absent("src_ip"), "0.0.0.0").otherwise(cols["src_ip"])
    out = parsed.select(
        "location", F.when(absent("session"), "unknown").otherwise(get("session", "string")).alias("session"), "seq",
        kind_of(F.when(absent("eventid"), "unknown").otherwise(get("eventid", "string"))).alias("kind"),
        F.when(~falsy & (shape == "STRING"), parse_time(at)).alias("ts"), get("src_port", "int").alias("src_port"), get("dst_port", "int").alias("dst_port"),
        get("duration", "double").alias("duration"), *[c.alias(k) for k, c in cols.items()], "source_file", F.coalesce(bad, F.lit(True)).alias("bad"),
    )
    return out.withColumn("ts_bad", F.col("ts").isNull())


def read_logs(spark: SparkSession, directory: str, location: str, pattern: str = "*.gz", limit: int | None = None) -> DataFrame:
    """Events of one sensor, without the bad lines."""
    return parse_lines(read_lines(spark, list_logs(spark, directory, pattern, limit), location)).where("not bad").drop("bad")


def parse_counts(parsed: DataFrame) -> DataFrame:
    """(files, events, errors) of parsed lines."""
    return parsed.agg(F.countDistinct("source_file").alias("files"), F.count_if(~F.col("bad")).alias("events"), F.count_if("bad").alias("errors"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """``line_number`` from 1 in each file; a shuffle, so only where it is asked for."""
    from pyspark.sql import Window

    return lines.withColumn("line_number", F.row_number().over(Window.partitionBy("location", "source_file").orderBy("seq")))
