"""Checks of stored records as raw JSON: required fields and three types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = ("commands", "auth_success", "event_count", "features", "labels_rule_based", "location", "protocol", "session_id", "session_type", "src_ip")
LABEL = ("level", "matched_patterns", "primary_tactic", "all_tactics")
FEATURE = ("extra_num_commands", "F44_duration", "F38_messages_per_sec")


def _at(path: str) -> Column:
    return F.try_variant_get("v", "$" + "".join(f"['{p}']" for p in path.split("/")), "variant")


def _kind(path: str) -> Column:
    return F.schema_of_variant(_at(path))


def checked(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ``ok_json`` and ``errors``, the problems of each record; a line that is no object has none but isn't ok."""
    gone = lambda path, what: F.when(_at(path).isNull(), f"missing {what}: {path.split('/')[-1]}")
    tests = [gone(p, "required field") for p in TOP] + [gone(f"labels_rule_based/{p}", "label field") for p in LABEL] + [gone(f"features/{p}", "feature") for p in FEATURE]
    wrong = lambda path, test, said: F.when(_at(path).isNotNull() & ~test(_kind(path)), F.concat(F.lit(f"{said}, is "), F.lower(_kind(path))))
    tests += [
        wrong("labels_rule_based/level", lambda k: k.isin("BIGINT", "BOOLEAN"), "level should be a whole number"),
        wrong("labels_rule_based/all_tactics", lambda k: k.startswith("ARRAY"), "all_tactics should be a list"), wrong("commands", lambda k: k.startswith("ARRAY"), "commands should be a list"),
    ]
    rows = lines.withColumn("v", F.try_parse_json(column))
    ok = F.col("v").isNotNull() & F.trim(column).startswith("{")
    return rows.withColumn("ok_json", F.coalesce(ok, F.lit(False))).withColumn("errors", F.when(F.col("ok_json"), F.array_compact(F.array(*tests))).otherwise(F.array().cast("array<string>"))).drop("v")


def check_summary(lines: DataFrame, column: str = "value", samples: int = 10) -> DataFrame:
    """(total, bad): records, and those with a problem or no JSON; blank lines don't count."""
    each = checked(lines.where(F.trim(column) != ""), column)
    return each.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok_json") | (F.size("errors") > 0)).alias("bad"))
