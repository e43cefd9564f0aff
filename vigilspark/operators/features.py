"""The 82 features of a session: 49 from its commands, 24 of the host, 9 of the place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.catalog import KEYWORDS, SCANNERS, TOTALS
from vigilspark.functions.columns import ip_number, is_common_password, is_private, rounded, ssh_family, ssh_family_code

from .sessionize import min_gap

EPHEMERAL_PORT = 49152
GEO_FIELDS = {
    "F47_continent_code": "continent_code", "F48_country_name": "country_name", "F48_country_iso": "country_iso", "F49_region_name": "region_name", "F50_city_name": "city_name",
    "F51_longitude": "longitude", "F52_latitude": "latitude", "extra_timezone": "timezone", "extra_accuracy_radius": "accuracy_radius",
}


def total_length() -> Column:
    """Of the commands joined by one space."""
    return F.col("sum_length") + F.greatest(F.col("n_commands") - 1, F.lit(0))


def _per_second(x: Column) -> Column:
    return F.when(F.col("duration_s") > 0, x / F.col("duration_s")).otherwise(x.cast("double"))


def message_columns() -> dict[str, Column]:
    """From ``sessions(..., keywords=True)``; 0 without commands, the gap then -1."""
    n, size = F.col("n_commands"), total_length()
    some = lambda x: F.when(n > 0, x).otherwise(0.0)
    out = {k: F.col(k) for k in (*KEYWORDS, *TOTALS) if not k.startswith("extra")}
    out |= {
        "F37_message_length": size, "F38_messages_per_sec": rounded(some(_per_second(n)), 4), "extra_chars_per_sec": rounded(some(_per_second(size)), 4), "extra_num_commands": n,
        "extra_avg_cmd_length": rounded(some(F.try_divide(size.cast("double"), n.cast("double"))), 2), "extra_unique_commands": F.col("n_unique_commands"),
        "extra_keyword_curl": F.col("extra_keyword_curl"), "extra_keyword_nc": F.col("extra_keyword_nc"),
        "extra_min_inter_command_gap": F.coalesce(rounded(min_gap(F.col("commands")), 6), F.lit(-1.0)), "extra_max_cmd_length": F.col("max_length"),
        "extra_command_diversity_ratio": rounded(some(F.try_divide(F.col("n_unique_commands").cast("double"), n.cast("double"))), 4),
        "extra_has_pipe": F.col("n_pipe"), "extra_has_redirect": F.col("n_redirect"),
    }
    return out


def host_columns() -> dict[str, Column]:
    user, password, version = (F.coalesce(F.col(c), F.lit("")) for c in ("final_username", "final_password", "ssh_version"))
    family, flag = ssh_family(F.col("ssh_version")), lambda x: F.coalesce(x, F.lit(False)).cast("int")
    n = F.col("n_commands")
    return {
        "F39_protocol": F.col("protocol"), "F40_src_port": F.col("src_port"), "F40_src_port_high": flag(F.col("src_port") > EPHEMERAL_PORT), "F41_ssh_version": version,
        "F41_ssh_family": family, "F41_ssh_family_encoded": ssh_family_code(family), "F42_username": user, "F42_username_is_root": flag(user == "root"), "F42_username_length": F.length(user),
        "F43_password": password, "F43_password_length": F.length(password), "F43_password_is_common": flag(is_common_password(password)), "F44_duration": rounded(F.col("duration_s"), 2),
        "F45_received_size_avg": rounded(F.when(n > 0, F.try_divide(F.col("sum_length").cast("double"), n.cast("double"))).otherwise(0.0), 2),
        "F46_has_files": flag(F.col("n_downloads") + F.col("n_uploads") > 0), "F46_download_count": F.col("n_downloads"), "F46_upload_count": F.col("n_uploads"),
        "extra_hassh": F.coalesce("hassh", F.lit("")), "extra_login_attempts": F.col("n_logins"), "extra_auth_success": flag(F.col("auth_success")), "extra_tcpip_forwards": F.col("n_forwards"),
        "extra_dst_port": F.col("dst_port"), "extra_password_equals_username": flag((user != "") & (F.lower(user) == F.lower(password))), "extra_ssh_family_is_scanner": flag(family.isin(*SCANNERS)),
    }


def empty_geo() -> dict[str, Column]:
    return {k: F.lit({"F51_longitude": 0.0, "F52_latitude": 0.0, "extra_accuracy_radius": 0}.get(k, "")) for k in GEO_FIELDS}


def with_geo(rows: DataFrame, ranges: DataFrame, ip_col: str = "src_ip", max_prefix: int = 24) -> DataFrame:
    """The nine geo columns: those of the narrowest range that holds a public address, else empty ones.

    ``ranges(low, high, ...)`` are split into aligned blocks, so the lookup is an equality join on
    (block size, block) for the few sizes that occur: no nested loop, and Spark may shuffle or
    broadcast either side by its size. Each address is looked up once.
    """
    low, high = ip_number(F.col("low")), ip_number(F.col("high"))
    known = ranges.withColumn("__low", low).withColumn("__high", high).where("__low is not null and __high >= __low")
    # a range of n addresses meets at most three blocks of the next lower power of two
    bits = F.greatest(F.floor(F.log2((F.col("__high") - F.col("__low") + 1).cast("double"))).cast("int"), F.lit(32 - max_prefix))
    known = known.withColumn("__bits", bits).withColumn("__block", F.explode(F.sequence(F.expr("shiftright(__low, __bits)"), F.expr("shiftright(__high, __bits)"))))
    sizes = [r[0] for r in known.select("__bits").distinct().collect()]  # at most 25 numbers
    if not sizes:
        return rows.withColumns(empty_geo())
    ips = rows.select(F.col(ip_col).alias("__ip")).distinct().withColumn("__n", ip_number(F.col("__ip"))).where(F.col("__n").isNotNull() & ~is_private(F.col("__ip")))
    probes = ips.withColumn("__bits", F.explode(F.array(*[F.lit(b) for b in sizes]))).withColumn("__block", F.expr("shiftright(__n, __bits)"))
    met = probes.join(known, ["__bits", "__block"]).where("__n between __low and __high")
    best = met.groupBy("__ip").agg(F.min_by(F.struct(*GEO_FIELDS.values()), F.struct(F.col("__high") - F.col("__low"), "__low")).alias("__geo"))
    none = empty_geo()
    found = rows.join(best, F.col(ip_col) == F.col("__ip"), "left")
    return found.withColumns({k: F.coalesce(F.col(f"__geo.{src}"), none[k]) for k, src in GEO_FIELDS.items()}).drop("__ip", "__geo")


def features(sessions: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``sessions(..., keywords=True)`` with the struct ``features`` (message, host, then geo) and the struct ``geo``."""
    rows = with_geo(sessions, ranges) if ranges is not None else sessions.withColumns(empty_geo())
    cols = {**message_columns(), **host_columns(), **{k: F.col(k) for k in GEO_FIELDS}}
    geo = F.struct(*[F.col(k).alias(v) for k, v in GEO_FIELDS.items()])
    return rows.withColumn("features", F.struct(*[c.alias(k) for k, c in cols.items()])).withColumn("geo", geo).drop(*GEO_FIELDS)
