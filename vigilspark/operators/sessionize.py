"""Sessions from events: one exchange on (location, session), shared by the window and the aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.catalog import DECODE_BARE, DECODE_PIPE, ESCAPE, ESCAPE_PIPE, KEYWORDS, RULES, TOTALS
from vigilspark.functions.columns import decoded_payloads, hits, hits_sql, is_suspicious, looks_like_typo, occurrences, seconds_between

KEYS = ("location", "session", "seg")
#: Bits of a rule mask; the catalog needs two.
MASK_BITS = 45
MASKS = tuple(f"mask{i}" for i in range(-(-len(RULES) // MASK_BITS)))
#: Distinct commands that are looked at once, and bytes of the longest of them.
KNOWN, LONGEST = 4096, 2048
DEFAULT_PORT, DEFAULT_PROTOCOL = 22, "1"


def segments(events: DataFrame) -> DataFrame:
    """``seg``: how often the session's key was closed before the row; an event after a close begins a new session. Events that have it keep it."""
    if "seg" in events.columns:
        return events
    before = Window.partitionBy("location", "session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("seg", F.coalesce(F.sum(F.when(F.col("kind") == "session.closed", 1).otherwise(0)).over(before), F.lit(0)).cast("long"))


def is_kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def command_text() -> Column:
    """The command of a command event; null for other events and for empty ones, which don't count."""
    return F.when(is_kind("command.input", "command.failed") & (F.col("input") != ""), F.col("input"))


def mask_sql(text: str, k: int) -> str:
    """Mask ``k`` of the rules that the SQL expression ``text`` meets."""
    return " | ".join(f"if({hits_sql(text, r.pattern)}, {1 << r.bit % MASK_BITS}L, 0L)" for r in RULES if r.bit // MASK_BITS == k)


def with_rule_bits(rows: DataFrame) -> DataFrame:
    """Rule masks of each ``__text`` and of the payloads decoded from it; whether it hides something; whether it reads like a mistake."""
    cmd = F.col("__text")
    pipe = hits(cmd, DECODE_PIPE)
    hidden = pipe | hits(cmd, DECODE_BARE) | hits(cmd, ESCAPE_PIPE) | (occurrences(cmd, ESCAPE) >= 3)
    rows = rows.withColumn("__decoded", F.when(pipe, decoded_payloads(cmd)))
    rows = rows.withColumns({m: F.expr(f"if(__text is null, null, {mask_sql('__text', k)})") for k, m in enumerate(MASKS)})
    inner = {m: F.expr(f"if(coalesce(size(__decoded), 0) > 0, {m} | aggregate(__decoded, 0L, (acc, x) -> acc | {mask_sql('x', k)}), {m})") for k, m in enumerate(MASKS)}
    rows = rows.withColumns(inner).withColumn("hidden", hidden).withColumn("suspicious", is_suspicious(cmd))
    unmatched = F.col(MASKS[0]).bitwiseOR(F.col(MASKS[1])) == 0
    # asked only where the answer can matter: elsewhere the session has a rule or is suspicious anyway
    return rows.withColumn("plain_unknown", F.coalesce(F.when(unmatched & ~F.col("suspicious"), ~looks_like_typo(cmd)), F.lit(False)))


def with_catalog(rows: DataFrame, keywords: bool, rules: bool) -> DataFrame:
    """What the catalog says of each ``__text``: keyword hits and totals, and rule bits."""
    if keywords:
        rows = rows.withColumns({name: F.expr(hits_sql("__text", p)) for name, p in KEYWORDS.items()} | {name: occurrences(F.col("__text"), p) for name, p in TOTALS.items()})
    return with_rule_bits(rows).drop("__decoded") if rules else rows


def examined(rows: DataFrame, keywords: bool, rules: bool) -> DataFrame:
    """``rows`` with ``__cmd`` and what the catalog says of it.

    Few commands make up most of a log, and the catalog has some hundred patterns. Up to
    ``KNOWN`` distinct commands are looked at once, in a table that is broadcast; the others, and those
    longer than ``LONGEST`` bytes, in their rows. The answer is the same for both.
    """
    rows = rows.withColumn("__cmd", command_text())
    if not (keywords or rules):
        return rows
    known = [] if rows.isStreaming else rows.select("__cmd").where(F.octet_length("__cmd") <= LONGEST).distinct().limit(KNOWN).collect()
    if not known:
        return with_catalog(rows.withColumn("__text", F.col("__cmd")), keywords, rules)
    once = with_catalog(rows.sparkSession.createDataFrame(known, "__text string"), keywords, rules)
    said = [c for c in once.columns if c != "__text"]
    once = once.select(F.col("__text").alias("__known"), *[F.col(c).alias(f"__known_{c}") for c in said])
    # a known command leaves no text to look at
    rows = rows.join(F.broadcast(once), F.col("__cmd") == F.col("__known"), "left").withColumn("__text", F.when(F.col("__known").isNull(), F.col("__cmd")))
    return with_catalog(rows, keywords, rules).withColumns({c: F.coalesce(f"__known_{c}", c) for c in said})


def sessions(events: DataFrame, keywords: bool = False, rules: bool = False) -> DataFrame:
    """A row for each session; ``keywords`` and ``rules`` add the sums and masks that features and labels need.

    Sessions end with a close event, whatever the time; those never closed have ``is_closed`` false.
    Bounds and counts are over all events, of unknown kinds too. Of values that several events carry
    the last counts, be it null. Columns that aren't asked for later are pruned from the aggregate.
    """
    rows = segments(events)
    rows = examined(rows, keywords, rules)
    cmd = F.col("__cmd")
    last = lambda x, kind: F.max_by(x, F.when(is_kind(kind), F.col("seq")))
    in_order = lambda test, **cols: F.array_sort(F.collect_list(F.when(test, F.struct("seq", *[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in cols.items()]))))
    aggs = {
        "start_ts": F.min("ts"), "end_ts": F.max("ts"), "event_count": F.count(F.lit(1)), "source_files": F.array_sort(F.collect_set("source_file")),
        "is_closed": F.bool_or(is_kind("session.closed")), "__connect": last(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol"), "session.connect"),
        "ssh_version": last(F.col("ssh_version"), "client.version"), "__kex": last(F.struct("hassh", "hassh_algorithms"), "client.kex"),
        "__login": last(F.struct("username", "password"), "login.success"), "auth_success": F.bool_or(is_kind("login.success")),
        "duration": F.max_by("duration", F.when(is_kind("session.closed") & F.col("duration").isNotNull(), F.col("seq"))),
        "n_logins": F.count_if(is_kind("login.success", "login.failed")), "n_failed_logins": F.count_if(is_kind("login.failed")),
        "n_commands": F.count(cmd), "n_failed_commands": F.count_if(cmd.isNotNull() & is_kind("command.failed")),
        "sum_length": F.coalesce(F.sum(F.length(cmd)), F.lit(0)), "max_length": F.coalesce(F.max(F.length(cmd)), F.lit(0)),
        "n_pipe": F.count_if(cmd.contains("|")), "n_redirect": F.count_if(cmd.contains(">")), "n_unique_commands": F.size(F.collect_set(cmd)).cast("long"),
        "n_downloads": F.count_if(is_kind("session.file_download")), "n_uploads": F.count_if(is_kind("session.file_upload")), "n_forwards": F.count_if(is_kind("direct-tcpip.request")),
        "__logins": in_order(is_kind("login.success", "login.failed"), username="username", password="password", success=is_kind("login.success")),
        "__commands": in_order(cmd.isNotNull(), timestamp="ts", input="__cmd", success=is_kind("command.input")),
        "__downloads": in_order(is_kind("session.file_download"), url="url", shasum="shasum", outfile="outfile"),
        "__uploads": in_order(is_kind("session.file_upload"), shasum="shasum", destfile="destfile"),
        "__forwards": in_order(is_kind("direct-tcpip.request"), dst_ip="dst_ip", dst_port="dst_port"),
    }
    if keywords:
        aggs |= {name: F.count_if(name) for name in KEYWORDS} | {name: F.sum(name) for name in TOTALS}
    if rules:
        aggs |= {m: F.coalesce(F.bit_or(m), F.lit(0).cast("long")) for m in MASKS}
        aggs |= {"obfuscation": F.bool_or("hidden"), "any_suspicious": F.bool_or("suspicious"), "n_plain_unknown": F.count_if("plain_unknown"), "first_seq": F.min("seq")}
    if "user_id" in events.columns:
        aggs["user_id"] = F.min("user_id")
    out = rows.groupBy(*KEYS).agg(*[a.alias(k) for k, a in aggs.items()])
    c = F.col("__connect")
    port = lambda x, none: F.coalesce(F.nullif(x, F.lit(0)), F.lit(none))
    drop_seq = lambda name: F.transform(name, lambda x: x.dropFields("seq"))
    computed = F.coalesce(F.col("duration"), seconds_between(F.col("start_ts"), F.col("end_ts")), F.lit(0.0))
    return out.select(
        "location", F.col("session").alias("session_id"), "seg",
        F.when(c.isNull(), "").otherwise(c["src_ip"]).alias("src_ip"), port(c["src_port"], 0).alias("src_port"), F.coalesce(c["dst_ip"], F.lit("")).alias("dst_ip"),
        port(c["dst_port"], DEFAULT_PORT).alias("dst_port"), F.coalesce(c["protocol"], F.lit(DEFAULT_PROTOCOL)).alias("protocol"),
        F.col("__kex.hassh").alias("hassh"), F.col("__kex.hassh_algorithms").alias("hassh_algorithms"), F.col("__login.username").alias("final_username"), F.col("__login.password").alias("final_password"),
        computed.alias("duration_s"), session_type(F.col("auth_success"), F.col("n_commands")).alias("session_type"),
        *[drop_seq("__" + k).alias(k) for k in ("logins", "commands", "downloads", "uploads", "forwards")],
        *[k for k in aggs if not k.startswith("__")],
    )


def session_type(auth: Column, n_commands: Column) -> Column:
    return F.when(~auth, "failed_auth_only").when(n_commands == 0, "success_no_commands").otherwise("success_with_commands")


def min_gap(commands: Column) -> Column:
    """Least number of seconds between two commands next to each other in time, null if fewer than two have a time."""
    at = F.array_sort(F.filter(F.transform(commands, lambda c: F.unix_micros(c["timestamp"])), lambda t: t.isNotNull()))
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(at) >= 2, F.array_min(gaps) / F.lit(1e6))


def session_counts(s: DataFrame) -> DataFrame:
    """(created, completed, active)."""
    return s.agg(F.count(F.lit(1)).alias("created"), F.count_if("is_closed").alias("completed"), F.count_if(~F.col("is_closed")).alias("active"))
