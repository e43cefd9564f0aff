"""Reports over sessions with two labels: funnel, confusion, cell profiles, costs.

They read one flat shape (``dual_columns``): seq, session_id, location, session_type, n_commands,
heads (first words of the first 20 commands), duration_s, auth_success, n_downloads, n_uploads,
is_anomaly, hunter_verdict, sent_to_hunter, sent_to_analyst, has_verdict, rule_level, rule_tactic,
matched_patterns, sophistication_score, agent_level, agent_tactic, agent_sophistication,
agent_confidence, cost_usd, latency_ms. The reports differ in how they compare tactics and in which
sessions they count; each says how.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.columns import command_bucket, first_word, ratio, tactic_loose, tactic_plain

SAMPLE_CAP, TOP_NAMES, TOP_ROWS, TOP_COLUMNS = 50, 20, 15, 5
HEADS, HEAD_LENGTH, TOP_COMMANDS, CELL_SAMPLES, CELL_SIZE, TOP_CELLS = 20, 40, 15, 10, 50, 20
RULES_PER_SECOND, COST_LIMIT = 10_000, 1.0
FOCUS_TACTICS = (
    ("Impact", "Persistence"), ("Unknown Activity (High)", "Persistence"), ("No Action", "Execution"), ("Command and Control", "Execution"),
    ("No Action", "Initial Access"), ("Discovery", "Initial Access"), ("Command and Control", "Initial Access"), ("Unknown Activity (Low)", "Initial Access"),
)
FOCUS_LEVELS = ((1, 2), (2, 1), (2, 3), (3, 1), (3, 2))


def heads(inputs: Column) -> Column:
    """First words, cut to 40 characters, of the first 20 commands; blank commands have none."""
    return F.filter(F.transform(F.slice(inputs, 1, HEADS), lambda c: F.substring(first_word(c), 1, HEAD_LENGTH)), lambda w: w != "")


def dual_columns(labeled: DataFrame, order: str = "seq") -> DataFrame:
    """The flat shape, from labelled records as they are stored."""
    inputs = F.transform("commands", lambda c: c["input"])
    rule, agent, metrics = "labels_rule_based", "labels_agentic.analyst_verdict", "labels_agentic.pipeline_metrics"
    return labeled.select(
        F.col(order).alias("seq"), "session_id", "location", "session_type", F.size("commands").cast("long").alias("n_commands"), heads(inputs).alias("heads"), "duration_s", "auth_success",
        F.size("downloads").cast("long").alias("n_downloads"), F.size("uploads").cast("long").alias("n_uploads"), F.coalesce("statistical_anomaly.is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.col("labels_agentic.hunter_verdict").alias("hunter_verdict"), F.coalesce(f"{metrics}.sent_to_hunter", F.lit(False)).alias("sent_to_hunter"), F.coalesce(f"{metrics}.sent_to_analyst", F.lit(False)).alias("sent_to_analyst"),
        F.col(agent).isNotNull().alias("has_verdict"), F.col(f"{rule}.level").alias("rule_level"), F.col(f"{rule}.primary_tactic").alias("rule_tactic"), F.col(f"{rule}.matched_patterns").alias("matched_patterns"),
        F.col(f"{rule}.sophistication_score").alias("sophistication_score"), F.col(f"{agent}.level").alias("agent_level"), F.col(f"{agent}.primary_tactic").alias("agent_tactic"),
        F.col(f"{agent}.sophistication").alias("agent_sophistication"), F.col(f"{agent}.confidence").alias("agent_confidence"),
        F.coalesce(f"{metrics}.total_cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce(f"{metrics}.total_latency_ms", F.lit(0)).alias("latency_ms"),
    )


def no_patterns() -> Column:
    return F.coalesce(F.size("matched_patterns") == 0, F.lit(True))


def is_novel() -> Column:
    """No rule matched, the second label has level 1 or 2."""
    return no_patterns() & F.coalesce(F.col("agent_level") <= 2, F.lit(False))


def has_both_levels() -> Column:
    return F.col("rule_level").isNotNull() & F.col("agent_level").isNotNull()


# -- funnel: outliers only; 'relevant' is any verdict but NOISE; tactics are compared loosely


def funnel_flags(rows: DataFrame) -> DataFrame:
    anomalous = F.coalesce(F.col("is_anomaly"), F.lit(False))
    processed = anomalous & F.col("hunter_verdict").isNotNull()
    noise = processed & (F.col("hunter_verdict") == "NOISE")
    dual = processed & ~noise & F.col("has_verdict")
    agree = dual & (tactic_loose(F.col("rule_tactic")) == tactic_loose(F.col("agent_tactic")))
    level = dual & F.coalesce(F.col("rule_level") == F.col("agent_level"), F.lit(False))
    flags = {"anomalous": anomalous, "hunter_processed": processed, "hunter_noise": noise, "dual_labeled": dual, "tactic_agree": agree, "level_agree": level, "agent_only": dual & is_novel()}
    return rows.withColumns({f"is_{k}": F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def funnel(rows: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """One row of counts and rates. ``agent_only_capped`` saturates at the number of samples that a report lists; ``agent_only`` doesn't."""
    n = lambda k: F.count_if(F.col(f"is_{k}"))
    one = funnel_flags(rows).agg(F.count(F.lit(1)).alias("total_sessions"), *[n(k).alias(k) for k in ("anomalous", "hunter_processed", "hunter_noise", "dual_labeled", "tactic_agree", "level_agree", "agent_only")])
    c = F.col
    return one.select(
        "*", (c("anomalous") - c("hunter_processed")).alias("hunter_errored"), (c("hunter_processed") - c("hunter_noise")).alias("hunter_relevant"),
        (c("dual_labeled") - c("tactic_agree")).alias("tactic_disagree"), (c("dual_labeled") - c("level_agree")).alias("level_disagree"),
        ratio(c("tactic_agree"), c("dual_labeled")).alias("tactic_agreement_rate"), ratio(c("level_agree"), c("dual_labeled")).alias("level_agreement_rate"),
        F.when(c("dual_labeled") > 0, 1 - ratio(c("tactic_agree"), c("dual_labeled"))).alias("tactic_disagreement_rate"),
        F.least(c("agent_only"), F.lit(cap)).alias("agent_only_capped"), ratio(F.least(c("agent_only"), F.lit(cap)), c("dual_labeled")).alias("agent_only_capped_rate"),
        ratio(c("hunter_noise"), c("hunter_processed")).alias("hunter_filter_rate"),
    )


def most_common(counts: DataFrame, group: list[str], top: int) -> DataFrame:
    """The ``top`` most counted rows of each group, of ties the first seen: ``counts`` has n and first."""
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def distributions(rows: DataFrame) -> DataFrame:
    """(kind, value, n, rank): tactics of both labels (20), their levels, verdicts and sophistication."""
    dual, f = F.col("is_dual_labeled"), funnel_flags(rows)
    pair = lambda kind, test, value: F.when(test, F.struct(F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value")))
    pairs = F.array_compact(F.array(
        pair("rule_tactic", dual, "rule_tactic"), pair("agent_tactic", dual, "agent_tactic"), pair("rule_level", dual & F.col("rule_level").isNotNull(), "rule_level"),
        pair("agent_level", dual & F.col("agent_level").isNotNull(), "agent_level"), pair("hunter_verdict", F.col("is_hunter_processed"), "hunter_verdict"),
        pair("sophistication", dual & (F.coalesce("agent_sophistication", F.lit("")) != ""), "agent_sophistication"),
    ))
    counts = f.select("seq", F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return most_common(counts, ["kind"], TOP_NAMES).drop("first")


def confusion(rows: DataFrame) -> DataFrame:
    """(kind, rule, agent, n): all pairs of levels; of tactics those that differ, 15 rows of 5 columns."""
    f = funnel_flags(rows).where("is_dual_labeled")
    level = F.when(has_both_levels(), F.struct(F.lit("level").alias("kind"), F.col("rule_level").cast("string").alias("rule"), F.col("agent_level").cast("string").alias("agent")))
    tactic = F.when(~F.col("is_tactic_agree"), F.struct(F.lit("tactic").alias("kind"), F.col("rule_tactic").alias("rule"), F.col("agent_tactic").alias("agent")))
    counts = f.select("seq", F.explode(F.array_compact(F.array(level, tactic))).alias("p")).groupBy("p.kind", "p.rule", "p.agent").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    tactics = counts.where("kind = 'tactic'")
    rows_ = tactics.groupBy("kind", "rule").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    top = most_common(rows_, ["kind"], TOP_ROWS).select("rule")
    kept = most_common(tactics, ["kind", "rule"], TOP_COLUMNS).join(top, "rule", "left_semi")
    return counts.where("kind = 'level'").select("kind", "rule", "agent", "n").union(kept.select("kind", "rule", "agent", "n"))


def samples(rows: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """(kind, seq, session_id, rule_tactic, agent_tactic, rule_level, agent_level): the first ``cap`` of each kind of disagreement."""
    f = funnel_flags(rows).where("is_dual_labeled")
    kinds = F.array_compact(F.array(F.when(~F.col("is_tactic_agree"), "tactic"), F.when(has_both_levels() & ~F.col("is_level_agree"), "level"), F.when(F.col("is_agent_only"), "agent_only")))
    w = Window.partitionBy("kind").orderBy("seq")
    each = f.select(F.explode(kinds).alias("kind"), "seq", "session_id", "rule_tactic", "agent_tactic", "rule_level", "agent_level")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("rank")


# -- cells: all sessions with a verdict and both tactics, outliers or not; tactics trimmed, agreement in lower case


def cells(rows: DataFrame) -> DataFrame:
    """A row for each cell that a session belongs to: (kind, rule, agent) and the session's columns."""
    rt, at = tactic_plain(F.col("rule_tactic")), tactic_plain(F.col("agent_tactic"))
    cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("rule"), b.cast("string").alias("agent"))
    found = F.array_compact(F.array(
        cell("tactic", rt, at), F.when(has_both_levels(), cell("level", F.col("rule_level"), F.col("agent_level"))),
        F.when(F.lower(rt) == F.lower(at), cell("agreement", rt, rt)), F.when(is_novel(), cell("novel", F.lit(""), F.lit(""))),
    ))
    return rows.where(F.col("has_verdict") & (rt != "") & (at != "")).withColumn("c", F.explode(found)).select("c.*", "*").drop("c")


def kept_cells(each: DataFrame) -> DataFrame:
    """(kind, rule, agent) to describe: the chosen ones, those of 50 sessions or more, the 20 largest of tactics, all of agreement and novel."""
    spark = each.sparkSession
    sizes = each.groupBy("kind", "rule", "agent").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    chosen = [("tactic", a, b) for a, b in FOCUS_TACTICS] + [("level", str(a), str(b)) for a, b in FOCUS_LEVELS]
    focus = F.broadcast(spark.createDataFrame(chosen, "kind string, rule string, agent string"))  # 13 rows
    large = sizes.where((F.col("n") >= CELL_SIZE) | F.col("kind").isin("agreement", "novel")).select("kind", "rule", "agent")
    top = most_common(sizes.where("kind = 'tactic'"), ["kind"], TOP_CELLS).select("kind", "rule", "agent")
    return sizes.select("kind", "rule", "agent").join(focus, ["kind", "rule", "agent"], "left_semi").union(large).union(top).distinct()


def cell_profiles(rows: DataFrame) -> DataFrame:
    """(kind, rule, agent, n, has_download, has_upload, avg_duration_s) of the cells to describe."""
    each = cells(rows)
    total = each.groupBy("kind", "rule", "agent").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_downloads") > 0).alias("has_download"), F.count_if(F.col("n_uploads") > 0).alias("has_upload"), F.avg("duration_s").alias("avg_duration_s")
    )
    return total.join(kept_cells(each), ["kind", "rule", "agent"], "left_semi")


def cell_counters(rows: DataFrame) -> DataFrame:
    """(kind, rule, agent, dim, value, n): the counters of every cell, of commands the 15 most used."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    dims = {
        "session_type": F.coalesce("session_type", F.lit("unknown")), "command_bucket": command_bucket(F.col("n_commands")), "agent_confidence": text("agent_confidence"), "agent_sophistication": text("agent_sophistication"),
        "rule_sophistication_score": text("sophistication_score"), "location": F.coalesce("location", F.lit("unknown")), "auth_success": F.when(F.coalesce("auth_success", F.lit(False)), "True").otherwise("False"),
    }
    pair = lambda dim, value: F.struct(F.lit(dim).alias("dim"), value.alias("value"))
    pairs = F.concat(F.array(*[pair(k, v) for k, v in dims.items()]), F.transform("heads", lambda h: pair("top_commands", h)))
    each = cells(rows.withColumn("pairs", pairs))
    counts = each.select("kind", "rule", "agent", "seq", F.explode("pairs").alias("p")).groupBy("kind", "rule", "agent", "p.dim", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    top = most_common(counts.where("dim = 'top_commands'").withColumn("first", F.struct("first", "value")), ["kind", "rule", "agent"], TOP_COMMANDS)
    cols = ["kind", "rule", "agent", "dim", "value", "n"]
    return counts.where("dim != 'top_commands'").select(*cols).union(top.select(*cols))


def cell_samples(rows: DataFrame, n: int = CELL_SAMPLES) -> DataFrame:
    """(kind, rule, agent, session_ids): the first ten of each cell; Spark limits each partition before the shuffle."""
    w = Window.partitionBy("kind", "rule", "agent").orderBy("seq")
    first = cells(rows).select("kind", "rule", "agent", "seq", "session_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return first.groupBy("kind", "rule", "agent").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id"))), lambda x: x["session_id"]).alias("session_ids"))


# -- costs: outliers; 'relevant' is exactly RELEVANT


def costs(rows: DataFrame) -> DataFrame:
    """One row: coverage of the rules, the reviewers' counts, costs and latency, and what a million sessions would take."""
    out, hv = F.coalesce("is_anomaly", F.lit(False)), F.coalesce("hunter_verdict", F.lit(""))
    failed = out & F.col("hunter_verdict").isNull() & F.col("sent_to_hunter")
    noise, relevant = out & (hv == "NOISE"), out & (hv == "RELEVANT")
    deep = relevant & F.col("sent_to_analyst")
    novel = deep & F.col("has_verdict") & is_novel()
    flags = {
        "anomalous": out, "with_patterns": ~no_patterns(), "sent_to_hunter": out & F.col("sent_to_hunter"), "hunter_errored": failed, "hunter_noise": noise, "hunter_relevant": relevant,
        "sent_to_analyst": deep, "novel_findings": novel,
    }
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    one = rows.agg(
        F.count(F.lit(1)).alias("total_sessions"), *[F.count_if(v).alias(k) for k, v in flags.items()],
        total(out, "cost_usd").cast("double").alias("total_cost_usd"), total(noise, "cost_usd").cast("double").alias("hunter_only_cost_usd"), total(deep, "cost_usd").cast("double").alias("analyst_cost_usd"), total(out, "latency_ms").cast("long").alias("total_latency_ms"),
    )
    c, share = F.col, ratio(F.col("anomalous"), F.col("total_sessions"))
    insight = F.try_divide(c("total_cost_usd"), F.nullif(c("novel_findings"), F.lit(0)).cast("double"))
    return one.select(
        "*", share.alias("anomaly_rate"), (c("total_sessions") - c("with_patterns")).alias("no_patterns"), ratio(c("with_patterns"), c("total_sessions")).alias("pattern_rate"),
        ratio(c("hunter_noise"), c("hunter_noise") + c("hunter_relevant")).alias("hunter_filter_rate"), ratio(c("novel_findings"), c("sent_to_analyst")).alias("novel_finding_rate"),
        ratio(c("total_cost_usd"), c("anomalous")).alias("avg_cost_per_anomalous_session"), ratio(c("total_cost_usd"), c("sent_to_hunter")).alias("avg_cost_per_hunter_call"), ratio(c("analyst_cost_usd"), c("sent_to_analyst")).alias("avg_cost_per_analyst_call"),
        insight.alias("cost_per_novel_finding"), (insight < COST_LIMIT).alias("threshold_met"), ratio(c("total_latency_ms"), c("sent_to_hunter")).alias("avg_latency_per_session_ms"),
        (ratio(c("total_cost_usd"), c("anomalous")) * share * 1e6).alias("cost_1m_sessions"), (ratio(c("total_latency_ms"), c("sent_to_hunter")) * share * 1e6 / 1000 / 3600).alias("time_1m_sessions_hours"),
    )


def floor_percentiles(values: DataFrame, column: str, shares: tuple[tuple[str, float], ...] = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))) -> DataFrame:
    """One row of min, max and the values at position floor(n p) of the sorted column; exact.

    Sorting happens over distinct values with their counts: costs are token counts times a price, so
    those are few however many sessions there are.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(1))))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col("v"))).alias(name) for name, p in shares]
    return placed.agg(*at, F.min("v").alias("min"), F.max("v").alias("max"))


def relevant_costs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_anomaly") & (F.col("hunter_verdict") == "RELEVANT") & (F.col("cost_usd") > 0))


# -- the overview of a run


def overview(labelled: DataFrame) -> DataFrame:
    """(section, value, n): session types, levels, every tactic of a session, and totals."""
    entry = lambda k, v: F.struct(F.lit(k).alias("section"), v.cast("string").alias("value"))
    fixed = F.array_compact(F.array(entry("session_type", F.col("session_type")), entry("level", F.col("level")), F.when(F.col("n_downloads") > 0, entry("total", F.lit("with_download")))))
    all_ = F.concat(fixed, F.transform("all_tactics", lambda t: F.struct(F.lit("tactic").alias("section"), t.alias("value"))))
    return labelled.select(F.explode(all_).alias("e")).groupBy("e.section", "e.value").agg(F.count(F.lit(1)).alias("n"))


def overview_averages(labelled: DataFrame) -> DataFrame:
    """(sessions, avg_duration_s, avg_commands): commands over the sessions that have any."""
    some = F.col("n_commands") > 0
    return labelled.agg(F.count(F.lit(1)).alias("sessions"), F.avg("duration_s").alias("avg_duration_s"), F.avg(F.when(some, F.col("n_commands"))).alias("avg_commands"))
