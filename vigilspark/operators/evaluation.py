"""Evaluation against annotators: votes, reports, McNemar, bootstrap, kappa.

Spark reduces the rows to small tables of counts; what follows from those is computed on the driver
where a closed formula needs it. Tactics are trimmed and compared with their case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.columns import fixed, tactic_plain

MARGIN, RESAMPLES, SEED = 0.05, 10_000, 42


def majority(votes: DataFrame, value: Column, name: str) -> DataFrame:
    """(annotation_id, name, n, agreement): most votes, then mean confidence (null is 0), then first seen."""
    rows = votes.select("annotation_id", value.alias("v"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c"), "seq")
    each = rows.groupBy("annotation_id", "v").agg(F.count(F.lit(1)).alias("votes"), F.avg("c").alias("c"), F.min("seq").alias("first"))
    order = F.struct(-F.col("votes"), -F.col("c"), "first")  # first may be a place in a file
    best = each.groupBy("annotation_id").agg(F.min_by(F.struct("v", "votes"), order).alias("b"), F.sum("votes").alias("n"))
    return best.select("annotation_id", F.col("b.v").alias(name), "n", (F.col("b.votes") / F.col("n")).alias(f"{name}_agreement_rate"))


def ground_truth(votes: DataFrame) -> DataFrame:
    """(annotation_id, tactic, level, fn_risk, n_annotators, both agreement rates); votes without identifier are dropped."""
    votes = votes.where("annotation_id is not null")
    tactic = majority(votes, F.coalesce("primary_tactic", F.lit("")), "tactic")
    level = majority(votes, F.col("threat_level"), "level").drop("n")
    risk = votes.groupBy("annotation_id").agg(F.bool_or(F.coalesce("is_false_negative_risk", F.lit(False))).alias("fn_risk"))
    return tactic.withColumnRenamed("n", "n_annotators").join(level, "annotation_id").join(risk, "annotation_id")


def aligned(truth: DataFrame, sample: DataFrame) -> DataFrame:
    """Inner join by annotation_id; of a repeated identifier in ``sample`` the last row by seq counts."""
    cols = [c for c in sample.columns if c not in ("annotation_id", "seq")]
    last = sample.groupBy("annotation_id").agg(F.max_by(F.struct(*cols), "seq").alias("s")).select("annotation_id", "s.*")
    return truth.join(last, "annotation_id")


def confusion_counts(rows: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """(pred, truth, n); the empty label is a class of its own."""
    return rows.groupBy(tactic_plain(pred.cast("string")).alias("pred"), tactic_plain(truth.cast("string")).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """(label, tp, predicted, support, precision, recall, f1) of each label that isn't empty."""
    c = confusion_counts(rows, pred, truth)
    part = lambda label, p, t, hit: F.struct(label.alias("label"), p.alias("p"), t.alias("t"), hit.alias("tp"))
    n, zero, hit = F.col("n"), F.lit(0).cast("long"), F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0).cast("long")
    sides = c.select(F.explode(F.array(part(F.col("pred"), n, zero, hit), part(F.col("truth"), zero, n, zero))).alias("s")).select("s.*").where("label != ''")
    out = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("predicted"), F.sum("t").alias("support"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("support"))
    return out.select("*", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def overall_report(rows: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """(n, accuracy, macro_f1, weighted_f1): pairs of two empty labels don't count for n and accuracy."""
    by = class_report(rows, pred, truth).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)).alias("weighted_f1"))
    c = confusion_counts(rows, pred, truth).where("pred != '' or truth != ''")
    acc = c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.try_divide(F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("accuracy"))
    return acc.crossJoin(F.broadcast(by))  # one row each


def mean_absolute_error(pred: Column, truth: Column) -> Column:
    """An aggregate; pairs with a null don't count, none at all gives null."""
    return F.avg(F.abs(pred - truth).cast("double"))


def detected(tactic: Column, level: Column) -> Column:
    """Neither without action nor of level 3."""
    return ~F.lower(tactic_plain(tactic)).isin("", "no action") & F.coalesce(level <= 2, F.lit(False))


def fn_rate(tactic: Column, level: Column, risk: Column) -> Column:
    """An aggregate: share of the rows at risk that aren't detected; null without such rows."""
    return F.avg(F.when(risk, (~detected(tactic, level)).cast("double")))


# -- McNemar


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial p-value: twice the lower tail, summed outwards from min(b, c) until terms no longer count, so its cost doesn't grow with the pairs."""
    n, k = b + c, min(b, c)
    if n == 0 or b == c:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total, ratio, i = 1.0, 1.0, k
    while i > 0 and ratio > 1e-18:
        ratio *= i / (n - i + 1)
        total += ratio
        i -= 1
    return float(min(1.0, 2 * math.exp(log) * total))


def mcnemar(rows: DataFrame, a_right: Column, b_right: Column) -> DataFrame:
    """(b, c, n_discordant, p_value)."""
    r = rows.agg(F.count_if(a_right & ~b_right).alias("b"), F.count_if(~a_right & b_right).alias("c")).first()
    return rows.sparkSession.createDataFrame([(r["b"], r["c"], r["b"] + r["c"], mcnemar_p(r["b"], r["c"]))], "b bigint, c bigint, n_discordant bigint, p_value double")


# -- bootstrap


def _f1(counts: np.ndarray, pred: np.ndarray, truth: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(macro, weighted) F1 of each resample; counts (resamples, triples); label 0 is the empty one."""
    def side(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), labels))
        for k in range(1, labels):
            out[:, k] = w[:, codes == k].sum(1)
        return out

    tp, p, t = side(np.where(pred == truth, pred, 0), counts), side(pred, counts), side(truth, counts)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.nan_to_num(2 * tp / (p + t))
    seen = ((p + t) > 0).sum(1)
    return np.divide(f.sum(1), seen, out=np.zeros(len(f)), where=seen > 0), np.divide((f * t).sum(1), t.sum(1), out=np.zeros(len(f)), where=t.sum(1) > 0)


def bootstrap(rows: DataFrame, a: Column, b: Column, truth: Column, n_boot: int = RESAMPLES, seed: int = SEED, margin: float = MARGIN) -> DataFrame:
    """(metric, mean_diff, ci95_low, ci95_high, n_boot, verdict): paired resampling of F1 of b minus a.

    Rows are reduced to counts of (a, b, truth); a resample of n rows is a multinomial draw of those
    counts, so its cost doesn't grow with n. Resamples are spread over the cluster, each with a seed of
    its own: results don't hang on the partitions. Both metrics use the same draws.
    """
    spark = rows.sparkSession
    plain = lambda x: tactic_plain(x.cast("string"))
    triples = [tuple(r) for r in rows.groupBy(plain(a).alias("a"), plain(b).alias("b"), plain(truth).alias("t")).agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b", "t").collect()]
    schema = "metric string, mean_diff double, ci95_low double, ci95_high double, n_boot bigint, verdict string"
    if not triples:
        return spark.createDataFrame([], schema)
    names = [""] + sorted({x for r in triples for x in r[:3]} - {""})
    codes = np.array([[names.index(x) for x in r[:3]] for r in triples])
    share = np.array([r[3] for r in triples], float)
    n = int(share.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = np.stack([np.random.default_rng((seed, int(i))).multinomial(n, share / n) for i in batch["id"]]).astype(float)
            one, two = _f1(w, codes[:, 0], codes[:, 2], len(names)), _f1(w, codes[:, 1], codes[:, 2], len(names))
            yield pd.DataFrame({"macro_f1": two[0] - one[0], "weighted_f1": two[1] - one[1]})

    found = spark.range(n_boot).mapInPandas(draw, "macro_f1 double, weighted_f1 double").toPandas()
    out = []
    for metric in found.columns:
        d = np.sort(found[metric].to_numpy())
        out.append((metric, float(d.mean()), float(d[int(0.025 * n_boot)]), float(d[int(0.975 * n_boot)]), n_boot))
    made = spark.createDataFrame(out, schema.rpartition(",")[0])
    return made.withColumn("verdict", verdict(F.col("ci95_low"), F.col("ci95_high"), margin))


def verdict(low: Column, high: Column, margin: float = MARGIN) -> Column:
    """What a 95% interval of the difference b - a says about b."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else fixed(p, 3) for p in parts])
    return (
        F.when(low > 0, said("B superior (95% CI [", low, ", ", high, "] above 0)")).when(high < 0, said("A superior (95% CI [", low, ", ", high, "] below 0)"))
        .when(low > -margin, said(f"B non-inferior within {margin} (CI low ", low, ")")).otherwise(said(f"inconclusive within {margin} (CI low ", low, ")"))
    )


# -- agreement of annotators


def kappa_of(counts: dict[tuple, int], linear: bool = False) -> float | None:
    """Cohen's kappa of counts by pair; weights fall with the distance of the labels' ranks if ``linear``."""
    n = sum(counts.values())
    if not n:
        return None
    labels = sorted({x for p in counts for x in p})
    k, at = len(labels), {x: i for i, x in enumerate(labels)}
    o = np.zeros((k, k))
    for (a, b), c in counts.items():
        o[at[a], at[b]] += c
    i = np.arange(k)
    w = 1 - np.abs(i[:, None] - i[None, :]) / max(1, k - 1) if linear else np.eye(k)
    po, pe = (o * w).sum() / n, (np.outer(o.sum(1), o.sum(0)) * w).sum() / n**2
    return 1.0 if pe >= 1 else float((po - pe) / (1 - pe))


def kappa(rows: DataFrame, a: Column, b: Column, linear: bool = False) -> float | None:
    counts = rows.where(a.isNotNull() & b.isNotNull()).groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return kappa_of({(r["a"], r["b"]): r["n"] for r in counts.collect()}, linear)


def first_two(votes: DataFrame) -> DataFrame:
    """The first two votes of each annotation that has at least two, side by side."""
    v = F.struct("seq", "primary_tactic", "threat_level")
    pair = votes.where("annotation_id is not null").groupBy("annotation_id").agg(F.min(v).alias("x"), F.array_sort(F.collect_list(v)).alias("all")).where(F.size("all") >= 2)
    y = F.element_at("all", 2)
    return pair.select("annotation_id", F.col("x.primary_tactic").alias("tactic_a"), y["primary_tactic"].alias("tactic_b"), F.col("x.threat_level").alias("level_a"), y["threat_level"].alias("level_b"))


def annotator_agreement(votes: DataFrame) -> DataFrame:
    """(n_overlap, tactic_kappa, level_weighted_kappa, both shares of equal votes), of the first two votes."""
    pairs = first_two(votes)
    same = lambda a, b: F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))
    r = pairs.agg(F.count(F.lit(1)).alias("n"), same("tactic_a", "tactic_b").alias("t"), same("level_a", "level_b").alias("l")).first()
    t, level = kappa(pairs, F.col("tactic_a"), F.col("tactic_b")), kappa(pairs, F.col("level_a"), F.col("level_b"), linear=True)
    return votes.sparkSession.createDataFrame([(r["n"], t, level, r["t"], r["l"])], "n_overlap bigint, tactic_kappa double, level_weighted_kappa double, tactic_agreement double, level_agreement double")


def novel_validation(rows: DataFrame, agent: Column, human: Column) -> DataFrame:
    """One row over the sampled novel sessions: whether annotators agree, and whether they saw a threat."""
    real = ~F.lower(tactic_plain(human)).isin("", "no action", "unknown")
    return rows.where("bucket = 'novel'").agg(
        F.count(F.lit(1)).alias("n_novel_in_sample"), F.count_if(tactic_plain(agent) == tactic_plain(human)).alias("agent_tactic_matches_human"), F.avg((tactic_plain(agent) == tactic_plain(human)).cast("double")).alias("agent_precision"),
        F.count_if(real).alias("human_saw_real_threat"), F.avg(real.cast("double")).alias("human_real_threat_rate"),
    )
