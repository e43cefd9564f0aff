"""Outliers by z-score: mergeable mean and variance of 13 features, learnt in one aggregate."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.columns import fixed, rounded

WATCHED: tuple[str, ...] = tuple("""
    F44_duration F38_messages_per_sec extra_chars_per_sec extra_num_commands extra_unique_commands extra_avg_cmd_length
    F28_keyword_wget F29_keyword_tftp F14_keyword_chmod F16_keyword_rm F17_keyword_history extra_keyword_curl F46_download_count
""".split())  # fmt: skip
FLAT_STD = 0.0001
RESULT = "struct<is_anomaly:boolean,score:double,reasons:array<string>,z_scores:map<string,double>>"


@dataclass
class Detector:
    """``stats[name]`` is (count, mean, sum of squared deviations)."""

    z_threshold: float = 3.0
    min_samples: int = 100
    stats: dict[str, tuple[int, float, float]] = field(default_factory=lambda: {k: (0, 0.0, 0.0) for k in WATCHED})
    trained: bool = False

    def std(self, name: str) -> float:
        n, _, m2 = self.stats[name]
        return math.sqrt(m2 / (n - 1)) if n > 1 else 0.0

    def to_json(self) -> str:
        data = {"z_threshold": self.z_threshold, "min_samples": self.min_samples, "trained": self.trained}
        data["features"] = {k: {"count": n, "mean": mean, "m2": m2, "std_dev": self.std(k)} for k, (n, mean, m2) in self.stats.items()}
        return json.dumps(data, indent=2)

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """To a file that every node can reach: through Spark's file systems where a session is given."""
        if spark is None:
            with open(path, "w") as f:
                f.write(self.to_json())
            return
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(self.to_json().encode()))
        out.close()

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Detector:
        """Names that aren't watched are left out."""
        if spark is None:
            with open(path) as f:
                return cls.from_json(f.read())
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])

    @classmethod
    def from_json(cls, text: str) -> Detector:
        data = json.loads(text)
        out = cls(data["z_threshold"], data["min_samples"], trained=data["trained"])
        out.stats |= {k: (v["count"], v["mean"], v["m2"]) for k, v in data["features"].items() if k in out.stats}
        return out

    def summary(self) -> str:
        rows = [f"Detector: trained={self.trained}, threshold {self.z_threshold}, at least {self.min_samples} samples"]
        return "\n".join(rows + [f"  {k}: n={n}, mean={mean:.2f}, std={self.std(k):.2f}" for k, (n, mean, _) in self.stats.items() if n])


def _numeric(name: str, src: str) -> Column:
    x = F.col(f"{src}.{name}" if src else name).cast("double")
    return F.when(~F.isnan(x), x)


def _said(x: Column, kind: str) -> Column:
    """A value as text; real ones, which have at most four digits after the point, without an exponent."""
    if kind not in ("double", "float"):
        return x.cast("string")
    return F.regexp_replace(F.regexp_replace(fixed(x, 4), "0+$", ""), r"\.$", ".0")


#: Values up to a thousand million, to the digits that features have.
_EXACT = "decimal(13,4)"


def _sums(x: Column) -> dict[str, Column]:
    """Aggregates of a value: of its first four digits exactly, and of what is left of it."""
    q = F.when(F.abs(x) < 1e9, F.round(x, 4).cast(_EXACT)).when(x.isNotNull(), F.lit(0).cast(_EXACT))
    d = q.cast("double")
    r = x - d
    return {"n": F.count(x), "s": F.sum(q), "q": F.sum(q * q), "r": F.sum(r), "var": F.var_samp(r), "cov": F.covar_samp(d, r)}


def _squares(k: str) -> Column:
    """Sum of squared deviations: exactly from ``mu``, a mean of four digits, less what that is ``off``; then what values have beyond that."""
    # a wider factor would cost the difference its eighth digit
    s, n, mu, off = (F.col(f"{p}_{k}") for p in ("s", "n", "mu", "off"))
    first = (F.col(f"q_{k}") - mu * (s + off).cast("decimal(22,4)")).cast("double") - off.cast("double") * off.cast("double") / n
    return F.when(n > 1, first + (2 * F.col(f"cov_{k}") + F.col(f"var_{k}")) * (n - 1))


def feature_stats(rows: DataFrame, src: str = "features", names: tuple[str, ...] = WATCHED) -> DataFrame:
    """(name, count, mean, m2): one partial aggregate over all rows; missing values and NaN don't count.

    Sums are exact up to the fourth digit after the point, so they don't depend on the order of the rows.
    """
    aggs = [c.alias(f"{p}_{k}") for k in names for p, c in _sums(_numeric(k, src)).items()]
    one = rows.agg(*aggs)
    one = one.select("*", *[F.coalesce(F.col(f"s_{k}") / F.col(f"n_{k}"), F.lit(0)).cast(_EXACT).alias(f"mu_{k}") for k in names])
    one = one.select("*", *[(F.col(f"s_{k}") - F.col(f"mu_{k}") * F.col(f"n_{k}").cast("decimal(12,0)")).cast("decimal(23,4)").alias(f"off_{k}") for k in names])
    mean = lambda k: F.coalesce((F.col(f"s_{k}").cast("double") + F.col(f"r_{k}")) / F.col(f"n_{k}"), F.lit(0.0))
    m2 = lambda k: F.coalesce(_squares(k), F.lit(0.0))
    packed = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"n_{k}").alias("count"), mean(k).alias("mean"), m2(k).alias("m2")) for k in names])
    return one.select(F.explode(packed).alias("s")).select("s.*")


def train(rows: DataFrame, z_threshold: float = 3.0, min_samples: int = 100, src: str = "features") -> Detector:
    """A detector of all ``rows``; trained once each feature has ``min_samples`` values. Only 13 rows come to the driver."""
    stats = {r["name"]: (r["count"], r["mean"], r["m2"]) for r in feature_stats(rows, src).collect()}
    return Detector(z_threshold, min_samples, stats, min(n for n, _, _ in stats.values()) >= min_samples)


def score(rows: DataFrame, detector: Detector | None, src: str = "features") -> DataFrame:
    """``statistical_anomaly`` (is_anomaly, score, reasons, z_scores) for each row: literals of the model, no join.

    A feature alone above the threshold, strictly, makes an outlier. Without a detector, or with an
    untrained one, all rows are flagged.
    """
    if detector is None or not detector.trained:
        why = "No detector - flagging all" if detector is None else "detector not trained yet"
        return rows.withColumn("statistical_anomaly", F.struct(F.lit(True).alias("is_anomaly"), F.lit(0.0).alias("score"), F.array(F.lit(why)).alias("reasons"), F.create_map().cast("map<string,double>").alias("z_scores")))
    z, reasons = {}, []
    kinds = dict(rows.select(f"{src}.*" if src else "*").dtypes)
    for name in WATCHED:
        n, mean, _ = detector.stats[name]
        if n < detector.min_samples or name not in kinds:
            continue
        x, std = _numeric(name, src), detector.std(name)
        z[name] = F.when(x.isNotNull(), F.lit(0.0) if std < FLAT_STD else (x - F.lit(mean)) / F.lit(std))
        said = _said(F.col(f"{src}.{name}" if src else name), kinds[name])
        why = F.concat(F.lit(f"{name}="), said, F.lit(" ("), F.when(z[name] > 0, "high").otherwise("low"), F.lit(", z="), fixed(z[name], 1), F.lit(")"))
        reasons.append(F.when(F.abs(z[name]) > detector.z_threshold, why))
    most = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(F.abs(x), F.lit(0.0)) for x in z.values()])
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), rounded(x, 3).alias("v")) for k, x in z.items()]), lambda p: p["v"].isNotNull()))
    out = F.struct(F.array_compact(F.array(*reasons)).alias("reasons"))
    rows = rows.withColumn("__r", out["reasons"])
    found = F.struct((F.size("__r") > 0).alias("is_anomaly"), rounded(most, 3).alias("score"), F.col("__r").alias("reasons"), pairs.alias("z_scores"))
    return rows.withColumn("statistical_anomaly", found.cast(RESULT)).drop("__r")
