"""Rule labels of sessions from their rule masks: level, tactics, speed, chains, sophistication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.catalog import CHAINS, LEVEL_OF, RULES, TACTICS

from .sessionize import MASK_BITS, MASKS, min_gap

PASTED_GAP, MACHINE_RATE, HUMAN_RATE, MANY_UNKNOWN, KEPT_PATTERNS = 0.05, 2.0, 0.3, 5, 20
FAILED, IDLE, CHAIN = "Initial Access (Failed)", "No Action", "Kill Chain Detected"
UNKNOWN_HIGH, UNKNOWN_LOW = "Unknown Activity (High)", "Unknown Activity (Low)"


def rule_sql(bit: int) -> str:
    return f"({MASKS[bit // MASK_BITS]} & {1 << bit % MASK_BITS}L) != 0"


def tactic_sql(tactic: str) -> str:
    want = [sum(1 << r.bit % MASK_BITS for r in RULES if r.tactic == tactic and r.bit // MASK_BITS == k) for k in range(len(MASKS))]
    return "(" + " or ".join(f"({m} & {w}L) != 0" for m, w in zip(MASKS, want) if w) + ")"


def labels(sessions: DataFrame) -> DataFrame:
    """``sessions(..., rules=True)`` with the columns of a rule label.

    Without commands: level 3, failed access or no action. Without a matching rule: level 3, unknown
    activity. Else the least level of the rules; a chain of tactics lifts it to 1. The primary tactic
    is the first of that level, or the chain where it has none. Patterns are sorted, the first 20 kept.
    """
    t = {name: f"__t{i}" for i, name in enumerate(TACTICS)}
    rows = sessions.withColumns({col: F.expr(tactic_sql(name)) for name, col in t.items()})
    has = {name: F.col(col) for name, col in t.items()}
    chain = reduce(Column.__or__, [reduce(Column.__and__, [has[x] for x in sorted(c)]) for c in CHAINS])
    rows = rows.withColumn("__n", reduce(Column.__add__, [c.cast("int") for c in has.values()])).withColumn("kill_chain_detected", chain)
    matched, lifted = F.col("__n") > 0, F.col("kill_chain_detected")
    of_level = lambda k: reduce(Column.__or__, [has[x] for x in TACTICS if LEVEL_OF[x] == k])
    rows = rows.withColumn("level", F.when(matched & (of_level(1) | lifted), 1).when(matched & of_level(2), 2).otherwise(3))
    level = F.col("level")

    first = F.when(F.lit(False), "")
    for name in TACTICS:
        first = first.when(has[name] & (level == LEVEL_OF[name]), name)
    first = first.otherwise(CHAIN)
    unknown = F.when(F.col("any_suspicious") | (F.col("n_plain_unknown") >= MANY_UNKNOWN), UNKNOWN_HIGH).otherwise(UNKNOWN_LOW)
    idle = F.col("n_commands") == 0
    none = F.when(F.col("auth_success"), IDLE).otherwise(FAILED)
    primary = F.when(idle, none).when(~matched, unknown).otherwise(first)

    speed = F.col("n_commands") / F.col("duration_s")
    gap = min_gap(F.col("commands"))
    behavior = (
        F.when(idle | ~(F.col("duration_s") > 0), "UNKNOWN_SPEED")
        .when(gap < PASTED_GAP, "MACHINE_SPEED").when(speed > MACHINE_RATE, "MACHINE_SPEED").when(speed < HUMAN_RATE, "HUMAN_SPEED").otherwise("UNKNOWN_SPEED")
    )
    hidden = F.col("obfuscation") & ~idle
    score = (
        F.when(idle, 1).when(~matched, F.when(hidden, 2).otherwise(1))
        .when(lifted & hidden & (F.col("__n") >= 4), 5).when((F.col("__n") >= 3) | lifted | hidden, 4).when(level <= 2, 3).otherwise(2)
    )
    names = sorted([(r.name, rule_sql(r.bit)) for r in RULES] + [("kill_chain", "kill_chain_detected"), ("obfuscation_decoded", "obfuscation")])
    patterns = F.slice(F.expr("array_compact(array(" + ", ".join(f"if({test}, '{name}', null)" for name, test in names) + "))"), 1, KEPT_PATTERNS)
    tactics = F.array_compact(F.array(*[F.when(has[x], x) for x in sorted(TACTICS)]))
    return rows.withColumns({
        "primary_tactic": primary, "all_tactics": F.when(matched, tactics).otherwise(F.array(primary)), "matched_patterns": F.when(matched, patterns).otherwise(F.array().cast("array<string>")),
        "behavior_tag": behavior, "obfuscation_detected": hidden, "sophistication_score": score, "tactic_count": F.when(matched, F.col("__n")).otherwise(1),
        "has_download": F.col("n_downloads") > 0, "has_upload": F.col("n_uploads") > 0,
    }).drop(*t.values(), "__n")


LABEL_FIELDS = (
    "level", "primary_tactic", "all_tactics", "matched_patterns", "behavior_tag", "kill_chain_detected", "obfuscation_detected", "sophistication_score", "tactic_count", "has_download", "has_upload",
)


def label_struct(*more: str) -> Column:
    return F.struct(*LABEL_FIELDS, *more)
