"""Outliers, joins, reviewers, sampling, evaluation and checks of records on hand-made cases."""

import json
import math
import random
from dataclasses import replace
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vigilspark.operators import agents, anomaly, evaluation, joins, sampling, schema_check
from vigilspark.plans import cases


def _rows(spark, values):
    base = dict.fromkeys(anomaly.WATCHED, 0.0)
    return spark.createDataFrame([(i, *(base | v).values()) for i, v in enumerate(values)], "i long, " + ", ".join(f"{k} double" for k in anomaly.WATCHED))


def test_detector_against_a_running_mean(spark, tmp_path):
    rng = random.Random(1)
    values = [{"F44_duration": rng.gauss(5, 2), "extra_num_commands": float(rng.randint(0, 9))} for _ in range(150)] + [{"F44_duration": float("nan")}]
    d = anomaly.train(_rows(spark, values), src="")
    n = mean = m2 = 0
    for v in values[:-1]:
        n += 1
        delta = v["F44_duration"] - mean
        mean += delta / n
        m2 += delta * (v["F44_duration"] - mean)
    assert d.stats["F44_duration"] == pytest.approx((n, mean, m2)) and d.trained
    d.save(str(tmp_path / "m.json"))
    assert anomaly.Detector.load(str(tmp_path / "m.json")) == d and "F44_duration" in d.summary()


@pytest.mark.parametrize("partitions", [1, 7])
def test_statistics_are_exact(spark, partitions):
    """As many digits of a large variance as are shown, in whatever order rows come; and values beyond four digits or above a thousand million."""
    n = 200_000
    cents = [k * 7919 * 7919 % 400_000_007 for k in range(n)]
    s, q = sum(cents), sum(c * c for c in cents)
    rows = spark.range(0, n, 1, partitions).select((F.expr("id * 7919 * 7919 % 400000007") / 100).alias("x"), (F.col("id") / 3).alias("y"), (F.col("id") * 1e6).alias("z"))
    got = {r["name"]: r for r in anomaly.feature_stats(rows, src="", names=("x", "y", "z")).collect()}
    exact = Fraction(n * q - s * s, n * 10_000)
    assert abs(Fraction(got["x"]["m2"]) / exact - 1) < Fraction(1, 2**52)
    assert got["x"]["mean"] == s / n / 100
    whole = Fraction(n * (n * n - 1), 12)
    assert got["y"]["m2"] == pytest.approx(float(whole / 9), rel=1e-12) and got["z"]["m2"] == pytest.approx(float(whole * 10**12), rel=1e-12)
    assert got["y"]["mean"] == pytest.approx((n - 1) / 6, rel=1e-14) and got["z"]["mean"] == pytest.approx((n - 1) / 2 * 1e6, rel=1e-14)


def test_only_above_the_threshold(spark):
    d = anomaly.Detector(stats={k: (200, 0.0, 199.0) for k in anomaly.WATCHED}, trained=True)
    got = [r["statistical_anomaly"] for r in anomaly.score(_rows(spark, [{"F44_duration": 3.0}, {"F44_duration": -3.5}, {"F44_duration": float("nan")}]), d, src="").orderBy("i").collect()]
    assert [g["is_anomaly"] for g in got] == [False, True, False] and got[0]["score"] == 3.0
    assert got[1]["reasons"] == ["F44_duration=-3.5 (low, z=-3.5)"] and "F44_duration" not in got[2]["z_scores"]
    flat = anomaly.Detector(stats={k: (200, 0.0, 0.0) for k in anomaly.WATCHED}, trained=True)
    assert not anomaly.score(_rows(spark, [{"F44_duration": 99.0}]), flat, src="").first()["statistical_anomaly"]["is_anomaly"]
    for none in (None, anomaly.Detector()):
        assert anomaly.score(_rows(spark, [{}]), none, src="").first()["statistical_anomaly"]["is_anomaly"]


def test_update_join_takes_nulls_and_updates_repeats(spark):
    old = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], "session_id string, labels_agentic string")
    new = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 3), ("", "q", 4), (None, "q", 5), ("zz", "q", 6)], "session_id string, labels_agentic string, seq long")
    got = sorted((r["session_id"], r["labels_agentic"] or "-") for r in joins.update_join(old, new).collect())
    assert got == [("a", "new"), ("a", "new"), ("b", "-"), ("c", "w")]
    assert tuple(joins.merge_report(old, new).first()) == (3, 1, 1)


# -- reviewers


def _session(i, text, out=True):
    return (f"s{i}", 1.0, True, [(text, "2024-01-01 00:00:00", True)], (out, 1.0, ["r"], {}))


def _sessions(spark):
    rows = [_session(0, "wget x | sh"), _session(1, "ls"), _session(2, "curl y"), _session(3, "wget fail"), _session(4, "wget z", out=False)]
    return spark.createDataFrame(rows, f"session_id string, duration_s double, auth_success boolean, commands array<struct<input:string,timestamp:string,success:boolean>>, statistical_anomaly {anomaly.RESULT}")


FAST = agents.AgentConfig(attempts=1, delay_s=0.0)


def test_branches_of_the_reviewers(spark):
    got = {r["session_id"]: r for r in agents.run_reviewers(_sessions(spark), lambda: agents.ScriptedClient("fail"), FAST, partitions=2).collect()}
    hv = {k: r["labels_agentic"]["hunter_verdict"] for k, r in got.items()}
    assert hv == {"s0": "RELEVANT", "s1": "NOISE", "s2": "RELEVANT", "s3": None, "s4": None}
    assert got["s0"]["labels_agentic"]["analyst_verdict"]["level"] == 1 and got["s2"]["labels_agentic"]["analyst_verdict"]["level"] == 2
    assert got["s3"]["review_detail"]["stage"] == "hunter" and got["s4"]["review_detail"]["skipped"] and not got["s4"]["labels_agentic"]["pipeline_metrics"]["sent_to_hunter"]


def test_run_stats_and_reanalysis(spark):
    done = agents.run_reviewers(_sessions(spark), lambda: agents.ScriptedClient("fail"), replace(FAST, price_out_1k=1.0), partitions=2)
    s = agents.run_stats(done).first()
    assert (s["sessions_processed"], s["sessions_anomalous"], s["sent_to_hunter"], s["marked_relevant"], s["errors"]) == (5, 4, 4, 2, 1) and s["hunter_filter_rate"] == 0.5
    again = agents.reanalyze(done.where("labels_agentic.hunter_verdict = 'RELEVANT'"), agents.ScriptedClient, replace(FAST, price_out_1k=1.0), 2).collect()
    assert len(again) == 2 and all(r["labels_agentic"]["pipeline_metrics"]["total_cost_usd"] == pytest.approx(0.14) for r in again)


def test_answers_are_parsed(spark):
    assert agents.parse_hunter('so {"verdict": "relevant", "confidence": 1}')["verdict"] == "RELEVANT"
    assert agents.parse_hunter("it is Relevant")["reasoning"] == "by keyword" and agents.parse_hunter("{bad}")["verdict"] == "NOISE"
    a = agents.parse_analyst('```json\n{"threat_level": "1", "iocs": ["x"]}\n```')
    assert (a["level"], a["primary_tactic"], a["iocs"]) == (1, "Unknown", ["x"])
    assert agents.parse_analyst('text {"threat_level": 3, "a": {"b": 1}} more')["level"] == 3
    assert agents.parse_analyst('{"level": 1}')["intent"] == agents.parse_analyst("nothing")["intent"] == agents.parse_analyst("{ {")["intent"] == "parse failed"


def test_retries_wait_as_asked():
    class Busy:
        n = 0

        def complete(self, system, prompt):
            self.n += 1
            if self.n < 3:
                raise RuntimeError("429 please retry in 90.5s" if self.n == 1 else "broken")
            return '{"verdict": "NOISE"}', 1000, 1000

    slept, now = [], [0.0]
    r = agents.Reviewer(Busy(), agents.AgentConfig(price_in_1k=1.0), "", lambda s: "", agents.parse_hunter, slept.append, lambda: now[0])
    got = r.analyze({})
    assert got.success and got.retries == 2 and slept == [60.0, 4.0] and got.cost == 1.0
    assert not agents.Reviewer(Busy(), agents.AgentConfig(attempts=1), "", lambda s: "", agents.parse_hunter, slept.append).analyze({}).success


def test_rate_limit():
    now = [0.0]
    r = agents.Reviewer(agents.ScriptedClient(), agents.AgentConfig(requests_per_minute=2), agents.HUNTER_SYSTEM, lambda s: "x", agents.parse_hunter, lambda s: now.__setitem__(0, now[0] + s), lambda: now[0])
    for _ in range(5):
        r.analyze({})
    assert now[0] == 120.0


# -- sampling


def test_sample_keeps_quotas_and_priorities(spark):
    dual = cases.dual_rows(spark, SMALL)
    q = sampling.Quotas()
    a, b = (sampling.stratified(d, q).collect() for d in (dual, dual.repartition(5)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert sorted(r["annotation_id"] for r in a) == list(range(1, len(a) + 1)) and len({r["seq"] for r in a}) == len(a)
    sizes = {}
    for r in a:
        sizes[r["bucket"], r["bucket_key"]] = sizes.get((r["bucket"], r["bucket_key"]), 0) + 1
    assert all(n <= q.disagreement[k] for (b, k), n in sizes.items() if b == "disagreement") and sum(n for (b, _), n in sizes.items() if b == "novel") <= q.novel
    assert q.total() == 400 and sampling.Quotas().scaled(40).novel == 4 and min(sampling.Quotas().scaled(1).agreement.values()) == 1


# -- evaluation


def _votes(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, annotation_id long, primary_tactic string, threat_level int, confidence int, is_false_negative_risk boolean")


def test_majority_and_its_ties(spark):
    v = _votes(spark, (1, "A", 1, 2, False), (1, "B", 2, 4, None), (2, "A", 1, None, True), (2, "A", 2, 5, False), (2, "B", 2, 5, False), (3, None, None, 3, None), (4, "X", 1, 3, None), (4, "Y", 2, 3, None), (None, "Z", 1, 1, None))
    got = {r["annotation_id"]: r for r in evaluation.ground_truth(v).collect()}
    assert {k: (r["tactic"], r["level"], r["fn_risk"], r["n_annotators"]) for k, r in got.items()} == {1: ("B", 2, False, 2), 2: ("A", 2, True, 3), 3: ("", None, False, 1), 4: ("X", 1, False, 2)}


def test_mcnemar():
    assert evaluation.mcnemar_p(0, 0) == 1.0 and evaluation.mcnemar_p(5, 5) == pytest.approx(1.0)
    want = sum(math.comb(12, k) for k in range(13) if math.comb(12, k) <= math.comb(12, 2)) / 2**12
    assert evaluation.mcnemar_p(2, 10) == pytest.approx(want) and 0 <= evaluation.mcnemar_p(900, 1100) < 1e-4


def test_kappa():
    assert evaluation.kappa_of({}) is None and evaluation.kappa_of({(1, 1): 5}) == 1.0
    assert evaluation.kappa_of({(0, 0): 20, (0, 1): 5, (1, 0): 10, (1, 1): 15}) == pytest.approx(0.4)
    assert evaluation.kappa_of({(1, 1): 3, (3, 3): 3, (1, 3): 1, (2, 2): 1}, True) < 1


def test_bootstrap_of_itself_is_zero_and_a_better_one_wins(spark):
    rows = spark.createDataFrame([(t, t if i % 3 else "X", t) for i, t in enumerate("ABC" * 60)], "b string, a string, t string")
    same = evaluation.bootstrap(rows, F.col("a"), F.col("a"), F.col("t"), 200).collect()
    assert all(r["mean_diff"] == r["ci95_low"] == r["ci95_high"] == 0 and r["verdict"].startswith("B non-inferior") for r in same)
    got = evaluation.bootstrap(rows, F.col("a"), F.col("b"), F.col("t"), 400).collect()
    assert all(r["ci95_low"] > 0.1 and r["verdict"].startswith("B superior") for r in got)
    again = evaluation.bootstrap(rows.repartition(7), F.col("a"), F.col("b"), F.col("t"), 400).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    ends = spark.createDataFrame([(-0.2, 0.1), (-0.2, -0.1)], "a double, b double").select(evaluation.verdict(F.col("a"), F.col("b")).alias("v"))
    assert [r["v"][:9] for r in ends.collect()] == ["inconclus", "A superio"]


def test_supports_add_up(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("", "B"), (None, None), (" C ", "C")], "p string, t string")
    r = evaluation.class_report(rows, F.col("p"), F.col("t")).collect()
    assert {x["label"]: (x["tp"], x["predicted"], x["support"]) for x in r} == {"A": (1, 2, 1), "B": (0, 0, 2), "C": (1, 1, 1)}
    o = evaluation.overall_report(rows, F.col("p"), F.col("t")).first()
    assert (o["n"], o["accuracy"]) == (4, 0.5)


# -- records


def test_schema_check(spark):
    good = {k: 1 for k in schema_check.TOP} | {"commands": [], "labels_rule_based": {"level": 1, "matched_patterns": [], "primary_tactic": "x", "all_tactics": []}, "features": dict.fromkeys(schema_check.FEATURE, 1)}
    bad = {k: v for k, v in good.items() if k != "src_ip"} | {"commands": {}, "labels_rule_based": {"level": "1", "primary_tactic": "x", "all_tactics": "y", "matched_patterns": []}}
    lines = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("x",), ("[1]",), ("",)], "value string")
    got = schema_check.checked(lines).collect()
    assert got[0]["errors"] == [] and len(got[1]["errors"]) == 4 and [r["ok_json"] for r in got] == [True, True, False, False, False]
    assert tuple(schema_check.check_summary(lines).first()) == (4, 3)
