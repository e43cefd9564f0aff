"""SQL of the queries over files and stored records."""

from __future__ import annotations

from vigilspark.operators.anomaly import FLAT_STD, WATCHED
from vigilspark.operators.sampling import OTHER, Quotas

from . import cases
from .oracles import _ISO, _KW, _NOVEL, _RAW_AT, DUAL, LAB, LOG, SCORED, SEG, SES, TRUTH, q
from .oracles import ORACLES as BASE

TOTAL = 100


def r(x: str, digits: int) -> str:
    """Half to even on the exact binary value."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


# -- features, outliers

_SOME = "CASE WHEN n_commands > 0 THEN {0} ELSE 0.0 END"
_PER = "CASE WHEN duration_s > 0 THEN {0} / duration_s ELSE {0} END"
_VALUES = {
    "F44_duration": r("duration_s", 2), "F38_messages_per_sec": r(_SOME.format(_PER.format("n_commands")), 4), "extra_chars_per_sec": r(_SOME.format(_PER.format("total_length")), 4), "extra_num_commands": "n_commands",
    "extra_unique_commands": "n_unique_commands", "extra_avg_cmd_length": r(_SOME.format("total_length / n_commands"), 2), "F46_download_count": "n_downloads",
}
_REAL = ("F44_duration", "F38_messages_per_sec", "extra_chars_per_sec", "extra_avg_cmd_length")


def watched(base: str) -> str:
    """CTE ``w`` of ``base`` with the watched features, and ``t`` of their statistics."""
    made = ", ".join(f"{x} AS {k}" for k, x in _VALUES.items())
    stats = ", ".join(f"count({k}) AS n_{k}, avg({k}) AS m_{k}, coalesce(sqrt(var_samp({k})), 0.0) AS s_{k}, coalesce(var_samp({k}), 0.0) AS v_{k}" for k in WATCHED)
    return f"""kw AS (SELECT session AS session_id, seg, {_KW} FROM sg GROUP BY session, seg), w AS (SELECT b.*, {made}, {", ".join(f"kw.{k}" for k in WATCHED if k not in _VALUES)} FROM {base} b JOIN kw USING (session_id, seg)),
        t AS (SELECT {stats}, least({", ".join(f"count({k})" for k in WATCHED)}) >= 100 AS trained FROM w)"""


def scored(base: str) -> str:
    z = {k: f"CASE WHEN s_{k} < {FLAT_STD} THEN 0.0 ELSE ({k} - m_{k}) / s_{k} END" for k in WATCHED}
    said = lambda k: f"CAST({k} AS VARCHAR)" if k not in _REAL else f"CAST(CAST({k} AS DOUBLE) AS VARCHAR)"
    why = ", ".join(f"CASE WHEN abs(z_{k}) > 3 THEN '{k}=' || {said(k)} || ' (' || CASE WHEN z_{k} > 0 THEN 'high' ELSE 'low' END || ', z=' || printf('%.1f', z_{k}) || ')' END" for k in WATCHED)
    most = ", ".join(f"abs(z_{k})" for k in WATCHED)
    return f"""{watched(base)}, zz AS (SELECT w.*, trained, {", ".join(f"{x} AS z_{k}" for k, x in z.items())} FROM w, t),
        o AS (SELECT *, CASE WHEN trained THEN list_filter([{why}], lambda x: x IS NOT NULL) ELSE ['detector not trained yet'] END AS reasons, CASE WHEN trained THEN {r(f"greatest({most})", 3)} ELSE 0.0 END AS score,
            CASE WHEN trained THEN concat_ws(',', {", ".join(f"CAST(round({r(f'z_{k}', 3)} * 1000) AS BIGINT)" for k in WATCHED)}) ELSE '{",".join("-" for _ in WATCHED)}' END AS z FROM zz),
        oo AS (SELECT *, len(reasons) > 0 AS is_anomaly FROM o)"""


# -- reviewers: what a prompt has of words that the stand-in reacts to

_LOUD = " OR ".join(f"contains(early, '{w}')" for w in ("wget", "curl", "tftp"))


def reviewed(fail: str | None) -> str:
    bad = lambda text: f"contains({text}, {q(fail)})" if fail else "false"
    return f"""{LAB}, {scored("lab")},
        said AS (SELECT session AS session_id, seg, string_agg(cmd, chr(10) ORDER BY seq) FILTER (WHERE i <= 50) AS c50, string_agg(cmd, chr(10) ORDER BY seq) AS c100
            FROM (SELECT session, sg.seg AS seg, cmd, sg.seq AS seq, row_number() OVER (PARTITION BY session, sg.seg ORDER BY sg.seq) AS i FROM sg WHERE cmd IS NOT NULL) WHERE i <= 100 GROUP BY ALL),
        pr AS (SELECT oo.*, concat_ws(chr(10), c50, array_to_string(reasons, ','), array_to_string(matched_patterns, ',')) AS early, concat_ws(chr(10), c100, array_to_string(reasons, ','), array_to_string(matched_patterns, ',')) AS late FROM oo LEFT JOIN said USING (session_id, seg)),
        rv AS (SELECT *, {bad("early")} AS fail1, {_LOUD} AS loud, {bad("late")} AS fail2, CASE WHEN contains(late, '| sh') OR contains(late, './') THEN 1 ELSE 2 END AS lev FROM pr),
        av AS (SELECT session_id, seg, first_seq, is_anomaly, loud, lev, is_anomaly AS to_hunter, CASE WHEN is_anomaly AND NOT fail1 THEN CASE WHEN loud THEN 'RELEVANT' ELSE 'NOISE' END END AS hunter_verdict, is_anomaly AND NOT fail1 AND loud AS to_analyst,
            CAST(CASE WHEN is_anomaly AND NOT fail1 AND loud AND NOT fail2 THEN lev END AS BIGINT) AS level, CASE WHEN is_anomaly AND fail1 THEN 'hunter' WHEN is_anomaly AND loud AND fail2 THEN 'analyst' END AS stage FROM rv)"""


FAIL = "crontab"

# -- samples

_Q = Quotas()
_LIMITS = ", ".join(f"('agreement', {q(k)}, {n})" for k, n in _Q.agreement.items()) + ", " + ", ".join(f"('disagreement', {q(k)}, {n})" for k, n in _Q.disagreement.items()) + f", ('novel', 'novel', {_Q.novel}), ('level_only', '*', {_Q.level_only})"


def sampled(seed: int, limit: str) -> str:
    """CTE ``sel``: the sample; ``limit`` is the quota of a pool in terms of n, the quota of the whole sample."""
    pairs = ", ".join(q(k) for k in _Q.disagreement)
    return f"""{DUAL}, p AS (SELECT *, trim(coalesce(rule_tactic, '')) AS rt, trim(coalesce(agent_tactic, '')) AS ag FROM dual WHERE has_verdict), s AS (SELECT *, lower(rt) = lower(ag) AND rt <> '' AS same, coalesce(rule_level = agent_level, true) AS lev FROM p),
        b AS (SELECT 'novel' AS bucket, 'novel' AS bucket_key, 'novel' AS pool, 2 AS rank, seq, session_id FROM s WHERE {_NOVEL}
            UNION ALL SELECT 'agreement', k, k, 4, seq, session_id FROM (SELECT *, CASE WHEN rt IN ({", ".join(q(k) for k in _Q.agreement)}) THEN rt ELSE '{OTHER}' END AS k FROM s WHERE same AND lev)
            UNION ALL SELECT 'level_only', rt || '|L' || rule_level || '->L' || agent_level, '*', 3, seq, session_id FROM s WHERE same AND NOT lev
            UNION ALL SELECT 'disagreement', k, k, 1, seq, session_id FROM (SELECT *, CASE WHEN rt || ' -> ' || ag IN ({pairs}) THEN rt || ' -> ' || ag WHEN rt = 'Discovery' THEN 'Discovery -> {OTHER}' ELSE '{OTHER} -> {OTHER}' END AS k FROM s WHERE NOT same)),
        quota AS (SELECT * FROM (VALUES {_LIMITS}) t(bucket, pool, n)),
        drawn AS (SELECT b.*, row_number() OVER (PARTITION BY b.bucket, b.pool ORDER BY md5('{seed}-' || seq), seq) AS i, {limit} AS most FROM b JOIN quota n ON n.bucket = b.bucket AND n.pool = b.pool),
        one AS (SELECT * FROM drawn WHERE i <= most QUALIFY row_number() OVER (PARTITION BY seq ORDER BY rank) = 1),
        sel AS (SELECT row_number() OVER (ORDER BY seq) AS annotation_id, seq, session_id, bucket, bucket_key FROM one)"""


_SCALED = sampled(7, f"CAST(greatest(1, round_even(n.n * CAST({TOTAL} AS DOUBLE) / (SELECT sum(n) FROM quota), 0)) AS BIGINT)")
_STR = "CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%d %H:%M:%S+00:00') ELSE strftime({0}, '%Y-%m-%d %H:%M:%S.%f+00:00') END"
_MAPPING = {
    "authentication.attempts": "bigint", "authentication.failed_count": "bigint", "authentication.final_password": "string", "authentication.final_username": "string", "authentication.success": "boolean", "authentication.success_count": "bigint", "authentication.usernames_tried": "array<string>",
    "client.hassh": "string", "client.hassh_algorithms": "string", "client.ssh_version": "string", "commands.failed_count": "bigint", "commands.inputs": "array<string>", "commands.success_count": "bigint", "commands.total_count": "bigint", "commands.unique_commands": "bigint",
    "connection.dst_ip": "string", "connection.dst_port": "int", "connection.protocol": "string", "connection.src_ip": "string", "connection.src_port": "int", "downloads.count": "bigint", "downloads.shasums": "array<string>", "downloads.urls": "array<string>",
    "labels_rule_based.all_tactics": "array<string>", "labels_rule_based.behavior_tag": "string", "labels_rule_based.has_download": "boolean", "labels_rule_based.has_upload": "boolean", "labels_rule_based.kill_chain_detected": "boolean", "labels_rule_based.level": "int",
    "labels_rule_based.matched_patterns": "array<string>", "labels_rule_based.obfuscation_detected": "boolean", "labels_rule_based.primary_tactic": "string", "labels_rule_based.session_type": "string", "labels_rule_based.sophistication_score": "int", "labels_rule_based.tactic_count": "int",
    "location": "string", "meta.event_count": "bigint", "meta.is_closed": "boolean", "meta.session_type": "string", "meta.source_files": "array<string>", "session_id": "string", "tcpip_forwards.count": "bigint", "timing.duration_s": "double", "timing.end_ts": "string", "timing.start_ts": "string", "uploads.count": "bigint",
}
_FILE = "'ssh-' || (seq % 3) AS location, 'decoy.json.2024_1_' || (seq % 4 + 1) || CASE WHEN seq % 4 % 2 = 1 THEN '.gz' ELSE '' END AS source_file"

ORACLES: dict[str, str] = {
    "o002_log_files": f"""WITH {LOG} SELECT {_FILE}, count(*) AS lines, count(*) FILTER (WHERE seq % 50 > 2) AS events, count(*) FILTER (WHERE seq % 50 <= 2) AS errors, count(*) FILTER (WHERE seq % 50 > 3 AND kind LIKE 'command.%') AS commands, max(CASE WHEN seq % 50 > 2 THEN {_RAW_AT} END) AS last_us
        FROM ev WHERE seq % 4 < 3 GROUP BY ALL""",
    "o006_file_counts": f"WITH {LOG}, f AS (SELECT *, {_FILE.replace('AS location', 'AS place').replace('AS source_file', 'AS file')} FROM ev) SELECT place AS location, count(DISTINCT file) AS files, count(*) FILTER (WHERE seq % 50 > 2) AS events, count(*) FILTER (WHERE seq % 50 <= 2) AS errors FROM f GROUP BY place",
    "o005_time_formats": f"WITH {LOG} SELECT seq, CASE seq % 8 WHEN 7 THEN NULL WHEN 3 THEN epoch_us(date_trunc('second', ts)) WHEN 4 THEN epoch_us(date_trunc('second', ts)) WHEN 5 THEN epoch_us(date_trunc('millisecond', ts)) ELSE epoch_us(ts) END AS us FROM ev",
    "o007_record_scans": f"WITH {LAB} SELECT session_type, CAST(level AS BIGINT) AS level, count(*) AS n, CAST(sum(n_commands) AS BIGINT) AS commands, CAST(sum(event_count) AS BIGINT) AS events, CAST(sum(total_length) AS BIGINT) AS lengths FROM lab GROUP BY ALL",
    "o008_bad_lines": "SELECT count(*) AS read, count(*) + 2 AS kept_lines, CAST(2 AS BIGINT) AS bad_lines, count(*) AS good_lines, true AS fails FROM labels",
    "o009_annotations": f"WITH {TRUTH.replace('AS voter))', 'AS voter) WHERE (doc_id * 3 + voter) % 7 <> 0)')} SELECT * FROM tr",
    "o010_last_sample": f"""WITH {SCORED.replace("FROM labels WHERE doc_id % 5 <> 0)", "FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq, 'Impact' AS a_tactic, 'again' AS bucket) FROM (SELECT " + ", ".join(f"{x} AS {k}" for k, x in cases.sample_columns(False).items()) + " FROM labels WHERE doc_id % 5 <> 0) WHERE annotation_id % 4 = 0)")}
        SELECT annotation_id, tactic, a_tactic, bucket FROM sc""",
    "o012_geo_files": BASE["o047_geo_lookup"],
    "o016_mapping": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in _MAPPING.items()) + ") t(field, kind)",
    "o017_stamped": f"WITH {SES} SELECT count(*) AS records, count(*) AS stamped FROM ss",
    "o019_sink": f"WITH {SES} SELECT count(*) AS found, CAST(sum(event_count) AS BIGINT) AS events, CAST(1 AS BIGINT) AS places, count(*) AS written, CAST(0 AS BIGINT) AS unnamed, CAST(1 AS BIGINT) AS locations, count(*) AS dry_run FROM ss",
    "o020_export": f"WITH {SES} SELECT count(*) AS found, count(*) AS written, true AS ended FROM ss",
    "o021_record_times": f"""WITH {SES}, fc AS (SELECT session AS session_id, seg, arg_min(ts, seq) AS at, arg_min(cmd, seq) AS input FROM sg WHERE cmd IS NOT NULL GROUP BY ALL)
        SELECT session_id, ss.seg, {_ISO.format("start_ts")} AS start_ts, {_ISO.format("end_ts")} AS end_ts, {_STR.format("fc.at")} AS first_command, fc.input FROM ss LEFT JOIN fc USING (session_id, seg)""",
    "o022_labelled_file": f"WITH {SES}, {scored('ss')} SELECT is_anomaly, is_anomaly AS was_anomaly, false AS sent, count(*) AS n, CAST(0 AS BIGINT) AS verdicts, CAST(0 AS BIGINT) AS ms FROM oo GROUP BY ALL",
    "o023_detector_file": f"WITH {SES}, {watched('ss')} " + " UNION ALL ".join(f"SELECT '{k}' AS name, n_{k} AS count, printf('%.6f', CAST(m_{k} AS DOUBLE)) AS mean, printf('%.6f', s_{k}) AS std, trained, CAST(3.0 AS DOUBLE) AS z_threshold, CAST(100 AS BIGINT) AS min_samples FROM t" for k in WATCHED),
    "o024_sample_metadata": f"WITH {_SCALED} SELECT CAST(7 AS BIGINT) AS seed, (SELECT count(*) FROM dual) AS total_sessions_scanned, (SELECT count(*) FROM dual WHERE has_verdict) AS dual_labeled_sessions, (SELECT count(*) FROM sel) AS drawn, bucket, count(*) AS n, (SELECT count(*) FROM b WHERE b.bucket = sel.bucket) AS population FROM sel GROUP BY bucket",
    "o025_report_file": BASE["o073_overview"],
    "o026_merged_file": f"WITH m AS ({BASE['o041_update_join']}) SELECT merged, labels_agentic, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, (SELECT count(*) FROM m) AS written FROM m GROUP BY merged, labels_agentic",
    "o038_schema_check": f"""WITH {SES} SELECT session_id, seg, user_id % 8 NOT IN (5, 7) AS ok_json, CASE user_id % 8 WHEN 1 THEN 'missing required field: location; missing required field: src_ip' WHEN 2 THEN 'level should be a whole number, is string' WHEN 3 THEN 'commands should be a list, is string'
        WHEN 4 THEN 'missing feature: F44_duration' WHEN 6 THEN 'missing label field: level; missing label field: matched_patterns' ELSE '' END AS errors FROM ss""",
    "o058_all_statistics": f"WITH {SES}, {watched('ss')} " + " UNION ALL ".join(f"SELECT '{k}' AS name, n_{k} AS count, printf('%.6f', CAST(m_{k} AS DOUBLE)) AS mean, printf('%.3f', v_{k}) AS variance FROM t" for k in WATCHED),
    "o060_summary": f"WITH {SES}, {watched('ss')} SELECT 'Detector: trained=' || CASE WHEN trained THEN 'True' ELSE 'False' END || ', threshold 3.0, at least 100 samples' AS line FROM t"
    + "".join(f" UNION ALL SELECT '  {k}: n=' || n_{k} || ', mean=' || printf('%.2f', CAST(m_{k} AS DOUBLE)) || ', std=' || printf('%.2f', s_{k}) FROM t" for k in WATCHED),
    "o061_run_stats": f"""WITH {reviewed(FAIL)} SELECT count(*) AS sessions_processed, count(*) FILTER (WHERE to_hunter) AS sessions_anomalous, count(*) FILTER (WHERE to_hunter) AS sent_to_hunter, count(*) FILTER (WHERE hunter_verdict = 'RELEVANT') AS marked_relevant, count(*) FILTER (WHERE to_analyst) AS sessions_fully_analyzed, count(stage) AS errors,
        round(count(*) FILTER (WHERE to_hunter) / count(*), 6) AS anomaly_rate, CASE WHEN count(*) FILTER (WHERE to_hunter) > 0 THEN round(1 - count(*) FILTER (WHERE hunter_verdict = 'RELEVANT') / count(*) FILTER (WHERE to_hunter), 6) ELSE 0.0 END AS hunter_filter_rate FROM av""",
    "o082_verdicts": """WITH i AS (SELECT DISTINCT doc_id % 41 - 20 AS k FROM labels), l AS (SELECT k, CAST(k AS DOUBLE) / 100 - CAST(0.04 AS DOUBLE) AS lo FROM i), h AS (SELECT *, lo + CAST(0.05 AS DOUBLE) AS hi FROM l)
        SELECT k, CASE WHEN lo > 0 THEN 'B superior (95% CI [' || printf('%.3f', lo) || ', ' || printf('%.3f', hi) || '] above 0)' WHEN hi < 0 THEN 'A superior (95% CI [' || printf('%.3f', lo) || ', ' || printf('%.3f', hi) || '] below 0)'
            WHEN lo > CAST(-0.05 AS DOUBLE) THEN 'B non-inferior within 0.05 (CI low ' || printf('%.3f', lo) || ')' ELSE 'inconclusive within 0.05 (CI low ' || printf('%.3f', lo) || ')' END AS verdict FROM h""",
    "o093_first_sessions": f"WITH {SES} SELECT session_id, seg, first_seq, event_count FROM ss ORDER BY first_seq LIMIT 25",
    "o094_list_caps": f"""WITH {SEG}, g AS (SELECT *, 'big' || (user_id % 3) AS big, count(cmd) OVER w AS ic, count(*) FILTER (WHERE kind = 'session.file_download') OVER w AS dn FROM sg WHERE kind <> 'session.closed' WINDOW w AS (PARTITION BY user_id % 3 ORDER BY seq))
        SELECT big AS session_id, count(cmd) AS commands, least(100, count(cmd)) AS inputs, string_agg(cmd, chr(10) ORDER BY seq) FILTER (WHERE ic <= 100 AND cmd IS NOT NULL) AS first, count(*) FILTER (WHERE kind = 'session.file_download') AS downloads,
            count(*) FILTER (WHERE kind = 'session.file_download' AND dn <= 20 AND url <> '') AS urls, count(*) FILTER (WHERE kind = 'session.file_download' AND dn <= 20) AS sums, CAST(20 AS BIGINT) AS patterns FROM g GROUP BY big""",
    "o098_stratified_sample": f"WITH {sampled(42, 'n.n')} SELECT * FROM sel",
    "o100_scaled_sample": f"WITH {_SCALED} SELECT * FROM sel",
    "o102_sample_records": f"""WITH {_SCALED},
        x AS (SELECT annotation_id, sel.session_id, bucket, bucket_key, lab.seg, n_commands AS commands, n_logins AS attempts FROM sel JOIN lab ON lab.first_seq = sel.seq),
        y AS (SELECT session AS session_id, seg, string_agg(cmd, chr(10) ORDER BY seq) FILTER (WHERE cmd IS NOT NULL) AS inputs FROM sg GROUP BY ALL),
        us AS (SELECT session_id, seg, array_to_string(list_sort(list(DISTINCT username))[1:20], ',') AS users FROM (SELECT session AS session_id, seg, username FROM sg WHERE kind IN ('login.success', 'login.failed') AND username <> '') GROUP BY ALL)
        SELECT annotation_id, x.session_id, bucket, bucket_key, commands, coalesce(inputs, '') AS inputs, attempts, coalesce(users, '') AS users, CAST(NULL AS VARCHAR) AS ssh_version, blind, CASE WHEN blind THEN '' ELSE 'rule_based_label,agent_label,hunter_verdict,statistical_anomaly' END AS labels
        FROM x JOIN y USING (session_id, seg) LEFT JOIN us USING (session_id, seg), (VALUES (true), (false)) v(blind)""",
    "o106_rates": f"""WITH {LAB} SELECT session_id, seg, {_VALUES["F38_messages_per_sec"]} AS F38_messages_per_sec, {_VALUES["extra_chars_per_sec"]} AS extra_chars_per_sec, {_VALUES["extra_avg_cmd_length"]} AS extra_avg_cmd_length, {r(_SOME.format("n_unique_commands / n_commands"), 4)} AS extra_command_diversity_ratio,
        coalesce({r("gap_us / 1e6", 6)}, -1.0) AS extra_min_inter_command_gap, max_length AS extra_max_cmd_length, n_unique_commands AS extra_unique_commands FROM lab""",
    "o120_durations": f"WITH {SES} SELECT session_id, seg, {r('duration_s', 2)} AS F44_duration, {r(_SOME.format('sum_length / n_commands'), 2)} AS F45_received_size_avg FROM ss",
    "o141_outliers": f"WITH {SES}, {scored('ss')} SELECT session_id, seg, is_anomaly, score, array_to_string(reasons, '; ') AS reasons, z FROM oo",
    "o142_flag_all": f"WITH {SES} SELECT d AS detector, true AS is_anomaly, CAST(0.0 AS DOUBLE) AS score, w AS reasons, (SELECT count(*) FROM ss) AS n, CAST(0 AS BIGINT) AS z_scores FROM (VALUES ('none', 'No detector - flagging all'), ('untrained', 'detector not trained yet')) t(d, w)",
    "o144_dry_labels": f"WITH {SES}, {scored('ss')} SELECT session_id, seg, is_anomaly AS was_anomaly, CAST(NULL AS VARCHAR) AS hunter_verdict, false AS to_hunter, CAST(0 AS BIGINT) AS ms, CAST(0.0 AS DOUBLE) AS usd FROM oo",
    "o149_reviewers": f"WITH {reviewed(FAIL)} SELECT session_id, seg, is_anomaly AS was_anomaly, hunter_verdict, level, CASE level WHEN 1 THEN 'Execution' WHEN 2 THEN 'Command and Control' END AS tactic, to_hunter, to_analyst, NOT to_hunter AS skipped, stage FROM av",
    "o152_retry_merge": f"""WITH {reviewed(FAIL)},
        again AS (SELECT session_id, CASE WHEN loud THEN 'RELEVANT' ELSE 'NOISE' END AS v, CAST(CASE WHEN loud THEN lev END AS BIGINT) AS l FROM av WHERE to_hunter AND hunter_verdict IS NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_seq DESC) = 1)
        SELECT session_id, seg, again.v IS NOT NULL AS merged, CASE WHEN again.v IS NOT NULL THEN again.v ELSE hunter_verdict END AS hunter_verdict, CASE WHEN again.v IS NOT NULL THEN again.l ELSE level END AS level FROM av LEFT JOIN again USING (session_id)""",
    "o153_reanalyze": f"WITH {reviewed(None)} SELECT session_id, seg, hunter_verdict, level, true AS to_analyst, true AS answered FROM av WHERE hunter_verdict = 'RELEVANT'",
    "o155_stream_sessions": f"""WITH {LAB}, li AS (SELECT session AS session_id, seg, string_agg(cmd, chr(10) ORDER BY seq) FILTER (WHERE cmd IS NOT NULL) AS commands FROM sg GROUP BY ALL)
        SELECT session_id, seg, event_count, is_closed, n_logins, n_failed_logins, n_commands, coalesce(commands, '') AS commands, session_type, total_length AS length, CAST(level AS BIGINT) AS level, primary_tactic FROM lab JOIN li USING (session_id, seg)""",
}
