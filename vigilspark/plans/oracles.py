"""SQL of the registered queries for DuckDB, built from shared common table expressions."""

from __future__ import annotations

from vigilspark import catalog as c
from vigilspark.operators.reports import FOCUS_LEVELS, FOCUS_TACTICS
from vigilspark.operators.sampling import Quotas
from vigilspark.sources import adapter
from vigilspark.sources.adapter import sql_list

from . import cases


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(c.re2(pattern))}, 'i')"


LOG = adapter.log_sql()
SEG = f"""{LOG},
    sg AS (SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'session.closed' THEN 1 ELSE 0 END) OVER (PARTITION BY location, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg,
        CASE WHEN kind IN ('command.input', 'command.failed') AND input <> '' THEN input END AS cmd FROM ev)"""
_LOGIN, _CLOSED, _CMD = "kind IN ('login.success', 'login.failed')", "kind = 'session.closed'", "cmd IS NOT NULL"
SES = f"""{SEG},
    raw AS (SELECT session AS session_id, seg, min(location) AS location, min(user_id) AS user_id, min(seq) AS first_seq, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS event_count, list_sort(list(DISTINCT source_file)) AS source_files,
            bool_or({_CLOSED}) AS is_closed, arg_max(struct_pack(a := src_ip, b := src_port, c := dst_ip, d := dst_port, e := protocol), seq) FILTER (WHERE kind = 'session.connect') AS conn,
            arg_max(ssh_version, seq) FILTER (WHERE kind = 'client.version') AS ssh_version, arg_max(hassh, seq) FILTER (WHERE kind = 'client.kex') AS hassh,
            arg_max(struct_pack(u := username, p := password), seq) FILTER (WHERE kind = 'login.success') AS login, bool_or(kind = 'login.success') AS auth_success, arg_max(duration, seq) FILTER (WHERE {_CLOSED} AND duration IS NOT NULL) AS duration,
            count(*) FILTER (WHERE {_LOGIN}) AS n_logins, count(*) FILTER (WHERE kind = 'login.failed') AS n_failed_logins, count(cmd) AS n_commands, count(cmd) FILTER (WHERE kind = 'command.failed') AS n_failed_commands,
            count(DISTINCT cmd) AS n_unique_commands, CAST(coalesce(sum(length(cmd)), 0) AS BIGINT) AS sum_length, CAST(coalesce(max(length(cmd)), 0) AS BIGINT) AS max_length,
            count(*) FILTER (WHERE kind = 'session.file_download') AS n_downloads, count(*) FILTER (WHERE kind = 'session.file_upload') AS n_uploads, count(*) FILTER (WHERE kind = 'direct-tcpip.request') AS n_forwards
        FROM sg GROUP BY session, seg),
    ss AS (SELECT *, CASE WHEN conn IS NULL THEN '' ELSE conn.a END AS src_ip, CAST(coalesce(nullif(conn.b, 0), 0) AS BIGINT) AS src_port, coalesce(conn.c, '') AS dst_ip, CAST(coalesce(nullif(conn.d, 0), 22) AS BIGINT) AS dst_port, coalesce(conn.e, '1') AS protocol,
            login.u AS final_username, login.p AS final_password, coalesce(duration, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 0.0) AS duration_s, sum_length + greatest(n_commands - 1, 0) AS total_length,
            CASE WHEN NOT auth_success THEN 'failed_auth_only' WHEN n_commands = 0 THEN 'success_no_commands' ELSE 'success_with_commands' END AS session_type FROM raw)"""

_VALUES = ", ".join(f"({r.level}, {q(r.tactic)}, {q(r.name)}, {q(c.re2(r.pattern))})" for r in c.RULES)
_WORD = r"lower(trim(regexp_extract(x, '\S+'), './'))"


def typo(text: str) -> str:
    w = _WORD.replace("x,", f"{text},", 1)
    known = sql_list(c.KNOWN_COMMANDS, False)
    return f"(length({w}) BETWEEN 1 AND 20 AND NOT list_contains({known}, {w}) AND len(list_filter({known}, lambda k: levenshtein({w}, k) <= 2)) > 0)"


SUSPICIOUS = "(length({0}) > 50 OR regexp_matches({0}, '[|<>;&$`]'))"
PAYLOADS = f"""dc AS (SELECT DISTINCT cmd FROM sg WHERE cmd IS NOT NULL),
    pl AS (SELECT cmd, decode(from_base64(blob)) AS payload FROM (SELECT cmd, unnest(regexp_extract_all(cmd, '[A-Za-z0-9+/]{{8,}}={{0,2}}')) AS blob FROM dc WHERE {has("cmd", c.DECODE_PIPE)}) WHERE length(blob) % 4 = 0)"""
_CHAINS = " OR ".join(f"list_has_all(tactics, {sql_list(tuple(sorted(x)), False)})" for x in c.CHAINS)
_FIRST = " ".join(f"WHEN level = {c.LEVEL_OF[t]} AND list_contains(tactics, {q(t)}) THEN {q(t)}" for t in c.TACTICS)
HITS = f"""{SES}, {PAYLOADS},
    rules AS (SELECT * FROM (VALUES {_VALUES}) t(lvl, tactic, name, pattern)),
    tx AS (SELECT cmd, cmd AS said FROM dc UNION SELECT cmd, payload FROM pl),
    hit AS (SELECT DISTINCT cmd, lvl, tactic, name FROM tx JOIN rules ON regexp_matches(said, pattern, 'i'))"""
LAB = f"""{HITS},
    fl AS (SELECT cmd, {has("cmd", c.DECODE_PIPE)} OR {has("cmd", c.DECODE_BARE)} OR {has("cmd", c.ESCAPE_PIPE)} OR len(regexp_extract_all(cmd, {q("(?i)" + c.re2(c.ESCAPE))})) >= 3 AS hidden,
        {SUSPICIOUS.format("cmd")} AS sus, NOT {SUSPICIOUS.format("cmd")} AND NOT {typo("cmd")} AS odd FROM dc),
    sf AS (SELECT session, seg, bool_or(hidden) AS hidden, bool_or(sus) AS sus, count(*) FILTER (WHERE odd) AS n_odd FROM sg JOIN fl USING (cmd) GROUP BY ALL),
    sh AS (SELECT session, seg, min(lvl) AS lv, list_sort(list(DISTINCT tactic)) AS tactics, list(DISTINCT name) AS names FROM sg JOIN hit USING (cmd) GROUP BY ALL),
    gp AS (SELECT session, seg, min(gap) AS gap_us FROM (SELECT session, seg, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session, seg ORDER BY ts) AS gap FROM sg WHERE cmd IS NOT NULL) GROUP BY ALL),
    l1 AS (SELECT ss.*, coalesce(sf.hidden, false) AS obfuscation_detected, sf.sus, sf.n_odd, sh.lv, sh.names, coalesce(sh.tactics, CAST([] AS VARCHAR[])) AS tactics, gp.gap_us,
        FROM ss LEFT JOIN sf ON sf.session = session_id AND sf.seg = ss.seg LEFT JOIN sh ON sh.session = session_id AND sh.seg = ss.seg LEFT JOIN gp ON gp.session = session_id AND gp.seg = ss.seg),
    l2 AS (SELECT *, ({_CHAINS}) AS kill_chain_detected FROM l1),
    l3 AS (SELECT *, CASE WHEN lv IS NULL THEN 3 WHEN kill_chain_detected THEN 1 ELSE lv END AS level FROM l2),
    lab AS (SELECT *, CASE WHEN n_commands = 0 THEN CASE WHEN auth_success THEN 'No Action' ELSE 'Initial Access (Failed)' END
            WHEN lv IS NULL THEN CASE WHEN sus OR n_odd >= 5 THEN 'Unknown Activity (High)' ELSE 'Unknown Activity (Low)' END ELSE CASE {_FIRST} ELSE 'Kill Chain Detected' END END AS primary_tactic,
            CASE WHEN n_commands = 0 OR NOT duration_s > 0 THEN 'UNKNOWN_SPEED' WHEN gap_us / 1e6 < 0.05 THEN 'MACHINE_SPEED' WHEN n_commands / duration_s > 2.0 THEN 'MACHINE_SPEED' WHEN n_commands / duration_s < 0.3 THEN 'HUMAN_SPEED' ELSE 'UNKNOWN_SPEED' END AS behavior_tag,
            CASE WHEN n_commands = 0 THEN 1 WHEN lv IS NULL THEN CASE WHEN obfuscation_detected THEN 2 ELSE 1 END WHEN kill_chain_detected AND obfuscation_detected AND len(tactics) >= 4 THEN 5
                WHEN len(tactics) >= 3 OR kill_chain_detected OR obfuscation_detected THEN 4 WHEN level <= 2 THEN 3 ELSE 2 END AS sophistication_score,
            CASE WHEN lv IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_sort(names || CASE WHEN kill_chain_detected THEN ['kill_chain'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN obfuscation_detected THEN ['obfuscation_decoded'] ELSE CAST([] AS VARCHAR[]) END)[1:20] END AS matched_patterns
        FROM l3)"""
_SECOND = ", ".join(f"{x} AS {k}" for k, x in cases.second_labels(False).items())
DUAL = f"""{LAB},
    hd AS (SELECT session AS session_id, seg, list(left(regexp_extract(cmd, '\\S+'), 40) ORDER BY seq) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY session, seg ORDER BY seq) AS i FROM sg WHERE cmd IS NOT NULL) WHERE i <= 20 GROUP BY ALL),
    d0 AS (SELECT lab.*, first_seq AS seq, level AS rule_level, primary_tactic AS rule_tactic, coalesce(heads, CAST([] AS VARCHAR[])) AS heads FROM lab LEFT JOIN hd USING (session_id, seg)),
    dual AS (SELECT *, {_SECOND} FROM d0)"""
_LOOSE = "trim(replace(lower(trim(coalesce({}, ''))), '(failed)', ''))"
_NOVEL = "(len(matched_patterns) = 0 AND coalesce(agent_level <= 2, false))"
FUN = f"""{DUAL},
    f0 AS (SELECT *, is_anomaly AND hunter_verdict IS NOT NULL AS p, coalesce(is_anomaly AND hunter_verdict = 'NOISE', false) AS noise FROM dual),
    f1 AS (SELECT *, p AND NOT noise AND has_verdict AS dl FROM f0),
    fun AS (SELECT *, dl AND {_LOOSE.format("rule_tactic")} = {_LOOSE.format("agent_tactic")} AS ta, dl AND coalesce(rule_level = agent_level, false) AS la, dl AND {_NOVEL} AS ao FROM f1)"""
CELL = f"""{DUAL},
    c0 AS (SELECT *, trim(coalesce(rule_tactic, '')) AS rt, trim(coalesce(agent_tactic, '')) AS ag FROM dual WHERE has_verdict),
    c1 AS (SELECT * FROM c0 WHERE rt <> '' AND ag <> ''),
    cel AS (SELECT 'tactic' AS kind, rt AS rule, ag AS agent, * FROM c1 UNION ALL SELECT 'level', CAST(rule_level AS VARCHAR), CAST(agent_level AS VARCHAR), * FROM c1 WHERE agent_level IS NOT NULL
        UNION ALL SELECT 'agreement', rt, rt, * FROM c1 WHERE lower(rt) = lower(ag) UNION ALL SELECT 'novel', '', '', * FROM c1 WHERE {_NOVEL}),
    siz AS (SELECT kind, rule, agent, count(*) AS n, min(seq) AS first FROM cel GROUP BY ALL),
    kept AS (SELECT kind, rule, agent FROM siz WHERE n >= 50 OR kind IN ('agreement', 'novel')
        OR (kind, rule, agent) IN ({", ".join(f"('tactic', {q(a)}, {q(b)})" for a, b in FOCUS_TACTICS)}, {", ".join(f"('level', '{a}', '{b}')" for a, b in FOCUS_LEVELS)})
        UNION SELECT kind, rule, agent FROM siz WHERE kind = 'tactic' QUALIFY row_number() OVER (ORDER BY n DESC, first) <= 20)"""
_VOTE = ", ".join(f"{x} AS {k}" for k, x in cases.vote_columns(False).items())
_SAMPLE = ", ".join(f"{x} AS {k}" for k, x in cases.sample_columns(False).items())


def _majority(value: str, name: str) -> str:
    return f"""{name}v AS (SELECT annotation_id, {value} AS v, count(*) AS k, avg(coalesce(confidence, 0)) AS c, min(seq) AS first FROM vo GROUP BY ALL),
        {name}m AS (SELECT annotation_id, v AS {name}, k, sum(k) OVER (PARTITION BY annotation_id) AS n FROM {name}v QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY k DESC, c DESC, first) = 1)"""


VOTES = f"vo AS (SELECT {_VOTE} FROM labels, (SELECT unnest(range(3)) AS voter))"
TRUTH = f"""{VOTES}, {_majority("coalesce(primary_tactic, '')", "tactic")}, {_majority("threat_level", "level")},
    tr AS (SELECT annotation_id, tactic, CAST(level AS BIGINT) AS level, fn_risk, CAST(t.n AS BIGINT) AS n_annotators, round(t.k / t.n, 6) AS tactic_agreement_rate, round(l.k / l.n, 6) AS level_agreement_rate
        FROM tacticm t JOIN levelm l USING (annotation_id) JOIN (SELECT annotation_id, bool_or(is_false_negative_risk) AS fn_risk FROM vo GROUP BY 1) USING (annotation_id))"""
SCORED = f"""{TRUTH},
    sm AS (SELECT * FROM (SELECT {_SAMPLE} FROM labels WHERE doc_id % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY seq DESC) = 1),
    sc AS (SELECT tr.*, trim(coalesce(a_tactic, '')) AS aa, trim(coalesce(b_tactic, '')) AS bt, trim(tactic) AS ht, a_tactic, b_tactic, CAST(a_level AS BIGINT) AS a_level, CAST(b_level AS BIGINT) AS b_level, bucket FROM tr JOIN sm USING (annotation_id))"""
REPORT = f"""{SCORED},
    lb AS (SELECT DISTINCT label FROM (SELECT bt AS label FROM sc UNION SELECT ht FROM sc) WHERE label <> ''),
    r0 AS (SELECT label, count(*) FILTER (WHERE bt = label AND ht = label) AS tp, count(*) FILTER (WHERE bt = label) AS predicted, count(*) FILTER (WHERE ht = label) AS support FROM sc, lb GROUP BY label),
    rp AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM r0)"""

_KW = ", ".join(f"CAST(coalesce(sum(CASE WHEN {has('cmd', p)} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {k}" for k, p in c.KEYWORDS.items())
_TOTALS = ", ".join(f"CAST(coalesce(sum(len(regexp_extract_all(cmd, {q('(?i)' + c.re2(p))}))), 0) AS BIGINT) AS {k}" for k, p in c.TOTALS.items())
_FAMILY = "CASE WHEN coalesce(ssh_version, '') = '' THEN 'unknown' " + " ".join(f"WHEN contains(lower(ssh_version), {q(p)}) THEN {q(f)}" for p, f, _ in c.SSH_FAMILIES) + " ELSE 'other' END"
_CODE = "CASE fam WHEN 'unknown' THEN 0 " + " ".join(f"WHEN {q(f)} THEN {n}" for _, f, n in c.SSH_FAMILIES) + " ELSE 1 END"
_PRIVATE = "(src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' OR src_ip LIKE '127.%' OR src_ip LIKE '0.%' OR (src_ip LIKE '172.%' AND TRY_CAST(split_part(src_ip, '.', 2) AS INT) BETWEEN 16 AND 31))"
_NUM = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"
_GEO = "geo AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in row) + ")" for row in adapter.GEO) + f") t({', '.join(x.split()[0] for x in adapter.GEO_SCHEMA.split(', '))}))"
_ISO = "CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f+00:00') END"
_RANKED = "row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, min(seq))"
_WATCH = ("extra_num_commands", "extra_unique_commands", "F28_keyword_wget", "F29_keyword_tftp", "F14_keyword_chmod", "F16_keyword_rm", "F17_keyword_history", "extra_keyword_curl", "F46_download_count")
_RAW_AT = "CASE WHEN seq % 19 <> 0 THEN epoch_us(ts) END"
_Q = Quotas()
_PAIRS = ", ".join(q(k) for k in _Q.disagreement)

ORACLES: dict[str, str] = {
    "o001_parse_lines": f"""WITH {LOG} SELECT seq, CASE WHEN seq % 50 = 2 THEN 'x' WHEN seq % 50 < 4 THEN 'unknown' ELSE session END AS session,
        CASE WHEN seq % 50 = 2 THEN 'session.closed' WHEN seq % 50 < 4 THEN 'unknown' ELSE kind END AS kind, CASE WHEN seq % 50 < 4 THEN '0.0.0.0' ELSE src_ip END AS src_ip,
        CASE WHEN seq % 50 > 2 THEN {_RAW_AT} END AS ts, CASE WHEN seq % 50 > 3 THEN CAST(src_port AS BIGINT) END AS src_port, CASE WHEN seq % 50 > 3 THEN duration END AS duration, CASE WHEN seq % 50 > 2 THEN input END AS input,
        seq % 50 <= 2 AS bad, CASE WHEN seq % 50 > 2 THEN {_RAW_AT} END IS NULL AS ts_bad FROM ev""",
    "o006_parse_counts": f"WITH {LOG} SELECT count(DISTINCT source_file) AS files, count(*) FILTER (WHERE seq % 50 > 2) AS events, count(*) FILTER (WHERE seq % 50 <= 2) AS errors FROM ev",
    "o088_line_numbers": f"WITH {LOG} SELECT source_file, seq, row_number() OVER (PARTITION BY source_file ORDER BY seq) AS line_number FROM ev",
    "o015_upsert_documents": """WITH d AS (SELECT user_id || '_' || event_type AS _id, * FROM events), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY _id ORDER BY event_id DESC) = 1),
        l AS (SELECT * FROM d WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY _id ORDER BY event_id DESC) = 1)
        SELECT _id, user_id, event_type, value FROM l UNION ALL SELECT _id, user_id, event_type, value FROM a WHERE _id NOT IN (SELECT _id FROM l)""",
    "o031_event_dispatch": f"WITH {SEG} SELECT kind, count(*) AS n, count(cmd) AS commands FROM sg GROUP BY kind",
    "o051_segments": f"WITH {SEG} SELECT session, seg, count(*) AS events, min(seq) AS first, max(seq) AS last FROM sg GROUP BY ALL",
    "o053_bounds_counts": f"""WITH {SES} SELECT session_id, seg, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, is_closed, array_to_string(source_files, ',') AS files, round(duration_s, 3) AS duration_s,
        event_count, n_logins, n_failed_logins, n_commands, n_failed_commands, n_unique_commands, n_downloads, n_uploads, n_forwards FROM ss""",
    "o054_last_values": f"WITH {SES} SELECT session_id, seg, src_ip, src_port, dst_ip, dst_port, protocol, ssh_version, hassh, final_username, final_password, duration FROM ss",
    "o055_ordered_lists": f"""WITH {SEG} SELECT session AS session_id, seg, coalesce(string_agg(coalesce(username, '-') || ':' || coalesce(password, '-') || CASE kind WHEN 'login.success' THEN ':y' ELSE ':n' END, chr(10) ORDER BY seq) FILTER (WHERE {_LOGIN}), '') AS logins,
        coalesce(string_agg(CASE kind WHEN 'command.input' THEN '+' ELSE '-' END || cmd, chr(10) ORDER BY seq) FILTER (WHERE {_CMD}), '') AS commands, coalesce(string_agg(coalesce(url, '-') || '|' || coalesce(shasum, '-'), chr(10) ORDER BY seq) FILTER (WHERE kind = 'session.file_download'), '') AS downloads,
        coalesce(string_agg(coalesce(destfile, '-'), chr(10) ORDER BY seq) FILTER (WHERE kind = 'session.file_upload'), '') AS uploads, coalesce(string_agg(coalesce(dst_ip, '-') || ':' || coalesce(CAST(dst_port AS VARCHAR), '-'), chr(10) ORDER BY seq) FILTER (WHERE kind = 'direct-tcpip.request'), '') AS forwards
        FROM sg GROUP BY session, seg""",
    "o032_session_types": f"WITH {SES} SELECT session_type, is_closed, count(*) AS n FROM ss GROUP BY ALL",
    "o057_session_counts": f"WITH {SES} SELECT count(*) AS created, count(*) FILTER (WHERE is_closed) AS completed, count(*) FILTER (WHERE NOT is_closed) AS active FROM ss",
    "o028_nested_documents": f"""WITH {LAB}, {_GEO},
        li AS (SELECT session AS session_id, seg, string_agg(cmd, chr(10) ORDER BY seq) FILTER (WHERE ic <= 100 AND cmd IS NOT NULL) AS inputs, string_agg(url, chr(10) ORDER BY seq) FILTER (WHERE dn <= 20 AND kind = 'session.file_download') AS urls,
                string_agg(DISTINCT username, chr(10) ORDER BY username) FILTER (WHERE {_LOGIN}) AS users
            FROM (SELECT *, count(cmd) OVER w AS ic, count(*) FILTER (WHERE kind = 'session.file_download') OVER w AS dn FROM sg WINDOW w AS (PARTITION BY session, seg ORDER BY seq)) GROUP BY ALL)
        SELECT session_id, dst_port, {_ISO.format("start_ts")} AS start_ts, n_logins AS attempts, n_logins - n_failed_logins AS logins, coalesce(users, '') AS users, n_commands AS commands, coalesce(inputs, '') AS inputs, coalesce(urls, '') AS urls, n_uploads AS uploads,
            event_count AS events, coalesce((SELECT country_iso FROM geo WHERE src_ip <> '' AND NOT {_PRIVATE} AND {_NUM.format("src_ip").replace("CAST(", "TRY_CAST(")} BETWEEN {_NUM.format("low")} AND {_NUM.format("high")}), '') AS country, CAST(level AS BIGINT) AS level, total_length AS length
        FROM lab JOIN li USING (session_id, seg)""",
    "o030_flat_records": f"""WITH {LAB} SELECT session_id, location, {_ISO.format("start_ts")} AS start_ts, {_ISO.format("end_ts")} AS end_ts, src_port, dst_port, CASE WHEN dst_port = 23 THEN 'telnet' ELSE 'ssh' END AS protocol, auth_success, n_commands AS commands, n_logins AS attempts, session_type, event_count, primary_tactic AS tactic FROM lab""",
    "o103_keyword_counts": f"WITH {SEG} SELECT session AS session_id, seg, {_KW}, CAST(coalesce(sum(CASE WHEN contains(cmd, '|') THEN 1 ELSE 0 END), 0) AS BIGINT) AS extra_has_pipe, CAST(coalesce(sum(CASE WHEN contains(cmd, '>') THEN 1 ELSE 0 END), 0) AS BIGINT) AS extra_has_redirect FROM sg GROUP BY session, seg",
    "o104_match_totals": f"WITH {SEG} SELECT session AS session_id, seg, {_TOTALS} FROM sg GROUP BY session, seg",
    "o105_lengths": f"WITH {SES} SELECT session_id, seg, total_length AS message_length, n_commands, n_unique_commands, max_length, CAST(floor(total_length * 1000 / greatest(n_commands, 1)) AS BIGINT) AS milli_avg_length FROM ss",
    "o111_min_gap": f"WITH {SEG}, g AS (SELECT session, seg, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session, seg ORDER BY ts) AS gap FROM sg WHERE cmd IS NOT NULL), m AS (SELECT session, seg, min(gap) AS gap FROM g GROUP BY ALL) SELECT s.session AS session_id, s.seg, coalesce(m.gap, -1) AS gap_us FROM (SELECT DISTINCT session, seg FROM sg) s LEFT JOIN m ON m.session = s.session AND m.seg = s.seg",
    "o115_host_features": f"""WITH {SES}, h AS (SELECT *, {_FAMILY} AS fam, coalesce(final_username, '') AS u, coalesce(final_password, '') AS p FROM ss)
        SELECT session_id, seg, protocol AS F39_protocol, src_port AS F40_src_port, CAST(src_port > 49152 AS BIGINT) AS F40_src_port_high, coalesce(ssh_version, '') AS F41_ssh_version, fam AS F41_ssh_family, CAST({_CODE} AS BIGINT) AS F41_ssh_family_encoded, u AS F42_username, CAST(u = 'root' AS BIGINT) AS F42_username_is_root, length(u) AS F42_username_length,
            p AS F43_password, length(p) AS F43_password_length, CAST(list_contains({sql_list(c.COMMON_PASSWORDS, False)}, lower(p)) AS BIGINT) AS F43_password_is_common, CAST(n_downloads + n_uploads > 0 AS BIGINT) AS F46_has_files, n_downloads AS F46_download_count, n_uploads AS F46_upload_count, coalesce(hassh, '') AS extra_hassh,
            n_logins AS extra_login_attempts, CAST(auth_success AS BIGINT) AS extra_auth_success, n_forwards AS extra_tcpip_forwards, dst_port AS extra_dst_port, CAST(u <> '' AND lower(u) = lower(p) AS BIGINT) AS extra_password_equals_username, CAST(fam IN ('nmap', 'masscan') AS BIGINT) AS extra_ssh_family_is_scanner FROM h""",
    "o039_private_addresses": f"WITH {LOG} SELECT seq, src_ip, coalesce({_PRIVATE}, false) AS private FROM ev",
    "o047_geo_lookup": f"""WITH {LOG}, {_GEO} SELECT seq, src_ip, coalesce(continent_code, '') AS F47_continent_code, coalesce(country_name, '') AS F48_country_name, coalesce(country_iso, '') AS F48_country_iso, coalesce(region_name, '') AS F49_region_name, coalesce(city_name, '') AS F50_city_name,
        coalesce(longitude, 0.0) AS F51_longitude, coalesce(latitude, 0.0) AS F52_latitude, coalesce(timezone, '') AS extra_timezone, CAST(coalesce(accuracy_radius, 0) AS BIGINT) AS extra_accuracy_radius
        FROM ev LEFT JOIN geo ON NOT {_PRIVATE} AND {_NUM.format("src_ip")} BETWEEN {_NUM.format("low")} AND {_NUM.format("high")}""",
    "o126_threat_levels": f"WITH {LAB} SELECT CAST(level AS BIGINT) AS level, primary_tactic, count(*) AS sessions FROM lab GROUP BY ALL",
    "o130_rule_hits": f"WITH {HITS} SELECT tactic, name AS rule, count(DISTINCT (session, seg)) AS sessions FROM sg JOIN hit USING (cmd) GROUP BY ALL",
    "o133_rule_labels": f"""WITH {LAB} SELECT session_id, seg, CAST(level AS BIGINT) AS level, primary_tactic, CASE WHEN lv IS NULL THEN primary_tactic ELSE array_to_string(tactics, ',') END AS all_tactics, array_to_string(matched_patterns, ',') AS matched_patterns, behavior_tag, kill_chain_detected, obfuscation_detected,
        CAST(sophistication_score AS BIGINT) AS sophistication_score, CAST(CASE WHEN lv IS NULL THEN 1 ELSE len(tactics) END AS BIGINT) AS tactic_count, n_downloads > 0 AS has_download, n_uploads > 0 AS has_upload FROM lab""",
    "o128_obfuscation": f"WITH {SEG} SELECT seq, {has('cmd', c.DECODE_PIPE)} AS pipe, {has('cmd', c.DECODE_BARE)} AS bare, {has('cmd', c.ESCAPE_PIPE)} AS escape_pipe, CAST(len(regexp_extract_all(cmd, {q('(?i)' + c.re2(c.ESCAPE))})) AS BIGINT) AS escapes FROM sg WHERE cmd IS NOT NULL",
    "o129_decoded_payloads": f"WITH {SEG}, {PAYLOADS} SELECT cmd, string_agg(payload, chr(10)) AS payload FROM pl GROUP BY cmd",
    "o131_unknown_commands": f"WITH {SEG} SELECT cmd, {SUSPICIOUS.format('cmd')} AS suspicious, {typo('cmd')} AS typo FROM (SELECT DISTINCT cmd FROM sg WHERE cmd IS NOT NULL)",
    "o132_typos": f"SELECT word, n, {typo('word')} AS typo FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM conversations) WHERE word <> '' GROUP BY word)",
    "o058_detector_stats": f"""WITH {SES}, kw AS (SELECT session AS session_id, seg, {_KW} FROM sg GROUP BY session, seg), f AS (SELECT *, n_commands AS extra_num_commands, n_unique_commands AS extra_unique_commands, n_downloads AS F46_download_count FROM ss JOIN kw USING (session_id, seg))
        {" UNION ALL ".join(f"SELECT {q(k)} AS name, count({k}) AS count, round(avg({k}), 9) AS mean, round(coalesce(var_samp({k}) * (count({k}) - 1), 0), 9) AS m2 FROM f" for k in _WATCH)}""",
    "o041_update_join": """WITH r AS (SELECT o_custkey * 2 AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS l FROM orders WHERE o_orderkey % 7 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
        SELECT o_custkey AS session_id, o_orderkey, CASE WHEN k IS NOT NULL THEN l ELSE o_orderstatus END AS labels_agentic, k IS NOT NULL AS merged FROM orders LEFT JOIN r ON k = o_custkey""",
    "o042_merge_report": """WITH r AS (SELECT DISTINCT o_custkey * 2 AS k FROM orders WHERE o_orderkey % 7 = 0) SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT k FROM r)) AS merged, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM r)) AS unchanged,
        (SELECT count(*) FROM r WHERE k NOT IN (SELECT o_custkey FROM orders)) AS not_found""",
    "o043_aligned": f"WITH {SCORED} SELECT annotation_id, tactic, level, a_tactic, b_tactic, a_level, b_level, bucket FROM sc",
    "o154_label_comparison": f"""WITH {DUAL} SELECT session_id, seg, CASE WHEN coalesce(agent_tactic, '') <> '' THEN lower(coalesce(rule_tactic, '')) = lower(agent_tactic) END AS tactics_agree, CASE WHEN coalesce(agent_level, 0) <> 0 THEN rule_level = agent_level END AS levels_agree,
        CAST(rule_level AS BIGINT) AS rule_level, CAST(agent_level AS BIGINT) AS agent_level, CAST(abs(rule_level - agent_level) AS BIGINT) AS level_difference FROM dual""",
    "o040_errored": f"WITH {DUAL} SELECT session_id, seg FROM dual WHERE sent_to_hunter AND hunter_verdict IS NULL",
    "o062_funnel": f"""WITH {FUN}, n AS (SELECT count(*) AS total_sessions, count(*) FILTER (WHERE is_anomaly) AS anomalous, count(*) FILTER (WHERE p) AS hunter_processed, count(*) FILTER (WHERE noise) AS hunter_noise, count(*) FILTER (WHERE dl) AS dual_labeled, count(*) FILTER (WHERE ta) AS tactic_agree, count(*) FILTER (WHERE la) AS level_agree, count(*) FILTER (WHERE ao) AS agent_only FROM fun)
        SELECT *, anomalous - hunter_processed AS hunter_errored, hunter_processed - hunter_noise AS hunter_relevant, dual_labeled - tactic_agree AS tactic_disagree, dual_labeled - level_agree AS level_disagree, tactic_agree / dual_labeled AS tactic_agreement_rate, level_agree / dual_labeled AS level_agreement_rate,
            1 - tactic_agree / dual_labeled AS tactic_disagreement_rate, least(agent_only, 50) AS agent_only_capped, least(agent_only, 50) / dual_labeled AS agent_only_capped_rate, hunter_noise / hunter_processed AS hunter_filter_rate FROM n""",
    "o063_distributions": f"""WITH {FUN}, v AS (SELECT 'rule_tactic' AS kind, rule_tactic AS value, seq FROM fun WHERE dl UNION ALL SELECT 'agent_tactic', agent_tactic, seq FROM fun WHERE dl UNION ALL SELECT 'rule_level', CAST(rule_level AS VARCHAR), seq FROM fun WHERE dl
        UNION ALL SELECT 'agent_level', CAST(agent_level AS VARCHAR), seq FROM fun WHERE dl AND agent_level IS NOT NULL UNION ALL SELECT 'hunter_verdict', hunter_verdict, seq FROM fun WHERE p UNION ALL SELECT 'sophistication', agent_sophistication, seq FROM fun WHERE dl AND coalesce(agent_sophistication, '') <> '')
        SELECT kind, value, count(*) AS n, {_RANKED} AS rank FROM v GROUP BY kind, value QUALIFY {_RANKED} <= 20""",
    "o064_confusion": f"""WITH {FUN}, t AS (SELECT rule_tactic AS rule, agent_tactic AS agent, count(*) AS n, min(seq) AS first FROM fun WHERE dl AND NOT ta GROUP BY ALL), top AS (SELECT rule FROM t GROUP BY rule ORDER BY sum(n) DESC, min(first) LIMIT 15)
        SELECT 'tactic' AS kind, rule, agent, n FROM t WHERE rule IN (SELECT rule FROM top) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY n DESC, first) <= 5
        UNION ALL SELECT 'level', CAST(rule_level AS VARCHAR), CAST(agent_level AS VARCHAR), count(*) FROM fun WHERE dl AND agent_level IS NOT NULL GROUP BY rule_level, agent_level""",
    "o089_disagreement_samples": f"""WITH {FUN}, k AS (SELECT 'tactic' AS kind, * FROM fun WHERE dl AND NOT ta UNION ALL SELECT 'level', * FROM fun WHERE dl AND agent_level IS NOT NULL AND NOT la UNION ALL SELECT 'agent_only', * FROM fun WHERE ao)
        SELECT kind, seq, session_id, rule_tactic, agent_tactic, CAST(rule_level AS BIGINT) AS rule_level, CAST(agent_level AS BIGINT) AS agent_level FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq) <= 50""",
    "o066_cell_profiles": f"WITH {CELL} SELECT kind, rule, agent, count(*) AS n, count(*) FILTER (WHERE n_downloads > 0) AS has_download, count(*) FILTER (WHERE n_uploads > 0) AS has_upload, round(avg(duration_s), 4) AS avg_duration_s FROM cel SEMI JOIN kept USING (kind, rule, agent) GROUP BY ALL",
    "o067_cell_counters": f"""WITH {CELL}, d AS (SELECT kind, rule, agent, seq, unnest([struct_pack(dim := 'session_type', value := session_type), struct_pack(dim := 'command_bucket', value := CASE WHEN n_commands = 0 THEN '0' WHEN n_commands <= 5 THEN '1-5' WHEN n_commands <= 20 THEN '6-20' ELSE '21+' END),
            struct_pack(dim := 'agent_confidence', value := coalesce(CAST(agent_confidence AS VARCHAR), 'None')), struct_pack(dim := 'agent_sophistication', value := coalesce(agent_sophistication, 'None')), struct_pack(dim := 'rule_sophistication_score', value := CAST(sophistication_score AS VARCHAR)),
            struct_pack(dim := 'location', value := location), struct_pack(dim := 'auth_success', value := CASE WHEN auth_success THEN 'True' ELSE 'False' END)] || list_transform(heads, lambda h: struct_pack(dim := 'top_commands', value := h))) AS p FROM cel),
        n AS (SELECT kind, rule, agent, p.dim AS dim, p.value AS value, count(*) AS n, min(seq) AS first FROM d GROUP BY ALL)
        SELECT kind, rule, agent, dim, value, n FROM n QUALIFY dim <> 'top_commands' OR row_number() OVER (PARTITION BY kind, rule, agent, dim ORDER BY n DESC, first, value) <= 15""",
    "o068_cell_samples": f"WITH {CELL}, r AS (SELECT kind, rule, agent, seq, session_id FROM cel QUALIFY row_number() OVER (PARTITION BY kind, rule, agent ORDER BY seq) <= 10) SELECT kind, rule, agent, string_agg(session_id, ',' ORDER BY seq) AS session_ids FROM r GROUP BY kind, rule, agent",
    "o070_costs": f"""WITH {DUAL}, n AS (SELECT count(*) AS total_sessions, count(*) FILTER (WHERE is_anomaly) AS anomalous, count(*) FILTER (WHERE len(matched_patterns) > 0) AS with_patterns, count(*) FILTER (WHERE is_anomaly AND sent_to_hunter) AS sent_to_hunter, count(*) FILTER (WHERE is_anomaly AND hunter_verdict IS NULL AND sent_to_hunter) AS hunter_errored,
            count(*) FILTER (WHERE is_anomaly AND hunter_verdict = 'NOISE') AS hunter_noise, count(*) FILTER (WHERE is_anomaly AND hunter_verdict = 'RELEVANT') AS hunter_relevant, count(*) FILTER (WHERE is_anomaly AND hunter_verdict = 'RELEVANT' AND sent_to_analyst) AS sent_to_analyst,
            count(*) FILTER (WHERE is_anomaly AND hunter_verdict = 'RELEVANT' AND sent_to_analyst AND has_verdict AND {_NOVEL}) AS novel_findings, coalesce(sum(cost_usd) FILTER (WHERE is_anomaly), 0.0) AS total_cost_usd, coalesce(sum(cost_usd) FILTER (WHERE is_anomaly AND hunter_verdict = 'NOISE'), 0.0) AS hunter_only_cost_usd,
            coalesce(sum(cost_usd) FILTER (WHERE is_anomaly AND hunter_verdict = 'RELEVANT' AND sent_to_analyst), 0.0) AS analyst_cost_usd, CAST(coalesce(sum(latency_ms) FILTER (WHERE is_anomaly), 0) AS BIGINT) AS total_latency_ms FROM dual)
        SELECT *, round(anomalous / total_sessions, 6) AS anomaly_rate, total_sessions - with_patterns AS no_patterns, round(with_patterns / total_sessions, 6) AS pattern_rate, round(hunter_noise / (hunter_noise + hunter_relevant), 6) AS hunter_filter_rate, round(novel_findings / sent_to_analyst, 6) AS novel_finding_rate, round(total_cost_usd / anomalous, 6) AS avg_cost_per_anomalous_session,
            round(total_cost_usd / sent_to_hunter, 6) AS avg_cost_per_hunter_call, round(analyst_cost_usd / sent_to_analyst, 6) AS avg_cost_per_analyst_call, round(total_cost_usd / nullif(novel_findings, 0), 6) AS cost_per_novel_finding, total_cost_usd / nullif(novel_findings, 0) < 1.0 AS threshold_met, round(total_latency_ms / sent_to_hunter, 6) AS avg_latency_per_session_ms,
            round(total_cost_usd / anomalous * (anomalous / total_sessions) * 1e6, 6) AS cost_1m_sessions, round(total_latency_ms / sent_to_hunter * (anomalous / total_sessions) * 1e6 / 1000 / 3600, 6) AS time_1m_sessions_hours FROM n""",
    "o071_cost_percentiles": f"WITH {DUAL}, v AS (SELECT list_sort(list(cost_usd)) AS l FROM dual WHERE is_anomaly AND hunter_verdict = 'RELEVANT' AND cost_usd > 0) SELECT l[CAST(floor(len(l) * 0.25) AS INT) + 1] AS p25, l[CAST(floor(len(l) * 0.5) AS INT) + 1] AS p50, l[CAST(floor(len(l) * 0.75) AS INT) + 1] AS p75, l[CAST(floor(len(l) * 0.95) AS INT) + 1] AS p95, l[1] AS min, l[len(l)] AS max FROM v",
    "o073_overview": f"""WITH {LAB} SELECT 'session_type' AS section, session_type AS value, count(*) AS n FROM lab GROUP BY ALL UNION ALL SELECT 'level', CAST(level AS VARCHAR), count(*) FROM lab GROUP BY level UNION ALL SELECT 'total', 'with_download', count(*) FROM lab WHERE n_downloads > 0
        UNION ALL SELECT 'tactic', t, count(*) FROM (SELECT unnest(CASE WHEN lv IS NULL THEN [primary_tactic] ELSE tactics END) AS t FROM lab) GROUP BY t""",
    "o073_averages": f"WITH {SES} SELECT count(*) AS sessions, round(avg(duration_s), 4) AS avg_duration_s, round(avg(n_commands) FILTER (WHERE n_commands > 0), 6) AS avg_commands FROM ss",
    "o101_populations": f"""WITH {DUAL}, p AS (SELECT *, trim(coalesce(rule_tactic, '')) AS rt, trim(coalesce(agent_tactic, '')) AS ag FROM dual WHERE has_verdict), s AS (SELECT *, lower(rt) = lower(ag) AND rt <> '' AS same, coalesce(rule_level = agent_level, true) AS lev FROM p),
        b AS (SELECT 'novel' AS bucket, 'novel' AS bucket_key FROM s WHERE {_NOVEL} UNION ALL SELECT 'agreement', CASE WHEN rt IN ({", ".join(q(k) for k in _Q.agreement)}) THEN rt ELSE '_other' END FROM s WHERE same AND lev
            UNION ALL SELECT 'level_only', rt || '|L' || rule_level || '->L' || agent_level FROM s WHERE same AND NOT lev UNION ALL SELECT 'disagreement', CASE WHEN rt || ' -> ' || ag IN ({_PAIRS}) THEN rt || ' -> ' || ag WHEN rt = 'Discovery' THEN 'Discovery -> _other' ELSE '_other -> _other' END FROM s WHERE NOT same)
        SELECT bucket, bucket_key, count(*) AS n FROM b GROUP BY ALL""",
    "o074_majority_vote": f"WITH {TRUTH} SELECT * FROM tr",
    "o076_confusion_matrix": f"WITH {SCORED} SELECT bt AS pred, ht AS truth, count(*) AS n FROM sc GROUP BY ALL",
    "o077_class_report": f"WITH {REPORT} SELECT label, tp, predicted, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rp",
    "o077_overall_report": f"WITH {REPORT} SELECT (SELECT count(*) FROM sc WHERE bt <> '' OR ht <> '') AS n, (SELECT round(avg(CAST(bt = ht AS INT)), 6) FROM sc WHERE bt <> '' OR ht <> '') AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rp",
    "o078_errors": f"""WITH {SCORED} SELECT round(avg(abs(a_level - level)), 6) AS a_mae, round(avg(abs(b_level - level)), 6) AS b_mae, round(avg(CASE WHEN lower(aa) NOT IN ('', 'no action') AND coalesce(a_level <= 2, false) THEN 0 ELSE 1 END) FILTER (WHERE fn_risk), 6) AS a_fn_rate,
        round(avg(CASE WHEN lower(bt) NOT IN ('', 'no action') AND coalesce(b_level <= 2, false) THEN 0 ELSE 1 END) FILTER (WHERE fn_risk), 6) AS b_fn_rate FROM sc""",
    "o080_mcnemar": f"""WITH {SCORED}, d AS (SELECT count(*) FILTER (WHERE aa = ht AND bt <> ht) AS b, count(*) FILTER (WHERE aa <> ht AND bt = ht) AS c FROM sc),
        p AS (SELECT k, exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) AS p, b FROM (SELECT b, c, unnest(range(b + c + 1)) AS k FROM d))
        SELECT b, c, b + c AS n_discordant, CASE WHEN b + c = 0 THEN 1.0 ELSE (SELECT round(least(1.0, sum(p)), 6) FROM p WHERE p <= (SELECT p FROM p WHERE k = b) * (1 + 1e-9)) END AS p_value FROM d""",
    "o083_annotator_agreement": f"""WITH {VOTES}, w AS (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY seq) AS i FROM vo), pr AS (SELECT x.primary_tactic AS ta, y.primary_tactic AS tb, x.threat_level AS la, y.threat_level AS lb FROM w x JOIN w y ON x.annotation_id = y.annotation_id AND x.i = 1 AND y.i = 2),
        tp AS (SELECT ta, tb FROM pr WHERE ta IS NOT NULL AND tb IS NOT NULL), tpe AS (SELECT sum(a.n * b.n) AS s FROM (SELECT ta AS x, count(*) AS n FROM tp GROUP BY 1) a JOIN (SELECT tb AS x, count(*) AS n FROM tp GROUP BY 1) b USING (x)),
        lk AS (SELECT DISTINCT x FROM (SELECT la AS x FROM pr UNION SELECT lb FROM pr)), lr AS (SELECT x, row_number() OVER (ORDER BY x) AS r, greatest(1, count(*) OVER () - 1) AS k FROM lk),
        lp AS (SELECT p.r AS i, o.r AS j, p.k AS k FROM pr JOIN lr p ON p.x = la JOIN lr o ON o.x = lb), lpe AS (SELECT sum(a.n * b.n * (1 - abs(a.i - b.j) / a.k)) AS s FROM (SELECT i, any_value(k) AS k, count(*) AS n FROM lp GROUP BY i) a, (SELECT j, count(*) AS n FROM lp GROUP BY j) b),
        o AS (SELECT (SELECT avg(CAST(ta = tb AS INT)) FROM tp) AS tpo, (SELECT s / pow((SELECT count(*) FROM tp), 2) FROM tpe) AS tpe, (SELECT avg(1 - abs(i - j) / k) FROM lp) AS lpo, (SELECT s / pow((SELECT count(*) FROM lp), 2) FROM lpe) AS lpe)
        SELECT (SELECT count(*) FROM pr) AS n_overlap, round((tpo - tpe) / (1 - tpe), 6) AS tactic_kappa, round((lpo - lpe) / (1 - lpe), 6) AS level_weighted_kappa, (SELECT round(avg(CASE WHEN ta IS NOT DISTINCT FROM tb THEN 1 ELSE 0 END), 6) FROM pr) AS tactic_agreement, (SELECT round(avg(CASE WHEN la IS NOT DISTINCT FROM lb THEN 1 ELSE 0 END), 6) FROM pr) AS level_agreement FROM o""",
    "o085_novel_validation": f"""WITH {SCORED} SELECT count(*) AS n_novel_in_sample, count(*) FILTER (WHERE bt = ht) AS agent_tactic_matches_human, round(avg(CAST(bt = ht AS INT)), 6) AS agent_precision, count(*) FILTER (WHERE lower(ht) NOT IN ('', 'no action', 'unknown')) AS human_saw_real_threat,
        round(avg(CASE WHEN lower(ht) NOT IN ('', 'no action', 'unknown') THEN 1 ELSE 0 END), 6) AS human_real_threat_rate FROM sc WHERE bucket = 'novel'""",
}
