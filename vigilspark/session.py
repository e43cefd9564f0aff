"""A Spark session with the settings that the engine expects, and settings of its own from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def load_env(path: str = ".env") -> dict[str, str]:
    """Put KEY=value lines of a file into the environment, which wins where it has the key; comments and other lines are skipped. Returns what was set."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path) as f:
            for line in map(str.strip, f):
                key, sep, value = (x.strip() for x in line.partition("="))
                if sep and key and not line.startswith("#") and key not in os.environ:
                    os.environ[key] = found[key] = value
    return found


@dataclass
class Settings:
    data_dir: str = field(default_factory=lambda: os.environ.get("DATA_DIR", "data"))
    locations: list[str] = field(default_factory=lambda: parse_locations(os.environ.get("LOCATIONS", "all")))
    index_prefix: str = field(default_factory=lambda: os.environ.get("INDEX_PREFIX", "sessions"))
    geo_path: str = field(default_factory=lambda: os.environ.get("GEO_PATH", ""))

    def path_of(self, location: str) -> str:
        return f"{self.data_dir.rstrip('/')}/{location}"

    def table_name(self, suffix: str = "") -> str:
        return f"{self.index_prefix}-{suffix}" if suffix else self.index_prefix


#: Sensors of 'all'.
CITIES = ("amsterdam", "bangalore", "london", "ny", "singapore", "toronto")


def parse_locations(text: str) -> list[str]:
    return [f"ssh-{c}" for c in CITIES] if text.strip().lower() == "all" else [x.strip() for x in text.split(",") if x.strip()]


def make_session(master: str | None = None, name: str = "vigilspark", **conf: str) -> SparkSession:
    """UTC, AQE with skew joins, and Arrow; a cluster's own settings win where they are given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true", "spark.speculation": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return b.config(map={**base, **conf}).getOrCreate()
