"""Address ranges with places, from the two forms in which city databases are published: CSV and MaxMind DB."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = "low string, high string, continent_code string, country_name string, country_iso string, region_name string, city_name string, longitude double, latitude double, timezone string, accuracy_radius int"
_TEXT = ("continent_code", "country_name", "country_iso", "region_name", "city_name", "timezone")
_MARK = b"\xab\xcd\xefMaxMind.com"
_ROWS = 20_000


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_geo(spark: SparkSession, path: str | None, locations: str | None = None) -> DataFrame | None:
    """Ranges of a ``.mmdb`` file, or of CSV blocks with their ``locations``; None, as without a database, where there is no such file."""
    if not path or not exists(spark, path) or (locations and not exists(spark, locations)):
        return None
    return read_csv(spark, path, locations) if locations else read_mmdb(spark, path)


def read_csv(spark: SparkSession, blocks: str, locations: str) -> DataFrame:
    """Blocks (network as CIDR, geoname_id, latitude, longitude, accuracy_radius) joined with locations (names, codes, time zone); IPv4 only."""
    kinds = "network string, geoname_id string, latitude double, longitude double, accuracy_radius int"
    b = spark.read.option("header", True).csv(blocks)
    b = b.select(*[F.col(n).try_cast(t).alias(n) for n, t in (k.split() for k in kinds.split(", "))])
    names = {"continent_code": "continent_code", "country_name": "country_name", "country_iso_code": "country_iso", "subdivision_1_name": "region_name", "city_name": "city_name", "time_zone": "timezone"}
    where = spark.read.option("header", True).csv(locations).select("geoname_id", *[F.col(k).alias(v) for k, v in names.items()])
    parts = F.split(F.split_part("network", F.lit("/"), F.lit(1)), r"\.")
    number = sum((parts[i].try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), parts[0].try_cast("long") * 256**3)
    size = F.expr("shiftleft(1L, 32 - try_cast(split_part(network, '/', 2) as int))")
    dotted = lambda n: F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255).cast("long")) for k in (24, 16, 8, 0)])
    rows = b.where(~F.col("network").contains(":")).withColumn("n", number).withColumn("size", size).where("n is not null and size is not null")
    rows = rows.join(where, "geoname_id", "left")
    return rows.select(dotted(F.col("n")).alias("low"), dotted(F.col("n") + F.col("size") - 1).alias("high"), *_filled())


def _filled() -> list:
    kinds = {"longitude": ("double", 0.0), "latitude": ("double", 0.0), "accuracy_radius": ("int", 0)}
    names = [x.split()[0] for x in RANGES.split(", ")][2:]
    return [F.coalesce(F.col(n), F.lit(kinds.get(n, ("string", ""))[1])).cast(kinds.get(n, ("string", ""))[0]).alias(n) for n in names]


class _Database:
    """A MaxMind DB: a binary tree over address bits, whose leaves point into a section of typed values."""

    def __init__(self, data: bytes):
        self.data = data
        self.start = data.rfind(_MARK) + len(_MARK)
        if self.start < len(_MARK):
            raise ValueError("no MaxMind DB")
        self.base = self.start
        meta = self.value(0)[0]
        self.nodes, self.bits, self.version = meta["node_count"], meta["record_size"], meta["ip_version"]
        self.width = self.bits // 4
        self.base = self.nodes * self.width + 16
        self.known: dict[int, Any] = {}

    def child(self, node: int, side: int) -> int:
        at = node * self.width
        if self.bits == 28:
            raw = self.data[at : at + 7]
            high = raw[3] >> 4 if side == 0 else raw[3] & 15
            return high << 24 | int.from_bytes(raw[:3] if side == 0 else raw[4:], "big")
        size = self.bits // 8
        return int.from_bytes(self.data[at + side * size : at + (side + 1) * size], "big")

    def value(self, at: int) -> tuple[Any, int]:
        """The value at an offset of the data section, and the offset past it."""
        p = self.base + at
        control = self.data[p]
        p += 1
        kind = control >> 5
        if kind == 1:
            size, low = (control >> 3 & 3) + 1, control & 7
            raw = int.from_bytes(self.data[p : p + size], "big")
            to = raw if size == 4 else (low << 8 * size | raw) + (0, 0, 2048, 526336)[size]
            return self.value(to)[0], p + size - self.base
        if kind == 0:
            kind = self.data[p] + 7
            p += 1
        size = control & 31
        if size > 28:
            extra = size - 28
            size = (29, 285, 65821)[extra - 1] + int.from_bytes(self.data[p : p + extra], "big")
            p += extra
        if kind in (7, 11):
            out, at = ({} if kind == 7 else []), p - self.base
            for _ in range(size):
                if kind == 7:
                    key, at = self.value(at)
                    out[key], at = self.value(at)
                else:
                    item, at = self.value(at)
                    out.append(item)
            return out, at
        raw = self.data[p : p + size]
        if kind == 14:
            return bool(size), p - self.base
        made = {2: lambda: raw.decode(), 3: lambda: struct.unpack(">d", raw)[0], 4: lambda: raw, 8: lambda: int.from_bytes(raw, "big", signed=True), 15: lambda: struct.unpack(">f", raw)[0]}
        return made.get(kind, lambda: int.from_bytes(raw, "big"))(), p + size - self.base

    def ranges(self) -> Iterator[tuple]:
        """(first address, last, value) of the IPv4 leaves that have a value."""
        node = 0
        for _ in range(96 if self.version == 6 else 0):
            if node < self.nodes:
                node = self.child(node, 0)
        open_ = [(node, 0, 32)]
        while open_:
            node, low, left = open_.pop()
            if node < self.nodes and left:
                open_ += [(self.child(node, 1), low | 1 << left - 1, left - 1), (self.child(node, 0), low, left - 1)]
            elif node > self.nodes:
                if node not in self.known:
                    self.known[node] = _place(self.value(node - self.nodes - 16)[0])
                yield low, low + (1 << left) - 1, self.known[node]


def _place(v: dict) -> tuple:
    name = lambda x: (x or {}).get("names", {}).get("en", "")
    country, at = v.get("country") or {}, v.get("location") or {}
    region = (v.get("subdivisions") or [{}])[0]
    return ((v.get("continent") or {}).get("code", ""), name(country), country.get("iso_code", ""), name(region), name(v.get("city")), float(at.get("longitude", 0.0)), float(at.get("latitude", 0.0)), at.get("time_zone", ""), int(at.get("accuracy_radius", 0)))


def read_mmdb(spark: SparkSession, path: str) -> DataFrame:
    """The IPv4 ranges of a city database, walked by one task and passed on in batches."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = [x.split()[0] for x in RANGES.split(", ")], []
        dotted = lambda n: ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
        for b in batches:
            for content in b["content"]:
                for low, high, place in _Database(bytes(content)).ranges():
                    rows.append((dotted(low), dotted(high), *place))
                    if len(rows) == _ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(walk, RANGES)
