"""Recorded payloads: a table of ``key, body, fetched_at`` read through freshness rules."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key binary, body binary, fetched_at timestamp"
#: How long each class of response may be used; the others do not age.
MAX_AGE = {"dbroot": "1 day", "capabilities": "7 days", "tilemap": "30 days", "metadata": "1 day"}


def latest(payloads: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of every key: what an upsert by key would have left."""
    rest = [c for c in payloads.columns if c != "key"]
    order = F.struct("fetched_at", *ties) if ties else F.col("fetched_at")
    return payloads.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("key", "r.*")


def fresh(payloads: DataFrame, max_age: str | None, now: str | Column | None = None) -> DataFrame:
    """Rows no older than ``max_age``; with None all of them."""
    if max_age is None:
        return payloads
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return payloads.where(F.col("fetched_at") >= now.cast("timestamp") - F.expr(f"interval {max_age}"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A payload table; ``append`` adds to it and ``latest`` resolves repeats."""
    return spark.read.schema(SCHEMA).parquet(path)


def append(payloads: DataFrame, path: str) -> None:
    payloads.select("key", "body", "fetched_at").write.mode("append").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of response files, named by the hexadecimal of their key."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)
    return files.where(name != "").select(F.unhex(name).alias("key"), F.col("content").alias("body"), F.col("modificationTime").alias("fetched_at"))


def default_folder(env: dict[str, str] | None = None) -> Path:
    """Where payloads are kept unless a path is given: an override, else the user's cache folder."""
    env = dict(os.environ) if env is None else env
    own = env.get("TERRACHRON_CACHE_DIR")
    if own:
        return Path(own).expanduser()
    base = env.get("XDG_CACHE_HOME")
    return (Path(base) if base else Path.home() / ".cache") / "terrachron"


def attach(rows: DataFrame, payloads: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with the ``body`` stored for each one's key, null where there is none."""
    return rows.join(payloads.select(F.col("key").alias("k__"), "body"), F.col(key) == F.col("k__"), "left").drop("k__")


def keys_to_fetch(rows: DataFrame, payloads: DataFrame, key: str = "key") -> DataFrame:
    """``key``: the distinct keys of ``rows`` that no payload is stored for, so that each is asked for once."""
    wanted = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
    return wanted.join(payloads.select("key"), "key", "left_anti")


def kind_of_store(name: str | None = None, env: dict[str, str] | None = None) -> str:
    """How payloads are kept: ``table`` or ``file``, as named or by the environment; anything else is refused."""
    env = dict(os.environ) if env is None else env
    chosen = (name or env.get("TERRACHRON_CACHE_KIND") or "table").lower()
    if chosen not in ("table", "file"):
        raise ValueError(f"payloads are kept as a table or as files, not {chosen!r}")
    return chosen
