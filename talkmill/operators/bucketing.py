"""Partitioning of lines by key: hash shards, keyed fan-out, grouped callbacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SHARDS = 256


@dataclass(frozen=True)
class RouteStats:
    routed: int
    without_key: int


def shard(key: Column, shards: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)).cast("int")


def partition_by_key(lines: DataFrame, key: Column, shards: int, out: str, seed: int = 0) -> RouteStats:
    """Lines (value) as text under out/shard=N; lines without a key are left out and counted. A second call with another seed re-hashes."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be 1 to {MAX_SHARDS}")
    keyed = lines.select("value", key.alias("__k"))
    # a shard is written by several tasks: rows of one hot key don't have to pass one task
    n = keyed.agg(F.count("__k").alias("y"), F.count_if(F.col("__k").isNull()).alias("n")).first()
    keyed.where("__k is not null").select("value", shard(F.col("__k"), shards, seed).alias("shard")).write.partitionBy("shard").mode("error").text(out)
    return RouteStats(n.y, n.n)


def for_each_group(lines: DataFrame, key: Column, fn: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn(key, frame of the group's rows) for each key, every group whole. Groups must fit a worker; see keep_first and aggregates otherwise."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(k[0], pdf.drop(columns="__k"))

    return lines.withColumn("__k", key).where("__k is not null").groupBy("__k").applyInPandas(run, schema)


def write_parts(lines: DataFrame, key: Column, parts: int, folder: str, stem: str) -> list[str]:
    """<stem>_part_NNNNNN.ndjson for each part, empty ones too. Parts are streamed by executors to a staging folder and published together."""
    import shutil

    staging = f"{folder}/_staging_{stem}"
    shutil.rmtree(staging, ignore_errors=True)
    lines.select("value", F.when(key.isNotNull(), shard(key, parts)).alias("p")).where("p is not null").repartition(parts, "p").write.partitionBy("p").text(staging)
    out = []
    try:
        for k in range(parts):
            at = Path(folder) / f"{stem}_part_{k:06d}.ndjson"
            tmp = at.with_suffix(".inprogress")
            with tmp.open("wb") as f:
                for part in sorted(Path(staging, f"p={k}").glob("part-*")) if Path(staging, f"p={k}").exists() else []:
                    with part.open("rb") as g:
                        shutil.copyfileobj(g, f, 1 << 20)
            out.append(str(at))
        for x in out:
            Path(x).with_suffix(".inprogress").rename(x)
    except BaseException:
        for x in out:
            Path(x).with_suffix(".inprogress").unlink(missing_ok=True)
        raise
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return out
