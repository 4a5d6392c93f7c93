"""Stores of others that a configuration names, read and never written."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .model import Store

VERSION = 1


@dataclass(frozen=True)
class Peer:
    """A store in a folder; ``reachable``: whether the folder is there."""

    name: str
    path: str
    reachable: bool


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_peers(spark: SparkSession, path: str) -> list[Peer]:
    """The peers of a JSON file: ``{"version": 1, "deps": [{"name", "path"}]}``; a path that isn't absolute counts from the file's folder. No file means no peers; what
    can't be read as such a list is an error, as the user wrote it."""
    if not _there(spark, path):
        return []
    (row,) = spark.read.text(path, wholetext=True).collect()
    try:
        data = json.loads(row.value)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: invalid JSON ({e.msg})") from e
    if not isinstance(data, dict) or data.get("version") != VERSION:
        raise ValueError(f"{path}: an object of version {VERSION} is expected")
    deps = data.get("deps") or []
    if not isinstance(deps, list):
        raise ValueError(f"{path}: 'deps' must be a list")
    out: dict[str, Peer] = {}
    for entry in deps:
        name, where = (entry.get(k) if isinstance(entry, dict) else None for k in ("name", "path"))
        if not all(isinstance(x, str) and x for x in (name, where)):
            raise ValueError(f"{path}: each of 'deps' needs a name and a path")
        if name in out:
            raise ValueError(f"{path}: {name!r} stands twice")
        full = where if "://" in where or where.startswith("/") else f"{path.rpartition('/')[0]}/{where}"
        out[name] = Peer(name, full, _there(spark, full))
    return list(out.values())


def open_peer(spark: SparkSession, peer: Peer) -> Store:
    """The tables in a peer's folder, one Parquet folder each."""
    if not peer.reachable:
        raise ValueError(f"the store of {peer.name!r} isn't there: {peer.path}")

    def make(name: str) -> DataFrame:
        return spark.read.parquet(f"{peer.path}/{name}")

    return Store(make, peer.path)
