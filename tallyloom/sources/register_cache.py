"""Normalised registers kept as Parquet, by what they were made from.

The key is a digest of the source files (path, size, time of change) and of the mapping, so a file that changed or was mapped
anew never meets an old register. One process builds a register at a time, others wait for it; the least recently used go when
all together exceed a number of bytes. Unlike a cached block, a kept register outlives its session and its executors.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import at_path, exists, ranked_by_use, remove

MOST_BYTES = 10 * 2**40
#: Seconds after which a lock is taken from a builder that has died; between looks at a lock.
STALE, WAIT = 3600, 0.1
_LOCKS: dict[str, threading.Lock] = {}
_GUARD = threading.Lock()


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, length, modificationTime) -> one row: files, bytes and two digests that don't depend on their order."""
    each = [F.xxhash64(F.lit(k), "path", "length", F.unix_micros("modificationTime")) for k in (1, 2)]
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), *[F.coalesce(F.bit_xor(x), F.lit(0)).alias(f"digest_{i}") for i, x in enumerate(each)])


def cache_key(spark: SparkSession, paths: list[str], mapping: dict[str, str] | None) -> str:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    made_from = [list(fingerprint(listed).first()), json.dumps(mapping, sort_keys=True) if mapping else "auto"]
    return hashlib.sha256(json.dumps(made_from).encode()).hexdigest()[:32]


def _lock_of(key: str) -> threading.Lock:
    with _GUARD:
        return _LOCKS.setdefault(key, threading.Lock())


@contextmanager
def building(spark: SparkSession, path: str):
    """One builder at a time, in this process and, by a file that only one can create, in all others."""
    with _lock_of(path):
        fs, p = at_path(spark, path)
        while True:
            try:
                fs.create(p, False).close()
                break
            except Exception:
                if not fs.exists(p):
                    continue
                if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE:
                    fs.delete(p, False)
                time.sleep(WAIT)
        try:
            yield
        finally:
            fs.delete(p, False)


def _use(spark: SparkSession, folder: str) -> None:
    fs, p = at_path(spark, f"{folder}/_used")
    fs.create(p, True).close()


def cached(spark: SparkSession, root: str, paths: list[str], mapping: dict[str, str] | None, build: Callable[[], DataFrame], most_bytes: int = MOST_BYTES) -> DataFrame:
    """The register that build() makes of the files, from the cache if it is there. build runs once for a key, whoever asks at the same time."""
    folder = f"{root}/registers/{cache_key(spark, paths, mapping)}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        at_path(spark, root)[0].mkdirs(at_path(spark, f"{root}/registers")[1])
        with building(spark, f"{folder}.lock"):
            if not exists(spark, f"{folder}/_SUCCESS"):
                half = f"{folder}.{uuid.uuid4().hex}"
                build().write.parquet(half)
                fs, p = at_path(spark, half)
                fs.rename(p, at_path(spark, folder)[1])
                _use(spark, folder)
                evict(spark, root, most_bytes)
    _use(spark, folder)
    return spark.read.parquet(folder)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(folder, bytes, used) of the registers that are there. A row for each comes to the driver."""
    fs, p = at_path(spark, f"{root}/registers")
    rows = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        used = at_path(spark, f"{s.getPath()}/_used")[1]
        if fs.exists(used):
            rows.append((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), fs.getFileStatus(used).getModificationTime()))
    return spark.createDataFrame(rows, "folder string, bytes long, used long")


def evict(spark: SparkSession, root: str, most_bytes: int) -> list[str]:
    """Remove the least recently used registers beyond most_bytes."""
    gone = [r["folder"] for r in ranked_by_use(entries(spark, root), most_bytes).filter("not stays").collect()]
    for f in gone:
        remove(spark, f"{root}/registers/{f}")
    return gone


def invalidate(spark: SparkSession, root: str, paths: list[str], mapping: dict[str, str] | None) -> None:
    """Forget the register of these files and this mapping."""
    remove(spark, f"{root}/registers/{cache_key(spark, paths, mapping)}")
