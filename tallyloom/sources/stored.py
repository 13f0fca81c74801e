"""Tables that jobs write for themselves, and a catalogue of the datasets in a folder.

Everything lies below one folder that the driver and all executors share. The catalogue is a log of Parquet files to which
every change appends a row; the latest row of a dataset holds. A record is made before a dataset is written, so whatever a
failed run leaves is either in the catalogue with an expiry, or in no catalogue at all: sweep() finds both.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fields import QueryError

#: Used where a session on one machine names no folder in spark.checkpoint.dir, as in tests.
DEFAULT_SHARED_DIR = "file:///tmp/tallyloom-stored"
#: Minutes that a dataset stays, if nothing else is said.
LIFETIME = 120
CATALOGUE = "_catalogue"
LOG = "dataset string, owner string, folder string, kind string, at timestamp, until timestamp, dropped boolean"
_ID = re.compile(r"[0-9a-f]{32}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A cluster has to name it: no machine's own folder will do."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return (named or DEFAULT_SHARED_DIR).rstrip("/")


def at_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so any store that Spark reads will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = at_path(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read again: it is computed once, and a lost executor costs no more than a reread."""
    path = f"{shared_dir(df.sparkSession)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- the catalogue


def _append(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    """Each change has a folder of its own: two commits into one folder would remove each other's files."""
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{root}/{CATALOGUE}/{uuid.uuid4().hex}")


def log(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/{CATALOGUE}"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{root}/{CATALOGUE}")


def current(entries: DataFrame) -> DataFrame:
    """The latest entry of each dataset; those that were dropped are left out."""
    last = entries.groupBy("dataset").agg(F.max_by(F.struct("owner", "folder", "kind", "at", "until", "dropped"), F.struct("at", F.coalesce("dropped", F.lit(False)))).alias("e"))
    return last.select("dataset", "e.*").filter(~F.coalesce("dropped", F.lit(False))).drop("dropped")


def add_dataset(df: DataFrame, root: str, owner: str, kind: str = "register", minutes: int = LIFETIME, now: datetime | None = None) -> str:
    """Write df as a dataset of `owner` and return its id. The record comes first: a run that fails half-way leaves a known folder."""
    dataset, now = uuid.uuid4().hex, now or datetime.now()
    folder = f"{kind}-{dataset}"
    _append(df.sparkSession, root, [(dataset, owner, folder, kind, now, now + timedelta(minutes=minutes), False)])
    df.write.parquet(f"{root}/{folder}")
    return dataset


def dataset(spark: SparkSession, root: str, name: str, owner: str) -> DataFrame:
    """A dataset, for its owner alone. An id of another form, an unknown one and another owner's are the same error."""
    found = current(log(spark, root)).filter((F.col("dataset") == name) & (F.col("owner") == owner)).first() if _ID.fullmatch(name) else None
    if found is None or not exists(spark, f"{root}/{found['folder']}/_SUCCESS"):
        raise QueryError("no such dataset")
    return spark.read.parquet(f"{root}/{found['folder']}")


def drop_dataset(spark: SparkSession, root: str, name: str, owner: str) -> None:
    found = current(log(spark, root)).filter((F.col("dataset") == name) & (F.col("owner") == owner)).first()
    if found is None:
        raise QueryError("no such dataset")
    remove(spark, f"{root}/{found['folder']}")
    _append(spark, root, [(name, owner, found["folder"], found["kind"], datetime.now(), None, True)])


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder, bytes, modified) of what lies right below root, but the catalogue. A row for each comes to the driver; no file is read."""
    fs, p = at_path(spark, root)
    rows = []
    if fs.exists(p):
        for s in fs.listStatus(p):
            if s.getPath().getName() != CATALOGUE:
                rows.append((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), datetime.fromtimestamp(s.getModificationTime() / 1000)))
    return spark.createDataFrame(rows, "folder string, bytes long, modified timestamp")


def judged(catalogue: DataFrame, there: DataFrame, now, lifetime_minutes: int = LIFETIME) -> DataFrame:
    """(folder, dataset, bytes, state): kept, expired (its time is over), orphan (in no catalogue and as old as a lifetime), fresh (in none, but young: it may be being written), missing.

    A dataset whose expiry is null stays for good.
    """
    now = F.lit(now).cast("timestamp")
    c = catalogue.select(F.col("folder").alias("c_folder"), "dataset", "until")
    j = there.join(c, F.col("folder") == F.col("c_folder"), "full_outer")
    old = F.col("modified") <= now - F.make_interval(mins=F.lit(lifetime_minutes))
    state = F.when(F.col("folder").isNull(), "missing").when(F.col("c_folder").isNull(), F.when(old, "orphan").otherwise("fresh")).when(F.col("until") <= now, "expired").otherwise("kept")
    return j.select(F.coalesce("folder", "c_folder").alias("folder"), "dataset", "bytes", state.alias("state"))


def sweep(spark: SparkSession, root: str, now: datetime | None = None, lifetime_minutes: int = LIFETIME) -> DataFrame:
    """Remove expired datasets and orphans, note them as dropped, and return what was judged."""
    now = now or datetime.now()
    entries = current(log(spark, root))
    rows = judged(entries, folders(spark, root), now, lifetime_minutes).collect()
    gone = [r for r in rows if r["state"] in ("expired", "orphan")]
    for r in gone:
        remove(spark, f"{root}/{r['folder']}")
    noted = [(r["dataset"], None, r["folder"], None, now, None, True) for r in rows if r["state"] in ("expired", "missing") and r["dataset"]]
    if noted:
        _append(spark, root, noted)
    return spark.createDataFrame(rows, "folder string, dataset string, bytes long, state string")


def compact(spark: SparkSession, root: str) -> int:
    """Rewrite the log to one row a live dataset and return how many there are. Older changes go once the new one is there; readers meanwhile see both, which says the same."""
    fs, p = at_path(spark, f"{root}/{CATALOGUE}")
    if not fs.exists(p):
        return 0
    before = [s.getPath() for s in fs.listStatus(p) if fs.exists(at_path(spark, f"{s.getPath()}/_SUCCESS")[1])]
    live = current(log(spark, root)).withColumn("dropped", F.lit(False)).select("dataset", "owner", "folder", "kind", "at", "until", "dropped").collect()
    _append(spark, root, [tuple(r) for r in live])
    for path in before:
        fs.delete(path, True)
    return len(live)


def ranked_by_use(entries: DataFrame, most_bytes: int) -> DataFrame:
    """(folder, bytes, used) -> + stays: the most recently used that fit into most_bytes together; the latest always does."""
    w = Window.orderBy(F.desc("used"), "folder")  # a row a dataset
    total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("stays", (total <= most_bytes) | (F.row_number().over(w) == 1))
