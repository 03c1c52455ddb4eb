"""A table with a log of changes beside it: every mutation is one commit, the present state is a view.

The base is any table. Changes are rows of the same columns with an operation and a version. A commit writes its rows to a
folder of their own and then puts the file of its version, which names that folder and is only put where no such file is:
of two writers that start from one version, one puts it, and the other starts anew from the state the first has left. So
rows that are read and changed are never changed twice, a deletion and its tombstone become visible together, and a store
that is opened again goes on from the last commit. The state of a key is its last change, else its base row. `compact`
writes the state as a new base.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OP, VERSION = "_op", "_version"


class Conflict(RuntimeError):
    """The store has moved on from the version that a change was asked for."""


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sparquill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint usable: where the session names no folder the shared one is set."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to a table of their own in the shared folder and read back.

    Cuts the lineage as a checkpoint does. The plan starts anew: sizes are known, so that small sides of joins are broadcast,
    and loops don't gather the constraints of earlier rounds, with which plans grow by the round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove the shuffle files of plans that nothing refers to; a trivial plan takes the last one's place first."""
    spark.range(1).count()
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` wrote and that nothing still to come reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


class Folder:
    """The few file operations that a log needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path
        self.files = self.at("").getFileSystem(conf)
        self.local = self.files.getScheme() == "file"

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.at(""))] if self.files.exists(self.at("")) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether the file is new; a file that is there stays as it is."""
        self.files.mkdirs(self.at(""))
        if self.local:
            # a link appears whole or not at all, and not twice
            root = self.at("").toUri().getPath()
            made = f"{root}/.{name}-{uuid.uuid4().hex}"
            with open(made, "w") as f:
                f.write(text)
            try:
                os.link(made, f"{root}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
        try:
            stream = self.files.create(self.at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        stream.write(text.encode())
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


class Store:
    """key: the columns that identify a row. kind: what tombstones of this table are filed under. path: where the log is or
    will be; a store opened on a path with commits has their state. at: the version a change is meant for, where the caller
    has read one; if the store is at another, the change is refused with Conflict."""

    TRIES = 10

    def __init__(self, base: DataFrame, key: Sequence[str], kind: str = "row", path: str | None = None):
        self.spark, self.base, self.key, self.kind = base.sparkSession, base, list(key), kind
        self.path = path or f"{shared_folder(self.spark)}/store-{uuid.uuid4().hex}"
        self.commits = Folder(self.spark, f"{self.path}/commits")
        self.known: dict[int, str] = {}
        self.schema = T.StructType([*base.schema.fields, T.StructField(OP, T.StringType()), T.StructField(VERSION, T.LongType())])

    @property
    def version(self) -> int:
        """The last commit, 0 where there is none."""
        return max((int(n) for n in self.commits.names() if n.isdigit()), default=0)

    def rows_of(self, version: int) -> str:
        while not self.known.get(version):
            self.known[version] = self.commits.read(f"{version:012d}")
            if not self.known[version]:
                time.sleep(0.05)  # its writer is about to name the rows
        return f"{self.path}/rows/{self.known[version]}"

    def _write(self, version: int, parts: list[tuple[DataFrame, str]]) -> str:
        rows = None
        for df, op in parts:
            part = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(self.base.schema[c].dataType).alias(c) for c in self.base.columns], F.lit(op).alias(OP), F.lit(version).cast("bigint").alias(VERSION))
            rows = part if rows is None else rows.unionByName(part)
        name = f"{version:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/rows/{name}")
        return name

    def commit(self, changes: Callable[[int], list[tuple[DataFrame, str]]], at: int | None = None) -> int:
        """Commit what `changes` makes of a version's state, again from the newer one where another commit came first; the new version."""
        for _ in range(self.TRIES):
            before = self.version
            if at is not None and at != before:
                break
            name = self._write(before + 1, changes(before))
            if self.commits.put_if_absent(f"{before + 1:012d}", name):
                self.known[before + 1] = name
                return before + 1
            Folder(self.spark, f"{self.path}/rows").delete(name)
            if at is not None:
                break
        raise Conflict(f"{self.path} is at version {self.version}")

    def changed(self, version: int) -> DataFrame:
        """The rows of one commit."""
        return self.spark.read.schema(self.schema).parquet(self.rows_of(version))

    def log(self, version: int | None = None) -> DataFrame:
        upto = self.version if version is None else version
        if not upto:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.rows_of(v) for v in range(1, upto + 1)])

    def current(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """Base rows that no change names, and the last change of every key that isn't a deletion; within a commit puts win.

        where: a condition on the state; it reaches the scan of the base.
        """
        log = self.log(version)
        last = log.groupBy(*self.key).agg(F.max_by(F.struct(*self.base.columns, OP), F.struct(VERSION, (F.col(OP) == "put").cast("int"))).alias("r"))
        last = last.where(f"r.{OP} = 'put'").select("r.*").select(*self.base.columns)
        base = self.base if where is None else self.base.where(where)
        # keys are compared null-safely by the aggregate, and here as well
        named = log.select(*[F.col(k).alias(f"_{k}") for k in self.key]).distinct()
        untouched = base.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key], "left_anti")
        return untouched.unionByName(last if where is None else last.where(where))

    def tombstones(self) -> DataFrame:
        """kind, keys and version of every deletion that left a tombstone, the newest for each key."""
        return self.log().where(F.col(OP) == "bury").groupBy(*self.key).agg(F.max(VERSION).alias("version")).withColumn("kind", F.lit(self.kind))

    def put(self, rows: DataFrame, at: int | None = None) -> int:
        """Insert or overwrite by key; keys of the rows are distinct."""
        return self.commit(lambda _: [(rows, "put")], at)

    def insert(self, rows: DataFrame, at: int | None = None) -> int:
        """Only rows whose key is new."""
        return self.commit(lambda v: [(rows.join(self.current(v).select(*self.key), self.key, "left_anti"), "put")], at)

    def update(self, where: Column, at: int | None = None, **values: Column) -> int:
        """Set columns of the rows that satisfy the predicate; returns how many there were."""
        to = lambda c: values.get(c, F.col(c)).cast(self.base.schema[c].dataType).alias(c)
        done = self.commit(lambda v: [(self.current(v, F.coalesce(where, F.lit(False))).select(*map(to, self.base.columns)), "put")], at)
        return self.changed(done).count()

    def claim(self, wanted: DataFrame, free: Column, order: Sequence[str], **values: Column) -> int:
        """Give every free row that is asked for to the first who asks; returns how many were given.

        wanted: the key and what `values` and `order` name. A row that someone else has taken meanwhile is free no longer.
        """

        def changes(v: int) -> list[tuple[DataFrame, str]]:
            first = wanted.groupBy(*self.key).agg(F.min(F.struct(*order, *[c for c in wanted.columns if c not in self.key and c not in order])).alias("_w"))
            open_rows = self.current(v, F.coalesce(free, F.lit(False))).join(first, self.key).select(*self.base.columns, "_w.*")
            return [(open_rows.select(*[values.get(c, F.col(c)).cast(self.base.schema[c].dataType).alias(c) for c in self.base.columns]), "put")]

        return self.changed(self.commit(changes)).count()

    def delete(self, where: Column, tombstone: bool = False, at: int | None = None) -> int:
        """Delete the rows that satisfy the predicate, with tombstones in the same commit if asked; returns how many there were."""
        done = self.commit(lambda v: [(self.current(v, F.coalesce(where, F.lit(False))), "bury" if tombstone else "drop")], at)
        return self.changed(done).count()

    def replace(self, where: Column, rows: DataFrame, at: int | None = None) -> int:
        """Rows that satisfy the predicate go and the new ones come, in one commit."""
        return self.commit(lambda v: [(self.current(v, F.coalesce(where, F.lit(False))), "drop"), (rows, "put")], at)

    def clear(self) -> int:
        return self.delete(F.lit(True))

    def compact(self, path: str) -> Store:
        """The state as the base of a new store with an empty log."""
        self.current().write.parquet(path)
        return Store(self.spark.read.parquet(path), self.key, self.kind)
