"""A store of batches that readers only see whole: staged data, commit markers, ids over all of it.

    store/data/token=<batch>-<attempt>/   rows of one attempt, written once
    store/parts/token=<batch>-<attempt>/  rows written by each task, which number the rows
    store/commits/<version>               which attempt counts, and the ids it got

A marker is complete when it appears and appears under a version only once, as in Spark's
own checkpoint logs. Of two writers the later one finds its version taken and appends
anew to what the other has stored; a repeated batch finds itself committed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.operators.dedupe import append_new, first_by_hash

#: ``monotonically_increasing_id`` counts a task's rows in its lower bits.
ROW_BITS = 33
COMMIT = "batch string, token string, n_rows bigint, first_id bigint, last_id bigint"
ATTEMPTS = 20


@dataclass(frozen=True)
class Commit:
    """What a batch added; ``last_id`` is that of the store after it."""

    batch: str
    token: str
    n_rows: int
    first_id: int
    last_id: int


class Folder:
    """Names and small files of a folder that the session's file systems reach; used on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.at(path)
        self.system = self.root.getFileSystem(self.conf)

    def at(self, *parts: str):
        path = self.jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            path = self.jvm.org.apache.hadoop.fs.Path(path, part)
        return path

    def names(self, *parts: str) -> list[str]:
        path = self.at(self.root.toString(), *parts)
        if not self.system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(path))

    def rename(self, source: str, target: str) -> bool:
        """Move a file or folder to a name that is free; whether it was."""
        old, new = self.at(source), self.at(target)
        if not self.system.exists(new.getParent()):
            self.system.mkdirs(new.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.conf)
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.system.makeQualified(old), self.system.makeQualified(new), options)
        except Py4JJavaError as failure:
            if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
                return False
            raise
        return True

    def put(self, text: str, *parts: str) -> bool:
        """Write a file under a name that is free; whether it was. Nobody sees a part of it."""
        draft = self.at(self.root.toString(), f"_draft-{uuid.uuid4().hex}")
        out = self.system.create(draft)
        out.write(text.encode())
        out.close()
        done = self.rename(draft.toString(), self.at(self.root.toString(), *parts).toString())
        if not done:
            self.system.delete(draft, False)
        return done

    def get(self, *parts: str) -> str:
        stream = self.system.open(self.at(self.root.toString(), *parts))
        try:
            size = self.system.getFileStatus(self.at(self.root.toString(), *parts)).getLen()
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()


def _version(n: int) -> str:
    return f"{n:020d}"


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per committed batch, or None before the first."""
    if not Folder(spark, path).names("commits"):
        return None
    return spark.read.schema(COMMIT).json(f"{path}/commits")


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of committed batches with ``id`` and ``batch``, or None before the first commit.

    ``id`` is the batch's first id, the rows of the tasks before the row's own, and the row's
    place in its task: all written with the batch, so that every read gives equal ids.
    """
    known = commits(spark, path)
    if known is None:
        return None
    rows = spark.read.parquet(f"{path}/data")
    parts = spark.read.parquet(f"{path}/parts").join(known.select("token", "batch", "first_id"), "token")
    task = F.shiftrightunsigned("_row", ROW_BITS)
    place = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    own = rows.withColumn("_part", task).join(parts, ["token", "_part"])
    columns = [c for c in rows.columns if c not in ("_row", "token")]
    return own.select((F.col("first_id") + F.col("_before") + place).alias("id"), "batch", *columns)


def append_batch(batch: DataFrame, path: str, batch_id: str, hash_col: str, order: list[str]) -> Commit:
    """Add the rows of a batch whose hash the store lacks, once, and number them on.

    Rows are written once, unseen by readers. Ids run on without gaps from the highest of the
    store: each task's rows are counted and the counts added up (a row per task), so no task sees all
    rows. A batch that is committed already adds nothing and gives its first result. Another
    writer's commit in between makes this one start anew.
    """
    spark = batch.sparkSession
    folder = Folder(spark, path)
    for _ in range(ATTEMPTS):
        versions = folder.names("commits")
        known = commits(spark, path)
        done = known.where(F.col("batch") == batch_id).first() if known is not None else None
        if done:
            return Commit(**done.asDict())
        stored = read_committed(spark, path)
        new = first_by_hash(batch, hash_col, order) if stored is None else append_new(batch, stored, hash_col, order)
        token = f"{batch_id}-{uuid.uuid4().hex}"
        data = f"{path}/data/token={token}"
        new.withColumn("_row", F.monotonically_increasing_id()).write.parquet(data)
        counts = spark.read.parquet(data).groupBy(F.shiftrightunsigned("_row", ROW_BITS).alias("_part")).agg(
            F.count("*").alias("n")).orderBy("_part").collect()
        before, at = [], 0
        for row in counts:
            before.append((row["_part"], at))
            at += row["n"]
        spark.createDataFrame(before, "_part bigint, _before bigint").coalesce(1).write.parquet(f"{path}/parts/token={token}")
        last = json.loads(folder.get("commits", versions[-1]))["last_id"] if versions else 0
        made = Commit(batch_id, token, at, last + 1, last + at)
        if folder.put(json.dumps(vars(made)), "commits", _version(len(versions) + 1)):
            return made
    raise RuntimeError(f"{ATTEMPTS} other writers committed before batch {batch_id}")
