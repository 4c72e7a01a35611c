"""A folder of saved rows in which each id stands once, whatever writers crash or overlap.

A writer stages the rows whose ids aren't saved yet as a table of its own, then commits it by creating the next numbered file below ``commits``, which names that
table.  Only one writer can create a number; the other leaves out what has been committed meanwhile and tries the next.  Readers see committed tables only, so a
crash before the commit loses nothing and repeats nothing: the rows are staged again.  A commit file that stays empty (its writer died between creating and writing it) is void
after ``LEASE`` seconds.  Files are reached through Spark's file systems, so the folder may be in any store that creates files exclusively.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Seconds for which an empty commit may still be written.
LEASE = 30.0


class Manifest:
    """Rows with an id in column ``key``; rows without one aren't saved."""

    def __init__(self, spark: SparkSession, folder: str, key: str, lease: float = LEASE):
        self.spark, self.folder, self.key, self.lease = spark, folder.rstrip("/"), key, lease
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def commits(self) -> list[str]:
        """The committed tables in order."""
        return [name for name in self._numbered() if name]

    def rows(self) -> DataFrame | None:
        """All saved rows; None if there are none."""
        return self._read(self.commits())

    def save(self, df: DataFrame, before_commit: Callable[[], None] = lambda: None) -> int:
        """Saves the rows whose id isn't saved yet, the first of each id, and returns how many they are.

        ``before_commit`` runs when the rows are staged and not yet committed.
        """
        known = self._numbered()
        new = self._new(df.where(df[self.key].isNotNull()).dropDuplicates([self.key]), [n for n in known if n])
        while True:
            name = f"staged/{uuid.uuid4().hex}"
            new.write.parquet(f"{self.folder}/{name}")
            staged = self.spark.read.parquet(f"{self.folder}/{name}")
            count = staged.count()
            before_commit()
            if not count or self._commit(len(known) + 1, name):
                return count
            now = self._numbered()
            new, known = self._new(staged, [n for n in now[len(known) :] if n]), now  # another writer was first

    def clean(self) -> int:
        """Deletes staged tables that no commit names, and returns how many; no writer may be at work."""
        at = self._path(f"{self.folder}/staged")
        kept = {name.split("/")[-1] for name in self.commits()}
        lost = [s.getPath() for s in (self._fs.listStatus(at) if self._fs.exists(at) else ()) if s.getPath().getName() not in kept]
        for path in lost:
            self._fs.delete(path, True)
        return len(lost)

    def _new(self, rows: DataFrame, tables: list[str]) -> DataFrame:
        saved = self._read(tables)
        return rows if saved is None else rows.join(saved.select(self.key), self.key, "left_anti").select(*rows.columns)

    def _read(self, tables: list[str]) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.folder}/{t}") for t in tables]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None

    def _commit(self, number: int, name: str) -> bool:
        path = self._path(f"{self.folder}/commits/{number:010d}")
        try:
            out = self._fs.create(path, False)
        except Exception as e:  # what a store throws differs; a number that is taken is no error
            if self._fs.exists(path):
                return False
            raise e
        out.write(bytearray(name.encode()))
        out.close()
        return True

    def _numbered(self) -> list[str]:
        """The tables of commits 1, 2, ... in order, empty for void ones."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return []
        return [self._table(s) for s in sorted(self._fs.listStatus(at), key=lambda s: s.getPath().getName())]

    def _table(self, status: object) -> str:
        path = status.getPath()
        while True:
            now = self._fs.getFileStatus(path)
            if now.getLen():
                lines = self.spark.read.text(path.toString()).collect()  # one line
                return lines[0][0]
            if time.time() - now.getModificationTime() / 1000 > self.lease:
                return ""
            time.sleep(0.2)


def read_through(wanted: DataFrame, key: str, folder: str, fetch: Callable[[str], str | None], at_once: int = 8) -> DataFrame:
    """(key, text) of all wanted keys: those in the folder, and what ``fetch`` gives for the others, which is stored there; null if it gives nothing.

    A stored text counts only if its digest does, and files that can't be read are passed over, so what was torn is fetched again.  Keys that give nothing are asked again the next time.
    """
    from protomill.sources.paged import patiently

    spark = wanted.sparkSession
    schema = "key string, text string, digest string"

    def stored() -> DataFrame:
        try:
            read = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(folder)
        except PySparkException:  # nothing is stored yet
            return spark.createDataFrame([], schema)
        return read.where("digest = sha2(text, 256)").dropDuplicates(["key"])

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            texts = [patiently(lambda k=k: fetch(k)) for k in pdf["key"]]
            kept = [(k, t, hashlib.sha256(t.encode()).hexdigest()) for k, t in zip(pdf["key"], texts, strict=True) if t is not None]
            yield pd.DataFrame(kept, columns=["key", "text", "digest"])

    keys = wanted.select(wanted[key].cast("string").alias("key")).where("key is not null").distinct()
    missing = keys.join(stored().select("key"), "key", "left_anti")
    missing.repartition(at_once).mapInPandas(run, schema).write.mode("append").parquet(folder)
    return keys.join(stored().select("key", "text"), "key", "left").withColumnRenamed("key", key)
