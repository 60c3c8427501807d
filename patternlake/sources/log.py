"""A log that takes each key once, from any number of writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.operators.border import children

#: Folders by hash of the key: an append looks keys up in those that its own rows fall in.
BUCKETS = 32


class AppendLog:
    """Rows below a folder, each key once. ``data`` has a table for each append, ``commits`` a numbered file for each one that counts.

    An append writes its table under a name of its own, and then publishes the next number by an operation that fails if the number is taken: a link or a rename without replacement. Who
    loses goes on from the winner's rows: what those have already is dropped, and the next number is tried. A writer that dies before it has published leaves a table that no commit
    names and no reader sees.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """What was published, in order: (table, rows)."""
        store, out = self._store(), []
        for name in children(self.spark, f"{self.path}/commits"):
            if name.isdigit():
                stream = store.open(self._path(f"commits/{name}"))
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                stream.close()
        return out

    def read(self) -> DataFrame | None:
        """All rows that count, or None if there are none."""
        return self._tables(self.commits())

    def _tables(self, commits: list[dict]) -> DataFrame | None:
        paths = [f"{self.path}/data/{c['table']}" for c in commits if c["rows"]]
        if not paths:
            return None
        schema = self.spark.read.parquet(paths[0]).schema
        every = [self.spark.read.schema(schema).parquet(p) for p in paths]  # each its own folder of buckets
        out = every[0]
        for e in every[1:]:
            out = out.unionByName(e)
        return out

    def _publish(self, number: int, commit: dict) -> bool:
        """Whether ``commit`` is now the one of that number."""
        store, name = self._store(), f"{number:09d}"
        store.mkdirs(self._path("commits"))
        draft, final = self._path(f"commits/.{uuid.uuid4().hex}"), self._path(f"commits/{name}")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        try:
            if store.getScheme() == "file":
                nio = self.jvm.java.nio.file
                nio.Files.createLink(nio.Path.of(final.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)), nio.Path.of(draft.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(draft, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            store.delete(draft, False)

    def _without(self, rows: DataFrame, commits: list[dict]) -> DataFrame:
        """``rows`` whose key no table of ``commits`` has; of those tables only the keys of the buckets in question are read."""
        known = self._tables(commits)
        if known is None:
            return rows
        buckets = [r["__bucket"] for r in rows.select("__bucket").distinct().collect()]  # at most BUCKETS
        return rows.join(known.where(F.col("__bucket").isin(buckets)).select(*self.key, "__bucket"), [*self.key, "__bucket"], "left_anti")

    def append(self, rows: DataFrame) -> int:
        """Add the rows whose key is new, one of each key; returns how many. A call that is repeated adds nothing."""
        todo = rows.dropDuplicates(self.key).withColumn("__bucket", F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int"))
        seen = self.commits()
        todo = self._without(todo, seen)
        while True:
            table = uuid.uuid4().hex
            todo.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{table}")
            todo = self.spark.read.schema(todo.schema).parquet(f"{self.path}/data/{table}")
            n = todo.count()
            if not n or self._publish(len(seen), {"table": table, "rows": n}):
                return n
            now = self.commits()
            todo, seen = self._without(todo, now[len(seen) :]), now
