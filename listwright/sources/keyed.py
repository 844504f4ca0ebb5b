"""A keyed table as runs of partial rows in folders by key hash, merged level by level.

A batch adds one run. Every ``fanout`` runs of a level become one run of the next, and the last
level is a base of which a merge rewrites only the folders of touched keys. So a lookup opens
the folders of its keys in a bounded number of runs, however many batches there were, and what a
merge has covered is removed once the next merge has succeeded.

Runs are ``root/L<level>/v=<version>/b=<bucket>``, complete with Spark's _SUCCESS mark. A run's
version is that of the last batch in it, so a batch that is replayed writes the same runs again,
from runs that are still there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listwright.sources.snapshots import folders, remove, versions


@dataclass(frozen=True)
class KeyedTable:
    """``merge`` folds rows to one per key, in any order and any grouping.

    Rows lie by the hash of ``key``, in ``buckets`` folders a run; ``levels`` counts those
    before the base. Versions are 0, 1, 2, ... without gaps.
    """

    root: str
    schema: T.StructType
    key: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 16
    fanout: int = 4
    levels: int = 2

    def bucket(self, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(*(key or self.key)), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``, whose columns are the key's; at most as many as there are."""
        return sorted(r.b for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def _run(self, level: int, version: int) -> str:
        return f"{self.root}/L{level}/v={version}"

    def _live(self, spark: SparkSession, before: int | None) -> list[tuple[int, int]]:
        """Runs below the base, from the newest level to the oldest, that no run above has covered."""
        covered, live = -1, []
        for level in range(self.levels, -1, -1):
            found = [v for v in versions(spark, f"{self.root}/L{level}") if before is None or v < before]
            if level < self.levels:
                live += [(level, v) for v in found if v > covered]
            covered = max([covered, *found])
        return live

    def _based(self, spark: SparkSession, before: int | None) -> dict[int, int]:
        """The newest version of each folder of the base."""
        newest: dict[int, int] = {}
        for v in versions(spark, f"{self.root}/L{self.levels}"):
            if before is None or v < before:
                newest.update(dict.fromkeys(folders(spark, self._run(self.levels, v), "b="), v))
        return newest

    def paths(self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None) -> list[str]:
        """The folders that hold the keys of these buckets, of versions before the given one."""
        wanted = None if buckets is None else set(buckets)
        here = lambda b: wanted is None or b in wanted
        out = [f"{self._run(self.levels, v)}/b={b}" for b, v in sorted(self._based(spark, before).items()) if here(b)]
        for level, v in self._live(spark, before):
            run = self._run(level, v)
            out += [f"{run}/b={b}" for b in folders(spark, run, "b=") if here(b)]
        return out

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def rows(self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """One row per key of these buckets, or of all."""
        return self.merge(self._read(spark, self.paths(spark, buckets, before)))

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the given keys; other buckets' folders are not opened."""
        found = self.rows(keys.sparkSession, self.touched(keys), before)
        return found.join(keys.select(*self.key).distinct(), list(self.key), "left_semi").select(*self.schema.names)

    def _write(self, rows: DataFrame, level: int, version: int) -> None:
        dealt = rows.select(*self.schema.names, self.bucket().alias("b")).repartition(self.buckets, "b")
        dealt.sortWithinPartitions("b", *self.key).write.mode("overwrite").partitionBy("b").parquet(self._run(level, version))

    def append(self, rows: DataFrame, version: int) -> None:
        """Add a batch's rows as a run, merge the runs whose turn it is, and remove covered ones."""
        spark = rows.sparkSession
        self._write(self.merge(rows.select(*self.schema.names)), 0, version)
        for level in range(1, self.levels + 1):
            span = self.fanout**level
            if (version + 1) % span:
                break
            before = [v for v in versions(spark, f"{self.root}/L{level}") if v < version]
            self._merge_into(spark, level, version, version - span)
            if before:
                self._forget(spark, level, before[-1])

    def _merge_into(self, spark: SparkSession, level: int, version: int, after: int) -> None:
        """One run of a level from the runs one below that came after the last; touched folders of the base with it."""
        runs = [self._run(level - 1, v) for v in versions(spark, f"{self.root}/L{level - 1}") if after < v <= version]
        found = [(run, b) for run in runs for b in folders(spark, run, "b=")]
        paths = [f"{run}/b={b}" for run, b in found]
        if level == self.levels:
            touched = {b for _, b in found}
            paths += [f"{self._run(level, v)}/b={b}" for b, v in self._based(spark, version).items() if b in touched]
        self._write(self.merge(self._read(spark, paths)), level, version)

    def _forget(self, spark: SparkSession, level: int, upto: int) -> None:
        """Remove runs that the level's run ``upto`` has covered, and folders of the base that two newer ones stand for."""
        for below in range(level):
            for v in versions(spark, f"{self.root}/L{below}"):
                if v <= upto:
                    remove(spark, self._run(below, v))
        if level < self.levels:
            return
        newer: dict[int, int] = {}
        for age, v in enumerate(reversed(versions(spark, f"{self.root}/L{level}"))):
            run = self._run(level, v)
            held = folders(spark, run, "b=")
            for b in held:
                newer[b] = newer.get(b, 0) + 1
                if newer[b] > 2:
                    remove(spark, f"{run}/b={b}")
            if age and all(newer[b] > 2 for b in held):
                remove(spark, run)
