"""State tables as folders: a log of event batches, snapshots of what they come to, and look-ups that read pruned files.

``log/_batch=N/_part=P`` holds the events of batch N, ``snapshot/_upto=N/_part=P`` a row
for each key: of every column the last value that an event of the batches up to N has set,
and beside it, as ``_at_<column>``, that event's order. Such rows merge in any order and
any number of times, so late events, a batch that is written again and a compaction that
was cut off change nothing: a snapshot is seen once it is whole, and what it holds may be
in the log as well.

``_part`` is a hash of the column that look-ups name, or the column itself (a day). A look-up of one
value reads that part of the newest snapshot and of the batches after it, nothing else.

Defined results: events with a null key are rows of a null key; events with a null order
set nothing, though their key is there; where two events of one order set a column, the larger value wins; a table without
batches is empty. Batches are numbered upward: one that comes below the newest snapshot's number is not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import whole


@dataclass(frozen=True)
class StateTable:
    """A table of latest values.

    schema: of the events: the keys, the order, and the columns that are set. prune: the key by which files are parted,
    into ``parts`` by its hash; by its values, if parts is 0.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: str
    prune: str
    parts: int = 64
    slices: int = 8

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in (*self.keys, self.order)]

    def part(self, value: Column) -> Column:
        text = F.coalesce(value.cast("string"), F.lit(""))
        return F.pmod(F.xxhash64(text), F.lit(self.parts)).cast("string") if self.parts else F.concat(F.lit("="), text)

    def append(self, events: DataFrame, batch: int) -> None:
        """Adds a batch; one of the same number is replaced, so a batch that is run again after a failure counts once."""
        rows = events.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], self.part(F.col(self.prune)).alias("_part"))
        self._write(rows, f"{self.path}/log/_batch={batch}")

    def compact(self, upto: int) -> None:
        """Writes the snapshot of the batches up to a number, from the newest one before and the batches since."""
        if whole(self.spark, f"{self.path}/snapshot/_upto={upto}"):
            return
        self._write(self._merged(self._sources(upto)).withColumn("_part", self.part(F.col(self.prune))), f"{self.path}/snapshot/_upto={upto}")

    def current(self) -> DataFrame:
        """A row for each key: the keys, the order of its last event, and the last value set of each column."""
        return self._public(self._sources())

    def lookup(self, value) -> DataFrame:
        """The rows of one value of the pruning key, from its files alone."""
        only = F.lit(value).cast(self.schema[self.prune].dataType)
        part = self.spark.range(1).select(self.part(only)).first()[0]  # one string
        return self._public([s.where((F.col("_part") == part) & F.col(self.prune).eqNullSafe(only)) for s in self._sources()])

    def _write(self, rows: DataFrame, path: str) -> None:
        # at most ``slices`` files a part, so a hot key's events are dealt to several tasks
        of_row = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "_part"]), F.lit(self.slices))
        rows.repartition("_part", of_row).write.mode("overwrite").partitionBy("_part").parquet(path)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.StringType())])).parquet(path)

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Numbers of the batches or snapshots that are whole, ascending."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith(name + "=")]
        return sorted(n for n in found if whole(self.spark, f"{self.path}/{kind}/{name}={n}"))

    def _at(self, c: str) -> str:
        return f"_at_{c}"

    def _snapshot_schema(self) -> T.StructType:
        at = self.schema[self.order].dataType
        return T.StructType([*self.schema.fields, *[T.StructField(self._at(c), at) for c in self.values]])

    def _sources(self, upto: int | None = None) -> list[DataFrame]:
        """The newest snapshot and the batches after it, alike in columns."""
        fits = lambda n: upto is None or n <= upto
        snapshots = [n for n in self._numbers("snapshot", "_upto") if fits(n)]
        after = snapshots[-1] if snapshots else None
        batches = [n for n in self._numbers("log", "_batch") if fits(n) and (after is None or n > after)]
        out = [self._read(f"{self.path}/snapshot/_upto={after}", self._snapshot_schema())] if snapshots else []
        set_at = {self._at(c): F.when(F.col(c).isNotNull(), F.col(self.order)) for c in self.values}
        out += [self._read(f"{self.path}/log/_batch={n}", self.schema).withColumns(set_at) for n in batches]
        return out or [self.spark.createDataFrame([], T.StructType([*self._snapshot_schema().fields, T.StructField("_part", T.StringType())]))]

    def _merged(self, sources: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, sources)
        last = lambda c: F.max(F.when(F.col(self._at(c)).isNotNull(), F.struct(F.col(self._at(c)).alias("at"), F.col(c).alias("value")))).alias(c)
        merged = rows.groupBy(*self.keys).agg(F.max(self.order).alias(self.order), *map(last, self.values))
        return merged.select(*self.keys, self.order, *[F.col(f"{c}.value").alias(c) for c in self.values], *[F.col(f"{c}.at").alias(self._at(c)) for c in self.values])

    def _public(self, sources: list[DataFrame]) -> DataFrame:
        return self._merged(sources).select(*self.keys, self.order, *self.values)
