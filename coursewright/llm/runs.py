"""Rows kept under a key in runs of sorted files, looked up by key without going through the rest.

Every append writes a run: a file per part of the key space, sorted by key, in
small row groups.  A lookup sends the wanted keys, sorted, to one task per part,
which opens that part's file of every run, compares the keys with the row groups'
least and greatest key (kept in the file's footer) and reads only the groups that
can hold one.  The rows read are bounded by wanted keys times the size of a group,
however long a run is.  Whenever ``FANOUT`` runs of like length stand side by side
they are merged into one, so there are only about log(appends) of them.

A run is named by the appends it covers and counts once its marker is there, which
is written last: an append or merge that breaks leaves nothing behind that is read,
and runs that a longer one covers are passed over until they are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Parts of the key space, and rows of a row group: what is read for one key.
PARTS, GROUP_ROWS = 16, 512
#: Runs of like length that are merged into one.
FANOUT = 4


@lru_cache(maxsize=4096)
def _file_index(uri: str) -> tuple[pq.ParquetFile, np.ndarray, np.ndarray]:
    """The open file with each row group's least and greatest key; files of a run never change."""
    fs, path = pafs.FileSystem.from_uri(uri)
    file = pq.ParquetFile(fs.open_input_file(path))
    at = file.schema_arrow.names.index("key")
    stats = [file.metadata.row_group(g).column(at).statistics for g in range(file.num_row_groups)]
    return file, np.array([s.min for s in stats], dtype=np.int64), np.array([s.max for s in stats], dtype=np.int64)


def _files(folder: str) -> list[str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return [folder + f.path[len(path) :] for f in found if f.path.endswith(".parquet")]


class SortedRuns:
    """Named tables (``schemas``, each starting with ``key long``) under ``path``, a URI that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], parts: int = PARTS, group_rows: int = GROUP_ROWS):
        self.spark, self.schemas, self.parts, self.group_rows = spark, schemas, parts, group_rows
        self.path = path if ":/" in path else f"file://{path}"
        #: Rows that lookups have read since the object was made (tasks that are run again count again).
        self.rows_read = spark.sparkContext.accumulator(0)

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _covered(self) -> list[tuple[int, int]]:
        """First and last append of each run that counts, oldest first."""
        fs, at = self._hadoop(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [tuple(map(int, n.split("-"))) for n in names if fs.exists(self._hadoop(f"{self.path}/{n}/_COMMITTED")[1])]
        return sorted(r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done))

    def _name(self, run: tuple[int, int]) -> str:
        return f"{self.path}/{run[0]:08d}-{run[1]:08d}"

    def runs(self) -> list[str]:
        return [self._name(r) for r in self._covered()]

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")

    def _write(self, run: tuple[int, int], tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            laid = df.withColumn("part", self._part()).hint("rebalance", "part").sortWithinPartitions("part", "key")
            laid.write.mode("overwrite").option("parquet.block.row.count.limit", self.group_rows).partitionBy("part").parquet(f"{self._name(run)}/{name}")
        fs, at = self._hadoop(f"{self._name(run)}/_COMMITTED")
        fs.create(at, True).close()

    def _merge(self, runs: list[tuple[int, int]]) -> None:
        """Writes several neighbouring runs anew as one; it reads these runs and no others."""
        read = lambda r, n: self.spark.read.schema(self.schemas[n]).parquet(f"{self._name(r)}/{n}").select(self.schemas[n].names)
        self._write((runs[0][0], runs[-1][1]), {n: reduce(DataFrame.unionByName, [read(r, n) for r in runs]) for n in self.schemas})
        for r in runs:
            fs, at = self._hadoop(self._name(r))
            fs.delete(at, True)

    def append(self, tables: dict[str, DataFrame]) -> None:
        """Writes all tables as one run; all of them count from the same moment, or none."""
        done = self._covered()
        no = done[-1][1] + 1 if done else 0
        self._write((no, no), tables)
        while True:
            done = self._covered()
            last = done[-FANOUT:]
            span = last[-1][1] - last[-1][0] + 1
            if len(last) < FANOUT or any((b - a + 1) // span not in range(1, FANOUT) for a, b in last):
                return
            self._merge(last)

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(done := self._covered()) > 1:
            self._merge(done)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of table ``name`` whose key is in ``keys``."""
        runs, read, schema, columns = self.runs(), self.rows_read, self.schemas[name], self.schemas[name].names
        arrow = to_arrow_schema(schema)  # runs may differ in what they declare never to be null
        probes = keys.select("key").distinct().withColumn("part", self._part()).repartition(self.parts, "part").sortWithinPartitions("part", "key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for part in np.unique(parts):
                    wanted = every[parts == part]
                    for uri in [f for r in runs for f in _files(f"{r}/{name}/part={part}")]:
                        file, least, most = _file_index(uri)
                        groups = np.flatnonzero(np.searchsorted(wanted, least, "left") < np.searchsorted(wanted, most, "right"))
                        for g in groups.tolist():
                            rows = file.read_row_group(g, columns=columns)
                            read.add(rows.num_rows)
                            hit = rows.filter(pa.array(np.isin(rows.column("key").to_numpy(), wanted)))
                            if hit.num_rows:
                                yield from hit.select(columns).cast(arrow).combine_chunks().to_batches()

        return probes.mapInArrow(run, schema)
