"""A store of versioned table sets: a version is written whole, then a pointer file is swapped to it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.schema import TABLES, VOCABULARIES

SCHEMA_VERSION = "1"


class StoreError(RuntimeError):
    """The store is missing, incomplete or of another schema."""


class Store:
    """Tables under ``root``; works on any file system Spark can write, as it uses Hadoop's own calls.

    Readers see one whole version: they follow ``CURRENT``, which names a version only once all its tables and its manifest
    are written. A reader never creates anything.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _swap_text(self, path: str, text: str) -> None:
        aside, p = self._path(f"{path}.{uuid.uuid4().hex}"), self._path(path)
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(aside.toUri().toString()), p, options)

    def replace(self, **tables: DataFrame) -> str:
        """Writes a version with ``tables``, those not given staying as they are, and makes it current.

        Of rows with one key the greatest ``seq`` counts, if there is such a column. Nodes and edges are written by kind.
        """
        version = uuid.uuid4().hex
        old = self._read_text(f"{self.root}/CURRENT")
        for name, ddl in TABLES.items():
            df = tables.get(name)
            if df is None:
                df = self.load(name) if old else self.spark.createDataFrame([], ddl)
            elif "seq" in df.columns:
                key = "key" if name == "meta" else "id"
                rest = [c for c in df.columns if c not in (key, "seq")]
                df = df.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(key, "x.*")
            fields = self.spark.createDataFrame([], ddl).schema.fields
            df = df.select(*(F.col(f.name).cast(f.dataType) for f in fields))
            if name in ("nodes", "edges"):
                df = df.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id")
            df.write.parquet(f"{self.root}/{version}/{name}")
        self._swap_text(f"{self.root}/{version}/MANIFEST", SCHEMA_VERSION)
        self._swap_text(f"{self.root}/CURRENT", version)
        return version

    def version(self) -> str:
        """The current version; refuses a store that is missing or not whole."""
        v = self._read_text(f"{self.root}/CURRENT")
        if v is None:
            raise StoreError("no store: nothing has been indexed")
        if self._read_text(f"{self.root}/{v}/MANIFEST") != SCHEMA_VERSION:
            raise StoreError(f"version {v} is not whole, or of another schema")
        return v

    def load(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{self.version()}/{table}")

    def get(self, table: str, key: str) -> DataFrame:
        """The row of one key; the filter reaches the files."""
        return self.load(table).where(F.col("key" if table == "meta" else "id") == key)

    def is_indexed(self) -> bool:
        try:
            return not self.load("nodes").isEmpty()
        except StoreError:
            return False

    def task_frames(self) -> DataFrame:
        """The newest first, ties by id."""
        return self.load("task_frames").orderBy(F.desc("created_at"), "id")


def invalid_rows(**tables: DataFrame) -> DataFrame:
    """(table, column, id) of rows whose value is outside a closed vocabulary, or whose id is null."""
    out = []
    for name, df in tables.items():
        out.append(df.where("id is null").select(F.lit(name).alias("table"), F.lit("id").alias("column"), F.col("id").alias("id")))
        if (words := VOCABULARIES.get((name, "kind"))) is not None:
            out.append(df.where(F.col("kind").isNull() | ~F.col("kind").isin(*words)).select(F.lit(name).alias("table"), F.lit("kind").alias("column"), "id"))
    return reduce(DataFrame.unionByName, out)
