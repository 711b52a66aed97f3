"""Intermediate tables in the shared folder that the session names.

A task that is retried after an executor is lost reads these files again, so
everything staged here survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import remove, shared_dir


class Stage:
    """The staged tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/voxelframe-{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.tables: dict[str, list[str]] = {}
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts the lineage at a durable table."""
        path = f"{self.root}/{name}-{len(self.paths)}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def put_dealt(self, df: DataFrame, name: str, deal: str, orders: list[list[str]], buckets: int) -> list[DataFrame]:
        """Write df, whose partitions are dealt by a column and sorted by each of the orders, and read it once as sorted by each.

        Rows are written as they come, one file a bucket; the orders have to
        hold, and tasks have to hold whole buckets.
        """
        path, first = f"{self.root}/{name}-{len(self.paths)}", f"voxelframe_{uuid.uuid4().hex}"
        columns, out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), []
        df.write.option("path", path).format("parquet").bucketBy(buckets, deal).saveAsTable(first)
        self.paths[name], self.tables[name] = path, [first]
        for order in orders:
            table = f"voxelframe_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({deal}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
            self.tables[name].append(table)
            out.append(self.spark.table(table))
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            for table in self.tables.pop(name, []):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if path := self.paths.pop(name, None):
                remove(self.spark, path)

    def close(self) -> None:
        """Delete what is left; runs when the application ends."""
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop(*self.tables)
                remove(self.spark, self.root)
        except Exception:  # the session has ended before; its folder goes with the cluster's clean-up
            pass
