"""Import of event databases: a Python data source with one partition per file."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class File(InputPartition):
    def __init__(self, event_name: str, path: str):
        self.event_name, self.path = event_name, path


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.table = options["table"]
        if not self.table.isidentifier():
            raise ValueError(f"no table name: {self.table!r}")
        self.files = [File(*x.split("=", 1)) for x in options["files"].split(";") if x]

    def partitions(self) -> list[InputPartition]:
        return self.files

    def read(self, partition: File) -> Iterator[tuple]:
        db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True, timeout=30)
        try:
            there = {r[1] for r in db.execute(f"PRAGMA table_info({self.table})")}
            # Columns an older layout lacks are null.
            cols = ", ".join(f'"{n}"' if n in there else "NULL" for n in self.names if n != "event_name")
            for row in db.execute(f"SELECT {cols} FROM {self.table}"):
                values = iter(row)
                yield tuple(partition.event_name if n == "event_name" else next(values) for n in self.names)
        finally:
            db.close()


class EventDatabases(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_sqlite"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, self.options)


def read(spark: SparkSession, files: dict[str, str], table: str, schema: str) -> DataFrame:
    """Rows of a table of each event's database; files: event -> path that every executor can open."""
    spark.dataSource.register(EventDatabases)
    listed = ";".join(f"{e}={p}" for e, p in sorted(files.items()))
    return spark.read.format("event_sqlite").schema(schema).option("table", table).option("files", listed).load()
