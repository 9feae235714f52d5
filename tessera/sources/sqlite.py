"""SQLite tables as a Spark data source: ranges of rows are read by tasks of their own."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Rows(InputPartition):
    """Rows with first <= rowid <= last, of which the first is the table's row number ``before``."""

    first: int
    last: int
    before: int


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def row_text(record: dict) -> str:
    """'column: value' joined by ' | '; values that are null, zero or empty are left out."""
    return " | ".join(f"{k}: {v}" for k, v in record.items() if v)


class SqliteSource(DataSource):
    """Format ``sqlite_documents``; options path, table, max_rows (all), tasks (8). Rows are (content, source, title), numbered from 0."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_documents"

    def schema(self) -> str:
        return "content string, source string, title string"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"].replace('"', '""')
        self.most, self.tasks = int(options.get("max_rows", 1 << 62)), int(options.get("tasks", 8))

    def partitions(self) -> list[Rows]:
        with opened(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            if low is None:
                return [Rows(0, -1, 0)]
            step, found, before = max(1, -(-(high - low + 1) // self.tasks)), [], 0
            for first in range(low, high + 1, step):
                if before >= self.most:
                    break
                found.append(Rows(first, first + step - 1, before))
                before += db.execute(f'SELECT count(*) FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (first, first + step - 1)).fetchone()[0]
            return found

    def read(self, partition: Rows) -> Iterator[tuple]:
        with opened(self.path) as db:
            cursor = db.execute(f'SELECT * FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid LIMIT ?', (partition.first, partition.last, min(self.most - partition.before, 1 << 62)))
            names = [d[0] for d in cursor.description]
            for i, row in enumerate(cursor, partition.before):
                text = row_text(dict(zip(names, row, strict=True)))
                if text:
                    yield text, f"{self.path}#row{i}", self.table
