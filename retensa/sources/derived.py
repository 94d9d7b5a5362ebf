"""Derived tables and fitted models, kept as long as the files behind them are the same (SRC3).

Every entry names the tables it was made from.  Asking for it compares the metadata of
their files (path, length, change time; no content is read) with that of the time it was
made: where a file was replaced, added or removed, all that was made from that table is dropped and
made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

def files_fingerprint(spark: SparkSession, path: str) -> str:
    """First 12 hex digits over the path, length and change time of every file below ``path``;
    "" if there is no such path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return ""
    rows, folders = [], [root]
    while folders:
        for s in fs.listStatus(folders.pop()):
            if s.isDirectory():
                folders.append(s.getPath())
            else:
                rows.append(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()[:12]


@dataclass
class Entry:
    value: Any
    prints: dict[str, str]                  # table -> fingerprint when it was made
    close: Callable[[Any], None] | None


@dataclass
class Derived:
    """Entries of all applications, by (application, folder of the tables, name)."""

    entries: dict[tuple, Entry] = field(default_factory=dict)

    def get(self, spark: SparkSession, folder: str, name: tuple, tables: tuple[str, ...],
            make: Callable[[], Any], close: Callable[[Any], None] | None = None) -> Any:
        """The entry, made now if there is none or a file of its tables has changed."""
        place = (spark.sparkContext.applicationId, folder)
        now = {t: files_fingerprint(spark, f"{folder.rstrip('/')}/{t}.parquet") for t in tables}
        self._drop(lambda key, entry: key[:2] == place and any(
            now.get(t, old) != old for t, old in entry.prints.items()))
        key = place + name
        if key not in self.entries:
            self.entries[key] = Entry(make(), now, close)
        return self.entries[key].value

    def _drop(self, which: Callable[[tuple, Entry], bool]) -> None:
        for key in [k for k, e in self.entries.items() if which(k, e)]:
            entry = self.entries.pop(key)
            if entry.close:
                entry.close(entry.value)

    def clear(self) -> None:
        self._drop(lambda key, entry: True)


DERIVED = Derived()
