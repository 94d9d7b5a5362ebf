"""Raw files in the shared folder, opened from tasks through Arrow's file systems.

A task writes under a name that holds its attempt, and a file only counts once the
task's rows, which carry the name, are committed.  So a retried or speculative task never
touches a file that others read.
"""

from __future__ import annotations

from collections import OrderedDict

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named like ``scheme://...``, ``file:/...`` or a path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


READ_BYTES, READ_ROWS = 1 << 24, 10_000


def read_tasks(total_bytes: int, ranges: int) -> int:
    """Tasks for reading byte ranges: Spark, which sees only the narrow rows that name them, would
    pack far too many into one."""
    return max(1, min(100_000, max(-(-total_bytes // READ_BYTES), -(-ranges // READ_ROWS))))


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name of this task attempt's own."""
    from pyspark import TaskContext
    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


class Folder:
    """Writes whole files and reads byte ranges; keeps a few files open."""

    def __init__(self, uri: str, kept: int = 32):
        self.fs, self.path = open_folder(uri)
        self.kept, self.open = kept, OrderedDict()

    def create(self, name: str):
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self.open.pop(name, None) or self.fs.open_input_file(f"{self.path}/{name}")
        self.open[name] = file
        if len(self.open) > self.kept:
            self.open.popitem(last=False)[1].close()
        return file.read_at(length, offset)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as file:
            return file.read()

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()
