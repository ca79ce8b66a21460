"""Small-file access through Hadoop's file systems: whatever Spark can reach, this reaches."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")


def retried(action: Callable[[], R], tries: int = 3, wait: float = 0.1, factor: float = 2.0) -> R:
    """Call until it works, waiting longer each time; the last error is raised."""
    for attempt in range(tries):
        try:
            return action()
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(wait * factor**attempt)
    raise ValueError("tries must be positive")


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return retried(lambda: self._path(path).getFileSystem(self._conf), tries=10, wait=0.01)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def make_directory(self, path: str) -> None:
        def make() -> None:
            if not self._fs(path).mkdirs(self._path(path)):
                raise OSError(f"can't make {path}")

        retried(make)

    def rename(self, old: str, new: str) -> None:
        def move() -> None:
            if not self._fs(old).rename(self._path(old), self._path(new)):
                raise OSError(f"can't rename {old} to {new}")

        retried(move)

    def list(self, path: str) -> list[str]:
        """Paths in a folder, sorted; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().toString() for s in self._fs(path).listStatus(self._path(path)))

    def size(self, path: str) -> int:
        """Bytes of a file or of all files below a folder; 0 if it isn't there."""
        return self._fs(path).getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def delete(self, path: str, use_trash: bool = False) -> bool:
        """Delete, or move to the trash where one is enabled; a missing path counts as deleted."""
        if not self.exists(path):
            return True
        if use_trash and self._jvm.org.apache.hadoop.fs.Trash.moveToAppropriateTrash(self._fs(path), self._path(path), self._conf):
            return True
        return self._fs(path).delete(self._path(path), True)

    def temporary(self, root: str) -> str:
        """A path under ``root`` that nothing has, deleted when the file system is closed."""
        path = f"{root.rstrip('/')}/tmp-{uuid.uuid4().hex}"
        self._fs(path).deleteOnExit(self._path(path))
        return path

    def read(self, path: str) -> bytes:
        stream = self._fs(path).open(self._path(path))
        with contextlib.closing(stream):
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))

    def write(self, path: str, data: bytes) -> None:
        stream = self._fs(path).create(self._path(path), True)
        with contextlib.closing(stream):
            stream.write(data)

    @contextlib.contextmanager
    def writing(self, path: str) -> Iterator[Callable[[bytes], None]]:
        """A function that appends to a new file; what is there replaces ``path`` at the end, and goes on an error."""
        at = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs(path).create(self._path(at), True)
        try:
            yield stream.write
        except BaseException:
            stream.close()
            self.delete(at)
            raise
        stream.close()
        self.delete(path)
        self.rename(at, path)
