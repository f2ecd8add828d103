"""Objects under a root on any Hadoop file system, from the driver; what moves many files is in operators.ingest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from chunkloom.config import Settings

STREAM_BYTES = 4096


@dataclass(frozen=True)
class Storage:
    """Names are paths below root. Retries are the file system client's own and, for tasks, spark.task.maxFailures.

    lists: whether the store can be listed; scan refuses where it cannot.
    """

    spark: SparkSession
    root: str
    lists: bool = True

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name.lstrip('/')}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _open(self, name: str):
        fs, path = self._at(name)
        if not fs.exists(path):
            raise FileNotFoundError(name)
        return fs.open(path)

    def save(self, name: str, data: bytes) -> None:
        """Writes or replaces an object."""
        fs, path = self._at(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def load(self, name: str, stream: bool = False) -> bytes | Iterator[bytes]:
        return self.load_stream(name) if stream else self.load_once(name)

    def load_once(self, name: str) -> bytes:
        source = self._open(name)
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def load_stream(self, name: str, size: int = STREAM_BYTES) -> Iterator[bytes]:
        """Pieces of size bytes, the last one shorter."""
        source = self._open(name)

        def pieces() -> Iterator[bytes]:
            try:
                while piece := bytes(source.readNBytes(size)):
                    yield piece
            finally:
                source.close()

        return pieces()

    def download(self, name: str, target: str) -> None:
        """Copies an object to a file of the driver."""
        with open(target, "wb") as out:
            for piece in self.load_stream(name, 1 << 20):
                out.write(piece)

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        """Deletes an object; one that is not there is no error."""
        fs, path = self._at(name)
        fs.delete(path, True)

    def scan(self, path: str, files: bool = True, directories: bool = False) -> list[str]:
        """Names below a path, at any depth, ascending; directories end with a slash. A path that is not there is an error."""
        if not self.lists:
            raise NotImplementedError("this store cannot be listed")
        if not files and not directories:
            raise ValueError("nothing to list: neither files nor directories")
        fs, top = self._at(path)
        if not fs.exists(top):
            raise FileNotFoundError(path)
        base = fs.makeQualified(self._at("")[1]).toString().rstrip("/") + "/"
        found, queue = [], [top]
        while queue:
            for status in fs.listStatus(queue.pop()):
                name = status.getPath().toString().removeprefix(base)
                if status.isDirectory():
                    queue.append(status.getPath())
                if status.isDirectory() and directories:
                    found.append(f"{name}/")
                elif status.isFile() and files:
                    found.append(name)
        return sorted(found)


def open_storage(spark: SparkSession, kind: str = "local", root: str | None = None) -> Storage:
    """Storage by kind: "local" below the settings' upload folder, or "uri" below any root that Hadoop reads."""
    if kind == "local":
        return Storage(spark, f"file://{root}" if root and root.startswith("/") else root or Settings().upload_dir)
    if kind == "uri" and root:
        return Storage(spark, root)
    raise ValueError(f"unsupported storage {kind}")
