"""Files through Hadoop's file systems: whatever Spark can reach, by the same paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


class WritableFile:
    """A file being written from its start; writing after close is refused."""

    def __init__(self, stream):
        self._stream = stream

    @property
    def is_open(self) -> bool:
        return self._stream is not None

    def write(self, data: bytes) -> bool:
        if not self.is_open:
            return False
        self._stream.write(bytearray(data))
        return True

    def flush(self) -> bool:
        if self.is_open:
            self._stream.flush()
        return self.is_open

    def sync(self) -> bool:
        """Makes what was written durable, where the file system can."""
        if not self.is_open:
            return False
        self._stream.hsync()
        return True

    def close(self) -> bool:
        """Closing twice is no error."""
        if self.is_open:
            self._stream.close()
            self._stream = None
        return True

    def __enter__(self) -> WritableFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class ReadableFile:
    """A file read from its start, or at a place."""

    def __init__(self, stream, size: int, gateway):
        self._stream, self.size, self._gateway = stream, size, gateway

    @property
    def is_open(self) -> bool:
        return self._stream is not None

    def read(self, n: int) -> bytes:
        """Up to n bytes from where the last read ended; none at the end. Failures raise."""
        if not self.is_open:
            raise ValueError("the file is closed")
        data = self._stream.readNBytes(n)
        return bytes(data)

    def read_at(self, at: int, n: int) -> bytes:
        if not self.is_open:
            raise ValueError("the file is closed")
        self._stream.seek(at)
        return self.read(n)

    def close(self) -> bool:
        if self.is_open:
            self._stream.close()
            self._stream = None
        return True

    def __enter__(self) -> ReadableFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class FileManager:
    """Create, open, test, delete and rename files of any file system that the session knows."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def _at(self, path: str):
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._spark._jsc.hadoopConfiguration()), target

    def create(self, path: str) -> WritableFile:
        """A new empty file in place of any at the path."""
        fs, target = self._at(path)
        return WritableFile(fs.create(target, True))

    def open(self, path: str) -> ReadableFile | None:
        """The file, or None where there is none."""
        fs, target = self._at(path)
        if not fs.exists(target):
            return None
        return ReadableFile(fs.open(target), fs.getFileStatus(target).getLen(), self._spark._sc._gateway)

    def exists(self, path: str) -> bool:
        """True for a file or folder."""
        fs, target = self._at(path)
        return fs.exists(target)

    def delete(self, path: str) -> bool:
        """Removes a file; an absent one counts as removed."""
        fs, target = self._at(path)
        return not fs.exists(target) or fs.delete(target, False)

    def rename(self, source: str, target: str) -> bool:
        """Moves a file over any at the target; False where there is no source."""
        fs, old = self._at(source)
        _, new = self._at(target)
        if not fs.exists(old):
            return False
        if fs.exists(new):
            fs.delete(new, False)
        return fs.rename(old, new)
