"""Small files and directories of a run, by the file system that Spark would use for the path."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def exists(self, path: str) -> bool:
        system, place = self._at(path)
        return system.exists(place)

    def make(self, path: str) -> None:
        system, place = self._at(path)
        system.mkdirs(place)

    def claim(self, path: str) -> bool:
        """Makes a directory; False if it was there. The creation of its marker file decides between two who try."""
        system, place = self._at(path)
        if system.exists(place):
            return False
        system.mkdirs(place)
        try:
            system.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/owner"), False).close()
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)

    def move(self, source: str, to: str) -> None:
        system, place = self._at(source)
        if not system.rename(place, self.spark._jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{source} can't be moved to {to}")

    def names(self, path: str) -> list[str]:
        system, place = self._at(path)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def read(self, path: str) -> str:
        system, place = self._at(path)
        stream = system.open(place)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The file appears whole: it is written beside its place and moved there."""
        system, place = self._at(path)
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        system.mkdirs(place.getParent())
        stream = system.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        over[0] = getattr(fs, "Options$Rename").OVERWRITE
        context = fs.FileContext.getFileContext(system.makeQualified(place).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(system.makeQualified(beside), system.makeQualified(place), over)

    def read_json(self, path: str) -> Any:
        return json.loads(self.read(path))

    def write_json(self, path: str, value: Any) -> None:
        self.write(path, json.dumps(value, ensure_ascii=False, indent=2, default=str))

    @contextmanager
    def lock(self, path: str, timeout: float = 30.0, poll: float = 0.05):
        """A directory that only one holds at a time."""
        end = time.monotonic() + timeout
        while not self.claim(path):
            if time.monotonic() > end:
                raise TimeoutError(f"{path} is held by another")
            time.sleep(poll)
        try:
            yield
        finally:
            self.remove(path)
