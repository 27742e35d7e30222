"""Marks of living writers and readers: small files that their holder renews, so that a dead one's age tells it.

Ages are told by the file system's own clock.  A lease is a mark that only one holder has: it is created only if absent,
holds a token of its holder, and one that nobody has renewed for ``seconds`` is taken over.  No file system can stop a
holder that has slept through its lease from waking up: what it writes then is refused by the numbers of the pointers
(``state``), not by the lease.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession

from catalogspark.sources.files import filesystem


class Fenced(RuntimeError):
    """Another writer has taken over: nothing of this one may become current any more."""


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, target = filesystem(spark, path)
    out = fs.create(target, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = filesystem(spark, path)
    source = fs.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.delete(target, True)


def clock(spark: SparkSession, folder: str) -> float:
    """Seconds by the clock of the file system that holds the folder."""
    path = f"{folder}/.clock-{uuid.uuid4().hex}"
    write_text(spark, path, "")
    fs, target = filesystem(spark, path)
    try:
        return fs.getFileStatus(target).getModificationTime() / 1000
    finally:
        fs.delete(target, False)


class Mark:
    """A file that is renewed three times in ``seconds`` as long as its holder lives."""

    def __init__(self, spark: SparkSession, path: str, seconds: float, text: str = ""):
        self.spark, self.path, self.seconds, self.text = spark, path, seconds, text
        self.ended = threading.Event()

    def _folder(self) -> str:
        return self.path.rpartition("/")[0]

    def start(self) -> None:
        write_text(self.spark, self.path, self.text)
        if self.seconds > 0:
            ahead = clock(self.spark, self._folder()) - time.time()
            threading.Thread(target=self._renew, args=(ahead,), daemon=True).start()

    def _renew(self, ahead: float) -> None:
        while not self.ended.wait(self.seconds / 3):
            try:
                if not self.held():
                    return
                fs, target = filesystem(self.spark, self.path)
                fs.setTimes(target, int((time.time() + ahead) * 1000), -1)
            except Exception:  # the session may be gone, or the store out of reach: an unrenewed mark grows old, which is what it is for
                continue

    def held(self) -> bool:
        """Whether the file is still there and ours."""
        fs, target = filesystem(self.spark, self.path)
        return fs.exists(target) and read_text(self.spark, self.path) == self.text

    def stop(self) -> None:
        self.ended.set()
        if self.held():
            delete(self.spark, self.path)


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a mark was renewed."""
    fs, target = filesystem(spark, path)
    return clock(spark, path.rpartition("/")[0]) - fs.getFileStatus(target).getModificationTime() / 1000


class Lease(Mark):
    """A mark of which there is one: of a writer."""

    def __init__(self, spark: SparkSession, path: str, seconds: float):
        super().__init__(spark, path, seconds, uuid.uuid4().hex)

    def start(self) -> None:
        fs, target = filesystem(self.spark, self.path)
        if fs.exists(target) and age(self.spark, self.path) > self.seconds:
            fs.delete(target, False)
        try:
            super().start()
        except Exception as e:
            raise RuntimeError(f"{self._folder()} is locked by another writer") from e
        if not self.held():
            raise RuntimeError(f"{self._folder()} is locked by another writer")
