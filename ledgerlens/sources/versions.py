"""Versioned folders with a manifest that is switched last.

A version is written whole into a folder of its own (``v-...``); then one small
manifest file is renamed to the next number.  Readers take the folder named by the
highest manifest, so they see the old version or the new one and never a
mixture, also while a writer is at work or after it died.  Two writers cannot take
the same number: the rename fails for the second, who takes the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_PREFIX = "manifest-"


def _system(spark: SparkSession, path: str):
    """(Hadoop file system, path class) of ``path``."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    return new_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), new_path


def _manifests(spark: SparkSession, path: str) -> list[int]:
    system, new_path = _system(spark, path)
    if not system.exists(new_path(path)):
        return []
    names = [f.getPath().getName() for f in system.listStatus(new_path(path))]
    return sorted(int(n[len(_PREFIX):]) for n in names
                  if n.startswith(_PREFIX) and n[len(_PREFIX):].isdigit())


def _read(spark: SparkSession, file: str) -> str:
    system, new_path = _system(spark, file)
    stream = spark._jvm.java.io.BufferedReader(
        spark._jvm.java.io.InputStreamReader(system.open(new_path(file)), "UTF-8"))
    try:
        return stream.readLine()
    finally:
        stream.close()


def committed(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """Folder of the last committed version (or of the numbered one); None if
    there is none."""
    found = _manifests(spark, path)
    if version is not None:
        found = [n for n in found if n == version]
    if not found:
        return None
    return f"{path}/{_read(spark, f'{path}/{_PREFIX}{found[-1]:08d}')}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> int:
    """``write(folder)`` a new version, then make it the current one; returns its
    number.  If ``write`` fails, readers keep the version they have."""
    name = f"v-{uuid.uuid4().hex[:16]}"
    write(f"{path}/{name}")
    system, new_path = _system(spark, path)
    draft = new_path(f"{path}/_draft-{name}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    while True:
        number = (_manifests(spark, path) or [0])[-1] + 1
        target = new_path(f"{path}/{_PREFIX}{number:08d}")
        if not system.exists(target) and system.rename(draft, target):
            return number


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all versions but the last ``keep`` (call when no reader is on them)."""
    system, new_path = _system(spark, path)
    for number in _manifests(spark, path)[:-keep]:
        file = f"{path}/{_PREFIX}{number:08d}"
        folder = f"{path}/{_read(spark, file)}"
        system.delete(new_path(file), False)
        system.delete(new_path(folder), True)
