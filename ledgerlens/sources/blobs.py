"""Objects that tasks write to the shared folder, and the size of the batches that
they are made from."""

from __future__ import annotations

import pickle
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Record batches between the JVM and Python of at most ``size`` bytes, so
    that long texts do not add up in either."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != f"{size}b":
        spark.conf.set(key, f"{size}b")


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder (any URI of pyarrow.fs, or a path)."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def save_object(folder: str, name: str, value) -> str:
    """Write a part of a model from a task; returns its URI.  The name is a fresh
    one, so that a task that runs again does not touch what is there."""
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex[:12]}"
    with system.open_output_stream(f"{root}/{file}") as out:
        pickle.dump(value, out, pickle.HIGHEST_PROTOCOL)
    return f"{folder}/{file}"


def load_object(path: str):
    system, file = open_folder(path)
    with system.open_input_stream(file) as stream:
        return pickle.loads(stream.read())
