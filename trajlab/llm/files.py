"""Files in the shared folder, read and written by tasks through pyarrow's file systems."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's one-slash file:/x is file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


@contextmanager
def written(folder: str, stem: str, suffix: str):
    """(stream, uri) of a new file whose name no other attempt of the task uses; it gets its
    final name on success only, so a lost executor leaves no half file under it."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path}/.{name}.part", compression=None) as out:
        yield out, f"{folder}/{name}"
    system.move(f"{path}/.{name}.part", f"{path}/{name}")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this operator wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
