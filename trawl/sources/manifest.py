"""Versioned manifests: what a table consists of, published by one rename.

``<root>/_manifest/<version>.json`` names the live parts of a table. A writer reads the last version,
writes its parts, then renames a finished file to the next version's name; the rename fails if that
version is there already. Readers so see all of a change or nothing, and of two writers that read
the same version one gets ``VersionTaken``. Works on any Hadoop file system Spark can write to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer published the next version first."""


def _folder(spark: SparkSession, root: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_manifest")
    conf = spark._jsc.hadoopConfiguration()
    return jvm, folder, folder.getFileSystem(conf), conf


def read(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last version and its contents; ``(0, {})`` before the first."""
    jvm, folder, fs, _ = _folder(spark, root)
    if not fs.exists(folder):
        return 0, {}
    versions = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName()[:-5].isdigit()]
    if not versions:
        return 0, {}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{max(versions):012d}.json"))
    try:
        return max(versions), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, version: int, contents: dict) -> int:
    """Make ``contents`` the version after ``version`` (the one that was read)."""
    jvm, folder, fs, conf = _folder(spark, root)
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(contents).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{version + 1:012d}.json")
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(draft, target, how)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            raise VersionTaken(f"{root}: version {version + 1} is there already") from None
        raise
    return version + 1
