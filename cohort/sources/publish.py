"""Names claimed once, folders that appear whole, and versions that readers follow through a manifest.

* ``claim``: of several writers that want a name, one gets it (create-if-absent).
* ``put``: a folder is written beside and renamed to its place, so that a reader sees all of it or nothing.
* ``publish`` / ``current``: every save is a version folder of its own; a manifest of one line names the one that counts
  and is replaced by a rename. A writer that dies leaves the last version in place; readers in the middle of
  an old version go on with it. ``versions`` lists them, ``prune`` deletes all but the newest and the current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MANIFEST = "CURRENT"


def _fs(spark: SparkSession, path: str):
    """(file system, path object) of a path in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. The store decides between writers that come at once."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":  # the local file system's create() looks first and creates then
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(p.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
        return True
    except Py4JJavaError as fault:
        if "FileAlreadyExists" in fault.java_exception.getClass().getName():
            return False
        raise


def claim(spark: SparkSession, base: str, stem: str) -> str:
    """The first of ``stem``, ``stem_1``, ``stem_2``, ... under ``base`` that is neither there nor claimed; it is this caller's."""
    base, i = base.rstrip("/"), 0
    while True:
        name = f"{stem}_{i}" if i else stem
        if not exists(spark, f"{base}/{name}") and _create(spark, f"{base}/_claims/{name}"):
            return name
        i += 1


def _rename(spark: SparkSession, source: str, target: str, replace: bool) -> None:
    jvm = spark.sparkContext._jvm
    _, p = _fs(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    context.rename(p, jvm.org.apache.hadoop.fs.Path(target), options)


def put(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """``write(folder)`` beside ``target``, then rename; raises if ``target`` is there."""
    base, _, name = target.rstrip("/").rpartition("/")
    staged = f"{base}/_staged-{name}-{uuid.uuid4().hex}"
    write(staged)
    _rename(spark, staged, target, replace=False)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` into a fresh version of ``path``, then let the manifest name it; returns the folder."""
    path, version = path.rstrip("/"), uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    write(folder)
    fs, p = _fs(spark, f"{path}/_manifest-{version}")
    out = fs.create(p, False)
    out.write(bytearray(version.encode()))
    out.close()
    _rename(spark, f"{path}/_manifest-{version}", f"{path}/{MANIFEST}", replace=True)
    return folder


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that the manifest names; ``path`` itself where nothing was published."""
    path = path.rstrip("/")
    fs, p = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return path
    stream = fs.open(p)
    version = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{path}/versions/{version}"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Version folders, the oldest first."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/versions")
    if not fs.exists(p):
        return []
    found = sorted(fs.listStatus(p), key=lambda s: (s.getModificationTime(), s.getPath().getName()))
    return [f"{path.rstrip('/')}/versions/{s.getPath().getName()}" for s in found]


def prune(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the current version and the ``keep`` newest ones."""
    stay = {current(spark, path), *versions(spark, path)[-keep:]}
    for folder in versions(spark, path):
        if folder not in stay:
            fs, p = _fs(spark, folder)
            fs.delete(p, True)
