"""Where the library keeps the tables it writes, and the few file-system calls it needs.

Everything goes to the folder the cluster shares between executors. The folder comes from
the session (`spark.checkpoint.dir`, or the context's checkpoint directory); only a local
master without either gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tableview-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") + "/tableview"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _path_and_fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _path_and_fs(spark, path)
    return fs.exists(jpath)


def is_file(spark: SparkSession, path: str) -> bool:
    jpath, fs = _path_and_fs(spark, path)
    return fs.getFileStatus(jpath).isFile()


def delete(spark: SparkSession, path: str) -> None:
    jpath, fs = _path_and_fs(spark, path)
    fs.delete(jpath, True)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the entries of one folder."""
    jpath, fs = _path_and_fs(spark, path)
    if not fs.exists(jpath):
        return []
    return [(status.getPath().toString(), status.getLen()) for status in fs.listStatus(jpath)]


def concatenate(spark: SparkSession, header: bytes, parts: list[str], destination: str) -> None:
    """Write header + parts to a `.part` file and rename it over the destination.

    The bytes flow from stream to stream inside the JVM, never through Python.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(destination)
    partial = jvm.org.apache.hadoop.fs.Path(destination + ".part")
    fs = jvm.org.apache.hadoop.fs.FileSystem.newInstance(target.toUri(), conf)
    fs.setWriteChecksum(False)
    try:
        out = fs.create(partial, True)
        try:
            out.write(bytearray(header))
            for part in parts:
                stream = jvm.org.apache.hadoop.fs.Path(part).getFileSystem(conf).open(
                    jvm.org.apache.hadoop.fs.Path(part)
                )
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 4 * 1024 * 1024, False)
                stream.close()
        finally:
            out.close()
        _rename_over(spark, fs, partial, target)
    except BaseException:
        fs.delete(partial, False)
        raise
    finally:
        fs.close()


def _rename_over(spark: SparkSession, fs, source, target) -> None:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark._jsc.hadoopConfiguration()
    )
    files.rename(fs.makeQualified(source), fs.makeQualified(target), overwrite)


def replace_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file that appears, or takes the place of an older one, when it is whole."""
    write_bytes(spark, path + ".part", data)
    target, fs = _path_and_fs(spark, path)
    _rename_over(spark, fs, spark._jvm.org.apache.hadoop.fs.Path(path + ".part"), target)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jpath, fs = _path_and_fs(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of the library's own, hidden ones included."""
    jpath, fs = _path_and_fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
