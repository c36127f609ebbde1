"""Shared storage for intermediate tables, and the table reader.

Lineage is cut with written tables in the folder that the cluster names in
``spark.checkpoint.dir``: all executors share it, so a lost executor costs a
re-read and not a recomputation.  Where the setting is absent (tests, one
machine) a temporary folder takes its place and is set as checkpoint folder.
Written tables are deleted by the operator that is done with them (``discard``)
or by the caller once its results are out (``sweep``).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only if unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="engramql-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage beyond it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


_written: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete all tables that this process wrote by ``cut``; for callers whose results are written or collected."""
    for path in _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_written)
    _written.clear()
    return n


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that no later plan reads."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shared_files(table: DataFrame) -> list[str]:
    """The files of a table written by ``cut``: every executor can read them."""
    return sorted(table.inputFiles())


def read_shared(files: list[str], columns: list[str], where=None) -> Iterator[pa.RecordBatch]:
    """Rows of shared files from within a task, one at a time; ``where`` is a pyarrow filter."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    if not files:
        return
    system, _ = fs.FileSystem.from_uri(files[0])
    paths = [fs.FileSystem.from_uri(f)[1] for f in files]
    scan = ds.dataset(paths, filesystem=system, format="parquet").scanner(columns=columns, filter=where, batch_size=1, batch_readahead=1, fragment_readahead=1, use_threads=False)
    yield from (b for b in scan.to_batches() if b.num_rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
