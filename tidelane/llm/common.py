"""What the operators share: reading tables, the shared folder, row ids, fresh column names."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
#: Runs of anything else, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that Python workers get at once, unless the session has a value of its own (long texts make Spark's default heavy).
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master where that is unset, a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelane-")
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelane/{name}-{uuid.uuid4().hex}"


#: Lists that are open for the paths that ``saved`` writes.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of what is saved within, so that they can be deleted once nothing reads them."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


def _folder(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p, fs = _folder(spark, path)
        fs.delete(p, True)


def touched(spark: SparkSession, path: str) -> None:
    """Makes an empty file, by whatever file system the path is in."""
    p, fs = _folder(spark, path)
    fs.create(p, True).close()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    p, fs = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: this cuts lineage, and any executor can read it again."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    for paths in _open:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of frames from ``saved`` that nothing reads any more."""
    deleted(spark, sorted({f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}))


#: A key that has at least this part of a table's rows is hot: there can't be more of these than so many.
HOT = 10_000


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key and, as ``count``, how many of the ``total`` rows have it (their sum, unless given). Rows
    of hot keys stay where they are and get the side's at most ``HOT`` rows by broadcast; only those of all other keys are shuffled, so that no task gets a
    hot key. Where ``side`` has at most ``HOT`` rows, or no key is hot, one join does. ``size``: the side's rows and its largest count, if they are known; a
    side with more than ``HOT`` rows is read several times, so it should be one that ``saved`` returned, and ``total`` is then given."""
    if size is None:
        *size, summed = side.agg(F.count(F.lit(1)), F.max(count), F.sum(count)).first()
        total = summed if total is None else total
    if size[0] <= HOT:
        return rows.join(F.broadcast(side), keys)
    least = max(total, HOT)
    if size[1] * HOT < least:
        return rows.join(side, keys)
    hot = F.col(count) * HOT >= least
    few = F.broadcast(side.filter(hot))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(side.filter(~hot), keys))


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that the table doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def text_of(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def id_order(column: Column) -> Column:
    """A 60-bit number from the md5 of an id as text: a shuffle that any engine can redo. Null ids count as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")
