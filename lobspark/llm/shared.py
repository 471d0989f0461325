"""What several operators need: written tables that survive lost executors, and reading of the input tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a character class and as characters. Fixed values.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BROADCAST, COUNTED_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="lobspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free_name(columns: list[str], *more: str) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in (*columns, *more)}
    name = "__own"
    while name in taken:
        name += "_"
    return name


@contextmanager
def _set(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted_sizes(spark: SparkSession):
    """Within it, a join broadcasts a side by the bytes that an exchange counted, never by an estimate from files.

    Files of numbers are ten times smaller than a hash table of their rows, and no estimate has the rows that explode() or a
    function on Arrow batches adds, so a limit of 10 MB let hundreds pass through the driver. A hash table of counted rows
    is up to six times larger than they are; the session's limit holds for the table.
    """
    limit = spark.conf.get(COUNTED_BROADCAST, None) or spark.conf.get(BROADCAST)
    size, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", limit.strip().lower()).groups()
    most = int(size) * 1024 ** "bkmgtp".index((unit or "b")[0])
    return _set(spark, {COUNTED_BROADCAST: str(most // 6 if most > 0 else most), BROADCAST: "-1"})


def write_out(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again.

    The write's shuffle files go as soon as it is done (Spark would keep them until the driver collects its garbage).
    A task that is lost before the write ends is computed again from its inputs; afterwards nothing is recomputed.
    The files are removed when the driver ends, or by drop(). batch_bytes: of what goes to Python at once, less than the
    session's own where rows hold long sets.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lobspark/{name}-{uuid.uuid4().hex}"
    with _set(spark, {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lobspark_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes what write_out() wrote for these frames; call it only once nothing lazy reads them any more."""
    for df in frames:
        path = getattr(df, "_lobspark_path", None)
        for entry in [x for x in _written if x[1] == path]:
            _remove(*entry)
            _written.remove(entry)


def written() -> int:
    """How many written tables there are; a mark for drop_since()."""
    return len(_written)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Removes all tables that were written after the mark, but for those of keep: for callers that hold a written result."""
    stay = {getattr(df, "_lobspark_path", None) for df in keep}
    for entry in [x for x in _written[mark:] if x[1] not in stay]:
        _remove(*entry)
        _written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def many_parts(spark: SparkSession, times: int = 1) -> int:
    """Partitions for a heavy shuffle: the session's own number, which the cluster sets by its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times
