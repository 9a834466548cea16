"""What the operators share: tables written to the shared folder, size-checked broadcasts, word bytes."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a key and a few numbers) is broadcast: some tens of MB in an executor.
BROADCAST_ROWS = 500_000
#: Bytes of text up to which such a table is broadcast.
BROADCAST_BYTES = 64_000_000

#: Bytes of an Arrow batch that a Python worker is sent.
ARROW_BYTES = 8_000_000

_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a part of the
    warehouse, which is only taken if it isn't a machine's own folder or the executors are threads of the driver."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (house.startswith(("file:", "/")) or ":" not in house) and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return house + "/_scratch"


def new_path(spark: SparkSession, tag: str, kept: bool = False) -> str:
    """A path in the shared folder for a table that is removed when the scope around the call ends (``scope``), and
    in any case when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/streamloom-{tag}-{uuid.uuid4().hex}"
    if _scopes and not kept:
        _scopes[-1].append((spark, path))
    return path


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    system, target = _filesystem(spark, path)
    system.delete(target, True)


@contextlib.contextmanager
def scope():
    """Tables that operators write within it are removed at its end. What they return reads those tables, so write or
    collect the result inside; without a scope they stay until the driver ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, tag: str, kept: bool = False) -> DataFrame:
    """The rows of df written as Parquet in the shared folder and read again: lineage ends here, and
    a lost executor costs no recomputation. What is ``kept`` outlives the scope."""
    spark = df.sparkSession
    own = new_path(spark, tag, kept)
    df.write.parquet(own)
    system, target = _filesystem(spark, own)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(own)
    out._scratch = own
    return out


def spent(df: DataFrame | None) -> None:
    """Remove the table behind what ``written`` returned: nothing reads it any more."""
    if df is not None:
        remove(df.sparkSession, df._scratch)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows and its strings ``size`` bytes, else with
    a merge hint (adaptive execution then splits hot keys). df must be cheap to read, so a written table."""
    fits = df.limit(rows + 1).count() <= rows
    texts = [F.octet_length(f"`{f.name}`") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    if fits and texts:
        fits = (df.agg(F.sum(sum(F.coalesce(x, F.lit(0)) for x in texts))).first()[0] or 0) <= size
    return F.broadcast(df) if fits else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a number for each row as column ``name`` (one that df lacks): its file's place among the files in order of
    their paths, and its place in the file. So the numbers don't depend on how the scan is cut into tasks. What isn't a
    plain scan of Parquet files, or is one of more than ``rows`` files, is written and numbered as written."""
    try:
        meta = df.metadataColumn("_metadata")
        path, place = free(df, "path_of_row"), free(df, "place_of_path")
        paths = df.select(meta["file_path"].alias(path)).distinct()
        files = written(paths.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias(place)), "files")  # of files, not rows
    except AnalysisException:
        files = None
    if files is None or files.count() > rows:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    columns = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumn(path, meta["file_path"]).withColumn(name, meta["row_index"])
    return df.join(F.broadcast(files), path).select(*columns, (F.shiftleft(F.col(place), 36) + F.col(name)).alias(name))


def _trim() -> None:
    """Give freed memory back, as a worker that waits for its next task would else keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) with batches of ARROW_BYTES at most (set for the session, unless it has
    less), after which the worker gives its memory back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES or int(now.rstrip("b")) <= 0:
        df.sparkSession.conf.set(key, str(ARROW_BYTES))

    def run(batches):
        yield from f(batches)
        _trim()

    return df.mapInArrow(run, schema)


def pieces(batches, most: int = 4_000_000):
    """The rows of Arrow batches in batches of some ``most`` bytes, so that a worker holds few texts at once."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in UTF-8: bytes.lower and
    bytes.split touch ASCII only, which is exactly this definition."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_count(text) -> "F.Column":
    """The number of words [^\\x20\\x09-\\x0D]+, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
