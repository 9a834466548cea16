"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest: (digest, keep_id, group_size). New rows are
first reduced to one row per digest (partial aggregates, so a group of copies of any size moves as one
row per task), anti-joined with the index by sort-merge, with no exchange on the index side, and the
new digests appended. The verdict on each digest is a join of the reduced rows with the index, and that on each row
a join of the rows with the verdicts, in which adaptive execution may split a digest that a third of all rows share.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove, table, written

SCHEMA = "digest string, keep_id bigint, group_size bigint"


class DigestIndex:
    """A digest index at ``path``, created if there is none.

    The number of buckets is fixed when the index is made (by default the session's shuffle partitions, so that the
    reduced rows are already dealt as the index is) and read from it later; asking for another number is an error. Each
    batch adds a file to each bucket; after ``MANY`` of them the index is written anew, one sorted file a bucket, as
    the next generation, which counts once it is complete.
    """

    MANY = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marks = [m for m in self._names(self.path) if re.fullmatch(r"_generation=\d+,buckets=\d+", m)]
        if marks:
            self.generation, self.buckets = max(tuple(map(int, re.findall(r"\d+", m))) for m in marks)
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        else:
            self.generation, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._mark()
        self._open()

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def _mark(self) -> None:
        self._files.create(self._path(f"{self.path}/_generation={self.generation},buckets={self.buckets}"), True).close()

    def _open(self) -> None:
        self.location = f"{self.path}/generation-{self.generation}"
        self.name = "digest_index_" + hashlib.sha256(self.location.encode()).hexdigest()[:40]
        self.spark.sql(f"create table if not exists {self.name} ({SCHEMA}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.location}'")

    def entries(self) -> DataFrame:
        """The index as it is, bucketed."""
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"drop table if exists {self.name}")

    def add(self, reduced: DataFrame) -> None:
        """Append the rows of reduced (digest, keep_id, group_size; one a digest) that the index lacks. Digests that it
        has stay as they are, so adding a batch twice changes nothing."""
        new = reduced.repartition(self.buckets, "digest").hint("merge").join(self.entries(), "digest", "left_anti")
        new.select("digest", "keep_id", "group_size").write.insertInto(self.name)
        if sum(n.startswith("part-") for n in self._names(self.location)) > self.MANY * self.buckets:
            self.compact()

    def compact(self) -> None:
        rows, old = self.spark.read.schema(SCHEMA).parquet(self.location), self.location
        self.close()
        before = self._path(f"{self.path}/_generation={self.generation},buckets={self.buckets}")
        self.generation += 1
        self._files.delete(self._path(f"{self.path}/generation-{self.generation}"), True)  # of a run that didn't end
        self._open()
        rows.repartition(self.buckets, "digest").select("digest", "keep_id", "group_size").write.insertInto(self.name)
        self._mark()
        self._files.delete(before, False)
        self._files.delete(self._path(old), True)

    def verdicts(self, reduced: DataFrame) -> DataFrame:
        """reduced (digest and whatever else) with keep_id and group_size of the index."""
        entries = self.spark.read.schema(SCHEMA).parquet(self.location)
        return reduced.drop("keep_id", "group_size").join(entries.hint("merge"), "digest", "left")


def digest(text) -> "F.Column":
    """SHA-256 of the text in UTF-8, lowercase hex; null counts as the empty text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, row_col: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs, and its ``row_col`` as ``row`` if given.

    Of rows with equal texts the one with the largest id stays, of several with that id the first; a row without an id
    stays only if its whole group has none. So exactly one row of a group is kept. Texts are equal if identical; a null
    is an empty text. With an index of earlier batches, a text found there is a copy of that batch's row, and group_size
    is the size of the group that made the entry; a batch that is given again gets the verdicts that it had. ``row_col``
    numbers the rows uniquely; without it they are numbered here. An empty table gives an empty table. Other columns,
    whatever their names, aren't read.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    digests = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"), row.cast("long").alias("row")), "digests")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    reduced = digests.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    reduced = written(reduced.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("best.doc_id").alias("best_id"), (-F.col("best.row")).alias("best_row")), "reduced")
    own = index is None
    index = index or DigestIndex(spark, new_path(spark, "index"))
    index.add(reduced)
    facts = index.verdicts(reduced).select("digest", "keep_id", "group_size", F.when(F.col("best_id").eqNullSafe(F.col("keep_id")), F.col("best_row")).alias("keep_row"))
    facts = written(facts, "facts")
    if own:
        index.close()
        remove(spark, index.path)
    out = digests.join(facts.hint("merge"), "digest")
    more = ["row"] if row_col else []
    return out.select("doc_id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"), *more)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
