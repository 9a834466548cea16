"""Documents to token ids in five stages, each an operator of streamloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import bpe, common, exact, minhash, mixing, toxicity


def without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """docs, whose rows ``row`` numbers, without the rows numbered in dropped (one column) and without the numbers."""
    gone = common.small(common.written(dropped.toDF(row), "dropped"))
    return docs.join(gone, row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine scores below one half."""
    model, name = toxicity.fit(docs, common.table(spark, sf_dir, "labels")), common.free(docs, "toxicity")
    return toxicity.scored(docs, model, name=name).where(F.col(f"`{name}`") < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those with equal texts: that with the largest doc_id, the first of several."""
    row = common.free(docs, "row")
    docs = common.numbered(docs, row)
    return without(docs, row, exact.exact_duplicates(docs, row_col=row).where("not kept").select("row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): the first in the order of the files."""
    row = common.free(docs, "row")
    docs = common.numbered(docs, row)
    return without(docs, row, minhash.near_duplicates(docs, id_col=row, size=5, percent=80).where("not kept").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times."""
    name = common.free(docs, "row")
    rows = common.numbered(docs, name)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")  # so that no column of its own clashes with the mix's
    sized = rows.select(whole, F.col(name).alias("row"), mixing._keyed(F.col("source")).alias("src"), common.word_count(F.col("text")).alias("size"))
    plan = mixing.mixing_plan(common.written(sized.select("row", "src", "size"), "sized"))
    taken = mixing.decided(sized, plan).where("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of them and of what they decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", to_tokens)]

#: No stage but exact dedup can be told in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.scope():  # what a stage's operator wrote is removed once its rows are written
            docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept=True)
        common.spent(before)
        before = docs
    return docs
