"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iteration import Steps
from .common import as_rows, as_text, checkpoint, read_documents, squeeze, stored

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one
    space. Level 1 counts rows by length, level 2 counts rows of surviving lengths by
    (length, hash of the first PREFIX_CHARS characters), level 3 compares SHA-256 of the full
    text, only for rows whose level-2 group has several rows. All three are partial
    aggregations over narrow rows, so a group of copies of any size never meets in one task. Each
    level's survivors are written, so rows find them by a broadcast where the files are small and
    else by a join whose large side AQE can split.

    digest_all=False reads full contents only of the surviving rows, in a second scan, and
    text_sha256 is null for the others. digest_all=True is for callers who need every digest:
    it is then taken in the first scan, which costs less than bringing the text to it later.

    Defined cases: null text counts as empty, and empty texts are copies of each other; of
    copies, the smallest doc_id stays, a null one only if all are null; of repeated rows with
    the same doc_id and text exactly one stays; very long texts are compared whole; an empty
    table gives no rows; further columns of the input are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), squeeze(as_text(F.col(text_col))).alias("norm"))
    measures = [F.length("norm").alias("n_chars"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix")]
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    number = F.monotonically_increasing_id()
    rows = checkpoint(base.select("doc_id", *measures, *([digest] if digest_all else [])).withColumn("row_id", number))

    with Steps(docs.sparkSession) as steps:
        lengths = steps.keep(rows.groupBy("n_chars").agg(F.count("*").alias("n")).filter("n > 1").select("n_chars"))
        prefixes = rows.join(lengths, "n_chars", "left_semi").groupBy("n_chars", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("n_chars", "prefix")
        prefixes = steps.keep(prefixes) if digest_all else stored(prefixes, "prefixes")  # else the result reads them
        if digest_all:
            suspects, known = rows.join(prefixes, ["n_chars", "prefix"], "left_semi"), rows
        else:
            suspects = checkpoint(base.select("doc_id", *measures, "norm").join(prefixes, ["n_chars", "prefix"], "left_semi").select("doc_id", "n_chars", "prefix", digest).withColumn("row_id", number))
            known = rows.join(prefixes, ["n_chars", "prefix"], "left_anti").withColumn("text_sha256", F.lit(None).cast("string")).select(suspects.columns).unionByName(suspects)
        groups = stored(
            suspects.groupBy("n_chars", "text_sha256")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best"), F.count("*").alias("group_size"))
            .filter("group_size > 1"), "groups"
        )
    joined = known.join(groups, ["n_chars", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("row_id") == F.col("best.row_id")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Only texts whose length and prefix recur are read in full and hashed. The rows that go are found
    again by doc_id, and their text's hash is compared only where that agrees. Defined cases are those
    of exact_dedup: one row of each text stays, of repeated rows any one.
    """
    found = exact_dedup(docs, id_col, text_col)
    gone = stored(found.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeated")), "copies")
    rows = as_rows(docs).withColumn("doc_id", F.col("row")[id_col])
    sha = F.sha2(squeeze(as_text(F.col("row")[text_col])).cast("binary"), 256)
    same = (sha >= F.col("gone_sha")) & (sha <= F.col("gone_sha"))  # as a range it is no join key, which every row would need
    left = rows.join(gone.filter("not repeated"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & same, "left_anti")
    if not gone.filter("repeated").isEmpty():
        left = left.withColumn("sha", sha).dropDuplicates(["doc_id", "sha"])
    return left.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir), digest_all=True)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
