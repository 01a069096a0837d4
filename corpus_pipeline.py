"""A training-data pipeline over `documents`: five stages, each an operator of gatelake.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm import decontam, langid, line_dedup, ngram_join, packing
from gatelake.llm.common import read_table, shuffle_partitions, staged
from gatelake.session import ship

#: A text is rejected if its language is undetermined or less sure than this.
LEAST_SCORE = 0.5
#: Near copies share at least 4/5 of their five-word shingles. op10's limits are that query's own.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5


#: The columns that stages add for themselves; a table's own of such a name is put aside under another one.
OWN = ("row", "_hash")


def aside(docs: DataFrame) -> dict[str, str]:
    """Names under which columns that clash with a stage's own are kept while it works."""
    return {c: f"{c}_{'x' * 8}" for c in docs.columns if c.lower() in OWN}


def apart(docs: DataFrame) -> DataFrame:
    """docs with row, a number of each row's own in the order of ids (nulls first), then texts: the id itself where ids are unique."""
    docs = docs.withColumnsRenamed(aside(docs))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    n_parts = shuffle_partitions(docs.sparkSession)
    ordered = docs.withColumn("_hash", F.xxhash64("text")).repartitionByRange(n_parts, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash")
    return staged(ordered.withColumn("row", F.monotonically_increasing_id()), "rows")


def as_given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their own names."""
    return rows.drop(*OWN).withColumnsRenamed({v: k for k, v in aside(docs).items()}).select(docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty, by a model of their labels.

    Every row is judged for itself, whatever its id; null texts and texts without a letter go. Other columns, of whatever name, stay."""
    ship(spark)
    model = langid.train(docs)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    told = langid.predict(plain, model, text_col=f"c{docs.columns.index('text')}")
    kept = told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(plain.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that (nearly) repeat an earlier one; those with no line left go, null and empty texts among them.

    Rows with a null or repeated id are documents of their own, earlier and later by id (nulls first), then by a hash of the text. text and n_chars
    change; other columns, of whatever name, stay."""
    ship(spark)
    rows = apart(docs)
    kept = line_dedup.dedup_lines(rows, id_col="row").where(F.length(F.trim(F.col("kept"))) > 0).select(F.col("doc_id").alias("row"), F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
    return as_given(rows.drop("text", "n_chars").join(kept, "row"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of the n-gram Jaccard join.

    Rows with a null or repeated id are documents of their own; a null id is the smallest, and of equal ids the first by a hash of the text. Null
    and empty texts are linked with nothing and stay; so do other columns, of whatever name."""
    ship(spark)
    rows = apart(docs)
    first = ngram_join.join_components(rows, id_col="row", shingle=SHINGLE, num=NUMERATOR, den=DENOMINATOR).where("doc_id = component_id").select(F.col("doc_id").alias("row")).distinct()
    return as_given(rows.join(first, "row", "left_semi"), docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Rows with a null or repeated id are judged each for itself; null and empty texts are
    clean; other columns, of whatever name, stay."""
    ship(spark)
    rows = apart(docs)
    found = decontam.decontaminate(rows, read_table(spark, sf_dir, "benchmark"), id_col="row").where("contaminated").select(F.col("doc_id").alias("row")).distinct()
    return as_given(rows.join(found, "row", "left_anti"), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences. Null and empty texts are one token; rows that share an id are documents of their own."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("language ID", languages), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmarks), ("best-fit packing", sequences)]

#: Training, edit distances and subword tokens aren't SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
