"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import read, written
from folio.llm.decontamination import find_contamination
from folio.llm.mixing import mix
from folio.llm.ngram_jaccard import ngram_jaccard
from folio.llm.quality_rules import quality_rules
from folio.llm.queries import tokenizer_path
from folio.llm.token_ids import read_token_ids, write_token_ids


def _packed(docs: DataFrame) -> DataFrame:
    """The input's columns as one struct, so that no name of a stage's own is one of theirs; beside it the id and a hash of the text, as the operators name rows."""
    return docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("_key"))


def _of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only what an operator needs."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = docs.select(F.struct("*").alias("row"))
    return quality_rules(rows, "row.text", "row.lang", "row.source").where("_q.kept").select("row.*")


def _same(id_col: str, key_col: str):
    return F.col("_id").eqNullSafe(F.col(id_col)) & (F.col("_key") == F.col(key_col))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id, of rows with equal id and text one. Null ids stay.

    Rows of one id are one document: they go together if its texts are copies of a smaller id's.
    """
    found = ngram_jaccard(_of(docs, "doc_id", "text"), n=5, num=80, den=100)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "copies")
    rows = _packed(docs).join(gone, F.col("_id") == F.col("gone_id"), "left_anti")
    again = rows.groupBy("_id", "_key").count().where("count > 1").select(F.col("_id").alias("again_id"), F.col("_key").alias("again_key"))
    again, on = written(again, "repeated"), _same("again_id", "again_key")
    once = rows.join(again, on, "left_semi").dropDuplicates(["_id", "_key"])
    return rows.join(again, on, "left_anti").unionAll(once).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 is in a benchmark phrase; their texts are left as they are."""
    found = find_contamination(_of(docs, "doc_id", "text"), read(spark, sf_dir, "benchmark"), window=13)
    gone = written(found.where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "contaminated")
    return _packed(docs).join(gone, _same("gone_id", "gone_key"), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows with equal id and text are taken equally often."""
    taken = mix(_of(docs, "doc_id", "text", "source")).where("copies > 0").groupBy(F.col("doc_id").alias("taken_id"), F.col("text_key").alias("taken_key")).agg(F.max("copies").alias("copies"))
    rows = _packed(docs).join(taken, _same("taken_id", "taken_key"))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back: doc_id, start, n_tokens, ids_crc32."""
    files = write_token_ids(_of(docs, "doc_id", "text"), tokenizer_path(), end_id=2)
    return read_token_ids(files, digests=True)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("ngram_jaccard", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: Quantile sketches and the tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
