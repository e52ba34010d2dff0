"""The corpus pipeline: quality rules, near copies, repeated passages, source mix, encoding."""

from pyspark.sql import DataFrame, SparkSession

from tidings.llm import bpe, ngram_join, quality_rules, repeats, source_mix
from tidings.llm.work import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null, empty and blank texts have no words and go; rows that repeat are judged alike; very long texts are judged whole; a posterior at the threshold stays; extra columns stay; no rows, no result rows."""
    return quality_rules.keep_good(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id. Null, empty and blank texts are like nothing and stay, as do rows without an id; of rows with one id and like texts one stays, and one id with unlike texts is judged text by text; very long texts are compared whole; extra columns stay; no rows, no result rows."""
    return ngram_join.drop_near_copies(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur twice go from the texts; the documents stay, also where nothing is left of a text. Null and empty texts stay as they are; rows that repeat are copies and are emptied from 200 bytes on; characters that a passage holds in part stay whole; very long texts are searched whole; extra columns stay, n_chars is counted anew; no rows, no result rows."""
    return repeats.remove_repeats(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null and empty texts count no words and go with their place; a null source is one of its own; rows of one id share a place and are taken together; very long texts count whole; extra columns stay; no rows, no result rows."""
    return source_mix.mix(spark, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of what they decode to. Null and empty texts have no ids; repeated rows are encoded alike, each in a row of its own; very long texts stream; other columns go; no rows, no result rows."""
    return bpe.encode(docs, bpe.vocabulary_path(), with_ids=True)


STAGES = [("quality_rules", quality), ("near_copies", near_copies), ("repeats", passages), ("source_mix", mixture), ("bpe", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return docs
