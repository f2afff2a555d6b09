"""From raw documents to shards for training: the stages in order, each over all rows that its predecessor kept.

STAGES has (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. The driver of a run writes each stage's rows as Parquet and reads them for the next.

In every stage an empty table gives an empty one, texts are read whole whatever their length, and further columns may
have any name: they are carried along by all stages but the last, which reads doc_id and text alone.
"""

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.decontam import remove_contaminated
from quire.llm.mixing import mix
from quire.llm.packing import shard
from quire.llm.quality import STRICT, filter_quality
from quire.llm.similar import drop_similar

SHARDS = 40
SEED = 0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the strict policy fails. A null or empty text has no words and goes; repeated rows stay or go alike."""
    return filter_quality(docs, STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links and of texts with a five-word Jaccard of 0.8 or more, the one with the smallest doc_id.

    Null ids come last and ties go by the text's hash; of repeated rows one stays. Null, empty and wordless texts have
    fingerprint zero, so they are one component.
    """
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any whole window of any benchmark item. Null and wordless texts stay, as do all under an empty benchmark; repeated rows stay or go alike."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that all sources weigh the same in bytes, in a global random order.

    A null source is a source of its own, a source without bytes is left out, and rows of one doc_id draw one count.
    """
    return mix(docs, seed=SEED)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot; equal texts share a shard, null with empty ones, and repeated rows have slots of their own."""
    return shard(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL has no XXH64 and no union-find to speak of, so the near-duplicate stage keeps it from expressing run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
