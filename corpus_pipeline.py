"""A training corpus from documents: toxicity, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of documents; extra columns go along untouched.
The mixing stage sorts by training position, which its files' names and rows keep; the last stage reads them in that order.

Nulls in any column, empty texts, repeated rows and empty tables pass through every stage: a null text is
clean, has no words and so no near duplicate, and takes no share of the mix (documents without words leave
there); a null id sorts after all others among near duplicates; a null source is a source of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, pieces, secrets, toxicity
from tessera.llm.common import crc_mod, small_batches, table, written, written_bytes
from tessera.llm.queries import model_path

#: The near-duplicate stage: words of a shingle, and the least similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
#: Bytes of the table of row keys that leave up to which it is broadcast; beyond, the rows are joined.
FEW_BYTES = 8 << 20
_ID = "__pipeline_row"


def with_row_id(docs: DataFrame) -> DataFrame:
    """Adds a key of each row, equal rows apart, that sorts by doc_id, nulls last: then a 64-bit hash of the row's file, and its place there.

    Rows that aren't read from files are written first, so that the key is the same wherever it is read.
    """
    first = F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id")
    key = F.struct(*first, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(_ID, key)
    except AnalysisException:
        return written(docs, "rows").withColumn(_ID, key)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on the labels doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.classify(docs, model, docs.columns, only=0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates."""
    keyed = with_row_id(docs)
    found = jaccard.jaccard_components(keyed, _ID, "text", size=SHINGLE, num=SIMILAR, den=100)
    leaves = written(found.where(F.col(_ID) != F.col("component_id")).select(_ID), "leaves")
    return keyed.join(F.broadcast(leaves) if written_bytes(leaves) <= FEW_BYTES else leaves, _ID, "left_anti").select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the secret's kind."""
    small_batches(spark)
    return secrets.redact(docs, "text", "n_chars")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix passes it, in training order: not at all, once or twice; the last one of a source's share is kept whole."""
    return mixing.repeated(docs, mixing.text_order("doc_id", "text"), "text", "source")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document, in the order of the files' names and of the rows in them."""
    small_batches(spark)
    ordered = mixing.with_file_place(docs, _ID).orderBy(_ID)
    return pieces.encode(ordered, model_path()).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_spans),
    ("mixing", mixed_sources),
    ("sentencepiece", tokens),
]

#: SQL can't express the toxicity stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
