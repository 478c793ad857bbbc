"""A corpus from documents to tokens: toxicity, exact and near duplicates, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir). run() writes what a stage returns as Parquet
in the shared folder and reads it back as the next one's input. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarix import storage
from planarix.llm import bpe, exact_dedup, mixing, queries, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's own input, doesn't predict toxic.

    Null and empty texts hold no evidence and stay, as do all where no row or only one class is labelled
    (all go if all labels are toxic). Equal texts share their fate, whatever their length. An empty table
    stays empty.
    """
    labels = queries.table(spark, sf_dir, "labels", "doc_id", "toxic").where(~queries.held_out())
    return _apart(docs, lambda d: toxicity.score(d, toxicity.fit(d, labels)).where("predicted = 0"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, one row: the document with the largest identifier.

    Null texts count as empty. Null identifiers lose against any other. Of rows that repeat identifier
    and text one stays.
    """
    ident, row = F.col("doc_id"), F.monotonically_increasing_id()
    number = lambda v: F.lpad(F.hex(v), 16, "0")
    # bytes that are ordered as (doc_id, place in the files), null first: no two rows are equal, so no second pass is needed
    key = F.unhex(F.concat(F.when(ident.isNull(), "00").otherwise("01"), number(F.coalesce(ident.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), number(row)))
    return _apart(docs, lambda d: exact_dedup.deduplicate(d.withColumn("row_key", key), id_col="row_key", keep="largest").where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more over 5-word shingles, the document with the smallest identifier.

    SimHash fingerprints and their covering tables give the candidates, the whole shingle sets decide.
    Texts without words are one group. Null identifiers stay only where their group has no other. Rows
    that repeat identifier and text share their fate.
    """
    found = lambda d: simhash.near_duplicates(d, shingle=5, similarity=0.8)
    return _apart(docs, lambda d: found(d).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice.

    Null texts have no words, and a null source is a source of its own. Rows that repeat an
    identifier share their number of copies. Without any words every target is 0, and nothing is taken.
    """
    return _apart(docs, lambda d: mixing.mix(d).withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))))


def _apart(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of `docs` that `apply` keeps, with their own columns, also those named as an operator names its results."""
    names = {c: f"own_{n}" for n, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    return apply(docs.withColumnsRenamed(names)).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, and whether decoding them gave the text back.

    One row a row of the input, repeated ones too; null and empty texts have no ids. Texts are
    encoded whole.
    """
    same = lambda text, ids, decoded: (ids, len(ids), decoded == text)
    return bpe.round_trip(docs, queries.tokenizer_path(), "ids array<int>, n_tokens bigint, round_trip boolean", same, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: The classifier and XXH64 are out of SQL's reach; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, storage.materialise(stage(spark, docs, sf_dir), name)
        storage.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
