"""A corpus from raw documents to packed sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents:

* toxicity: rows that the factorization machine scores 0.5 or more go;
* language: rows without a letter or far from every learned language go;
* near_duplicates: of each SimHash group the row with the smallest doc_id stays
  (one of its repeated rows; a group without any id keeps one row);
* repeated_passages: words in repeated 35-word windows go; a text that loses
  none stays as it is, n_chars is that of the new text, no row is dropped;
* packing: one row per piece, with the sequence it goes into.

Each stage first sets the session's Arrow batches to at most ``BATCH_BYTES``
(see ``bounded_batches``); the rows do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import langid, packing, simhash, substring, toxicity
from riskframe.llm.common import Scratch, table
from riskframe.llm.queries import held_out

#: bytes of a batch that Spark hands to Python
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(stage: Callable) -> Callable:
    """Lets Spark end a batch at ``BATCH_BYTES``, unless the session names a lower number.  By default mostly
    the number of rows ends it: batches grow with the texts, and so does the memory outside the heap that an executor
    keeps from them stage after stage.  Set before a stage and not reset, as its result runs later."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark.conf.get(_BATCH)
        if not now.isdigit() or int(now) > BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


@bounded_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic."""
    labels = table(spark, sf_dir, "labels").where(~held_out(0, 5))
    model = toxicity.train(docs, "doc_id", "text", labels, "doc_id", "toxic")
    return docs.where(model.column(F.col("text")) < 0.5)


@bounded_batches
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise."""
    out = langid.learn_and_identify(docs, "text", "lang", F.lit(True), F.struct(*docs.columns))
    return out.where(~F.col("rejected")).select("kept.*")


@bounded_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs, "doc_id", "text", shingle=3, max_bits=3)


@bounded_batches
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated 35-word windows."""
    cut = substring.remove_repeats(docs, F.struct(*[c for c in docs.columns if c != "text"]), "text",
                                   window=35, respace=False)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("id")[c].alias(c) for c in docs.columns])


@bounded_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of permitted lengths."""
    return packing.pack(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", substring_stage),
    ("packing", packing_stage),
]

#: The fitted models and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
