"""The corpus pipeline: toxic documents go, copies go, near copies go, sources
are mixed to their target weights, and what is taken is encoded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows of ``docs`` and returns a DataFrame, all but the last with
the columns of ``documents``.  ``run`` applies them to ``documents``, with each
result written as Parquet in the shared folder and read again.

A document that the mix takes twice is two rows.  SQL can't express the
trained and seeded stages, so there is no ``ORACLE_SQL``; the tests hold each
stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import exact_dedup, jaccard_join, mixing, sentencepiece_bpe, toxicity
from tenderlake.llm.common import fresh, saved


NEAR_WORDS, NEAR_PERCENT = 5, 80     # the contract of op10 (3 and 90) binds that query only


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(
        toxicity.fold(F.col("doc_id")) != toxicity.HELD_OUT)
    model = toxicity.fit(docs, labels)
    score = fresh(docs, "score")["score"]
    return toxicity.score(docs, model, keep=tuple(docs.columns), into=score).where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by links (Jaccard similarity of the sets of
    5-word runs of 0.8 or more) one document stays."""
    return jaccard_join.one_of_each(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    got = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), F.col("doc_id"))
    copies = got.columns[len(docs.columns) + 2]     # named apart from the columns of docs
    return (got.where(F.col(copies) > 0)
            .withColumn(fresh(got, "copy")["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
            .select(*docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the pieces' ids of the whole text and their
    number."""
    got = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), drop_text=True, release=True)
    return got.withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
