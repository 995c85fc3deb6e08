"""A training corpus from ``documents``: quality classifier, near-dedup, substring dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and the next stage reads. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import mixing, near_dup, packing, quality, substring
from stratalog.llm.common import forget, packed, scratch, written


def _unpacked(rows: DataFrame, like: DataFrame, **other) -> DataFrame:
    """The columns of ``like`` from the struct ``row``, those in ``other`` from there."""
    return rows.select(*[other[c].alias(c) if c in other else F.col("row")[c].alias(c) for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on the labelled ones among them.

    A null or empty text has the score of the bias, so the labels decide whether such rows stay. Repeated rows are
    judged alike. All columns are kept, whatever their names. An empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = docs.select(packed(docs, ["text"]).alias("row"), "text")
    return _unpacked(quality.score_quality(rows, model).where("predicted = 1"), docs, text=F.col("text"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8 or more).

    Documents without words stay, each with its own id and text; repeated rows are one document. All columns are kept,
    whatever their names. An empty table gives an empty table.
    """
    return near_dup.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of documents with smaller ids; a document that is all passages goes.

    ``n_chars`` follows a cut. Null and empty texts stay as they are; repeated rows are treated alike. All columns are
    kept, whatever their names. An empty table gives an empty table.
    """
    rows = docs.select(packed(docs, ["text"]).alias("row"), "doc_id", "text")
    cut = substring.drop_repeated_passages(rows).where("removed_words = 0 OR text <> ''")
    length = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
    return _unpacked(cut, docs, text=F.col("text"), n_chars=length.cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one that it takes in part counts as taken.

    Null sources are one source. Texts without words stay once where their turn comes before the budget ends. Rows
    equal in id, source and number of words are taken equally often. All columns are kept, whatever their names. An
    empty table gives an empty table.
    """
    rows = docs.select(packed(docs).alias("row"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    copies = mixing.mix_sources(rows, size=F.col("size")).where("copies > 0")
    copies = copies.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    same = F.expr("r.doc_id <=> c.doc_id AND r.source <=> c.source AND r.size = c.size")
    taken = rows.alias("r").join(copies.alias("c"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _unpacked(taken, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in sequences of at most 2048 tokens.

    A null or empty text is the end token alone; repeated rows are documents of their own. Other columns are left out.
    An empty table gives an empty table.
    """
    pieces = packing.tokenized_pieces(docs, with_ids=False)
    return packing.pack(pieces, order=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``. What a stage leaves in the shared folder goes when its result is written."""
    out, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            out = written(stage(spark, out, sf_dir), name, keep=True)
        if last is not None:
            forget(last)
        last = out
    return STAGES[-1][1](spark, out, sf_dir)


#: The classifier and the minhashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
