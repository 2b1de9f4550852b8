"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before kept, is written as Parquet and read again. The first four return the columns
of documents; the last one returns a row per token piece with its place in a sequence.

Awkward rows: a missing text counts as the empty one in every stage. Empty texts score the labels' share of good documents, are
equal to each other (one stays), have no near copies, no tokens to mix (they appear at their domains' rate), and are packed as the
end id alone. Rows without doc_id are never learned from, lose ties against rows with one, and keep their missing doc_id. Of rows that
are equal in every column exact dedup keeps one. Further columns of any name pass through the first four stages. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.chosen_path import one_of_each
from chronofold.llm.exact_dedup import deduplicate
from chronofold.llm.mixing import mix_documents
from chronofold.llm.neighbour_quality import keep_good
from chronofold.llm.packing import pack_documents
from chronofold.llm.shared import made, release, stored, table

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours among the labelled ones are mostly good; the others go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (white space aside): the longest, then the one of the least doc_id."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that languages come near their tempered weights; none is lost."""
    return mix_documents(docs, docs.selectExpr("text", "lang as domain"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Latent-semantic voting, chosen paths and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        mark = made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            release(spark, mark, keep_last=True)  # what the stage has written on its way
    return docs
