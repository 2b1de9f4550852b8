"""The registered queries of this package: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.shared import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of documents, read back: doc_id, start, n_tokens, ids_crc32."""
    from chronofold.llm.token_files import token_file_report

    return token_file_report(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 1024 tokens."""
    from chronofold.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    from chronofold.llm.exact_dedup import duplicate_report

    return duplicate_report(table(spark, sf_dir, "documents"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    from chronofold.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the fixed patterns' spans, all spans."""
    from chronofold.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fixed rules and the line field's verdict of every document."""
    from chronofold.llm.line_rules import line_quality

    return line_quality(table(spark, sf_dir, "documents"))


def op3_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by nearest-neighbour voting."""
    from chronofold.llm.neighbour_quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the languages' expected totals to tempered weights."""
    from chronofold.llm.mixing import mixture_rates

    docs = table(spark, sf_dir, "documents")
    return mixture_rates(docs, docs.selectExpr("text", "lang as domain"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte passages that start in a document before it."""
    from chronofold.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies (five-word shingles, similarity 0.8) and its number of links."""
    from chronofold.llm.chosen_path import similar_groups

    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_size", "n_links")


QUERIES = {
    "op7_near_duplicates": op7_near_duplicates,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op3_neighbour_quality": op3_neighbour_quality,
    "op5_line_quality": op5_line_quality,
    "op2_secret_scan": op2_secret_scan,
    "op1_url_filter": op1_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op4_pack_sequences": op4_pack_sequences,
    "op8_token_files": op8_token_files,
}


def oracle_sql() -> dict[str, str]:
    from chronofold.llm.exact_dedup import DUPLICATE_SQL

    from chronofold.llm.url_filter import filter_sql

    return {"op1_url_filter": filter_sql(), "op6_exact_dedup": DUPLICATE_SQL}
