"""From raw documents to packed sequences: clean, deduplicate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnloom.llm.line_dedup import line_dedup
from churnloom.llm.mixing import mixed_documents
from churnloom.llm.ngram_jaccard import ngram_jaccard
from churnloom.llm.packing import pack
from churnloom.llm.quality_rules import quality_rules
from churnloom.plans.stages import cut


def _with_text(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The given columns, with a new text and what follows from it."""
    new = {"text": F.col(text)}
    if "n_chars" in columns:
        new["n_chars"] = F.length(text).cast("long")
    return df.withColumns(new).select(*columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines.

    Null, empty and short texts fail the rules and go. Rows are judged one by one: repeated rows and null ids change
    nothing. An empty table stays empty, as in all stages.
    """
    return _with_text(quality_rules(docs, keep_text=False).where("kept"), "clean_text", docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document that was nothing else goes.

    Texts without lines, null ones too, lose nothing and stay. Null ids come first; rows that agree in id and text lose
    the same lines and all stay, those with one id and different texts are ordered by a hash.
    """
    return _with_text(line_dedup(docs).where("n_removed = 0 or n_removed < n_lines"), "clean_text", docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingles, the one with the smallest id.

    Documents without id are in no group and stay; of rows with one id, one stays.
    """
    kept = ngram_jaccard(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words, null ones too, are not taken. A null source is one of its own, the last. Rows that agree in
    id, source and text share what is taken of them; null ids queue by their texts.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of tokens.

    A null text is an empty one, of the end token alone. Repeated rows are packed each, null ids kept. An empty table has
    no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", clean_documents),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# Shingle sets and tokens of this kind are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each is written and read again by the next.

    Nulls, empty texts and repeated rows fare as each stage says; columns beyond ``doc_id``, ``text``, ``source`` and
    ``n_chars`` are handed on unchanged, whatever their names, up to the last stage. Without documents there are no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
