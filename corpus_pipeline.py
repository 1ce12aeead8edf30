"""From raw documents to token ids: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import line_dedup, minhash, mixing, pieces, toxicity
from resona.llm.registry import vocabulary_path
from resona.llm.tables import WHITE, cut, table

#: A SentencePiece path depends on a model file and the toxicity stage on trained weights, which SQL cannot express.
ORACLE_SQL = None


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def rest_of(docs: DataFrame) -> Column:
    """All columns but the text, as ``row_of``."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a text and the rest."""
    return found.select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def has_words() -> Column:
    return F.coalesce(F.col("text").rlike(f"[^{WHITE}]"), F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as their texts have it, where they have the column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go; every column of the others stays as it is.

    Null and empty texts score as texts without toxic words and stay, as do repeated rows with equal score; no rows give no rows.
    """
    scored = toxicity.classify(docs.select("doc_id", "text", rest_of(docs)), table(spark, sf_dir, "labels"), threshold=0.7)
    return restored(scored.where(F.col("predicted") == 0), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text, where documents have it.

    Every row stays, with an empty text if all its lines go; rows without doc_id keep their lines; a null text becomes the empty line it counts as; no rows give no rows.
    """
    return counted(restored(line_dedup.dedup_lines(docs.select("doc_id", "text", rest_of(docs)), min_chars=10), docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays.

    Copies are told by their texts' sets of shingles: of rows with the group's smallest doc_id, those with its first text
    stay, once; different texts under one doc_id are different documents. A group without any doc_id keeps one
    row of its first text; texts without words have no group and all stay; no rows give no rows.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    keepers = found.where("keeper AND n_shingles > 0").select("t1", "t2").distinct()
    own = F.struct(F.col("doc_id").isNull(), "doc_id")
    keyed = docs.where(has_words()).select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), own.alias("id"), row_of(docs))
    one = keyed.groupBy("t1", "t2").agg(F.min_by("row", "id").alias("row")).join(keepers, ["t1", "t2"])
    return one.select("row.*").union(docs.where(~has_words()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix: each document as often, and at the ends of a run as far, as the mix takes its words; n_chars follows the text.

    Texts without words take no place in a mix and go; a null source is a source; repeated rows are documents each; no rows give no rows.
    """
    return counted(mixing.take(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the piece ids of every text; a null or empty text has none."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.load(vocabulary_path()))
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("piece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
