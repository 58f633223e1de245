"""A corpus pipeline of five operators, each stage over all that the one before kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import bpe, decontaminate, langid, pii, simhash
from lexigrid.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with every column but text under a name that no operator gives, so that columns of its own stay as they are."""
    return docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else f"__own_{i}") for i, c in enumerate(docs.columns)))


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, under their names."""
    return found.select(*(F.col("text" if c == "text" else f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; those without a letter, null ones too, go.

    The model learns from the text and lang of docs. Rows that repeat stay or go
    together; without any lang to learn, and in an empty table, none stays.
    """
    return _back(langid.identify(_aside(docs), langid.train(docs)).where(~F.col("rejected")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    Shingles of five words and a similarity of 0.8: fingerprints of 256 bits
    give the candidates, with a radius three deviations beyond the distance of
    two texts of just that similarity, and the sets of shingles decide. Rows with
    a null doc_id stay, as no other row can be told from them; of rows that
    repeat a doc_id all stay or go. Texts without words are one group; an empty
    table gives an empty one.
    """
    lanes, similarity = 4, 0.8
    found = simhash.near_duplicates(docs, words_per_shingle=5, lanes=lanes, radius=simhash.radius_for(similarity, 64 * lanes), similarity=similarity)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none.

    Rows that repeat stay or go together; an empty table stays empty.
    """
    found = decontaminate.find_contamination(_aside(docs), table(spark, sf_dir, "benchmark"))
    return _back(found.where("n_hit = 0"), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text.

    Null texts stay null, with a null n_chars; repeated rows are redacted alike;
    an empty table stays empty.
    """
    found = _back(pii.find_pii(_aside(docs), pii.train(docs), redact=True), docs)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, where each ends, and whether they decode to its text.

    Null and empty texts have no ids. Columns of docs that documents has not are
    left out, whatever their names; an empty table gives an empty one.
    """
    coded = bpe.encode(docs.select(*COLUMNS), bpe.rank_file(spark), decoded=True)
    exact = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"), F.lit(False))
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", "ends", F.size("ids").cast("bigint").alias("n_tokens"), exact.alias("round_trip"))


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("tokenize", tokenize),
]

#: SQL can express neither the fingerprints nor the learned models; the stages are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
