"""A corpus pipeline of five stages: language, near copies, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again as the next one's docs.
All but the last return the columns of `documents`.

- language: rows whose predicted language is `und` (null or no letter) go, and those judged with a score under that of all
  but one in 10,000 of the labelled rows that were held out.
- near_copies: of each class of near copies the row of the least id stays.
- decontamination: rows that cover a benchmark item go.
- secrets: secrets are replaced by marks, n_chars follows if there is such a column; all rows stay.
- pieces: ids of the pieces and the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.common import stored, table, unused
from bytelore.llm.decontamination import without_covering
from bytelore.llm.language import least_score, train, with_language
from bytelore.llm.near_copies import representatives
from bytelore.llm.pieces import model_path, piece_ids
from bytelore.llm.queries import in_small_batches
from bytelore.llm.secrets import redact_secrets
from bytelore.sources.stored import forget, kept, scratch

#: Tiling, alignment, networks and merges have no SQL form; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    network = train(docs)
    found = with_language(docs, network, lang_pred=lang, score=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= least_score(docs, network))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_covering(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(clean.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_ids(docs, model_path())


STAGES = [(f.__name__, in_small_batches(f)) for f in (language, near_copies, decontamination, secrets, pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next begins; then what it read, and all tables that it wrote on its way, are deleted. The last one's rows are written, too."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with scratch():
            docs = kept(stored(stage(spark, before, sf_dir)))
        forget(before)
    return docs
