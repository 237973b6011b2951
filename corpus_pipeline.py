"""The corpus pipeline: documents through five operators, each stage's result written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept and returns the columns of `documents`, the last one two more. Clean
documents pass every filtering stage unchanged. Nulls: a null text has no letters and goes at the first stage; a null lang,
source or n_chars passes through. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, cut
from quarry.llm.decontaminate import match_benchmark, remove_matches
from quarry.llm.langid import UNDETERMINED, calibrate, fit_languages, held_out, predict_languages
from quarry.llm.mixing import mix_documents
from quarry.llm.neardup import keep_one
from quarry.llm.secrets import findings_of, redact, scan_secrets, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of no determinable language (null, without letters, or scored below all clean held-out ones) go.

    A null lang becomes the prediction, and so does a lang that a sure prediction contradicts, if the model knows that lang (one it
    was fitted on can sway it). Without
    a lang to learn from, documents with letters stay as they are.
    """
    held = held_out()
    model = fit_languages(docs, ~held) or fit_languages(docs)
    if model is None:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    least, sure = calibrate(docs.filter(held), model)
    found = predict_languages(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    confident = F.lit(False)
    for lang, usual in sure.items():
        confident = F.when(F.col("lang_pred") == lang, F.col("score") >= usual).otherwise(confident)
    wrong = F.col("lang").isin(model.languages) & (F.col("lang") != F.col("lang_pred")) & confident
    return found.select("doc_id", "text", F.when(F.col("lang").isNull() | wrong, F.col("lang_pred")).otherwise(F.col("lang")).alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: five-word shingles, similarity of 0.8 or more; the document of the smallest id of each group stays."""
    return keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: matched passages are cut out; documents that consist of them for more than 80 % go."""
    return _resized(remove_matches(match_benchmark(_sized(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every found secret is replaced by a mark; no document goes."""
    return _resized(redact(scan_secrets(_sized(docs), train(findings_of(docs)))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the columns of documents, and how many words of each (`taken`, repeats counted) the mix takes; rows of none go."""
    return mix_documents(docs.select(*COLUMNS)).filter("taken > 0")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.length("text").alias("chars_before"))


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars anew where a stage has changed the text; elsewhere as it was."""
    now = F.length("text")
    return docs.withColumn("n_chars", F.when(now != F.col("chars_before"), now.cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def _bounded(stage: Stage) -> Stage:
    """The stage, in a session whose Arrow batches of texts are bounded (unless its owner has chosen their size)."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _bounded(stage)) for name, stage in (("language ID", identify_language), ("near-dedup", drop_near_duplicates), ("decontamination", decontaminate), ("secret scan", remove_secrets), ("mixing", mix))]
#: Models and minima of hashes aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of `sf_dir`, one after another; lineage is cut between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) - 1 else docs
    return docs
