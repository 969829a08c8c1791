"""A corpus pipeline of five stages, each one operator of breakwater.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes what a stage returns and reads it for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import common, decontaminate, language, line_dedup, packing, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of some length of which the best language knows less than this is in none of them.
LEAST_KNOWN, SOME_CHARS = 0.2, 40

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter go (null and empty ones too), and those in none of the
    learned languages.  Repeated rows, null ids and texts of any length are rows like others; an
    empty table stays empty."""
    filters = language.fit(language.training_rows(docs))
    found = language.identify(docs.select(*COLUMNS), filters)
    known = (F.col("lang_pred") != language.UNKNOWN) & ((F.col("known") >= LEAST_KNOWN) | (F.length("text") < SOME_CHARS))
    return found.filter(known).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that are boilerplate of their source.  All rows stay; a
    null text stays null, and null sources are one source."""
    slim = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return slim.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of texts alike to 0.8 in shingles of five words the
    document of the least id stays, of rows of equal id one.  Null and wordless texts are one
    group.  Rows without an id cannot be named by a group and stay."""
    docs = docs.select(*COLUMNS)
    groups = common.stored(simhash.near_copies(docs))
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    ids = common.stored(kept.distinct())
    stays = docs.join(ids, "doc_id", "left_semi")
    if kept.count() != ids.count():
        stays = stays.dropDuplicates(["doc_id"])
    return stays.unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of the benchmark go (rows
    without an id cannot be named and stay)."""
    docs = docs.select(*COLUMNS)
    leaks = decontaminate.find_leaks(docs, common.table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 4096 tokens: a row for each piece.  A null text is
    empty (the end id alone); null ids and repeated rows are packed like others; an empty table
    gives no rows."""
    import public_tokenizers

    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Language ID, SimHash, the latent space and token ids cannot be expressed in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
