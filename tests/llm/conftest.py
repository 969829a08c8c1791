import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use inside; a table may have such columns too.
CLASHING = (
    "number shard slot home grp part fp component_id text_crc32 size _copy _range _hash bin piece n_lines n_dropped lang_pred "
    "score known key cell host page row drop lines lost root node least _at _shift draw column n"
).split()

LONG = "la maison est grande et le jardin aussi " * 6000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),
    (2, "Another text under the same id, which says something else.", "en", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t ", "en", "a"),
    (6, "12345 67890 !!", "de", "a"),
    (7, LONG, "fr", "c"),
    (8, "Zażółć gęślą jaźń 🙂 日本語", "pl", "c"),
    (9, "kurz", "de", "c"),
    (None, "A row without an id.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with
    the names that operators use."""
    base = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return base.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
