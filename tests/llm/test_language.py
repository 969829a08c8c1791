import numpy as np
from pyspark.sql import functions as F

from breakwater.llm import language


def test_held_out_accuracy(documents):
    filters = language.fit(language.training_rows(documents))
    rows = language.identify(documents.withColumn("held_out", language.held_out()), filters).filter("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_sample_bound_and_partitions_do_not_change_much(documents):
    a = language.fit(language.training_rows(documents), sample=20)
    b = language.fit(language.training_rows(documents.repartition(7)), sample=20)
    assert a.languages == b.languages and all((x == y).all() for x, y in zip(a.slices, b.slices, strict=True))


def test_messy_table(messy, spark):
    rows = messy.select(F.col("doc_id").alias("draw"), "text", "lang")
    filters = language.fit(rows.unionByName(rows))  # n-grams must be there twice
    assert set(filters.languages) == {"en", "de", "fr", "pl"}
    got = language.identify(messy, filters).collect()
    assert len(got) == 12 and "shard" in got[0].asDict()
    by = {(r.doc_id, r.text): r.lang_pred for r in got}
    assert by[3, None] == by[4, ""] == by[5, " \n\t "] == by[6, "12345 67890 !!"] == "und"
    assert {by[1, messy.first().text], by[7, [r.text for r in got if r.doc_id == 7][0]]} == {"en", "fr"}


def test_empty_tables(no_rows, messy):
    filters = language.fit(language.training_rows(no_rows))
    assert language.identify(no_rows, filters).collect() == []
    assert {r.lang_pred for r in language.identify(messy, filters).collect()} == {"und"}


def test_many_languages_and_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    alphabets = ["".join(chr(0x4E00 + 40 * i + int(j)) for j in rng.integers(0, 40, 60)) for i in range(70)]
    rows = [(i, a * 3, f"l{i:02d}") for i, a in enumerate(alphabets)]
    filters = language.fit(spark.createDataFrame(rows, "draw long, text string, lang string"))
    assert len(filters.slices) == 2
    for i, a in enumerate(alphabets):
        counts, total = filters.counts(a * 2)
        assert filters.predict(a)[0] == f"l{i:02d}" and counts[filters.languages.index(f"l{i:02d}")] >= 0.95 * total
