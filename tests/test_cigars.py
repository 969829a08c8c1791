"""CIGARs read without regular expressions give what the regular expressions give."""

from pyspark.sql import functions as F

from breakwater.sources import alignments

CIGARS = ["100M", "40S60M", "60M40S", "10S80M10S", "5H40S60M", "60M40S5H", "30M2D70M", "50M3I47M", "20M500N80M", "100=", "*", "M60", "3SM", "4S5M6S7", "5M6", "S5M", "M", "0S9M", "7M7M", "5M3S2S"]


def test_plain_cigars_equal_regular_expressions(spark):
    rows = [(c, f"q\t3\t1\t101\t60\t{c}\t=\t1\t300\t*\t*") for c in CIGARS]
    lines = spark.createDataFrame(rows, "sample string, line string")
    got = {r["sample"]: (r.ref_end, r.align_start, r.align_end, r.len) for r in alignments.sam_lines(lines).collect()}
    c = F.col("sample")
    length = alignments._cigar_sum(c, "MIS=X")
    want = lines.filter(c != "*").select(
        c,
        100 + alignments._cigar_sum(c, "MDN=X"),
        alignments._end_clip(c, r"^(?:[0-9]+H)?([0-9]+)S"),
        length - alignments._end_clip(c, r"[0-9]+[^0-9H]([0-9]+)S(?:[0-9]+H)?$"),
        length,
    )
    assert got == {r[0]: tuple(r)[1:] for r in want.collect()}
    plain = lines.select(c, alignments._plain(c)["_match"].alias("m")).filter("m IS NOT NULL").collect()
    assert {r[0] for r in plain} >= set(CIGARS[:4]) and not {r[0] for r in plain} & {"30M2D70M", "M60", "4S5M6S7", "3SM"}
