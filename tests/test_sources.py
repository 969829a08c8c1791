"""Format scans over files, and sinks."""

import pytest
from pyspark.sql import functions as F

from breakwater.functions import genotype
from breakwater.sources import alignments, cnv, sample_tables, sinks, snv, sv
from breakwater.sources.text import lines_to_table, read_lines, read_table


def write(path, *rows):
    path.write_text("\n".join("\t".join(map(str, r)) for r in rows) + "\n")
    return str(path)


def test_simple_table_and_blacklist(spark, tmp_path):
    f = write(tmp_path / "a.txt", ("chr1", "pos1", "chr2", "pos2"), (12, 500, 12, 100), (2, 7, 10, 9))
    out = sv.sv_simple(read_table(spark, f).withColumn("sample", F.lit("S"))).orderBy("original_pos1").collect()
    # Unlike chromosomes compare as strings when loading.
    assert [(r.chr1, r.pos1, r.chr2, r.pos2, r.dir1) for r in out] == [("10", 9, "2", 7, None), ("12", 100, "12", 500, None)]
    bed = write(tmp_path / "b.bed", ("chr1", 5, 9), ("chrX", "x", 3))
    rows = sv.blacklist_bed(read_table(spark, bed, header=False)).collect()
    assert [(r.chrom, r.start_pos, r.end_pos) for r in rows] == [("1", 5, 9)]


def test_vcf_mates_from_file(spark, tmp_path):
    f = write(
        tmp_path / "c.vcf",
        ("##fileformat=VCFv4.2",),
        ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"),
        (1, 10, "a_1", "N", "N[2:20[", ".", "PASS", "MATEID=a_2"),
        (2, 20, "a_2", "N", "]1:10]N", ".", ".", "MATEID=a_1"),
        (1, 30, "b_1", "N", "N[2:40[", ".", "LowQual", "PARID=b_2"),
        (2, 40, "b_2", "N", "]1:30]N", ".", "PASS", "PARID=b_1"),
        (3, 50, "c_1", "N", "N[3:60[", ".", "PASS", "SVTYPE=BND"),
    )
    out = sv.sv_vcf(read_lines(spark, f).withColumn("sample", F.lit("S"))).collect()
    assert [(r.original_id, r.chr1, r.pos1, r.dir1, r.chr2, r.pos2, r.dir2) for r in out] == [
        ("a_1", "1", 10, "+", "2", 20, "-")
    ]


HEAD = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def test_mutect_falls_back_to_first_sample(spark, tmp_path):
    f = write(
        tmp_path / "d.vcf",
        (*HEAD, "tumour"),
        (1, 44395, 0, "A", "C", ".", ".", ".", "GT:AD:BQ:DP:FA", "0:33,15:.:15:0.0"),
        (1, 9, 0, "A", "C", ".", ".", ".", "GT:AD", "0:33,0"),
        (1, 8, 0, "A", "C", ".", "REJECT", ".", "GT:AD", "0:3,9"),
    )
    rows = snv.mutect_vcf(read_lines(spark, f).withColumn("sample", F.lit("other"))).collect()
    assert [(r.chrom, r.pos, r.ref, r.var) for r in rows] == [("1", 44395, 33.0, 15.0)]


def test_base_counts_ask_for_a_known_sample(spark, tmp_path):
    f = write(tmp_path / "e.vcf", (*HEAD, "T1"), (1, 5, ".", "A", "G,C", ".", ".", ".", "BCOUNT", "9,0,4,1"))
    lines = read_lines(spark, f).withColumn("sample", F.lit("x"))
    assert [(r.sample, r.ref, r.var) for r in snv.base_counts_vcf(lines, "T1").collect()] == [("T1", 9.0, 4.0)]
    with pytest.raises(Exception, match="sample T9 is not in"):
        snv.base_counts_vcf(lines, "T9").collect()


def test_strand_counts_genotype_rules(spark, tmp_path):
    fmt = "GT:FAZ:FCZ:FGZ:FTZ:RAZ:RCZ:RGZ:RTZ"
    call = "0|1:10:3:0:0:5:2:0:1"

    def row(pos, info):
        return (1, pos, ".", "A", "C", ".", ".", info, fmt, "0|0:1:1:1:1:1:1:1:1", call)

    f = write(
        tmp_path / "f.vcf",
        (*HEAD, "NORMAL", "TUMOUR"),
        row(1, "TG=AA/AC;SG=AA/AA"),
        row(2, "TG=AA/AA;SG=AA/AT"),
        row(3, "AA/AA=0.1;AC/AA=0.9"),
        row(4, "AC/AG=0.9"),
        row(5, "DP=3"),
    )
    rows = snv.strand_counts_vcf(read_lines(spark, f).withColumn("sample", F.lit("s"))).collect()
    assert sorted((r.pos, r.ref, r.var) for r in rows) == [(1, 15.0, 5.0), (2, 15.0, 1.0), (3, 15.0, 5.0)]


def test_copy_number_formats_are_told_apart(spark):
    def table(names, row):
        data = spark.createDataFrame([("S", 0, "\t".join(row))], "sample string, ordinal long, line string")
        out = cnv.segments(lines_to_table(data, names))
        return out.select(genotype.render(F.col("states"))).first()[0]

    names = [f"battenberg_{n}_A" for n in ("nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2")]
    assert table(["chr", "start", "end", *names], ["1", "1", "9", "2", "1", "0.25", "1", "1", "0.75"]) == "2.0,1.0,0.25|1.0,1.0,0.75"
    assert table(["chromosome", "start", "end", "major_cn", "minor_cn", "star"], ["1", "1", "9", "3", "0", "1"]) == "3.0,0.0,1.0"
    with pytest.raises(ValueError):
        table(["a", "b"], ["1", "2"])


def test_sam_spans(spark, tmp_path):
    f = write(
        tmp_path / "g.sam",
        ("@HD", "VN:1.6"),
        ("q1", 99, "1", 101, 60, "5H10S50M2D3I20M5S", "=", 300, 250, "*", "*"),
        ("q2", 147, "1", 11, 60, "100M", "=", 1, -250, "*", "*"),
        ("q3", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*"),
    )
    rows = {r.query_name: r for r in alignments.sam_lines(read_lines(spark, f).withColumn("sample", F.lit("s"))).collect()}
    assert set(rows) == {"q1", "q2"}
    q1 = rows["q1"]
    assert (q1.ref_start, q1.ref_end, q1.align_start, q1.align_end, q1.len) == (100, 172, 10, 83, 88)
    assert not q1.is_reverse and rows["q2"].is_reverse and rows["q2"].align_end == 100


def test_parameters_and_bad_purity(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    given = spark.createDataFrame([("a", 0.8, 3.0)], "sample string, purity double, ploidy double")
    rows = {r.sample: r for r in sample_tables.sample_params(samples, given, None).collect()}
    assert (rows["a"].purity, rows["b"].purity, rows["b"].ploidy, rows["b"].read_len) == (0.8, 1.0, 2.0, 100)
    bad = given.withColumn("purity", F.lit(1.5))
    with pytest.raises(Exception, match="purity is not between"):
        sample_tables.sample_params(samples, bad, None).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("S1", 1, "1,1,0.7|2,1,0.3"), ("S1", 2, "")], "sample string, id long, g string")
    df = df.select("sample", "id", genotype.parse(F.col("g")).alias("states"))
    sinks.write_tsv(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t" / "sample=S1").glob("*.csv"))
    assert "1.0,1.0,0.7|2.0,1.0,0.3" in text and "2\t\n" in text
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_copy_number_dispatch(spark, tmp_path):
    f = write(tmp_path / "a.csv", ("1,1,100,200,2,1,3,1",), ("2,2,300,400,2,1,2,0",))
    out = cnv.segments(read_lines(spark, f).withColumn("sample", F.lit("S"))).orderBy("chr").collect()
    assert [(r.chr, r.startpos, r.endpos) for r in out] == [("1", 100, 200), ("2", 300, 400)]
    assert [(r.states[0][0], r.states[0][1]) for r in out] == [(2.0, 1.0), (2.0, 0.0)]
    empty = spark.createDataFrame([], "sample string, ordinal long")
    assert cnv.segments(empty).collect() == [] and "states" in cnv.segments(empty).columns
    with pytest.raises(ValueError, match="not recognised"):
        cnv.segments(spark.createDataFrame([], "sample string, ordinal long, a string"))


def test_copy_number_files_of_mixed_formats(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    write(folder / "a.csv", ("1,1,100,200,2,1,3,1",), ("2,2,300,400,2,1,2,0",))
    write(folder / "b.txt", ('"minor_cn"', "star", "chromosome", "end", "start", "major_cn"), (1, 9, "7", 90, 10, 4), (1, 9, "7", 95, 91, "NA"))
    write(folder / "c.txt", ("chr", "startpos", "endpos", "nMaj1_A", "nMin1_A", "frac1_A", "nMaj2_A", "nMin2_A", "frac2_A"))
    (folder / "empty.txt").write_text("")
    lines = read_lines(spark, str(folder)).withColumn("sample", F.regexp_extract("path", "([a-z]+)[.][a-z]+$", 1))
    out = cnv.mixed_segments(lines).select("sample", "chr", "startpos", "endpos", genotype.render(F.col("states")))
    assert sorted(map(tuple, out.collect())) == [
        ("a", "1", 100, 200, "2.0,1.0,1.0"),
        ("a", "2", 300, 400, "2.0,0.0,1.0"),
        ("b", "7", 10, 90, "4.0,1.0,1.0"),
    ]
    write(folder / "d.txt", ("who", "knows"), (1, 2))
    with pytest.raises(Exception, match="not recognised in .*d.txt"):
        cnv.mixed_segments(read_lines(spark, str(folder)).withColumn("sample", F.lit("S"))).collect()
    assert cnv.mixed_segments(lines.limit(0)).collect() == []
