from collections import defaultdict

import pyarrow as pa
import pytest

from breakwater.llm import common


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_gapless_in_order(spark, parts):
    rows = [(i % 3, (i * 7919) % 50, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v long, t string").repartition(parts)
    got = sorted((r.number, r.v) for r in common.numbered(df, ["v"]).collect())
    assert [n for n, _ in got] == list(range(300)) and [v for _, v in got] == sorted(v for _, v in got)
    by = defaultdict(list)
    for r in common.numbered(df, ["v", "t"], "g", "slot").collect():
        by[r.g].append((r.slot, r.v, r.t))
    for g, found in by.items():
        assert [(v, t) for _, v, t in sorted(found)] == sorted((v, t) for k, v, t in rows if k == g)
        assert [n for n, _, _ in sorted(found)] == list(range(len(found)))
    assert common.numbered(df.limit(0), ["v"]).collect() == []


def test_scratch_tables(spark):
    df = common.stored(spark.range(5))
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(ValueError):
        common.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert common.small_table(spark, [], a=pa.int64()).collect() == []


def test_blocks_cover_all_texts():
    texts = ["a" * n for n in (0, 5, 100, 3, 3, 3, 0)]
    assert [i for s, e in common.blocks(texts, 7) for i in range(s, e)] == list(range(7))
    assert list(common.blocks([], 7)) == []
