from __future__ import annotations

from quillon.plans import QUERIES


def test_mask_pairs_make_runs_once_a_mask(spark, tmp_path):
    spark.createDataFrame([(0, 5), (1, 5), (30, 3)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["mask_overlap_pairs"](spark, str(tmp_path))
    # The join of pairs takes intervals, not run lengths.
    pairs = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "named_struct(end, 0" not in pairs and "slice(" not in pairs
    assert sorted(map(tuple, df.select("a", "b", "shared").collect())) == [(0, 1, 24)]
