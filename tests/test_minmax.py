import numpy as np
import pytest

from tessella.operators import minmax as mm
from tessella.sources.synthetic import normal_matrix

INF, NAN = float("inf"), float("nan")


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")


@pytest.mark.parametrize("values, expected", [([1.0, NAN, 3.0], (1, 3)), ([NAN, NAN], (INF, -INF)), ([], (INF, -INF)), ([None, 2.0], (2, 2))])
def test_fit(spark, values, expected):
    row = mm.minmax_fit(frame(spark, values), ["v"]).first()
    assert (row["data_min"], row["data_max"]) == expected


@pytest.mark.parametrize("v, low, high, expected", [
    (5, 5, 5, 0.0), (7, 5, 5, 0.0), (NAN, 5, 5, NAN), (9, 1, 3, 4.0), (-1, 1, 3, -1.0), (2, INF, -INF, NAN), (2, 1, INF, 0.0), (INF, 1, INF, NAN),
    (3e38, -3e38, 3e38, NAN), (1e-40, 0, 1e-40, INF),
])
def test_transform_edges(spark, v, low, high, expected):
    stats = spark.createDataFrame([("v", float(low), float(high))], mm.STATS)
    got = mm.minmax_transform(frame(spark, [float(v)]), stats, ["v"]).first()["v"]
    assert np.isnan(got) if np.isnan(expected) else got == expected


def test_against_numpy(spark):
    df = normal_matrix(spark, 2000, 6, seed=42, scale=10, shift=100)
    cols = [f"c{k}" for k in range(6)]
    x = df.orderBy("row_id").toPandas()[cols].to_numpy(np.float32)
    got = mm.minmax_fit_transform(df, cols).orderBy("row_id").toPandas()[cols].to_numpy(np.float32)
    low, high = x.min(axis=0), x.max(axis=0)
    np.testing.assert_array_equal(got, (x - low) * (np.float32(1) / (high - low)))


def test_range_clip_and_null(spark):
    stats = spark.createDataFrame([("v", 0.0, 10.0)], mm.STATS)
    got = mm.minmax_transform(frame(spark, [-5.0, 5.0, 20.0, NAN, None]), stats, ["v"], feature_range=(-1, 1), clip=True).orderBy("id").collect()
    assert [r["v"] for r in got[:3]] == [-1.0, 0.0, 1.0] and np.isnan(got[3]["v"]) and got[4]["v"] is None


def test_estimator(spark):
    df = frame(spark, [1.0, 2.0, 5.0])
    scaler = mm.MinMaxScaler(["v"]).partial_fit(df.filter("id < 2")).partial_fit(df.filter("id = 2"))
    assert (scaler.data_min_, scaler.data_max_) == ([1.0], [5.0])
    back = scaler.inverse_transform(scaler.transform(df)).orderBy("id").collect()
    assert [r["v"] for r in back] == [1.0, 2.0, 5.0]
    assert scaler.metrics_ == {"rows": 1} and scaler.get_params() == {"cols": ["v"], "feature_range": (0, 1), "copy": True, "clip": False, "n_jobs": None}
    assert scaler.set_output(transform="default").set_params(clip=True).clip and scaler.get_feature_names_out(["v"]) == ["v"]
    assert [r["v"] for r in mm.MinMaxScaler(["v"], n_jobs=1, copy=False).fit_transform(df, None, sample_weight=None).orderBy("id").collect()] == [0.0, 0.25, 1.0]
    with pytest.raises(ValueError):
        mm.MinMaxScaler(["v"], n_jobs=0)
    with pytest.raises(ValueError):
        scaler.set_output(transform="pandas")
    with pytest.raises(ValueError):
        mm.MinMaxScaler(["v"]).transform(df)
    with pytest.raises(ValueError):
        mm.minmax_transform(df, scaler.stats_, ["w"])


def test_arrays(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [NAN, 7.0])], "id int, a array<float>")
    got = mm.array_transform(df, mm.array_fit(df, "a"), "a").orderBy("id").collect()
    assert got[0]["a"] == [0.0, 0.0] and got[1]["a"] == [1.0, 0.0] and np.isnan(got[2]["a"][0]) and got[2]["a"][1] == 1.0


@pytest.mark.parametrize("given", [[1.0, 2.0, 3.0], [1.0], []])
def test_arrays_of_other_lengths_raise(spark, given):
    stats = mm.array_fit(spark.createDataFrame([([1.0, 5.0],), ([3.0, 6.0],)], "a array<float>"), "a")
    fine = spark.createDataFrame([([2.0, None],), (None,)], "a array<float>")
    assert [r["a"] for r in mm.array_transform(fine, stats, "a").collect()] == [[0.5, None], None]
    with pytest.raises(Exception, match="2 positions were fitted"):
        mm.array_transform(spark.createDataFrame([(given,)], "a array<float>"), stats, "a").collect()


def test_fit_reads_only_its_columns(spark, tables):
    df = spark.read.parquet(f"{tables}/lineitem.parquet")
    plan = mm.minmax_fit(df, ["l_tax"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan
