"""The library against NumPy, pandas and DuckDB."""

import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lattica.functions import arrays as A, quantiles as Q
from lattica.operators import ensemble, explain, forecast, preprocess, synthetic, tuning
from lattica.operators.estimators import Classifier, Regressor
from lattica.operators.panel import Panel
from lattica.operators.predictor import KernelPredictor, weighted_quantiles
from lattica.operators.unsupervised import Conditionals, Unsupervised
from lattica.plans import queries as plans
from lattica.sources import panels
from lattica.streaming import streams

SF = "/root/testdata/sf0.001"


def panel(spark, rows):
    return Panel(spark.createDataFrame(rows, "item_id string, timestamp string, target double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


def values(p):
    return [r.target for r in p.sorted().df.collect()]


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}/*.parquet" if os.path.isdir(f"{SF}/{t}") else f"{SF}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    want, got = con.execute(plans.ORACLE_SQL[name]).df(), plans.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(want.columns)
    plain = lambda df: df[order].astype({c: "datetime64[ns]" for c in order if str(df[c].dtype).startswith("datetime")}).sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, atol=2e-6, rtol=1e-9)


def test_fill_methods_keep_to_items(spark):
    rows = [("a", f"2024-01-0{i + 1}", v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [("b", "2024-01-01", None), ("b", "2024-01-02", 7.0)]
    p = panel(spark, rows)
    assert values(p.fill_missing("auto")) == [1, 1, 1, 1, 4, 4, 7, 7]
    assert values(p.fill_missing("interpolate")) == [None, 1, 2, 3, 4, 4, None, 7]
    assert values(p.fill_missing("constant", -1.0)) == [-1, 1, -1, -1, 4, -1, -1, 7]
    with pytest.raises(ValueError):
        p.fill_missing("spline")


def test_slices_are_python_slices(spark):
    rows = [(k, f"2024-01-{i + 1:02d}", float(i)) for k, n in (("a", 3), ("b", 8)) for i in range(n)]
    p = panel(spark, rows)
    for a in (None, 0, 2, -2, -9, 5):
        for b in (None, 0, 2, -1, -9, 9):
            assert values(p.slice_by_timestep(a, b)) == [float(v) for n in (3, 8) for v in list(range(n))[a:b]]


def test_tails_that_are_not_known_are_refused(spark):
    q = Q.Quantiles(F.array(*(F.lit(float(v)) for v in range(9))), 9, tails="gpd")
    for ask in (q.mean, q.variance, lambda: q.density(F.lit(1.0)), lambda: q.crps(F.lit(1.0))):
        with pytest.raises(NotImplementedError):
            ask()
    assert spark.range(1).select(q.cdf(F.lit(4.0))).first()[0] == pytest.approx(0.5)


def test_a_feature_may_be_called_features(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(60)], "k long, features double, other double, y double")
    got = {}
    for name in ("features", "plain"):
        data = df.withColumnRenamed("features", name)
        model = Regressor().fit(data.drop("k"), "y")
        out = model.predict(data.drop("y"), "k").toPandas().sort_values("k")
        got[name] = out[[c for c in out.columns if c != "k"]].to_numpy(dtype=float)
    assert np.allclose(got["features"], got["plain"])


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("freq", ["D", "2D", "5h", "36h", "7min", "90s", "W", "2W", "3W", "MS", "2MS", "ME", "2ME", "QS", "2QE", "3QS", "YE", "2YS", "B"])
def test_resampling_is_that_of_pandas(spark, zone, freq):
    """Every row falls into one period, whatever the session's time zone; the clocks change on 2024-03-10 in New York."""
    rng = random.Random(freq)
    if freq.endswith(("s", "min")):
        rows = [(k, str(pd.Timestamp("2024-03-10 01:50:00.250") + pd.Timedelta(seconds=rng.randrange(9000))), rng.random()) for k in "ab" for _ in range(60)]
    else:
        rows = [(k, str(pd.Timestamp("2024-02-28 23:30") + pd.Timedelta(minutes=rng.randrange(90 * 1440 if freq[-1] in "Dh" else 900 * 1440))), rng.random()) for k in "ab" for _ in range(120)]
    got = panel(spark, rows).convert_frequency(freq, "sum").sorted().df.select("item_id", F.col("timestamp").cast("string").alias("t"), "target").collect()
    df = pd.DataFrame(rows, columns=["item_id", "timestamp", "target"]).astype({"timestamp": "datetime64[ns]"})
    want = pd.concat({k: g.set_index("timestamp")["target"].resample(freq).sum() for k, g in df.groupby("item_id")})
    assert [(r.item_id, r.t) for r in got] == [(k, f"{t:%Y-%m-%d %H:%M:%S}") for k, t in want.index]
    assert [r.target for r in got] == pytest.approx(want.tolist())
    assert sum(r.target for r in got) == pytest.approx(df.target.sum())


def test_business_days_and_multiples(spark, zone):
    for freq in ("B", "2MS", "2QE", "3YE", "2W-SUN", "D"):
        stamps = pd.date_range("2024-03-06", periods=8, freq=freq)
        p = panel(spark, [("a", str(t), 1.0) for t in stamps])
        assert p.infer_frequency() == freq.removesuffix("-SUN")
        late = [r.timestamp for r in p.build_horizon(4).sorted().df.collect()]
        assert late == [t.to_pydatetime() for t in pd.date_range(stamps[-1], periods=5, freq=freq)[1:]]


def test_frequencies(spark, zone):
    for freq, alias in {"h": "h", "2h": "2h", "D": "D", "MS": "MS", "ME": "ME", "QS": "QS", "YE": "YE", "15min": "15min"}.items():
        stamps = pd.date_range("2023-01-31", periods=6, freq=freq)
        p = panel(spark, [("a", str(t), 1.0) for t in stamps])
        assert p.infer_frequency() == alias
        late = [r.timestamp for r in p.build_horizon(3).sorted().df.collect()]
        assert late == [t.to_pydatetime() for t in pd.date_range(stamps[-1], periods=4, freq=freq)[1:]]
    irregular = panel(spark, [("a", f"2024-01-0{d}", 1.0) for d in (1, 2, 5, 6)])
    assert irregular.infer_frequency() == "IRREG"
    with pytest.raises(ValueError):
        irregular.build_horizon(2)
    with pytest.raises(ValueError):
        irregular.build_horizon(0, "D")


def test_quarters_resampled_to_years(spark):
    p = panel(spark, [("a", str(t), float(i + 1)) for i, t in enumerate(pd.date_range("2020-03-31", periods=8, freq="QE"))])
    for how, want in {"mean": [2.5, 6.5], "sum": [10, 26], "max": [4, 8], "first": [1, 5], "last": [4, 8]}.items():
        got = p.convert_frequency("YE", how)
        assert values(got) == want
        assert [r.timestamp.isoformat()[:10] for r in got.sorted().df.collect()] == ["2020-12-31", "2021-12-31"]


def test_sources_check_what_they_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", float("nan"))], "id string, t string, target double")
    p = panels.from_frame(df, "id", "t")
    assert values(p) == [None]
    p.df.write.parquet(f"{tmp_path}/x.parquet")
    assert panels.from_path(spark, f"{tmp_path}/x.parquet").df.count() == 1
    with pytest.raises(ValueError):
        panels.from_frame(df, "id")
    with pytest.raises(ValueError):
        panels.from_frame(df.withColumn("t", F.lit("never")) .withColumn("t", F.lit(None).cast("string")), "id", "t")
    it = panels.from_iterable(spark, [{"target": [1, 2], "start": "2024-01-31"}, {"target": [3], "start": "2024-02-01"}], "D")
    assert values(it) == [1, 2, 3]
    with pytest.raises(ValueError):
        panels.from_iterable(spark, [[1]], "D")
    with pytest.raises(ValueError):
        p.with_static(spark.createDataFrame([("b", 1)], "item_id string, s int"))
    with pytest.raises(ValueError):
        panels.check_features(df.select("t", "id"), [("id", "string"), ("t", "string")])


def test_distribution_algebra(spark):
    rng = np.random.default_rng(0)
    q = np.sort(rng.normal(size=(6, 99)), axis=1)
    levels = np.array(Q.default_levels(99))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "i int, q array<double>")
    for tails in ("exp", "gpd"):
        d = Q.Quantiles(F.col("q"), 99, tails=tails)
        for a in (0.001, 0.02, 0.37, 0.5, 0.985, 0.9995):
            back = df.select(d.cdf(d.icdf(F.lit(a)))).collect()
            assert np.allclose([r[0] for r in back], a, atol=1e-6)
    d = Q.Quantiles(F.col("q"), 99)
    got = df.select(d.plain_mean(), d.plain_variance(), d.mean(), d.variance(), d.crps(F.lit(0.3)), d.density(F.lit(0.1))).toPandas().to_numpy()
    assert np.allclose(got[:, 0], q.mean(axis=1)) and np.allclose(got[:, 1], q.var(axis=1, ddof=1))
    grid = np.linspace(1e-5, 1 - 1e-5, 20_001)
    k, a = 20, levels
    for i, r in enumerate(q):
        beta = lambda x, y: float(np.clip(abs(np.cov(x, y, bias=True)[0, 1] / y.var()), 0.01, 100))
        bl, br = beta(r[:k], np.log(a[:k])), beta(r[-k:], np.log(1 - a[-k:]))
        z = np.interp(grid, a, r)
        z = np.where(grid < a[0], bl * np.log(grid / a[0]) + r[0], np.where(grid > a[-1], -br * np.log((1 - grid) / (1 - a[-1])) + r[-1], z))
        mean = np.trapezoid(z, grid)
        assert got[i, 2] == pytest.approx(mean, abs=2e-3)
        assert got[i, 3] == pytest.approx(np.trapezoid(z * z, grid) - mean**2, abs=5e-3)
        assert got[i, 4] == pytest.approx(2 * np.trapezoid(((0.3 <= z) - grid) * (z - 0.3), grid), abs=2e-3)


def test_isotonic():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.normal(size=12)
        got = Q.isotonic(v)
        want = [max(min(np.mean(v[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(got, want) and (np.diff(got) >= -1e-12).all()


def test_isotonic_columns(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0], [1.0, 3.0, 1.0]), ([1.0, 2.0, 2.0], [1.0, 1.0, 1.0]), (None, [1.0])], "q array<double>, w array<double>")
    got = df.select(Q.isotonic_quantiles(F.col("q")).alias("a"), Q.isotonic_quantiles(F.col("q"), F.col("w")).alias("b")).collect()
    assert [r.a for r in got] == [[2.0, 2.0, 2.0], [1.0, 2.0, 2.0], None]
    assert [r.b for r in got] == [[1.5, 1.5, 2.0], [1.0, 2.0, 2.0], None]


def test_equal_context_rows_count_each(spark):
    context = spark.createDataFrame([([0.0, 1.0], 0)] * 5 + [([1.0, 0.0], 1), ([0.5, 0.5], 1)], "features array<double>, y int")
    query = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, features array<double>")
    sums = lambda cells: {r.id: r.sums for r in KernelPredictor(1.0, cells).class_sums(context, query, 2).collect()}
    whole, tiled = sums(1000), sums(4)
    assert set(whole) == set(tiled) == {1, 2, 3}
    assert all(np.allclose(whole[i], tiled[i]) for i in whole)


def test_varying_columns(spark):
    rows = [(1, None, None, "a", float("nan")), (1, 2.0, None, "a", float("nan")), (1, 2.0, None, "b", float("nan"))]
    df = spark.createDataFrame(rows, "same int, gap double, none int, two string, nan double")
    assert preprocess.non_constant(df, df.columns) == ["gap", "two"]
    assert preprocess.non_constant(df, df.columns) == [c for c, n in preprocess.unique_counts(df, df.columns).items() if n > 1]
    assert preprocess.non_constant(df.limit(1), df.columns) == df.columns


def test_stream_without_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = streams.batch_files(spark, str(tmp_path / "none"), "item_id string, target double")
    got = streams.drained(stream, str(tmp_path / "out"))
    assert got.count() == 0 and got.columns == ["item_id", "target", "batch"]


def test_permutations():
    sq = ensemble.permutations(6, 4, "latin", 1)
    assert len(sq) == 6 and all(sorted(r) == list(range(6)) for r in sq) and all(sorted(c) == list(range(6)) for c in zip(*sq, strict=True))
    assert ensemble.permutations(5, 1, "latin") == [[0, 1, 2, 3, 4]]
    assert ensemble.permutations(3, 9, "shift") == [[0, 1, 2], [1, 2, 0], [2, 0, 1]]
    p = random.Random(0).sample(range(9), 9)
    assert [p[i] for i in A.inverse_permutation(p)] == list(range(9))
    m = ensemble.members(4, 3, 2)
    assert len(m) == 4 and ensemble.remap(m[0], {1}).features in ((0, 1), (1, 0))


def test_power_and_quantile_normal(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(size=800))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = np.array([r.x for r in preprocess.Power().fit(df, ["x"]).transform(df).collect()])
    assert abs(out.mean()) < 1e-6 and abs(out.std() - 1) < 1e-6 and abs(((out - out.mean()) ** 3).mean()) < 0.35
    z = np.array([r.x for r in preprocess.QuantileNormal().fit(df, ["x"]).transform(df).collect()])
    assert (np.argsort(z, kind="stable") == np.argsort(x, kind="stable"))[100:-100].mean() > 0.99 and abs(z[np.abs(z) < 4].std() - 1) < 0.1
    ppf = spark.createDataFrame([(0.975,), (0.5,), (0.001,)], "p double").select(A.normal_ppf(F.col("p"))).collect()
    assert [r[0] for r in ppf] == pytest.approx([1.959963985, 0, -3.090232306], abs=1e-6)


def test_tiled_context_equals_broadcast(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=4)], int(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int")
    context, late = df.where("id >= 20"), df.where("id < 20").drop("y")
    one = {r.id: r.logits for r in KernelPredictor(0.7).class_logits(context, late, 3).collect()}
    two = {r.id: r.logits for r in KernelPredictor(0.7, broadcast_cells=60).class_logits(context, late, 3).collect()}
    assert all(np.allclose(one[i], two[i]) for i in one) and len(two) == 20


def test_quantiles_of_a_whole_context(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (150, 2)).astype(float)
    y = np.where(np.arange(150) % 3 == 0, 1.0, rng.normal(size=150).round(1))
    late = np.array([[0.0, 1.0], [2.5, 3.0], [0.0, 1.0], [90.0, 0.0]])
    context = spark.createDataFrame([(list(map(float, f)), float(v)) for f, v in zip(x, y, strict=True)], "features array<double>, y double")
    query = spark.createDataFrame([(i, list(map(float, f))) for i, f in enumerate(late)], "id long, features array<double>")
    one = {r.id: r.quantiles for r in KernelPredictor(0.7, levels=39).quantiles(context, query).collect()}
    for cells in (2, 60, 250):
        two = {r.id: r.quantiles for r in KernelPredictor(0.7, broadcast_cells=cells, levels=39).quantiles(context, query).collect()}
        assert len(two) == 4 and all(len(two[i]) == 39 and np.allclose(one[i], two[i]) for i in one)
    keys = [r.k for r in context.select(F.xxhash64("features").alias("k")).collect()]
    order = np.lexsort((keys, y))
    weight = np.exp(-((late[:, None] - x[order][None]) ** 2).sum(axis=2) / (2 * 0.49 * 2))
    want = weighted_quantiles(y[order], weight, np.arange(1, 40) / 40)
    assert np.allclose([one[i] for i in range(4)], want)


def test_two_targets_from_all_orders(spark, tmp_path):
    rows = [(k, n, float(10 * (k % 7) + n), 0.01 * (k % 3), float(n), 0.1 * n) for k in range(1, 601) for n in (1, 2, 3)]
    schema = "l_orderkey long, l_linenumber int, l_extendedprice double, l_tax double, l_quantity double, l_discount double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    again = [(50, 1, 0.0, 0.0, 3.0, 0.3), (50, 1, 0.0, 0.0, 3.0, 0.3)]  # lines that share a row_id
    spark.createDataFrame(again, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["regress_two_targets"](spark, str(tmp_path)).toPandas().set_index("row_id")
    held = pd.DataFrame(rows, columns=["k", "n", "price", "tax", "q", "d"])
    assert sorted(got.index) == sorted([10 * k + n for k in range(50, 601, 50) for n in (1, 2, 3)] + [501, 501])
    both = ["l_extendedprice_mean", "l_tax_mean"]
    pairs = [tuple(r) for r in got.loc[[501], both].round(9).to_numpy()]
    assert sorted(pairs) == sorted([tuple(got.loc[1001, both].round(9)), *[tuple(got.loc[1003, both].round(9))] * 2])
    x = held[held.k % 50 != 0]
    z = x[["q", "d"]].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    assert len(x) == 1764
    for n in (1, 2, 3):
        at = z[(x.n == n).to_numpy()][0]
        w = np.exp(-((z - at) ** 2).sum(axis=1) / (4 * 1764 ** (-1 / 3)))
        order = np.argsort(x.price.to_numpy(), kind="stable")
        want = weighted_quantiles(x.price.to_numpy()[order], w[None, order], np.arange(1, 1000) / 1000).mean()
        assert got.loc[1000 + n, "l_extendedprice_mean"] == pytest.approx(want, rel=1e-6)


def test_all_rows_are_context(spark):
    rng = np.random.default_rng(0)
    n = 5000
    a, c = rng.normal(size=n), np.where(np.arange(n) % 1250 == 7, 9.0, np.arange(n) % 2)  # 9 is rare
    y = a + c
    df = spark.createDataFrame([(i, float(a[i]), float(c[i]), float(y[i])) for i in range(n)], "id long, a double, c double, y double")
    u = Unsupervised().fit(df, ["a", "c"])
    assert len(u.model.raw) == n and (u.model.raw[:, 1] == 9).sum() == 4
    assert len(Unsupervised(max_context=100).fit(df, ["a", "c"]).model.raw) == 100
    z = (a - a.mean()) / a.std()
    few = df.where("id in (7, 8, 1257)")
    got = u.score_samples(few, 1).toPandas().set_index("id")["density"]
    s = n**-0.2 * a.std()
    w = lambda i: np.exp(-((z - z[i]) ** 2) / (2 * n ** (-2 / 5)))
    for i in (7, 8, 1257):
        p = np.exp(-((a[i] - a) ** 2) / (2 * s * s)).mean() / (s * np.sqrt(2 * np.pi))
        assert got[i] == pytest.approx(p * w(i)[c == c[i]].sum() / w(i).sum(), rel=1e-9)
    phi = explain.KernelExplainer(df, ["a"], "y").shapley(few, "id").toPandas().set_index("id")["phi"]
    assert phi[7] == pytest.approx(w(7) @ y / w(7).sum() - y.mean(), rel=1e-9)
    assert Regressor(n_estimators=1).fit(df, "y", ["a"]).limited.count() == n
    assert Regressor(n_estimators=1, max_context=50).fit(df, "y", ["a"]).limited.count() == 50


def test_kernel_queries_read_every_vector(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 900
    x, y = rng.normal(size=(n, 64)).astype(np.float32), rng.integers(0, 3, n)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, late = x.astype(float), np.arange(n) % 5 == 0
    dist = ((x[late][:, None] - x[~late][None]) ** 2).sum(axis=2)
    hot, h = np.eye(3)[y[~late]], 720 ** (-1 / 68)
    weight, logit = np.exp(-dist / (2 * h * h * 64)) @ hot, np.log(np.exp(-dist / (2 * 0.25 * 64)) @ hot[:, 0] + 1e-9)
    got = plans.QUERIES["kernel_class_weights"](spark, str(tmp_path)).toPandas().pivot(index="row_id", columns="class", values="weight").sort_index()
    assert list(got.index) == list(range(0, n, 5)) and np.allclose(got.to_numpy(), weight, atol=1e-5)
    got = plans.QUERIES["kernel_logits"](spark, str(tmp_path)).toPandas().sort_values("vec_id")
    assert list(got.vec_id) == list(range(0, n, 5)) and np.allclose(got.logit, logit, atol=2e-6)


def test_estimators(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    rows = [(i, float(a), float(b), "uvw"[i % 3], "hi" if a > 0 else "lo", float(3 * a + 0.1 * b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, s string, y string, z double")
    train, test = df.where("id >= 30"), df.where("id < 30")
    c = Classifier(n_estimators=2).fit(train, "y", ["a", "b", "s"])
    got = c.predict(test, "id").toPandas().set_index("id")
    assert np.mean([got["prediction"][r[0]] == r[4] for r in rows[:30]]) > 0.85
    assert np.allclose(np.stack(got["proba"]).sum(axis=1), 1)
    masked = c.predict_proba(test.withColumn("b", F.lit(None).cast("double")), "id")
    assert masked.count() == 30
    c.save(f"{tmp_path}/m", spark)
    again = Classifier.load(f"{tmp_path}/m", spark).predict_proba(test, "id").toPandas().set_index("id")
    assert np.allclose(np.stack(again.sort_index()["proba"]), np.stack(got.sort_index()["proba"]))
    r = Regressor(n_estimators=2).fit(train, "z", ["a", "b"])
    out = r.predict(test, "id", ("mean", "median", "variance"), (0.1, 0.9)).toPandas().set_index("id").sort_index()
    truth = np.array([v[5] for v in rows[:30]])
    assert np.corrcoef(out["mean"], truth)[0, 1] > 0.9 and (out["q_0.1"] <= out["q_0.9"]).all() and (out["variance"] >= 0).all()
    with pytest.raises(ValueError):
        r.predict(test, "id", ("mode",))
    with pytest.raises(ValueError):
        c.predict(test.drop("a"), "id")


def test_seasons_and_forecast(spark):
    x = np.sin(2 * np.pi * np.arange(140) / 7) + 0.01 * np.arange(140)
    assert forecast.detect_periods_config(x, forecast.PeriodicConfig())[0][0] == 7
    assert list(forecast.local_peaks(np.array([0, 2, 2, 2, 1, 3, 0]))) == [2, 5]
    rows = [(k, str(t), float(v + s)) for k, s in (("a", 0), ("b", 100)) for t, v in zip(pd.date_range("2024-01-01", periods=140, freq="D"), x, strict=True)]
    df = spark.createDataFrame(rows, "item_id string, timestamp string, target double")
    got = forecast.Forecaster().predict_df(df, prediction_length=7, quantiles=(0.1, 0.5, 0.9)).toPandas()
    assert sorted(got.columns) == ["0.1", "0.5", "0.9", "item_id", "target", "timestamp"] and len(got) == 14
    assert (got["0.1"] <= got["0.9"]).all() and got.groupby("item_id").target.mean().diff().iloc[-1] == pytest.approx(100, abs=3)
    with pytest.raises(ValueError):
        forecast.Forecaster().predict_df(df)
    with pytest.raises(ValueError):
        forecast.resolve(["fourier"])


def test_unsupervised(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    x = np.column_stack((a, 2 * a + 0.1 * rng.normal(size=300), (a > 0).astype(float)))
    rows = [(i, *(None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)] + [(999, 0.0, 30.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    u = Unsupervised().fit(df, ["a", "b", "c"])
    full = u.impute(df).toPandas().set_index("id")
    assert not full.isna().any().any()
    lost = [i for i in range(300) if (i + 1) % 17 == 0]
    assert np.abs(full.loc[lost, "b"] - x[lost, 1]).mean() < 0.9
    density = u.score_samples(df).toPandas().set_index("id")["density"]
    assert density[999] <= density.quantile(0.05)
    made = u.generate(spark, 50).toPandas()
    assert len(made) == 50 and set(made["c"]) <= {0.0, 1.0} and made.equals(u.generate(spark, 50).toPandas())
    assert Conditionals(np.zeros((0, 2)), [False, True]).draw(np.zeros((3, 2)), [0], 1, 1.0, np.full(3, 0.5)).tolist() == [0, 0, 0]


def test_shapley_sums_to_the_prediction(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, r), float(r[0] - r[1])) for i, r in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    e = explain.KernelExplainer(df, ["a", "b", "c"], "y")
    phi = e.shapley(df.limit(5), "id").toPandas().groupby("id").phi.sum()
    q = np.array([r[1:4] for r in rows[:5]])
    full = e._values(q, {frozenset((0, 1, 2))})[frozenset((0, 1, 2))]
    assert np.allclose(phi.sort_index(), full - e.y.mean())
    assert e.interactions(df.limit(2), "id").count() == 6 and explain.importance(e.shapley(df, "id")).count() == 3


def test_synthetic(spark):
    for prior in ("graph", "mlp", "tree", "dummy"):
        x, y, n = synthetic.make_dataset(3, 80, 6, 3, seed=1, prior=prior)
        again = synthetic.make_dataset(3, 80, 6, 3, seed=1, prior=prior)
        assert x.shape == (80, 6) and np.isfinite(x).all() and (x == again[0]).all() and set(y[:n]) == set(y[n:])
    df = synthetic.datasets(spark, 3, 40, 4)
    assert df.count() == 120 and df.select("dataset_id").distinct().count() == 3
    assert synthetic.gaussian_tables(spark, 2, 10, 3).count() == 20
    assert [synthetic.feature_cap(n) for n in (5000, 15_000, 70_000)] == [100, 80, 10]


def test_tuning(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=2) + 3 * (i % 2)], i % 2) for i in range(400)]
    df = tuning.split(spark.createDataFrame(rows, "id long, features array<double>, y int"), "id", by="y").cache()
    assert tuning.coverage(df, "y") and df.where("role = 'query'").count() == 80
    got = tuning.tune_bandwidth(df.where("role = 'context'"), df.where("role = 'query'"), 2, start=8.0, epochs=3)
    assert got.best_loss <= got.history[0][2] and got.best < 8
    assert tuning.chunk_count(130, 60) == 2 and tuning.chunk_count(170, 60) == 3


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 0{h}:{m:02d}:00", float(h)) for h in range(3) for m in (0, 30)] + [("b", "2024-01-01 00:10:00", 5.0)]
    df = spark.createDataFrame(rows, "item_id string, timestamp string, target double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    streams.write_batches(df.coalesce(1), f"{tmp_path}/in", {"rows": len(rows)})
    schema = "item_id string, timestamp timestamp, target double"

    def run(make, mode, name):
        q = make(streams.batch_files(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        for _ in range(60):  # a query with timeouts in its state keeps running empty batches
            if q.awaitTermination(1) or (q.lastProgress and q.lastProgress["batchId"] > 0):
                break
        q.stop()
        return spark.table(name).collect()

    got = run(lambda s: streams.resample_stream(s, "h"), "complete", "hours")
    assert {(r.item_id, r.timestamp.hour, r.n) for r in got} == {("a", 0, 2), ("a", 1, 2), ("a", 2, 2), ("b", 0, 1)}
    last = {}
    for r in run(lambda s: streams.last_rows_stream(s, 3), "update", "ring"):
        last[r.item_id] = r.targets
    assert sorted(last["a"]) == [1.0, 2.0, 2.0] and last["b"] == [5.0]
    context = spark.createDataFrame([([0.0], 0), ([5.0], 1)], "features array<double>, y int")
    scored = run(lambda s: streams.score_stream(s.select("item_id", F.array("target").alias("features")), context, KernelPredictor(1.0), 2), "append", "scored")
    assert all((r.logits[1] > r.logits[0]) == (r.features[0] > 2.5) for r in scored) and len(scored) == 7
    spark.dataSource.register(streams.SyntheticSource)
    assert spark.read.format("lattica_synthetic").option("datasets", 3).option("rows", 20).load().count() == 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shapley_of_many_copies(spark):
    """Equal rows travel and are explained once; values, and rows given back, count every copy."""
    rng = np.random.default_rng(3)
    kinds = [(float(a), float(b), float(y)) for a, b, y in zip(rng.integers(0, 4, 30), rng.integers(0, 3, 30), rng.normal(size=30).round(2), strict=True)]
    x = np.array([r for i, r in enumerate(kinds) for _ in range(1 + i % 5) for _ in range(20)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, 1.0, 0.5)], "id long, a double, b double, y double")
    e = explain.KernelExplainer(df, ["a", "b"], "y")
    assert len(e.x) == len({r[:2] for r in kinds})
    z = (x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0)

    def value(i, s):
        h = len(x) ** (-1 / (len(s) + 4))
        w = np.exp(-((z[:, s] - z[i, s]) ** 2).sum(axis=1) / (2 * h * h * len(s)))
        return w @ x[:, 2] / w.sum()

    phi = e.shapley(df, "id").toPandas().pivot(index="id", columns="feature", values="phi")
    pairs = e.interactions(df, "id").toPandas().set_index("id")
    assert len(phi) == len(pairs) == len(x) + 1 and phi.loc[-1].isna().all()
    for i in (0, 1, 500, len(x) - 1):
        a, b, both, none = value(i, [0]), value(i, [1]), value(i, [0, 1]), x[:, 2].mean()
        assert phi.loc[i].tolist() == pytest.approx([(a - none + both - b) / 2, (b - none + both - a) / 2], rel=1e-9)
        assert pairs.loc[i, "phi"] == pytest.approx(both - a - b + none, rel=1e-9)


def _copied(spark):
    rng = np.random.default_rng(5)
    kinds = np.column_stack((rng.integers(0, 12, 40) + 0.5, rng.integers(0, 9, 40) + 0.25, rng.integers(0, 3, 40)))
    kinds[::7, 1] = np.nan
    x = np.array([r for i, r in enumerate(kinds) for _ in range(10 * (1 + i % 4))])
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    return x, df, Unsupervised().fit(df, ["a", "b", "c"])


def test_density_of_many_copies(spark):
    """Equal rows travel and are scored once, and count as often as they come."""
    x, df, u = _copied(spark)
    assert len(u.model.raw) == len(np.unique(np.nan_to_num(x, nan=-1.0), axis=0)) < len(x) == u.model.counts.sum()
    got = u.score_samples(df, 1).toPandas().set_index("id")["density"]
    assert len(got) == len(x)
    n, ok = len(x), np.isfinite(x[:, 1])
    z = (np.where(ok[:, None] | (np.arange(3) != 1), x, np.nanmedian(x[:, 1])) - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0)

    def weight(i, given, rows):
        w = np.exp(-((z[np.ix_(rows, given)] - z[i, given]) ** 2).sum(axis=1) / (2 * len(rows) ** (-2 / (len(given) + 4)) * len(given)))
        return w / w.sum()

    def normal(i, j, rows):
        s = np.nanstd(x[:, j]) * len(rows) ** -0.2
        return np.exp(-((x[i, j] - x[rows, j]) ** 2) / (2 * s * s)) / (s * np.sqrt(2 * np.pi))

    every, some = np.arange(n), np.flatnonzero(ok)
    for i in (0, 5, 300, n - 1):
        p = normal(i, 0, every).mean() * (weight(i, [0], some) @ normal(i, 1, some) if ok[i] else 1) * weight(i, [0, 1], every)[x[:, 2] == x[i, 2]].sum()
        assert got[i] == pytest.approx(p, rel=1e-9)


def test_imputing_many_copies(spark):
    """Copies are imputed once, as if every one were a context row of its own; other columns and all rows come back."""
    x, df, u = _copied(spark)
    each = Conditionals(x, [False, False, True])
    assert np.allclose((each.mean, each.std, each.warm), (u.model.mean, u.model.std, u.model.warm))
    full = u.impute(df.withColumn("more", F.col("id") + 1)).toPandas().set_index("id").sort_index()
    lost = np.isnan(x[:, 1])
    rows = np.where(lost[:, None] & (np.arange(3) == 1), each.warm[1], x)
    rows[lost, 1] = each.draw(rows[lost], [0, 2], 1, 0.0, np.full(lost.sum(), 0.5))
    assert list(full.columns) == ["a", "b", "c", "more"] and (full["more"] == full.index + 1).all()
    assert np.allclose(full[["a", "b", "c"]], rows) and len(full) == len(x)
    ok = np.flatnonzero(~lost)
    z = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0)
    i = np.flatnonzero(lost)[0]
    order = ok[np.argsort(x[ok, 1], kind="stable")]
    w = np.exp(-((z[np.ix_(order, [0, 2])] - z[i, [0, 2]]) ** 2).sum(axis=1) / (4 * len(ok) ** (-1 / 3)))
    assert abs(rows[i, 1] - weighted_quantiles(x[order, 1], w[None], np.array([0.5]))[0, 0]) < 0.05
    assert u.impute(df, temperature=1.0).count() == len(x)


def test_quantile_normal_of_many_knots(spark):
    """Every value's place among 1,000 knots with ties, as NumPy finds it; the work for a row doesn't grow with the knots."""
    rng = np.random.default_rng(2)
    q = np.sort(np.concatenate((rng.normal(size=900).round(2), np.full(100, 0.5))))
    stage = preprocess.QuantileNormal()
    stage.columns, stage.grid = ["x"], {"x": [float(v) for v in q]}
    x = np.concatenate((q[::9], rng.normal(size=4000).round(3), [0.5, -9.0, 9.0]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "id long, x double").repartition(4)
    got = stage.transform(df).toPandas().set_index("id")["x"]
    assert np.isnan(got[-1]) and len(got) == len(x) + 1

    def place(k):
        k = np.clip(k, 1, len(q) - 1)
        a, b = q[k - 1], q[k]
        return (k - 1 + np.where(b > a, np.clip((x - a) / np.where(b > a, b - a, 1), 0, 1), x > a)) / (len(q) - 1)

    p = np.clip((place(np.searchsorted(q, x, "right")) + place(np.searchsorted(q, x, "left"))) / 2, 1e-7, 1 - 1e-7)
    want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id long, p double").select("id", A.normal_ppf(F.col("p")).alias("z")).toPandas().set_index("id")["z"]
    assert np.allclose(got[list(range(len(x)))], want[list(range(len(x)))], rtol=1e-12, atol=1e-12)
    assert str(stage.column("x")).count("filter(") == 0


def test_tiles_of_bounded_size(spark, monkeypatch):
    """Tiles hold TILE_CELLS numbers however much may be broadcast, and give the same quantiles."""
    from lattica.operators import predictor

    rng = np.random.default_rng(4)
    rows = [(list(map(float, f)), float(v)) for f, v in zip(rng.integers(0, 3, (200, 2)), rng.normal(size=200), strict=True)]
    context, query = spark.createDataFrame(rows, "features array<double>, y double"), spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id long, features array<double>")
    one = {r.id: r.quantiles for r in KernelPredictor(0.7, levels=39).quantiles(context, query).collect()}
    monkeypatch.setattr(predictor, "TILE_CELLS", 40)
    asked, tiled = [], KernelPredictor._tiled_quantiles
    monkeypatch.setattr(KernelPredictor, "_tiled_quantiles", lambda self, *a: asked.append(a[-1]) or tiled(self, *a))
    two = {r.id: r.quantiles for r in KernelPredictor(0.7, broadcast_cells=300, levels=39).quantiles(context, query).collect()}
    assert asked == [10] and len(two) == 9 and all(np.allclose(one[i], two[i]) for i in one)
