from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionloom.models import classification, clustering, cross, decomposition, expansion, kalman, kernel, regression, series, tree
from regionloom.session import staging_folder


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(180), "a": x[:, 0], "b": x[:, 1], "y": np.repeat(["p", "q", "r"], 60)})).repartition(4)


@pytest.mark.parametrize("fit", [classification.logistic_regression, classification.naive_bayes, classification.decision_tree, classification.svm])
def test_classifiers_separate_blobs(blobs, fit):
    _, predictions, metrics = fit(blobs, ["a", "b"], "y")
    row = metrics.first()
    assert row["accuracy"] > 0.97 and row["f1"] > 0.97 and row["n"] == 180
    assert predictions.where("predicted_label = y").count() > 174


def dual(x, y, gamma, c):
    """The dual by projected gradient with the balance as a multiplier that is bisected: slow, and another way altogether."""
    q = kernel.kernel(x, x, gamma) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        z = alpha - step * (q @ alpha - 1)
        low, high = -100.0, 100.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (np.clip(z - middle * y, 0, c) * y).sum() > 0 else (low, middle)
        new = np.clip(z - low * y, 0, c)
        if np.abs(new - alpha).max() < 1e-10:
            break
        alpha = new
    return alpha


@pytest.mark.parametrize("noise", [0.3, 1.2])
def test_machine_is_the_solution_of_the_dual(spark, noise):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (150, 2))
    y = np.where((x**2).sum(axis=1) + noise * rng.normal(0, 1, 150) > 1.3, 1.0, -1.0)
    alpha = dual(x, y, 0.5, 1.0)
    sums = kernel.kernel(x, x, 0.5) @ (alpha * y)
    df = spark.createDataFrame([(i, [float(v) for v in p], float(c)) for i, (p, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    other = df.limit(3).selectExpr("id + 1000 AS id", "x", "0D AS y")  # rows of other classes only get decision values
    for working in (1024, 40):
        found = kernel.machine(df.unionByName(other), 0.5, 1.0, working=working, most_passes=200)
        rows = {r["id"]: r for r in found.rows.collect()}
        assert found.gap <= 1e-3 and len(rows) == 153
        assert [rows[i]["sum"] for i in range(150)] == pytest.approx(sums, abs=0.02)
        a = np.array([rows[i]["alpha"] for i in range(150)])
        assert (a >= 0).all() and (a <= 1).all() and abs((a * y).sum()) < 1e-9
        value = lambda v: v.sum() - 0.5 * (v * y) @ kernel.kernel(x, x, 0.5) @ (v * y)
        assert value(a) == pytest.approx(value(alpha), rel=1e-3)
        assert rows[1000]["alpha"] == 0


def test_passes_leave_no_copies_of_the_rows(spark):
    """Only the last pass's table stays, and the cascade starts from full nodes."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(0, 1, (300, 2)), np.where(rng.random(300) < 0.5, 1.0, -1.0)
    df = spark.createDataFrame([(i, [float(v) for v in p], float(c)) for i, (p, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    folder = Path(staging_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = kernel.machine(df, 0.5, 1.0, working=40, most_passes=12)
    assert found.passes == 12 and found.rows.count() == 300
    # 300 rows are 9 nodes of 36 rows, so 5 levels; then the last pass
    assert len(set(folder.iterdir()) - before) <= 6


@pytest.mark.parametrize("features", [1, 2, 3, 4])
def test_expansion_is_the_kernel(features):
    rng = np.random.default_rng(features)
    x = rng.uniform(-1.8, 1.8, (60, features)) * np.arange(1, features + 1) ** 0.5
    x[:, -1] = 0.5 if features == 3 else x[:, -1]  # a feature of one value
    e = expansion.expansion(x.min(axis=0), x.max(axis=0), 0.25)
    a, b = e.values(x, tuple(len(sizes) for _, sizes in e.sides))
    assert (a @ a.T) * (b @ b.T) == pytest.approx(kernel.kernel(x, x, 0.25), abs=1e-10)
    few, more = e.terms(1e-4), e.terms(1e-8)
    assert all((f == m[: len(f)]).all() for f, m in zip(few, more, strict=True))
    assert expansion.expansion(np.full(9, -1.8), np.full(9, 1.8), 0.25) is None or len(few[0]) < len(more[0])


def violation(y, alpha, sums, c=1.0):
    up, low = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
    return (y - sums)[up].max() - (y - sums)[low].min()


@pytest.mark.parametrize("held, bent, working", [(1 << 16, 1 << 19, 64), (0, 100, 64), (1 << 16, 1 << 19, 30)])
def test_machine_of_unrelated_labels_is_solved_to_the_gap(spark, monkeypatch, held, bent, working):
    """Nearly all rows are support vectors, as on ``l_linestatus``: rows in the driver, in blocks, and by working sets alone."""
    monkeypatch.setattr(expansion, "HELD_ROWS", held)
    monkeypatch.setattr(expansion, "_BENT_ROWS", bent)
    monkeypatch.setattr(expansion, "_CELLS", 256)
    monkeypatch.setattr(expansion, "_BENT_CELLS", 256)
    monkeypatch.setattr(expansion, "_PIECE", 1000)
    if working == 30:
        monkeypatch.setattr(expansion, "MOST_TERMS", 0)
    n = 1500 if working == 64 else 90
    rng = np.random.default_rng(11)
    x, y = rng.uniform(-1.7, 1.7, (n, 2)), np.where(rng.random(n) < 0.5, 1.0, -1.0)
    df = spark.createDataFrame([(i, [float(v) for v in p], float(c)) for i, (p, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    other = df.limit(3).selectExpr("id + 10000 AS id", "x", "0D AS y")
    found = kernel.machine(df.unionByName(other), 0.5, 1.0, working=working)
    rows = {r["id"]: r for r in found.rows.collect()}
    assert len(rows) == n + 3 and found.gap <= 1e-3
    alpha, sums = (np.array([rows[i][name] for i in range(n)]) for name in ("alpha", "sum"))
    assert (alpha >= 0).all() and (alpha <= 1).all() and abs((alpha * y).sum()) < 1e-7
    assert sums == pytest.approx(kernel.kernel(x, x, 0.5) @ (alpha * y), abs=1e-7)
    assert violation(y, alpha, sums) <= 1e-3
    first = {r["x"][0]: i for i, r in rows.items() if i < n}
    for i in rows.keys() - set(range(n)):
        assert rows[i]["alpha"] == 0 and rows[i]["sum"] == pytest.approx(rows[first[rows[i]["x"][0]]]["sum"], abs=1e-9)


def test_support_vectors_of_rings_and_of_one_class(spark):
    """What no line can part."""
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 2 * np.pi, 400), np.repeat([1.0, 3.0], 200) + rng.normal(0, 0.2, 400)
    df = spark.createDataFrame(pd.DataFrame({"a": radius * np.cos(angle), "b": radius * np.sin(angle), "y": np.repeat(["in", "out"], 200)}))
    model, predictions, metrics = classification.svm(df, ["a", "b"], "y")
    assert metrics.first()["accuracy"] > 0.99 and model.gap <= 1e-3 and predictions.count() == 400
    _, predictions, metrics = classification.svm(df.where("y = 'in'"), ["a", "b"], "y")
    assert metrics.first()["accuracy"] == 1.0 and predictions.count() == 200


def plain_tree(x, y, classes, depth, number=1):
    """{node: (feature, threshold, counts)} by trying every boundary."""
    counts = np.bincount(y, minlength=classes)
    found = {number: (None, None, counts.tolist())}
    if depth == 0 or (counts > 0).sum() < 2:
        return found
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:], strict=True):
            left = x[:, f] <= a
            score = sum((np.bincount(s, minlength=classes).astype(float) ** 2).sum() / len(s) for s in (y[left], y[~left]))
            if best is None or score > best[0] + 1e-9:
                best = (score, f, a / 2 + b / 2)
    if best is None:
        return found
    _, f, threshold = best
    left = x[:, f] <= threshold
    found[number] = (f, threshold, counts.tolist())
    return found | plain_tree(x[left], y[left], classes, depth - 1, 2 * number) | plain_tree(x[~left], y[~left], classes, depth - 1, 2 * number + 1)


def test_tree_is_that_of_brute_force(spark):
    rng = np.random.default_rng(21)
    x = np.column_stack([rng.normal(0, 1, 300), rng.integers(0, 7, 300), rng.exponential(1, 300), np.ones(300)])
    y = ((x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 2] > 3)).astype(int)
    y[rng.random(300) < 0.1] = 2
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y)).repartition(5)
    want = plain_tree(x, y, 3, 5)
    got = tree.grow(df, list("abcd"), "y", 3, 5)
    assert {i: (n.feature, n.threshold, n.counts) for i, n in got.nodes.items()} == want
    _, predictions, _ = classification.decision_tree(df, list("abcd"), "y", 5)
    hits = sum(max(c) for f, _, c in want.values() if f is None)
    assert predictions.where("predicted_label = y").count() == hits
    assert got.importances.sum() == pytest.approx(1.0) and got.importances[3] == 0


def test_tree_without_a_split(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (None, "b"), (1.0, "b")], "x double, y string")
    model, predictions, _ = classification.decision_tree(df, ["x"], "y")
    assert len(model.nodes) == 1 and {r["predicted_label"] for r in predictions.collect()} == {"b"} and predictions.count() == 3
    assert list(model.importances) == [0.0]


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "c"), ("d", "b")], "y string, p string")
    row = classification.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.5
    assert row["precision"] == 0.75  # a: 1/1 twice, c: 1/1, d: 0
    assert row["recall"] == 0.5


def test_clusters(blobs):
    found = clustering.kmeans(blobs, ["a", "b"], 3, keep=["id", "y"])
    table = found.labels.groupBy("y", "cluster").count().collect()
    assert len(table) == 3 and all(r["count"] == 60 for r in table) and found.silhouette > 0.8
    assert clustering.kmeans(blobs.limit(1), ["a", "b"], 6).k == 1
    assert clustering.kmeans(blobs.limit(0), ["a", "b"], 6).k == 0
    assert clustering.cluster_profiles(found.labels, ["a"], 5).where("n = 0").count() == 2


def test_clusters_against_plain_lloyd_steps(spark):
    """The result is a fixed point of Lloyd's step up to the tolerance, and no worse than the best of plain starts."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.8, (n, 3)) for c, n in ((0, 900), (2, 300), (5, 150), (-3, 40))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).reset_index(names="id")).repartition(7)
    found = clustering.kmeans(df, ["a", "b", "c"], 4, scale=False, keep=["id"], tolerance=1e-10)
    labels = np.array([c for _, c in sorted((r["id"], r["cluster"]) for r in found.labels.collect())])
    centers = np.array(found.centers)
    squares = ((x[:, None] - centers) ** 2).sum(axis=2)
    assert (labels == squares.argmin(axis=1)).all()
    assert found.inertia == pytest.approx(squares.min(axis=1).sum(), rel=1e-6)
    assert centers == pytest.approx(np.array([x[labels == j].mean(axis=0) for j in range(4)]), abs=1e-3)

    def plain(seed):
        c = x[np.random.default_rng(seed).choice(len(x), 4, replace=False)]
        for _ in range(100):
            near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(4)])
        return ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()

    assert found.inertia <= min(plain(s) for s in range(10)) * 1.001
    again = clustering.kmeans(df.repartition(3), ["a", "b", "c"], 4, scale=False, tolerance=1e-10)
    assert again.centers == found.centers


def test_settled_rows_are_not_measured_again(spark):
    """Sums for moved centres, with only the rows of small margins measured, are those of all rows."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.5, (400, 2)) for c in (0, 4, 9)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    base = np.array([[0.1, 0.0], [4.0, 4.2], [9.0, 8.9]])
    held = clustering._Rows(df, ["a", "b"], base)
    for move in (0.0, 0.01, 0.3, 2.5):
        centers = base + move * np.array([[1, -1], [-1, 0.5], [0.2, 1]])
        sums, share = held.sums(centers)
        near = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        assert list(sums.n) == [np.count_nonzero(near == j) for j in range(3)]
        assert sums.inertia(centers) == pytest.approx(((x[:, None] - centers) ** 2).sum(axis=2).min(axis=1).sum(), rel=1e-9)
        assert share < 0.5 or move > 1
        assert held.labelled(centers).groupBy("cluster").count().count() == 3


def test_silhouette_is_euclidean(spark):
    rng = np.random.default_rng(9)
    x, labels = rng.normal(0, 1, (90, 2)), np.repeat([0, 1, 2, 3], [50, 30, 9, 1])
    x[labels == 1] += 3
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "cluster": labels.astype(np.int32)}))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    scores = []
    for i in range(90):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == j].mean() for j in range(4) if j != labels[i])
        scores.append((b - a) / max(a, b))
    assert clustering.silhouette(df, ["a", "b"], 4) == pytest.approx(np.mean(scores), abs=1e-9)


def test_clusters_of_few_distinct_rows(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (1.0, 2.0), (1.0, 2.0), (float("nan"), 2.0)], "a double, b double")
    found = clustering.kmeans(df, ["a", "b"], 3)
    assert found.k == 1 and found.labels.count() == 3 and found.inertia == 0.0
    two = clustering.kmeans(df.unionByName(df.withColumn("b", df["b"] + 1)), ["a", "b"], 3)
    assert two.k == 2 and two.inertia == pytest.approx(0.0, abs=1e-9) and two.silhouette == pytest.approx(1.0)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (200, 3))
    x = base @ np.array([[2.0, 0.5, 0.1], [0, 1, 0.3], [0, 0, 0.2]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    _, _, loadings, metrics = decomposition.pca(df, ["a", "b", "c"], 2)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    got = [r["explained_ratio"] for r in metrics.orderBy("component").collect()]
    assert got == pytest.approx((values / 3)[:2].round(4), abs=1e-4)
    assert metrics.first()["reconstruction_mse"] == pytest.approx(values[2] / 3, abs=1e-5)
    assert loadings.where("component = 1").agg(F.max(F.abs("loading")) == F.max("loading")).first()[0]


def test_regression(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 + 3 * i - (i % 3)) for i in range(20)], "u double, v double, y double")
    model, _, metrics = regression.linear_regression(df, ["u", "v"], "y")
    terms = dict(regression.coefficients(model, ["u", "v"], spark).collect())
    assert terms == pytest.approx({"intercept": 2.0, "u": 3.0, "v": -1.0}, abs=1e-6)
    assert metrics.first()["r2"] == 1.0


@pytest.mark.parametrize("n", [4, 37, 64, 211])
def test_spectrum_of_any_length_in_pieces(spark, n):
    rng = np.random.default_rng(n)
    y = rng.normal(0, 1, n) + np.sin(np.arange(n))
    df = spark.createDataFrame(pd.DataFrame({"k": "s", "t": np.arange(n), "y": y}))
    for longest in (3, 10**6):
        got = series.spectrum(df, "k", "t", "y", longest).orderBy("k").toPandas()
        want = np.fft.rfft(y)
        # the series key and the frequency number share the letter only in the result of the caller
        amplitude = got.sort_values("frequency")["amplitude"].to_numpy()
        phase = got.sort_values("frequency")["phase"].to_numpy()
        assert np.allclose(amplitude, np.abs(want), atol=1e-8)
        assert np.allclose(amplitude * np.exp(1j * phase), want, atol=1e-7)


def test_short_series_have_no_spectrum(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(3)], "s string, t int, y double")
    assert series.fourier(df, "s", "t", "y").count() == 0


def simulate(n, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n)
    w = np.zeros(n)
    for i in range(1, n):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    return np.cumsum(w)


def test_arima_blocks_do_not_matter(spark):
    frames = [pd.DataFrame({"s": k, "t": np.arange(n), "y": simulate(n, i)}) for i, (k, n) in enumerate((("hot", 4000), ("small", 300)))]
    df = spark.createDataFrame(pd.concat(frames))
    one, f_one = series.arima(df, "s", "t", "y", (1, 1, 1), 5, block=10**6, method="two_step")
    many, f_many = series.arima(df, "s", "t", "y", (1, 1, 1), 5, block=64, method="two_step")
    a = {r["s"]: r for r in one.collect()}
    b = {r["s"]: r for r in many.collect()}
    assert a["hot"]["coef"] == pytest.approx([0.6, 0.3], abs=0.06)
    for k in a:
        assert a[k]["coef"] == pytest.approx(b[k]["coef"], abs=1e-9) and a[k]["aic"] == b[k]["aic"]
        assert a[k]["rmse"] == pytest.approx(1.0, abs=0.12)
    x = f_one.orderBy("s", "step").toPandas()
    y = f_many.orderBy("s", "step").toPandas()
    assert np.allclose(x["forecast"], y["forecast"]) and (x["ci_low"] < x["forecast"]).all()
    width = x[x.s == "hot"]["ci_high"] - x[x.s == "hot"]["ci_low"]
    assert (np.diff(width) > 0).all()


def plain_filter(w, phi, theta):
    """-2 log likelihood and noise variance by a Kalman filter, value by value."""
    t, load = kalman.matrices(np.array(phi), np.array(theta))
    r = len(t)
    spread = np.linalg.solve(np.eye(r * r) - np.kron(t, t), np.outer(load, load).ravel()).reshape(r, r)
    x, logs, squares = np.zeros(r), 0.0, 0.0
    for y in w:
        x, spread = t @ x, t @ spread @ t.T + np.outer(load, load)
        size, miss = spread[0, 0], y - x[0]
        gain = spread[:, 0] / size
        x, spread = x + gain * miss, spread - np.outer(gain, spread[0])
        logs, squares = logs + np.log(size), squares + miss * miss / size
    variance = squares / len(w)
    return len(w) * (np.log(2 * np.pi * variance) + 1) + logs, variance, x


@pytest.mark.parametrize("phi,theta", [([0.5], []), ([], [0.4]), ([0.5, -0.3], [0.4, 0.2, 0.1]), ([1.2, -0.4], [-0.6])])
def test_scan_over_blocks_is_the_filter(phi, theta):
    w = np.random.default_rng(3).normal(0, 1, 403).cumsum() * 0.2
    want = plain_filter(w, phi, theta)
    phi, theta = np.array(phi), np.array(theta)
    for cuts in ([], [1], [200], [17, 64, 65, 301]):
        parts = [kalman.block_element(x, phi, theta) for x in np.split(w, cuts)]
        whole = parts[0]
        for part in parts[1:]:
            whole = kalman.combined(whole, kalman.Element.unpacked(part.packed(), len(part.a)))
        got = kalman.deviance(whole, phi, theta, len(w))
        assert got == pytest.approx(want[:2], rel=1e-9)
        assert kalman.from_start(whole, phi, theta).b == pytest.approx(want[2], abs=1e-8)


def test_arima_likelihood(spark, monkeypatch):
    """AIC and BIC are those of a plain filter at the coefficients, no other coefficients do better, blocks do not matter."""
    monkeypatch.setattr(kalman, "FAN", 4)
    frames = [pd.DataFrame({"s": k, "t": np.arange(n), "y": simulate(n, i)}) for i, (k, n) in enumerate((("hot", 1500), ("small", 120)))]
    df = spark.createDataFrame(pd.concat(frames))
    one, f_one = series.arima(df, "s", "t", "y", (1, 1, 1), 5)
    many, f_many = series.arima(df, "s", "t", "y", (1, 1, 1), 5, block=64)
    a, b = ({r["s"]: r for r in x.collect()} for x in (one, many))
    for frame in frames:
        k, w = frame["s"][0], np.diff(frame["y"])
        value, variance, state = plain_filter(w, a[k]["coef"][:1], a[k]["coef"][1:])
        assert a[k]["n"] == len(w) and a[k]["sigma2"] == pytest.approx(variance, rel=1e-6)
        assert a[k]["aic"] == pytest.approx(value + 6, abs=0.006) and a[k]["bic"] == pytest.approx(value + 3 * np.log(len(w)), abs=0.006)
        for move in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02), (0.02, -0.02)):
            assert plain_filter(w, [a[k]["coef"][0] + move[0]], [a[k]["coef"][1] + move[1]])[0] > value
        assert a[k]["coef"] == pytest.approx(b[k]["coef"], abs=1e-5) and a[k]["aic"] == pytest.approx(b[k]["aic"], abs=0.011)
        first = f_one.where(F.col("s") == k).where("step = 1").first()
        t, _ = kalman.matrices(np.array(a[k]["coef"][:1]), np.array(a[k]["coef"][1:]))
        assert first["forecast"] == pytest.approx(frame["y"].iloc[-1] + (t @ state)[0], abs=1e-6)
        assert first["ci_high"] - first["forecast"] == pytest.approx(1.959964 * np.sqrt(variance), rel=1e-3)
    x, y = (f.orderBy("s", "step").toPandas() for f in (f_one, f_many))
    assert np.allclose(x["forecast"], y["forecast"], atol=1e-3) and np.allclose(x["ci_low"], y["ci_low"], atol=1e-3)


def test_arima_with_a_mean_and_of_a_constant(spark):
    rng = np.random.default_rng(6)
    rows = [("a", i, float(v)) for i, v in enumerate(1000 + 5 * rng.normal(0, 1, 400))] + [("b", i, 7.0) for i in range(30)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    fits, forecasts = series.arima(df, "s", "t", "y", (1, 0, 0), 3)
    fits = {r["s"]: r for r in fits.collect()}
    mean = fits["a"]["coef"][0] / (1 - fits["a"]["coef"][1])
    assert mean == pytest.approx(1000, abs=1.5) and fits["a"]["sigma2"] == pytest.approx(25, rel=0.2)
    assert fits["b"]["aic"] is None and fits["b"]["rmse"] == pytest.approx(0.0, abs=1e-6)
    assert [r["forecast"] for r in forecasts.where("s = 'b'").collect()] == pytest.approx([7.0] * 3, abs=1e-6)


def test_arima_forecast_of_a_line(spark):
    df = spark.createDataFrame([("a", i, 3.0 * i + (i % 2) * 0.01) for i in range(60)], "s string, t int, y double")
    _, forecasts = series.arima(df, "s", "t", "y", (1, 2, 0), 3)
    assert [r["forecast"] for r in forecasts.orderBy("step").collect()] == pytest.approx([180, 183, 186], abs=0.1)


def test_cross_analysis(blobs):
    rows = blobs.withColumn("cluster", F.col("y")).withColumn("c", F.col("a") * 2 + 1)
    found = cross.cross_analysis(rows, "cluster", {"one": ["a"], "two": ["c"]}, ["linear_regression", "naive_bayes"])
    assert found.count() == 12
    assert {r["score"] for r in found.where("model = 'linear_regression'").collect()} == {1.0}


def test_cross_analysis_is_that_of_single_fits(spark):
    """Classifiers fitted for all clusters and targets together score as those fitted for one cluster and target."""
    rng = np.random.default_rng(31)
    n = 600
    x = rng.normal(0, 1, (n, 2))
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1] * 3 + 1, "u": x[:, 0] + rng.normal(0, 0.7, n), "v": x[:, 1] ** 2 + rng.normal(0, 0.5, n), "k": np.arange(n) % 3})
    df = spark.createDataFrame(frame).withColumn("u", F.when(F.col("u") > -2, F.col("u")))
    found = cross.cross_analysis(df, "k", {"one": ["a", "b"], "two": ["u", "v"]}, ["naive_bayes", "logistic_regression"])
    got = {(r["k"], r["target"], r["model"]): (r["n"], r["score"]) for r in found.where("from_group = 'one'").collect()}
    assert len(got) == 12
    for k in range(3):
        for target in ("u", "v"):
            part = df.where((F.col("k") == k) & F.col(target).isNotNull())
            mean = part.agg(F.avg(target)).first()[0]
            part = part.withColumn("label", F.when(F.col(target) > mean, "above").otherwise("below"))
            for model, fit in (("naive_bayes", classification.naive_bayes), ("logistic_regression", classification.logistic_regression)):
                metrics = fit(part, ["a", "b"], "label")[2].first()
                assert got[k, target, model][0] == metrics["n"]
                assert got[k, target, model][1] == pytest.approx(metrics["accuracy"], abs=0.006)


def test_kmeans_assignment_takes_the_nearest_seconds(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * i * 7919 % 9000 * 1013) AS ts, i % 5 AS user_id, 'a' AS event_type, i * 0.5 AS value, '{}' AS props FROM range(300) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = entry.queries()["kmeans_assignment"](spark, str(tmp_path)).select("cluster", "n", "inertia").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(entry.oracle_sql()["kmeans_assignment"]).fetchall())
