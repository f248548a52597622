"""Principal axes of wide vectors, and charts that are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import localize as LZ
from pathloom.operators import manifold as MF
from pathloom.session import materialize


def _frame(spark, x):
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    return materialize(spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5))


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 6)) @ (rng.normal(size=(6, 300)) * np.array([9, 6, 4, 2, 1, 0.5])[:, None]) + 0.01 * rng.normal(size=(90, 300)) + 5.0
    return _frame(spark, x), x


def test_axes_of_wide_rows(wide):
    df, x = wide
    mean, axes, var, total = LZ.pca_fit(df, 3)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and total == pytest.approx(c.var(0, ddof=1).sum())
    assert np.allclose(var, s[:3] ** 2 / (len(x) - 1)) and np.allclose(np.abs(axes), np.abs(vt[:3].T), atol=1e-8)


def test_both_ways_to_the_axes_agree(wide, monkeypatch):
    df, _ = wide
    found = LZ.pca_fit(df, 2)
    monkeypatch.setattr(LZ, "WIDE_AXES", 10**9)
    other = LZ.pca_fit(df, 2)
    assert np.allclose(found[1], other[1], atol=1e-9) and np.allclose(found[2], other[2]) and found[3] == pytest.approx(other[3])


def test_wide_rows_are_decomposed_in_numpy(wide, monkeypatch):
    """The other way takes a minute for two thousand columns."""

    def never(*a, **k):
        raise AssertionError("decomposed in the JVM")

    monkeypatch.setattr(LZ, "PCA", never)
    assert LZ.pca_fit(wide[0], 2)[1].shape == (300, 2)


def test_rows_that_have_no_axes(spark):
    with pytest.raises(Exception):
        LZ.pca_fit(_frame(spark, np.ones((1, 300))), 2)


def test_a_chart_under_two_names_is_made_once(spark, wide, monkeypatch):
    df, fits = wide[0], []
    fit = LZ.pca_fit
    monkeypatch.setattr(MF, "pca_fit", lambda *a: fits.append(a) or fit(*a))
    cut = lambda n: materialize(df.withColumn("vec", F.slice("vec", 1, n)))
    out = MF.chart_study({"RI": df, "Cov": cut(4), "Feat": cut(7)})
    z = {}
    for r in out.collect():
        z.setdefault(r["method"], {})[r["id"]] = (r["z1"], r["z2"])
    assert len(fits) == 3 and set(z) == {"pca [RI]", "pca [Cov]", "pca [Feat]", "cmds [RI]"}
    assert z["pca [RI]"] == z["cmds [RI]"] and all(len(v) == 90 for v in z.values())
