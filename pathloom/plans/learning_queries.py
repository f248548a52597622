"""Registered queries for trained regressors, projections and chart layouts, and the full pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import charts as CH
from pathloom.operators import evaluate as EV
from pathloom.operators import features as FT
from pathloom.operators import graph as GR
from pathloom.operators import localize as LZ
from pathloom.operators import manifold as MF
from pathloom.operators import nets as NN
from pathloom.plans.common import publish, q
from pathloom.plans.feature_queries import AXIS
from pathloom.plans.position_queries import PT
from pathloom.schema import GROUP_COLUMNS, group_widths
from pathloom.session import materialize
from pathloom.sources import carriers as C


def _points(spark, d):
    return C.embedding_points(spark, d)


def _scaled(spark, d):
    p = _points(spark, d)
    train, test = p.filter(~F.col("is_test")), p.filter("is_test")
    return materialize(LZ.standardize(train, train)), materialize(LZ.standardize(test, train))


# ---------------------------------------------------------------- linear algebra
def explained_variance(spark, d):
    return publish(MF.explained_variance(_points(spark, d), 64))


def pca_power_sums(spark, d):
    """All component variances as their sum and their sum of squares: the traces of the covariance and of its square."""
    v = MF.explained_variance(_points(spark, d), 64)
    return publish(v.agg(F.count("*").alias("components"), F.sum("variance").alias("p1"), F.sum(F.col("variance") * F.col("variance")).alias("p2")))


def pca_chart(spark, d):
    return publish(MF.pca_chart(_points(spark, d)))


def pca_distances(spark, d):
    """Squared distance of each point to the origin over all principal axes (rotation-free)."""
    p = _points(spark, d)
    mean, axes, _, _ = LZ.pca_fit(p, 64)
    z = LZ.pca_project(p, mean, axes)
    return publish(z.select("id", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v).alias("r2")))


def pca_whiten(spark, d):
    train, test = _scaled(spark, d)
    w = LZ.pca_whiten(test, train, 0.95)
    return publish(w.select("id", F.size("vec").alias("n_comp"), F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v).alias("r2")))


def wknn_whitened(spark, d):
    """wKNN in the whitened space (Mahalanobis distance in the retained subspace)."""
    train, test = _scaled(spark, d)
    both = LZ.pca_whiten(train.unionByName(test), train, 0.95)
    both = materialize(both)
    from pathloom.operators.knn import knn_join

    tr, te = both.filter(~F.col("is_test")), both.filter("is_test")
    pred = LZ.with_error(LZ.idw_predict(knn_join(te, tr, 5, carry=("x", "y")), 5), te)
    return publish(EV.error_metrics(materialize(pred.withColumn("method", F.lit("whitened"))), "method"))


def cmds_chart(spark, d):
    return publish(MF.cmds_chart(_points(spark, d)))


def laplacian_chart(spark, d):
    """The spectral chart of the neighbour graph of all points."""
    return publish(GR.spectral_chart(_points(spark, d))[0])


def geodesic_chart(spark, d):
    """Scaling of the ways along the neighbour graph."""
    return publish(GR.geodesic_chart(_points(spark, d)))


def laplacian_spectrum(spark, d):
    """Leading eigenvalues of the graph behind that chart, with residuals."""
    found = GR.leading_eigenvectors(GR.neighbour_graph(_points(spark, d)), 3)
    rows = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(found.values, found.residuals))]
    return publish(spark.createDataFrame(rows, "component int, eigenvalue double, residual double"))


def feature_image(spark, d):
    """Vectors reshaped to nine rows (a remainder is dropped): sum per image row."""
    p = FT.to_image(_points(spark, d), 9)
    r = p.select("id", F.posexplode("image").alias("tx", "row"))
    return publish(r.select("id", "tx", F.size("row").alias("width"), F.aggregate("row", F.lit(0.0), lambda a, v: a + v).alias("total")))


# ---------------------------------------------------------------- learners
def nn_regression(spark, d):
    train, test = _scaled(spark, d)
    return publish(NN.regress_positions(train, test))


def nn_regression_plain(spark, d):
    """Plain layer stack with weight decay."""
    train, test = _scaled(spark, d)
    return publish(NN.regress_positions(train, test, NN.MLP_PLAIN, method="MLP plain", decay=1e-3))


def nn_classification(spark, d):
    train, test = _scaled(spark, d)
    nx, ny = EV.grid_shape(_points(spark, d), -1.25, -1.25, 10.0)
    out = NN.classify_positions(train, test, -1.25, -1.25, 10.0, nx, ny)
    return publish(out.withColumn("correct", F.col("correct").cast("int")))


def cnn_regression(spark, d):
    train, test = _scaled(spark, d)
    return publish(NN.cnn_positions(train, test, 8))


def autoencoder_chart(spark, d):
    return publish(NN.autoencoder_chart(materialize(LZ.standardize(_points(spark, d))), rounds=300, patience=30, rate=1e-3))


# ---------------------------------------------------------------- layouts
def _study_inputs(spark, d):
    """Three representations of the event fingerprints."""
    fp = materialize(FT.build_fingerprints(C.event_paths(spark, d), C.event_rx(spark, d), C.N_TX, ["ofdm_mag_gd", "tdoa", "aoa"], AXIS))
    n = 2 * (AXIS["fft_size"] // AXIS["step"]) - 1
    blocks = fp.select("rx_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(C.N_TX - 1)), lambda i: F.slice("f_ofdm", i * n + 1, n))).alias("tx_id", "ofdm"))
    gram = FT.cosine_gram(blocks, C.N_TX).groupBy(F.col("rx_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("tx_i", "tx_j", "cos"))), lambda e: e["cos"]).alias("vec")
    )
    inputs = {
        "RI": materialize(LZ.standardize(FT.to_vector(fp, ["ofdm_mag_gd", "tdoa", "aoa"]))),
        "Cov": materialize(LZ.standardize(gram)),
        "Feat": materialize(LZ.standardize(FT.to_vector(fp, ["tdoa", "aoa"]))),
    }
    return inputs


def chart_study(spark, d):
    """The linear charts of the study over three input representations of the event fingerprints."""
    return publish(MF.chart_study(_study_inputs(spark, d)))


def best_chart(spark, d):
    """The chart of the study that keeps neighbourhoods best."""
    return publish(MF.best_chart(MF.study_scores(_study_inputs(spark, d))))


# ---------------------------------------------------------------- pipeline
def paths_to_position(spark, d):
    """Raw paths to positioning metrics: links, imputation, fingerprints of all groups, scaling, weights, wKNN."""
    groups = list(GROUP_COLUMNS)
    fp = FT.build_fingerprints(C.event_paths(spark, d), C.event_rx(spark, d), C.N_TX, groups, AXIS)
    v = materialize(FT.to_vector(fp, groups).withColumn("is_test", F.pmod("id", F.lit(10)) < 3))
    train, test = v.filter(~F.col("is_test")), v.filter("is_test")
    widths = group_widths(C.N_TX, AXIS["fft_size"], AXIS["step"])
    sizes = [widths[g] for g in groups]
    prep = lambda x: LZ.apply_group_weights(LZ.standardize(x, train), sizes)
    from pathloom.operators.knn import knn_join

    nb = knn_join(prep(test), prep(train), 5, carry=("x", "y"))
    pred = LZ.with_error(LZ.idw_predict(nb, 5), test).withColumn("method", F.lit("WKNN (IDW)"))
    return publish(EV.error_metrics(materialize(pred), "method"))


def chart_from_pca(spark, d):
    """Scores of the principal-axis chart."""
    p = _points(spark, d)
    z = MF.pca_chart(p).select("id", F.array("z1", "z2").alias("lo"))
    pts = materialize(p.select("id", F.col("vec").alias("hi"), "x", "y").join(z, "id"))
    return publish(CH.chart_scores(pts, "PCA"))


QUERIES = {
    f.__name__: f
    for f in (
        explained_variance, pca_power_sums, pca_chart, pca_distances, pca_whiten, wknn_whitened, cmds_chart,
        laplacian_chart, laplacian_spectrum, geodesic_chart,
        feature_image, nn_regression, nn_regression_plain, nn_classification, cnn_regression, autoencoder_chart,
        chart_study, best_chart, paths_to_position, chart_from_pca,
    )
}

ORACLES = {
    "pca_power_sums": f"""WITH {PT}, u AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM points),
        c AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.v, b.v) AS v FROM u a JOIN u b USING (id) GROUP BY a.dim, b.dim)
        SELECT count(*) FILTER (i = j) AS components, {q('sum(v) FILTER (i = j)', 'p1')}, {q('sum(v*v)', 'p2')} FROM c""",
    "pca_distances": f"""WITH {PT}, u AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM points), m AS (SELECT dim, avg(v) AS mu FROM u GROUP BY dim)
        SELECT id, {q('sum((v-mu)*(v-mu))', 'r2')} FROM u JOIN m USING (dim) GROUP BY id""",
    "feature_image": f"""WITH {PT}, u AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM points)
        SELECT id, CAST(dim // 7 AS INTEGER) AS tx, CAST(count(*) AS INTEGER) AS width, {q('sum(v)', 'total')} FROM u WHERE dim < 63 GROUP BY id, dim // 7""",
}
