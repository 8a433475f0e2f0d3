"""The registered queries of the estimators and the equivalent SQL.

Numbers are rounded on both sides to fewer digits than the order of summation
can change. Names ending in ``_fit`` return a fitted model as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import stats
from ..operators.bayes import GaussianNB
from ..operators.cluster import DBSCAN, KMeans
from ..operators.decomposition import PCA, TruncatedSVD
from ..operators.density import radius_components
from ..operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from ..operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors, pairwise, radius_edges
from ..operators.scale import MinMaxScaler, RobustScaler, StandardScaler
from ..operators.svm import SVC, SVR
from ..operators.trees import HistGradientBoostingClassifier, HistGradientBoostingRegressor, Tree, predict_all
from ..registry import Pipeline
from ..sources.frames import table, to_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def quick(c: Column, digits: int = 6) -> Column:
    """As ``r``, without a decimal for each of many numbers: as SQL's, half up of the scaled number, where that is exact."""
    small, scale = 0.5 / 10.0**digits, 10.0**digits
    return F.when(c.between(-small, 1e15 / scale), F.floor(c * scale + 0.5) / scale).otherwise(r(c, digits))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def lineitem(spark: SparkSession, sf: str, label: str | None = None, features: list[str] | None = None) -> DataFrame:
    return to_features(table(spark, sf, "lineitem"), features or LINEITEM, label=F.expr(label) if label else None)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return to_features(table(spark, sf, "part"), ["p_size", "p_retailprice"], id=F.col("p_partkey"))


def embeddings(spark: SparkSession, sf: str, dims: int | None = None) -> DataFrame:
    df = to_features(table(spark, sf, "embeddings"), "embedding", id=F.col("vec_id"), label=F.col("label"))
    return df.withColumn("features", F.slice("features", 1, dims)) if dims else df


# ---- scalers

_PER_FEATURE = " UNION ALL ".join


@query(_PER_FEATURE(f"SELECT {i} AS feature_idx, round(avg({c}), 4) AS mean, round(var_pop({c}), 2) AS var, round(stddev_pop({c}), 4) AS scale FROM lineitem" for i, c in enumerate(LINEITEM)))
def standard_scaler_fit(spark, sf):
    return rounded(StandardScaler().fit(lineitem(spark, sf)).to_df(spark), mean=4, var=2, scale=4)


@query(_PER_FEATURE(f"SELECT {i} AS feature_idx, min({c}) AS data_min, max({c}) AS data_max, max({c}) - min({c}) AS data_range, round(1 / (max({c}) - min({c})), 8) AS scale FROM lineitem" for i, c in enumerate(LINEITEM)))
def minmax_scaler_fit(spark, sf):
    return rounded(MinMaxScaler().fit(lineitem(spark, sf)).to_df(spark), scale=8)


@query(_PER_FEATURE(f"SELECT {i} AS feature_idx, round(quantile_cont({c}, 0.5), 6) AS center, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS scale FROM lineitem" for i, c in enumerate(LINEITEM)))
def robust_scaler_fit(spark, sf):
    return rounded(RobustScaler().fit(lineitem(spark, sf)).to_df(spark), center=6, scale=6)


def _two(df: DataFrame) -> DataFrame:
    return df.select("id", r(F.col("features")[0]).alias("f0"), r(F.col("features")[1]).alias("f1"))


def _scaled_sql(stats_: str, f: str) -> str:
    cols = ", ".join(f"{stats_.format(c=c, i=i)}" for i, c in enumerate(("p_size", "p_retailprice")))
    out = ", ".join(f"round({f.format(c=c, i=i)}, 6) + 0.0 AS f{i}" for i, c in enumerate(("p_size", "p_retailprice")))
    return f"WITH s AS (SELECT {cols} FROM part) SELECT p_partkey AS id, {out} FROM part, s"


@query(_scaled_sql("avg({c}) AS m{i}, stddev_pop({c}) AS d{i}", "({c} - m{i}) / d{i}"))
def standard_scaler_transform(spark, sf):
    return _two(StandardScaler().fit_transform(parts(spark, sf)))


@query(_scaled_sql("min({c}) AS m{i}, max({c}) - min({c}) AS d{i}", "({c} - m{i}) / d{i} * 2 - 1"))
def minmax_scaler_transform(spark, sf):
    return _two(MinMaxScaler((-1.0, 1.0)).fit_transform(parts(spark, sf)))


@query(_scaled_sql("median({c}) AS m{i}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS d{i}", "({c} - m{i}) / d{i}"))
def robust_scaler_transform(spark, sf):
    return _two(RobustScaler().fit_transform(parts(spark, sf)))


@query("SELECT p_partkey AS id, round(CAST(p_size AS DOUBLE), 6) AS f0, round(p_retailprice, 6) AS f1 FROM part")
def scaler_inverse_transform(spark, sf):
    s = RobustScaler().fit(parts(spark, sf))
    return _two(s.inverse_transform(s.transform(parts(spark, sf))))


# ---- Gram matrix and linear models

_UNNEST = "SELECT vec_id, label, unnest(embedding) :: DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


@query(f"WITH e AS ({_UNNEST}) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_pop(a.x, b.x), 8) + 0.0 AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def covariance_matrix(spark, sf):
    df = embeddings(spark, sf)
    g = stats.gram(df)
    rows = [(i, j, round(float(v / g["n"]), 8) + 0.0) for i, row in enumerate(g["xx"]) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, value double")


def _coefs(model, spark: SparkSession, digits: int = 3) -> DataFrame:
    return rounded(model.to_df(spark), coef=digits)


@query("SELECT -1 AS feature_idx, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coef FROM lineitem UNION ALL SELECT 0, round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def linear_regression_fit(spark, sf):
    return _coefs(LinearRegression().fit(lineitem(spark, sf, "l_extendedprice", ["l_quantity"])), spark)


_TWO = """WITH s AS (SELECT avg(l_quantity) mx, avg(l_discount) mz, avg(l_extendedprice) my, var_pop(l_quantity) xx, var_pop(l_discount) zz, covar_pop(l_quantity, l_discount) xz,
  covar_pop(l_quantity, l_extendedprice) xy, covar_pop(l_discount, l_extendedprice) zy, var_pop(l_extendedprice) yy, count(*) n FROM lineitem),
w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS w0, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS w1 FROM s)"""


@query(_TWO + " SELECT -1 AS feature_idx, round(my - w0 * mx - w1 * mz, 3) AS coef FROM w UNION ALL SELECT 0, round(w0, 3) FROM w UNION ALL SELECT 1, round(w1, 3) FROM w")
def linear_regression_two_features_fit(spark, sf):
    return _coefs(LinearRegression().fit(lineitem(spark, sf, "l_extendedprice", ["l_quantity", "l_discount"])), spark)


@query(_TWO + " SELECT round((w0 * xy + w1 * zy) / yy, 8) AS r2 FROM w")
def linear_regression_score(spark, sf):
    df = lineitem(spark, sf, "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(LinearRegression().fit(df).score(df), 8),)], "r2 double")


@query("SELECT p_partkey AS id, round(p_size * (SELECT regr_slope(p_retailprice, p_size) FROM part) + (SELECT regr_intercept(p_retailprice, p_size) FROM part), 6) AS prediction FROM part")
def linear_regression_predict(spark, sf):
    df = to_features(table(spark, sf, "part"), ["p_size"], id=F.col("p_partkey"), label=F.col("p_retailprice"))
    return LinearRegression().fit(df).predict(df).select("id", r("prediction").alias("prediction"))


def _one_sql(w: str) -> str:
    return f"""WITH s AS (SELECT count(*) n, avg(l_quantity) mx, avg(l_extendedprice) my, var_pop(l_quantity) * count(*) xx, covar_pop(l_quantity, l_extendedprice) * count(*) xy FROM lineitem),
w AS (SELECT *, {w} AS w FROM s) SELECT -1 AS feature_idx, round(my - w * mx, 3) AS coef FROM w UNION ALL SELECT 0, round(w, 3) FROM w"""


@query(_one_sql("xy / (xx + 1000000)"))
def ridge_fit(spark, sf):
    return _coefs(Ridge(1e6).fit(lineitem(spark, sf, "l_extendedprice", ["l_quantity"])), spark)


@query(_one_sql("sign(xy) * greatest(abs(xy) - n * 1000, 0) / xx"))
def lasso_fit(spark, sf):
    return _coefs(Lasso(1000.0).fit(lineitem(spark, sf, "l_extendedprice", ["l_quantity"])), spark)


@query(_one_sql("sign(xy) * greatest(abs(xy) - n * 250, 0) / (xx + n * 750)"))
def elastic_net_fit(spark, sf):
    return _coefs(ElasticNet(1000.0, 0.25).fit(lineitem(spark, sf, "l_extendedprice", ["l_quantity"])), spark)


def _newton_sql(steps: int = 10) -> str:
    """Newton's method for one feature and an intercept, a common table for each step; C = 1, on l_quantity / 10."""
    out = ["d AS (SELECT l_quantity / 10 AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)", "b0 AS (SELECT 0.0 :: DOUBLE AS a, 0.0 :: DOUBLE AS w)"]
    for k in range(steps):
        out.append(
            f"g{k} AS (SELECT any_value(a) a, any_value(w) w, sum(p - y) ga, sum((p - y) * x) + any_value(w) gw, sum(p * (1 - p)) haa, sum(p * (1 - p) * x) haw, sum(p * (1 - p) * x * x) + 1 hww "
            f"FROM (SELECT x, y, a, w, 1 / (1 + exp(-(a + w * x))) AS p FROM d, b{k}))"
        )
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT a - (hww * ga - haw * gw) / (haa * hww - haw * haw) AS a, w - (haa * gw - haw * ga) / (haa * hww - haw * haw) AS w FROM g{k})")
    return f"WITH {', '.join(out)} SELECT 0 AS class_idx, -1 AS feature_idx, round(a, 6) AS coef FROM b{steps} UNION ALL SELECT 0, 0, round(w, 6) FROM b{steps}"


@query(_newton_sql())
def logistic_regression_fit(spark, sf):
    df = to_features(table(spark, sf, "lineitem").withColumn("x", F.col("l_quantity") / 10), ["x"], label=F.expr("int(l_returnflag = 'R')"))
    return _coefs(LogisticRegression().fit(df), spark, 6)


@query(_newton_sql().replace(_newton_sql()[_newton_sql().rindex(" SELECT 0 AS class_idx"):], " SELECT p_partkey AS id, CAST(a + w * p_size / 10 > 0 AS INTEGER) AS prediction, round(1 / (1 + exp(-(a + w * p_size / 10))), 6) AS probability FROM part, b10"))
def logistic_regression_predict(spark, sf):
    df = to_features(table(spark, sf, "lineitem").withColumn("x", F.col("l_quantity") / 10), ["x"], label=F.expr("int(l_returnflag = 'R')"))
    m = LogisticRegression().fit(df)
    new = to_features(table(spark, sf, "part").withColumn("x", F.col("p_size") / 10), ["x"], id=F.col("p_partkey"))
    return m.predict_proba(m.predict(new)).select("id", "prediction", r(F.col("probability")[1]).alias("probability"))


@query(
    """WITH c AS (SELECT l_returnflag AS f, CAST(l_quantity > 25 AS INTEGER) AS x, ln(count(*)) AS l FROM lineitem GROUP BY 1, 2),
n AS (SELECT CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS k, x, l - avg(l) OVER (PARTITION BY x) AS l FROM c)
SELECT k AS class_idx, -1 AS feature_idx, round(l, 3) + 0.0 AS coef FROM n WHERE x = 0
UNION ALL SELECT a.k, 0, round(a.l - b.l, 3) + 0.0 FROM n a JOIN n b ON a.k = b.k WHERE a.x = 1 AND b.x = 0"""
)
def multinomial_logistic_saturated_fit(spark, sf):
    """One feature of two values: the optimum is the centred logarithm of the counts."""
    df = to_features(table(spark, sf, "lineitem").withColumn("x", F.expr("int(l_quantity > 25)")), ["x"], label=F.col("l_returnflag"))
    return _coefs(LogisticRegression(C=1e9, tol=1e-13).fit(df), spark, 3)


@query("SELECT p_partkey AS id, round(p_size * (SELECT regr_slope(p_retailprice, p_size) FROM part) + (SELECT regr_intercept(p_retailprice, p_size) FROM part), 6) AS prediction FROM part")
def pipeline_predict(spark, sf):
    df = to_features(table(spark, sf, "part"), ["p_size"], id=F.col("p_partkey"), label=F.col("p_retailprice"))
    steps = [("standard", StandardScaler()), ("range", MinMaxScaler((-2.0, 5.0))), ("model", LinearRegression())]
    return Pipeline(steps).fit(df).predict(df).select("id", r("prediction").alias("prediction"))


@query()
def multinomial_logistic_fit(spark, sf):
    df = Pipeline([("scale", StandardScaler()), ("keep", StandardScaler())]).fit(f := lineitem(spark, sf, "l_returnflag", ["l_quantity", "l_discount"])).transform(f)
    return _coefs(LogisticRegression(tol=1e-7).fit(df), spark, 2)


# ---- naive Bayes

_NB = f"""WITH e AS ({_UNNEST}), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(x) AS v FROM e GROUP BY i)),
m AS (SELECT label, i, avg(x) AS theta, var_pop(x) + any_value(eps) AS var FROM e, eps GROUP BY label, i)"""


@query(_NB + " SELECT CAST(label AS BIGINT) AS label, CAST(i AS INTEGER) AS feature_idx, round(n / sum(n) OVER (PARTITION BY i), 9) AS prior, round(theta, 9) + 0.0 AS theta, round(var, 9) AS var FROM m JOIN n USING (label)")
def gaussian_nb_fit(spark, sf):
    return rounded(GaussianNB().fit(embeddings(spark, sf)).to_df(spark), prior=9, theta=9, var=9)


_JLL = f"""{_NB}, j AS (SELECT e.vec_id, m.label, any_value(ln(n.n / (SELECT count(*) FROM embeddings))) - 0.5 * sum(ln(2 * pi() * m.var) + (e.x - m.theta) * (e.x - m.theta) / m.var) AS j
FROM e JOIN m ON e.i = m.i JOIN n ON n.label = m.label GROUP BY 1, 2)"""


@query(_JLL + " SELECT vec_id AS id, arg_max(label, j) AS prediction FROM j GROUP BY vec_id")
def gaussian_nb_predict(spark, sf):
    df = embeddings(spark, sf)
    return GaussianNB().fit(df).predict(df).select("id", F.col("prediction").cast("int").alias("prediction"))


@query(_JLL + ", t AS (SELECT vec_id, max(j) AS top FROM j GROUP BY 1) SELECT vec_id AS id, CAST(label AS INTEGER) AS label, round(exp(j - top) / sum(exp(j - top)) OVER (PARTITION BY vec_id), 6) AS probability FROM j JOIN t USING (vec_id)")
def gaussian_nb_proba(spark, sf):
    m = GaussianNB().fit(df := embeddings(spark, sf))
    names = F.array(*[F.lit(int(c)) for c in m.classes_])
    return m.predict_proba(df).select("id", F.posexplode("probability").alias("at", "p")).select("id", F.get(names, F.col("at")).alias("label"), r("p").alias("probability"))


# ---- distances and neighbours

_PAIRS = f"""WITH e AS ({_UNNEST}), d AS (SELECT a.vec_id AS q, b.vec_id AS t, sum((a.x - b.x) * (a.x - b.x)) AS d2, sum(abs(a.x - b.x)) AS l1,
1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS cosine FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2)"""


def _pairwise(metric: str, sql: str, name: str) -> None:
    @query(f"{_PAIRS} SELECT q AS left_id, t AS right_id, round({sql}, 6) + 0.0 AS distance FROM d", name)
    def run(spark, sf):
        e = embeddings(spark, sf).select("id", "features")
        return pairwise(e, e, metric).select("left_id", "right_id", quick(F.col("distance")).alias("distance"))


_pairwise("sqeuclidean", "d2", "pairwise_distance")
_pairwise("manhattan", "l1", "pairwise_manhattan")
_pairwise("cosine", "cosine", "pairwise_cosine")

_NEAR = _PAIRS + ", k AS (SELECT q, t, sqrt(d2) AS dist, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS rank FROM d QUALIFY rank <= 5)"


@query(_NEAR + " SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, t AS neighbor_id, round(dist, 6) AS distance FROM k")
def kneighbors(spark, sf):
    return rounded(NearestNeighbors(5).fit(embeddings(spark, sf)).kneighbors(), distance=6)


@query(f"{_PAIRS}, k AS (SELECT q, t, l1, row_number() OVER (PARTITION BY q ORDER BY l1, t) AS rank FROM d QUALIFY rank <= 5) SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, t AS neighbor_id, round(l1, 6) AS distance FROM k")
def kneighbors_manhattan(spark, sf):
    return rounded(NearestNeighbors(5, "manhattan").fit(embeddings(spark, sf)).kneighbors(), distance=6)


@query(f"{_PAIRS}, k AS (SELECT q, t, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine, t) AS rank FROM d QUALIFY rank <= 6) SELECT q AS query_id, CAST(rank - 1 AS INTEGER) AS rank, t AS neighbor_id, round(cosine, 6) AS distance FROM k WHERE rank > 1")
def kneighbors_cosine(spark, sf):
    """Without the first, which is the row itself."""
    near = NearestNeighbors(6, "cosine").fit(embeddings(spark, sf)).kneighbors().where("rank > 1").withColumn("rank", F.col("rank") - 1)
    return rounded(near, distance=6)


_VOTES = _NEAR + ", v AS (SELECT q, label, sum({w}) AS w, min(rank) AS nearest FROM k JOIN embeddings ON t = vec_id GROUP BY 1, 2)"


@query(_VOTES.format(w="1") + " SELECT q AS id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, label) = 1")
def knn_classifier_predict(spark, sf):
    df = embeddings(spark, sf)
    return KNeighborsClassifier(5).fit(df).predict(df).select("id", "prediction")


@query(_VOTES.format(w="1 / (dist + 1e-10)") + " SELECT q AS id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, nearest, label) = 1")
def knn_classifier_weighted_predict(spark, sf):
    df = embeddings(spark, sf)
    return KNeighborsClassifier(5, "distance").fit(df).predict(df).select("id", "prediction")


@query(_VOTES.format(w="1") + " SELECT q AS id, label, round(w / sum(w) OVER (PARTITION BY q), 6) AS share FROM v")
def knn_classifier_proba(spark, sf):
    df = embeddings(spark, sf)
    return rounded(KNeighborsClassifier(5).fit(df).predict_proba(df), share=6)


@query(_NEAR + " SELECT q AS id, round(avg(label), 6) AS prediction FROM k JOIN embeddings ON t = vec_id GROUP BY q")
def knn_regressor_predict(spark, sf):
    df = embeddings(spark, sf)
    return KNeighborsRegressor(5).fit(df).predict(df).select("id", r("prediction").alias("prediction"))


@query(_NEAR + " SELECT q AS id, round(sum(label / (dist + 1e-10)) / sum(1 / (dist + 1e-10)), 6) + 0.0 AS prediction FROM k JOIN embeddings ON t = vec_id GROUP BY q")
def knn_regressor_weighted_predict(spark, sf):
    df = embeddings(spark, sf)
    return KNeighborsRegressor(5, "distance").fit(df).predict(df).select("id", r("prediction").alias("prediction"))


@query(f"{_PAIRS} SELECT q AS left_id, t AS right_id, round(exp(-0.5 * d2), 6) AS value FROM d")
def rbf_kernel(spark, sf):
    e = embeddings(spark, sf).select("id", "features")
    return pairwise(e, e, "sqeuclidean").select("left_id", "right_id", quick(V.rbf(F.col("distance"), 0.5)).alias("value"))


# ---- clusters

_CENTERS = f"WITH e AS ({_UNNEST}), c AS (SELECT vec_id AS c, i, x FROM e WHERE vec_id < 8), d AS (SELECT e.vec_id, c.c, sum((e.x - c.x) * (e.x - c.x)) AS d2 FROM e JOIN c ON e.i = c.i GROUP BY 1, 2)"


def _given_centers(spark: SparkSession, sf: str, max_iter: int = 0) -> tuple[KMeans, DataFrame]:
    df = embeddings(spark, sf)
    m = KMeans(8, init=np.array([x.features for x in df.where("id < 8").orderBy("id").collect()]), max_iter=max_iter, tol=0.0)
    return m.fit(df), df


@query(_CENTERS + " SELECT vec_id AS id, CAST(arg_min(c, (d2, c)) AS INTEGER) AS prediction FROM d GROUP BY 1")
def kmeans_assign(spark, sf):
    m, df = _given_centers(spark, sf)
    return m.predict(df).select("id", "prediction")


@query(_CENTERS + " SELECT round(sum(d2), 6) AS inertia FROM (SELECT min(d2) AS d2 FROM d GROUP BY vec_id)")
def kmeans_inertia(spark, sf):
    return spark.createDataFrame([(round(_given_centers(spark, sf)[0].inertia_, 6),)], "inertia double")


@query(_CENTERS + " SELECT vec_id AS id, CAST(c AS INTEGER) AS cluster, round(sqrt(d2), 6) AS distance FROM d")
def kmeans_transform(spark, sf):
    m, df = _given_centers(spark, sf)
    return m.transform(df).select("id", F.posexplode("distances").alias("cluster", "d")).select("id", "cluster", r("d").alias("distance"))


def _lloyd_sql(steps: int) -> str:
    out = [f"e AS MATERIALIZED ({_UNNEST})", "c0 AS MATERIALIZED (SELECT CAST(vec_id AS INTEGER) AS c, i, x FROM e WHERE vec_id < 8)"]
    for k in range(steps):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d2, c)) AS c FROM (SELECT e.vec_id, c, sum((e.x - k.x) * (e.x - k.x)) AS d2 FROM e JOIN c{k} k ON e.i = k.i GROUP BY 1, 2) GROUP BY 1)")
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(n.x, k.x) AS x FROM c{k} k LEFT JOIN (SELECT a.c, e.i, avg(e.x) AS x FROM a{k} a JOIN e USING (vec_id) GROUP BY 1, 2) n ON n.c = k.c AND n.i = k.i)")
    return f"WITH {', '.join(out)} SELECT c AS cluster, CAST(i AS INTEGER) AS dim, round(x, 8) + 0.0 AS value FROM c{steps}"


@query(_lloyd_sql(4))
def kmeans_fit(spark, sf):
    return rounded(_given_centers(spark, sf, 4)[0].to_df(spark), value=8)


EPS, MIN_SAMPLES = 0.02, 4
_NEAR_2D = f"WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1] :: DOUBLE AS x, embedding[2] :: DOUBLE AS y FROM embeddings), n AS MATERIALIZED (SELECT a.id, b.id AS other FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS} * {EPS})"


_DBSCAN = f""", core AS MATERIALIZED (SELECT id FROM n GROUP BY id HAVING count(*) >= {MIN_SAMPLES}),
ce AS MATERIALIZED (SELECT n.id, n.other FROM n JOIN core a ON n.id = a.id JOIN core b ON n.other = b.id),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.other, reach.root FROM reach JOIN ce ON ce.id = reach.id),
root AS MATERIALIZED (SELECT id, min(root) AS root FROM reach GROUP BY id),
num AS (SELECT root, CAST(row_number() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT root FROM root)),
border AS (SELECT n.id, min(n.other) AS other FROM n JOIN core ON n.other = core.id WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id)
SELECT p.id, coalesce(a.cluster, b.cluster, -1) AS cluster, root.id IS NOT NULL AS is_core
FROM p LEFT JOIN root ON root.id = p.id LEFT JOIN num a ON a.root = root.root LEFT JOIN border ON border.id = p.id LEFT JOIN root r2 ON r2.id = border.other LEFT JOIN num b ON b.root = r2.root"""


@query(_NEAR_2D + _DBSCAN)
def dbscan_fit(spark, sf):
    return DBSCAN(EPS, MIN_SAMPLES).fit(embeddings(spark, sf, 2)).labels_


@query(_NEAR_2D + ", reach(id, root) AS (SELECT DISTINCT id, id FROM n WHERE id <> other UNION SELECT n.other, reach.root FROM reach JOIN n ON n.id = reach.id) SELECT id, min(root) AS component FROM reach GROUP BY id", "connected_components")
def _components(spark, sf):
    return radius_components(embeddings(spark, sf, 2).select("id", "features"), EPS)


@query(_NEAR_2D + " SELECT id, other FROM n WHERE id <> other", "radius_neighbors")
def _radius(spark, sf):
    return radius_edges(embeddings(spark, sf, 2).select("id", "features"), EPS)


@query("SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN -10.0 WHEN 'N' THEN 0.0 ELSE 7.0 END :: DOUBLE AS value, CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 2.0 END :: DOUBLE AS other FROM lineitem")
def kmeans_parallel_init_separate(spark, sf):
    """As many clusters as there are different rows: seeding must find them all."""
    df = table(spark, sf, "lineitem").selectExpr("case l_returnflag when 'A' then -10.0D when 'N' then 0.0D else 7.0D end AS a", "case l_linestatus when 'F' then 1.0D else 2.0D end AS b")
    df = to_features(df, ["a", "b"])
    m = KMeans(df.distinct().count(), random_state=1).fit(df)
    return spark.createDataFrame([tuple(float(v) for v in c) for c in m.cluster_centers_], "value double, other double")


def _near_whole(eps: float) -> str:
    return f"WITH RECURSIVE e AS ({_UNNEST}), n AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS other FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2 HAVING sum((a.x - b.x) * (a.x - b.x)) <= {eps} * {eps})"


#: Over whole vectors, which lie about 1.4 apart.
WHOLE_EPS = 1.13


@query(f"{_near_whole(WHOLE_EPS)} SELECT id, other FROM n WHERE id <> other", "radius_neighbors_whole")
def _radius_whole(spark, sf):
    return NearestNeighbors(5).fit(e := embeddings(spark, sf)).radius_neighbors(WHOLE_EPS, e).where("left_id != right_id").select(F.col("left_id").alias("id"), F.col("right_id").alias("other"))


@query(_near_whole(WHOLE_EPS) + ", p AS (SELECT vec_id AS id FROM embeddings)" + _DBSCAN)
def dbscan_whole_fit(spark, sf):
    return DBSCAN(WHOLE_EPS, MIN_SAMPLES).fit(embeddings(spark, sf)).labels_


@query()
def kmeans_parallel_init_fit(spark, sf):
    m = KMeans(8, max_iter=20, random_state=3).fit(embeddings(spark, sf))
    return rounded(m.to_df(spark), value=4)


# ---- decompositions: two features have eigenvalues in closed form

_EIGEN = """WITH s AS (SELECT count(*) n, {a} a, {b} b, {c} c, var_samp(p_size) + var_samp(p_retailprice) AS total FROM part),
l AS (SELECT n, total, 0 AS component, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS s2 FROM s UNION ALL SELECT n, total, 1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 FROM s)
SELECT component, round(sqrt(s2), 3) AS singular_value, round(s2 / (n - 1), 3) AS explained_variance, round(s2 / (n - 1) / total, 8) AS explained_variance_ratio FROM l"""


def _spectrum(model, spark: SparkSession) -> DataFrame:
    return rounded(model.to_df(spark).drop("vector"), singular_value=3, explained_variance=3, explained_variance_ratio=8)


@query(_EIGEN.format(a="var_pop(p_size) * count(*)", b="covar_pop(p_size, p_retailprice) * count(*)", c="var_pop(p_retailprice) * count(*)"))
def pca_fit(spark, sf):
    return _spectrum(PCA().fit(parts(spark, sf)), spark)


@query(_EIGEN.format(a="sum(p_size * p_size)", b="sum(p_size * p_retailprice)", c="sum(p_retailprice * p_retailprice)"))
def truncated_svd_fit(spark, sf):
    return _spectrum(TruncatedSVD(2).fit(parts(spark, sf)), spark)


_VECTORS = """WITH s AS (SELECT {a} a, {b} b, {c} c FROM part), l AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l FROM s),
u AS (SELECT b / sqrt(b * b + (l - a) * (l - a)) AS x, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS y FROM l),
v AS (SELECT 0 AS component, x, y FROM u UNION ALL SELECT 1, -y, x FROM u)
SELECT component, round(x * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END), 6) + 0.0 AS v0, round(y * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END), 6) + 0.0 AS v1 FROM v"""


def _directions(model, spark: SparkSession) -> DataFrame:
    return model.to_df(spark).select("component", r(F.col("vector")[0]).alias("v0"), r(F.col("vector")[1]).alias("v1"))


@query(_VECTORS.format(a="var_pop(p_size)", b="covar_pop(p_size, p_retailprice)", c="var_pop(p_retailprice)"))
def pca_components(spark, sf):
    return _directions(PCA().fit(parts(spark, sf)), spark)


@query(_VECTORS.format(a="avg(p_size * p_size)", b="avg(p_size * p_retailprice)", c="avg(p_retailprice * p_retailprice)"))
def truncated_svd_components(spark, sf):
    return _directions(TruncatedSVD(2).fit(parts(spark, sf)), spark)


@query(f"WITH e AS ({_UNNEST}) SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_samp(x) AS v FROM e GROUP BY i)")
def pca_total_variance(spark, sf):
    return spark.createDataFrame([(round(float(PCA().fit(embeddings(spark, sf)).explained_variance_.sum()), 6),)], "total_variance double")


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings")
def truncated_svd_transform_norms(spark, sf):
    df = embeddings(spark, sf)
    return TruncatedSVD(64).fit_transform(df).select("id", r(V.norm_squared(F.col("features"))).alias("norm2"))


# ---- support vectors and trees


@query(f"{_PAIRS} SELECT q AS id, round(sum((CASE WHEN t % 2 = 0 THEN 1 ELSE -0.5 END) * exp(-0.7 * d2)) + 0.1, 6) + 0.0 AS decision FROM d WHERE t < 40 GROUP BY q")
def svc_decision(spark, sf):
    df = embeddings(spark, sf)
    vectors = [x.features for x in df.where("id < 40").orderBy("id").collect()]
    m = SVC().given(spark, [vectors], [[1.0 if i % 2 == 0 else -0.5 for i in range(40)]], [0.1], 0.7)
    m.pairs_ = [(0, 1)]
    return m.decision_function(df).select("id", r("decision").alias("decision"))


def _flag(spark: SparkSession, sf: str) -> DataFrame:
    return to_features(table(spark, sf, "lineitem").withColumn("x", F.expr("int(l_returnflag = 'R')")), ["x"], label=F.expr("int(l_returnflag = 'R')"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return to_features(table(spark, sf, "part").withColumn("x", (F.col("p_size") + 0.1) / 50), ["x"], id=F.col("p_partkey"))


# Two different rows, however often: the machine is known in closed form.
_TWO_POINTS = """WITH g AS (SELECT 1 / var_pop(CAST(l_returnflag = 'R' AS INTEGER)) AS g FROM lineitem), x AS (SELECT p_partkey AS id, (p_size + 0.1) :: DOUBLE / 50 AS x FROM part),
k AS (SELECT id, (exp(-g * (x - 1) * (x - 1)) - exp(-g * x * x)) / (1 - exp(-g)) AS z FROM x, g)"""


@query(_TWO_POINTS + " SELECT id, round(z, 6) + 0.0 AS decision, CAST(z > 0 AS INTEGER) AS prediction FROM k")
def svc_fit_two_points(spark, sf):
    m = SVC(tol=1e-10).fit(_flag(spark, sf))
    return m.predict(m.decision_function(_sizes(spark, sf))).select("id", r("decision").alias("decision"), "prediction")


@query(_TWO_POINTS + " SELECT id, round(0.5 + 0.4 * z, 6) AS prediction FROM k")
def svr_fit_two_points(spark, sf):
    return SVR(tol=1e-10).fit(_flag(spark, sf)).predict(_sizes(spark, sf)).select("id", r("prediction").alias("prediction"))


@query()
def svc_fit(spark, sf):
    df = embeddings(spark, sf).withColumn("label", F.expr("int(label < 5)"))
    return SVC().fit(df).predict(df).select("id", "prediction")


@query()
def svr_fit(spark, sf):
    df = embeddings(spark, sf).withColumn("label", F.col("features")[0])
    return SVR(C=10.0).fit(df).predict(df).select("id", r("prediction", 1).alias("prediction"))


_TREES = [
    Tree([0, 1, -1, -1, -1], [25.0, 1200.0, 0.0, 0.0, 0.0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0.0, 0.0, 0.25, -1.0, 0.5]),
    Tree([1, -1, -1], [1000.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 0.125, -0.375]),
]


@query("SELECT p_partkey AS id, 3.0 + CASE WHEN p_size <= 25 THEN CASE WHEN p_retailprice <= 1200 THEN -1.0 ELSE 0.5 END ELSE 0.25 END + CASE WHEN p_retailprice <= 1000.5 THEN 0.125 ELSE -0.375 END :: DOUBLE AS prediction FROM part")
def tree_predict(spark, sf):
    return parts(spark, sf).select("id", predict_all(F.col("features"), _TREES, 3.0).alias("prediction"))


def _stumps_sql(y: str, baseline: str, gradient: str, hessian: str, steps: int, rate: float) -> str:
    """Boosted stumps over one feature, grouped by its values: a few common tables for each step; ends in b{steps} (x, raw)."""
    out = [f"d AS (SELECT l_quantity AS x, count(*) AS n, CAST(sum({y}) AS DOUBLE) AS y FROM lineitem GROUP BY 1)", f"b0 AS (SELECT *, (SELECT {baseline} FROM d) AS raw FROM d)"]
    for k in range(steps):
        out.append(f"g{k} AS (SELECT x, n, {gradient} AS g, {hessian} AS h FROM b{k})")
        out.append(f"c{k} AS (SELECT x, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(n) OVER o AS nl, sum(g) OVER () AS gt, sum(h) OVER () AS ht, sum(n) OVER () AS nt FROM g{k} WINDOW o AS (ORDER BY x))")
        out.append(f"s{k} AS MATERIALIZED (SELECT x AS t, -{rate} * gl / hl AS l, -{rate} * (gt - gl) / (ht - hl) AS r FROM c{k} WHERE nl >= 20 AND nt - nl >= 20 ORDER BY gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) DESC LIMIT 1)")
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT x, n, y, raw + CASE WHEN x <= t THEN l ELSE r END AS raw FROM b{k}, s{k})")
    return "WITH " + ", ".join(out)


@query(_stumps_sql("l_extendedprice", "sum(y) / sum(n)", "n * raw - y", "n", 5, 0.5) + " SELECT CAST(x AS DOUBLE) AS quantity, round(raw, 3) AS prediction FROM b5")
def hist_gradient_boosting_regressor_stumps(spark, sf):
    df = lineitem(spark, sf, "l_extendedprice", ["l_quantity"])
    m = HistGradientBoostingRegressor(learning_rate=0.5, max_iter=5, max_leaf_nodes=2).fit(df)
    return m.predict(df.select("features").distinct()).select(F.col("features")[0].alias("quantity"), r("prediction", 3).alias("prediction"))


@query(
    _stumps_sql("CAST(l_returnflag = 'R' AS INTEGER)", "ln(sum(y) / (sum(n) - sum(y)))", "n / (1 + exp(-raw)) - y", "n / (1 + exp(-raw)) * (1 - 1 / (1 + exp(-raw)))", 4, 0.5)
    + " SELECT CAST(x AS DOUBLE) AS quantity, CAST(raw >= 0 AS INTEGER) AS prediction, round(1 / (1 + exp(-raw)), 6) AS probability FROM b4"
)
def hist_gradient_boosting_classifier_stumps(spark, sf):
    df = lineitem(spark, sf, "int(l_returnflag = 'R')", ["l_quantity"])
    m = HistGradientBoostingClassifier(learning_rate=0.5, max_iter=4, max_leaf_nodes=2).fit(df)
    rows = m.predict_proba(m.predict(df.select("features").distinct()))
    return rows.select(F.col("features")[0].alias("quantity"), "prediction", r(F.col("probability")[1]).alias("probability"))


@query()
def hist_gradient_boosting_regressor_fit(spark, sf):
    m = HistGradientBoostingRegressor(max_iter=3, max_leaf_nodes=8, max_depth=3).fit(lineitem(spark, sf, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))
    return rounded(m.to_df(spark), threshold=6, value=2)


@query()
def hist_gradient_boosting_classifier_fit(spark, sf):
    m = HistGradientBoostingClassifier(max_iter=2, max_leaf_nodes=4, max_depth=2).fit(lineitem(spark, sf, "l_returnflag", ["l_quantity", "l_extendedprice"]))
    return rounded(m.to_df(spark), threshold=6, value=4)


# ---- scalar primitives


@query(
    "SELECT event_id, round(1 / (1 + exp(-greatest(-100, least(100, value / 10)))), 6) AS sigmoid, round(greatest(CASE WHEN event_id % 2 = 1 THEN -value / 10 ELSE value / 10 END, 0) + ln(1 + exp(-abs(value / 10))), 6) + 0.0 AS log_loss, "
    "round(sign(value) * greatest(abs(value) - 20, 0), 6) + 0.0 AS soft_threshold FROM events"
)
def scalar_functions(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", r(V.sigmoid(v / 10)).alias("sigmoid"), r(V.log_loss(v / 10, F.col("event_id") % 2)).alias("log_loss"), r(V.soft_threshold(v, 20.0)).alias("soft_threshold"))


@query(f"WITH e AS ({_UNNEST}), s AS (SELECT vec_id, sum(exp(x)) AS s, any_value(label) AS label FROM e GROUP BY 1) SELECT s.vec_id AS id, round(-ln(greatest(1e-7, exp(e.x) / s.s)), 6) AS cross_entropy FROM s JOIN e ON e.vec_id = s.vec_id AND e.i = s.label")
def softmax_cross_entropy(spark, sf):
    return embeddings(spark, sf).withColumn("p", V.softmax(F.col("features"))).select("id", r(V.cross_entropy(F.col("p"), F.col("label"))).alias("cross_entropy"))


@query("SELECT p_partkey AS id, round(2.0 * p_size - 0.5 * p_retailprice, 6) + 0.0 AS f0, round(CAST(p_size AS DOUBLE), 6) AS f1 FROM part")
def matrix_product(spark, sf):
    return _two(parts(spark, sf).withColumn("features", V.matmul(F.col("features"), [[2.0, 1.0], [-0.5, 0.0]])))


@query("SELECT p_partkey AS id, round(p_size - (SELECT avg(p_size) FROM part), 6) + 0.0 AS f0, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 6) + 0.0 AS f1 FROM part")
def center_columns(spark, sf):
    mean, _ = stats.moments(df := parts(spark, sf))
    return _two(df.withColumn("features", V.center(F.col("features"), mean)))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings")
def row_norms(spark, sf):
    return embeddings(spark, sf).select("id", r(V.norm_squared(F.col("features"))).alias("norm2"))
