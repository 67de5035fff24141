"""Model evaluation and scoring.

The metrics are checked on a fixed score, a plain formula of the listing, so that SQL can follow.
``tuned_trees_a``, ``tuned_trees_b``, ``early_stopped_trees``, ``stacked_trees`` and ``train_price_model`` run with the defaults of the operators, which are those of a full run;
the models of the other queries have few, shallow trees.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from acreage.catalog.features import KEY, _SPLIT, _U, listings, parts
from acreage.functions.scalars import round_out
from acreage.operators import features as ft
from acreage.operators import modelling as m
from acreage.operators.boosting import Boosting, Settings
from acreage.operators.market import coverage
from acreage.operators.stages import TreeRegressor
from acreage.plans.train import TrainConfig, prepared_splits, train
from acreage.plans.views import with_views
from acreage.session import scratch_path, stored

_METRICS = {"mae": 3, "rmse": 3, "r2": 6, "r2_log": 6, "mape": 5, "medae": 3}
_FIXED = "(10.5::DOUBLE + 0.55::DOUBLE * ln(1 + area_sqm / 10))"
_FIXED_B = "(12::DOUBLE + 0.002::DOUBLE * area_sqm)"
_P = f", p AS (SELECT row_key, {_SPLIT} AS split, ln(1 + price_usd) AS label, {{score}} AS prediction, {_U} AS u FROM listings)"
_EVALUATE = """, e AS (SELECT split, label, prediction, exp(label) - 1 AS y, exp(label) - exp(prediction) AS err FROM p)
SELECT split, count(*) AS rows, round(avg(abs(err)), 3) AS mae, round(sqrt(avg(err * err)), 3) AS rmse,
       round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2,
       round(1 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(*)), 6) AS r2_log,
       round(avg(abs(err / (y + 1e-10::DOUBLE))) * 100, 5) AS mape, round(quantile_cont(abs(err), 0.5), 3) AS medae
FROM e GROUP BY split"""


def fixed_score(df):
    return F.lit(10.5) + F.lit(0.55) * F.log1p(F.col("area_sqm") / 10)


def other_score(df):
    return F.lit(12.0) + F.lit(0.002) * F.col("area_sqm")


def predicted(spark, sf, score=fixed_score):
    rows = parts(spark, sf)
    return rows.select("row_key", "split", F.log1p("price_usd").alias("label"), score(rows).alias("prediction"))


def _candidates(spark, sf):
    a = m.evaluate_all(predicted(spark, sf)).withColumn("model", F.lit("log_area"))
    b = m.evaluate_all(predicted(spark, sf, other_score)).withColumn("model", F.lit("linear_area"))
    return a.unionByName(b)


def _banded(spark, sf):
    rows = listings(spark, sf)
    return m.price_band(rows.withColumn("prediction", fixed_score(rows)), range_pct=F.col("rooms") * 5).select(
        "row_key", "predicted_price", "price_low", "price_high")


def _ridge(spark, sf):
    """Ridge coefficients of the log price on two of the features."""
    rows = stored(listings(spark, sf).select(F.log1p("price_usd").alias("label"), F.log1p("area_sqm").alias("x")), "rows")  # the fit reads them several times
    model = m.ridge(rows, ["x"], alpha=100.0)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double").select(
        F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _prepared(spark, sf):
    _, _, data = prepared_splits(listings(spark, sf))
    return data


def _rows(spark, sf):
    return _prepared(spark, sf).filter("split = 'train'")


def _tuned(grid):
    def build(spark, sf):
        rows = _rows(spark, sf)
        estimator, settings, score = m.fit_tuned(rows, grid)
        best = spark.createDataFrame([(score, str(sorted(settings.items())))], "cv_r2 double, settings string")
        return best.withColumn("trees", F.lit(estimator.fit(rows).getNumTrees))
    return build


def _evaluated(fit):
    """Metrics by split of a model fitted on the training rows."""
    def build(spark, sf):
        data = _prepared(spark, sf)
        model = fit(data.filter("split = 'train'"))
        return m.evaluate_all(model.transform(data).select("split", "label", "prediction"))
    return build


def _gbt_c(rows):
    return m.StackedModel([m.gbt_c().fit(rows)])


def _stacked(rows):
    """All three families with their default settings, the third from two seeds."""
    return m.fit_stack(rows, [Boosting(Settings()), Boosting(Settings(max_leaves=31)), m.gbt_c(seed=42), m.gbt_c(seed=43)])


def _cross_validated(spark, sf):
    folds = m.cross_val(listings(spark, sf), lambda rows: m.StackedModel([m._gbt(42, maxIter=3, maxDepth=3).fit(rows)]), KEY, folds=2)
    return m.summarise_folds(folds)


def _trained(spark, sf):
    _, tables = train(listings(spark, sf), TrainConfig())
    return tables["candidates"]


def _one_model(spark, sf):
    """A small model, saved and read back."""
    fitted, made = ft.fit_and_engineer(stored(parts(spark, sf), "rows", spread=True), F.col("split") == "train")
    data = ft.vectorise(made, fitted).select("split", "features", "label")
    model = m.StackedModel([m._gbt(42, maxIter=3, maxDepth=3).fit(data.filter("split = 'train'"))])
    metrics = m.evaluate_all(model.transform(data))
    path = m.PriceModel(fitted, model, metrics).save(scratch_path(spark, "model"))
    return m.PriceModel.load(spark, path)


def _scored(spark, sf):
    return _one_model(spark, sf).score(listings(spark, sf).drop("price_usd"))


_TREE = {"trees": 1, "rate": 1.0, "max_depth": 2, "least_rows": 30, "l1": 20.0, "l2": 1.5}
_TREE_INPUTS = ("rooms", "area_sqm", "building_age", "balcony")


def _tree_rows(spark, sf):
    """The listings with the price in 100,000 as target, joined once: the fit reads them several times."""
    return stored(listings(spark, sf).select("row_key", *_TREE_INPUTS, (F.col("price_usd") / 100000).alias("label")), "rows")


def _tree(leaves=None):
    """One tree on four columns of the listings, the price in 100,000 as target."""
    def build(spark, sf):
        vectors = VectorAssembler(inputCols=list(_TREE_INPUTS), outputCol="features").transform(_tree_rows(spark, sf))
        model = Boosting(Settings(**_TREE, max_leaves=leaves)).fit(vectors.select("features", "label"))
        names = F.array(*[F.lit(c) for c in _TREE_INPUTS])
        return model.nodes(spark).select(F.lit(round(model.base, 6)).alias("base"), "path", F.try_element_at(names, F.nullif("feature", F.lit(-1)) + 1).alias("feature"), "threshold", F.round("value", 6).alias("value"))
    return build


def _tree_scores(spark, sf):
    """The price in 100,000 that the same tree gives each listing, from a pipeline that was saved and read back."""
    rows = _tree_rows(spark, sf)
    stages = [VectorAssembler(inputCols=list(_TREE_INPUTS), outputCol="features"), TreeRegressor(_TREE)]
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path).transform(rows.drop("label")).select("row_key", F.round("prediction", 5).alias("prediction"))


def _tree_sql(leaves=None, scores=False):
    """Gradients as whole numbers; sums by value of each column; the best cut of the root, then of its children (of the better one only if there may be three leaves)."""
    l1, l2, least = (f"{_TREE[k]}::DOUBLE" for k in ("l1", "l2", "least_rows"))

    def part(g, h):
        return f"(greatest(abs({g} / 1048576::DOUBLE) - {l1}, 0::DOUBLE) * greatest(abs({g} / 1048576::DOUBLE) - {l1}, 0::DOUBLE) / ({h} + {l2}))"

    def level(rows, name):
        values = " UNION ALL ".join(f"SELECT path, {i} AS f, CAST({c} AS DOUBLE) AS x, g FROM {rows}" for i, c in enumerate(_TREE_INPUTS))
        return f"""{name}_sums AS (SELECT path, f, x, CAST(sum(g) AS BIGINT) AS g, count(*) AS h FROM ({values}) GROUP BY ALL),
            {name}_cuts AS (SELECT *, CAST(sum(g) OVER upto AS BIGINT) AS lg, CAST(sum(h) OVER upto AS BIGINT) AS lh, CAST(sum(g) OVER (PARTITION BY path, f) AS BIGINT) AS ag, CAST(sum(h) OVER (PARTITION BY path, f) AS BIGINT) AS ah
                FROM {name}_sums WINDOW upto AS (PARTITION BY path, f ORDER BY x)),
            {name}_gains AS (SELECT *, CASE WHEN lh >= {least} AND ah - lh >= {least} THEN {part('lg', 'lh')} + {part('(ag - lg)', '(ah - lh)')} - {part('ag', 'ah')} ELSE 0 END AS gain FROM {name}_cuts),
            {name} AS (SELECT * FROM {name}_gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, x) = 1)"""

    def below(name, source):
        value = "CASE s.f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(_TREE_INPUTS)) + " END"
        return f"{name} AS (SELECT r.* EXCLUDE (path), CASE WHEN s.f IS NULL THEN r.path WHEN {value} <= s.x THEN 2 * r.path ELSE 2 * r.path + 1 END AS path FROM {source[0]} r LEFT JOIN {source[1]} s ON r.path = s.path)"
    names = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_TREE_INPUTS)) + " END"
    order = "WHERE path > 1" + (" QUALIFY row_number() OVER (ORDER BY gain DESC, path) = 1" if leaves == 3 else "")
    nodes = f"""SELECT round(base, 6) AS base, path, feature, threshold, round(value, 6) AS value FROM b,
            (SELECT path, {names} AS feature, x AS threshold, 0 AS value FROM s0 UNION ALL SELECT path, {names}, x, 0 FROM s1
             UNION ALL SELECT path, NULL, NULL, -sign(g) * greatest(abs(g / 1048576::DOUBLE) - {l1}, 0::DOUBLE) / (h + {l2}) FROM leaf)"""
    return with_views(f""", y AS (SELECT *, price_usd / 100000 AS y FROM listings),
        b AS (SELECT CAST(sum(CAST(round_even(y * 1048576, 0) AS BIGINT)) AS BIGINT) / 1048576::DOUBLE / count(*) AS base FROM y),
        r0 AS (SELECT y.*, 1 AS path, CAST(round_even((base - y) * 1048576, 0) AS BIGINT) AS g FROM y, b),
        {level('r0', 's0')}, {below('r1', ('r0', 's0'))}, {level('r1', 's1_all')}, s1 AS (SELECT * FROM s1_all {order}), {below('r2', ('r1', 's1'))},
        leaf AS (SELECT path, CAST(sum(g) AS BIGINT) AS g, count(*) AS h FROM r2 GROUP BY path)
        {"SELECT row_key, round(base - sign(l.g) * greatest(abs(l.g / 1048576::DOUBLE) - " + l1 + ", 0::DOUBLE) / (h + " + l2 + "), 5) AS prediction FROM r2 JOIN leaf l USING (path), b" if scores else nodes}""", "listings")


def _coverage(spark, sf):
    train_rows = parts(spark, sf).filter("split = 'train'")
    return coverage(ft.target_encode_fit(train_rows, "city"), ft.target_encode_fit(train_rows, "country"))


ENTRIES = {
    "evaluate_splits": (
        lambda s, d: round_out(m.evaluate_all(predicted(s, d)), _METRICS),
        with_views(_P.format(score=_FIXED) + _EVALUATE, "listings")),
    "evaluate_test": (
        lambda s, d: round_out(m.evaluate(predicted(s, d).filter("split = 'test'")), _METRICS),
        with_views(_P.format(score=_FIXED) + _EVALUATE.replace("FROM p)", "FROM p WHERE split = 'test')"), "listings")),
    "select_best": (
        lambda s, d: round_out(m.select_best(_candidates(s, d).filter("split = 'val'")), {"best_score": 6}),
        with_views(f""", v AS (SELECT * FROM listings WHERE {_SPLIT} = 'val'),
            a AS (SELECT price_usd AS y, price_usd + 1 - exp({_FIXED}) AS e1, price_usd + 1 - exp({_FIXED_B}) AS e2 FROM v),
            r AS (SELECT 'log_area' AS best_model, 1 - sum(e1 * e1) / (var_pop(y) * count(*)) AS s FROM a
                  UNION ALL SELECT 'linear_area', 1 - sum(e2 * e2) / (var_pop(y) * count(*)) FROM a)
            SELECT best_model, round(s, 6) AS best_score FROM r ORDER BY s DESC, best_model LIMIT 1""", "listings")),
    "improvement": (
        lambda s, d: round_out(m.improvement(m.evaluate_all(predicted(s, d))), {"r2": 6, "improvement_pct": 4}),
        with_views(_P.format(score=_FIXED) + """, e AS (SELECT exp(label) - 1 AS y, exp(label) - exp(prediction) AS err FROM p WHERE split = 'test'),
            r AS (SELECT 1 - sum(err * err) / (var_pop(y) * count(*)) AS r2 FROM e)
            SELECT round(r2, 6) AS r2, round((r2 - 0.7153::DOUBLE) / 0.7153::DOUBLE * 100, 4) AS improvement_pct FROM r""", "listings")),
    "fold_scores": (
        lambda s, d: round_out(m.summarise_folds(m.evaluate_all(
            ft.assign_fold(predicted(s, d), KEY, 5), by="fold", groups=tuple(range(5)))), {"cv_r2_mean": 6, "cv_r2_std": 6}),
        with_views(_P.format(score=_FIXED) + """, e AS (SELECT least(4, CAST(floor(u * 5) AS INTEGER)) AS fold, exp(label) - 1 AS y,
                exp(label) - exp(prediction) AS err FROM p),
            r AS (SELECT fold, 1 - sum(err * err) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY fold)
            SELECT round(avg(r2), 6) AS cv_r2_mean, round(stddev_pop(r2), 6) AS cv_r2_std, count(*) AS folds FROM r""", "listings")),
    "price_band": (_banded, with_views(f""", p AS (SELECT row_key, exp({_FIXED}) - 1 AS p, rooms * 5 / 100 AS w FROM listings)
        SELECT row_key, round(p, 2) AS predicted_price, round(greatest(0, p * (1 - w)), 2) AS price_low,
               round(p * (1 + w), 2) AS price_high FROM p""", "listings")),
    "ridge": (_ridge, with_views(""", v AS (SELECT ln(1 + price_usd) AS y, ln(1 + area_sqm) AS x FROM listings),
        b AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 100) AS slope, avg(x) AS mx, avg(y) AS my FROM v)
        SELECT round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM b""", "listings")),
    "model_coverage": (_coverage, with_views(f""", t AS (SELECT * FROM listings WHERE {_SPLIT} = 'train')
        SELECT count(DISTINCT country) AS countries, count(DISTINCT city) AS cities FROM t""", "listings")),
    "level_wise_tree": (_tree(), _tree_sql()),
    "best_leaf_first_tree": (_tree(3), _tree_sql(3)),
    "saved_tree_scores": (_tree_scores, _tree_sql(scores=True)),
    "tuned_trees_a": (_tuned(m.GRID_A), None),
    "tuned_trees_b": (_tuned(m.GRID_B), None),
    "early_stopped_trees": (_evaluated(_gbt_c), None),
    "stacked_trees": (_evaluated(_stacked), None),
    "cross_validation": (_cross_validated, None),
    "train_price_model": (_trained, None),
    "score_listings": (_scored, None),
    "model_status": (lambda s, d: m.model_status(_one_model(s, d)), None),
}
