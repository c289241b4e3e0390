"""Model fitting and experiments on Spark ML: every fit and every score is a Spark job over all rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as K
from pyspark.ml import clustering as G
from pyspark.ml import evaluation as E
from pyspark.ml import feature as T
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edlens.functions.hashing import key_unit, poisson_one
from edlens.operators import isotonic as I
from edlens.operators.fairness import fairness_by_group, worst_group_accuracy
from edlens.operators.metrics import classification_metrics, rates, ratio, regression_metrics, score_cells
from edlens.operators.ordered import in_order, shuffled_position
from edlens.operators.profile import numeric_columns
from edlens.operators.splits import stratified_kfold
from edlens.session import materialise

SEED = 42
CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda **p: K.LogisticRegression(maxIter=p.pop("maxIter", 100), **p),
    "random_forest": lambda **p: K.RandomForestClassifier(seed=SEED, numTrees=p.pop("numTrees", 100), **p),
    "gradient_boosting": lambda **p: K.GBTClassifier(seed=SEED, **p),
    "svm": lambda **p: K.LinearSVC(**p),
    "naive_bayes": lambda **p: K.NaiveBayes(modelType="gaussian", **p),
    "mlp": lambda **p: K.MultilayerPerceptronClassifier(seed=SEED, **p),
    "decision_tree": lambda **p: K.DecisionTreeClassifier(seed=SEED, **p),
}
REGRESSORS: dict[str, Callable] = {
    "linear": lambda **p: R.LinearRegression(**p),
    "ridge": lambda **p: R.LinearRegression(regParam=p.pop("regParam", 1.0), elasticNetParam=0.0, **p),
    "lasso": lambda **p: R.LinearRegression(regParam=p.pop("regParam", 1.0), elasticNetParam=1.0, **p),
    "random_forest": lambda **p: R.RandomForestRegressor(seed=SEED, numTrees=p.pop("numTrees", 100), **p),
    "gradient_boosting": lambda **p: R.GBTRegressor(seed=SEED, **p),
    "decision_tree": lambda **p: R.DecisionTreeRegressor(seed=SEED, **p),
}
SCALED = {"logistic", "svm", "mlp", "linear", "ridge", "lasso"}


def make_estimator(kind: str, task: str = "classification", n_features: int | None = None, **params):
    table = {"classification": CLASSIFIERS, "regression": REGRESSORS}.get(task, {})
    if kind not in table:
        raise ValueError(f"unsupported {task} model {kind}; known: {sorted(table)}")
    if kind == "mlp":
        params.setdefault("layers", [n_features, 16, 2])
    return table[kind](featuresCol="features", labelCol="label", **params)


@dataclass
class Fitted:
    pipeline: PipelineModel
    features: list[str]
    label: str
    kind: str
    task: str

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Rows with the positive-class probability (or the prediction of a regression)."""
        cols = df.columns
        scored = self.pipeline.transform(df)
        if self.task == "regression":
            value = F.col("prediction")
        elif self.kind == "svm":
            value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        else:
            value = vector_to_array("probability")[1]
        return scored.select(*cols, value.alias(out))

    @property
    def model(self):
        return self.pipeline.stages[-1]

    def importances(self) -> DataFrame:
        """Tree importances, or absolute coefficients of scaled features."""
        m = self.model
        v = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
        rows = [(f, float(x)) for f, x in zip(self.features, v)]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def fit_model(df: DataFrame, features: list[str], label: str, kind: str = "logistic", task: str = "classification", weight: str | None = None, **params) -> Fitted:
    vectors = {f.name for f in df.schema if isinstance(f.dataType, VectorUDT)}
    cols = [F.col(c) if c in vectors else F.col(c).cast("double").alias(c) for c in features]
    data = df.select(*cols, F.col(label).cast("double").alias("label"), *([F.col(weight).alias("__weight")] if weight else []))
    data = data.hint("rebalance")  # even partitions, as many as the size needs: training passes over them many times
    if weight:
        params["weightCol"] = "__weight"
    stages = [T.VectorAssembler(inputCols=features, outputCol="raw" if kind in SCALED else "features", handleInvalid="error")]
    if kind in SCALED:
        stages.append(T.StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    stages.append(make_estimator(kind, task, len(features), **params))
    return Fitted(Pipeline(stages=stages).fit(data), features, label, kind, task)


def evaluate(scored: DataFrame, label: str, by: list[str] | None = None, p: str = "p") -> DataFrame:
    """Accuracy, F1, balanced accuracy and AUC at a threshold of .5, all from one table of score cells: rows are scored once."""
    by = by or []
    rows = scored.select(*by, F.col(label).cast("int").alias("y"), F.col(p).alias("p"))
    cells = materialise(score_cells(rows, by)).withColumn("__neg", -F.col("score"))
    run = in_order(cells, by, ["__neg"], running={"above": "pos"})
    called, pos = F.col("score") >= 0.5, F.col("pos")
    g = run.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(called, pos)), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(called, F.col("n") - pos)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~called, F.col("n") - pos)), F.lit(0)).alias("tn"), F.coalesce(F.sum(F.when(~called, pos)), F.lit(0)).alias("fn"),
        F.sum((F.col("n") - pos) * (F.col("above") - pos / 2.0)).alias("area"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.select(*by, *[rates()[c].alias(c) for c in ("accuracy", "f1", "balanced_accuracy")], ratio(F.col("area"), (tp + fn) * (fp + tn), 0.5).alias("roc_auc"))


def cross_predict(df: DataFrame, key: list[str], features: list[str], label: str, kind: str = "logistic", task: str = "classification", folds: int = 5, strata: list[str] | None = None, out: str = "p", **params) -> DataFrame:
    """Out-of-fold scores: every row is scored by the model that has not seen it."""
    parts = stratified_kfold(df, key, strata if strata is not None else ([label] if task == "classification" else []), folds)
    parts = materialise(parts)
    scored = None
    for f in range(folds):
        m = fit_model(parts.where(F.col("fold") != f), features, label, kind, task, **params)
        s = m.score(parts.where(F.col("fold") == f), out)
        scored = s if scored is None else scored.unionByName(s)
    return scored


def platt(cal: DataFrame, test: DataFrame, y: str = "y", p: str = "p", out: str = "calibrated") -> DataFrame:
    m = fit_model(cal.select(F.col(p).alias("__p"), F.col(y).alias("__y")), ["__p"], "__y")
    return m.score(test.withColumn("__p", F.col(p)), out).drop("__p")


def isotonic(cal: DataFrame, test: DataFrame, y: str = "y", p: str = "p", out: str = "calibrated") -> DataFrame:
    """Isotonic fit on rows averaged per distinct score; scores outside the fitted range take its ends."""
    return I.predict(test, I.fit(cal, y, p), p, out)


def fit_stacking_calibrator(df: DataFrame, y: str, l2: float = 1e-3, prefix: str = "prob_") -> dict:
    """Logistic weights over the ``prob_*`` columns: names, weights, bias."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    data = T.VectorAssembler(inputCols=cols, outputCol="features").transform(df.select(*cols, F.col(y).cast("double").alias("label")))
    m = K.LogisticRegression(regParam=2 * l2, standardization=False, maxIter=200).fit(data)
    return {"names": [c[len(prefix) :] for c in cols], "weights": [float(w) for w in m.coefficients], "bias": float(m.intercept)}


def grid_search(df: DataFrame, key: list[str], features: list[str], label: str, kind: str, grid: dict[str, list], task: str = "classification", folds: int = 5, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """Best parameters and the mean score of every grid point, on stratified folds."""
    parts = stratified_kfold(df, key, [label] if task == "classification" else [], folds)
    data = materialise(parts.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"), "fold"))
    raw = "raw" if kind in SCALED else "features"
    est = make_estimator(kind, task, len(features))
    stages = [T.VectorAssembler(inputCols=features, outputCol=raw), *([T.StandardScaler(inputCol=raw, outputCol="features", withMean=True)] if kind in SCALED else []), est]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    points = builder.build()
    metric = E.BinaryClassificationEvaluator() if task == "classification" else E.RegressionEvaluator(metricName="rmse")
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=points, evaluator=metric, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(data)
    rows = [({p.name: v for p, v in m.items()}, float(s)) for m, s in zip(points, cv.avgMetrics)]
    best = (max if metric.isLargerBetter() else min)(rows, key=lambda r: r[1])[0]
    table = df.sparkSession.createDataFrame([(str(sorted(p.items())), s) for p, s in rows], "params string, score double")
    return best, table


def nested_cv(df: DataFrame, key: list[str], features: list[str], label: str, kind: str, grid: dict[str, list], task: str = "regression", outer: int = 10, inner: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per outer fold metrics with parameters chosen inside, and out-of-fold predictions."""
    parts = materialise(stratified_kfold(df, key, [label] if task == "classification" else [], outer, seed=SEED + 1).withColumnRenamed("fold", "outer_fold"))
    preds = None
    for f in range(outer):
        train = parts.where(F.col("outer_fold") != f)
        best, _ = grid_search(train, key, features, label, kind, grid, task, inner)
        s = fit_model(train, features, label, kind, task, **best).score(parts.where(F.col("outer_fold") == f), "yhat")
        preds = s if preds is None else preds.unionByName(s)
    if task == "regression":
        return regression_metrics(preds, ["outer_fold"], label, "yhat"), preds
    return evaluate(preds, label, ["outer_fold"], "yhat"), preds


def stack(df: DataFrame, key: list[str], features: list[str], label: str, bases: list[str], folds: int = 5) -> DataFrame:
    """Out-of-fold base probabilities combined by a logistic meta learner fitted on them."""
    wide = None
    for b in bases:
        s = cross_predict(df.select(*key, *features, label), key, features, label, b, folds=folds, out=f"prob_{b}")
        s = s.select(*key, f"prob_{b}") if wide is not None else s.select(*key, label, f"prob_{b}")
        wide = s if wide is None else wide.join(s, key)
    wide = materialise(wide)  # one fold of lineage per base model and fold ends here
    meta = fit_model(wide, [f"prob_{b}" for b in bases], label)
    return meta.score(wide)


def bag(train: DataFrame, test: DataFrame, key: list[str], features: list[str], label: str, kind: str = "decision_tree", models: int = 10, task: str = "classification") -> DataFrame:
    """Mean score of models fitted on bootstrap weights (Poisson draws hashed from the key)."""
    out, names = test, []
    for i in range(models):
        drawn = train.withColumn("__w", poisson_one(key_unit(key, f"bag-{i}"))).where("__w > 0")
        out = fit_model(drawn, features, label, kind, task, weight="__w").score(out, f"__bag_{i}")
        names.append(f"__bag_{i}")
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / models
    return out.withColumn("p", mean).drop(*names)


def domain_classifier(df: DataFrame, key: list[str], features: list[str], folds: int = 5) -> DataFrame:
    """Accuracy and AUC of telling the domains apart, and the proxy A-distance 2 (1 - 2 err) in [0, 2]."""
    m = evaluate(cross_predict(df, key, features, "domain", folds=folds), "domain")
    return m.select("accuracy", "roc_auc", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 2 * (2 * F.col("accuracy") - 1))).alias("proxy_a_distance"))


def importance_weights(df: DataFrame, features: list[str], clip_at: float | None = 0.95, kind: str = "logistic") -> DataFrame:
    """Source rows with weights from a class-balanced domain classifier."""
    from edlens.operators.drift import odds_weights

    n = df.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["domain"]: r["n"] for r in n.collect()}  # two rows
    total = sum(counts.values())
    balance = F.when(F.col("domain") == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    m = fit_model(df.withColumn("__b", balance), features, "domain", kind, weight="__b")
    return odds_weights(m.score(df.where("domain = 0"), "p_target"), "p_target", clip_at)


def pca_features(df: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """Up to k principal components of the scaled features appended as pc_1 .. pc_k."""
    k = min(k, len(features))
    model = Pipeline(stages=[
        T.VectorAssembler(inputCols=features, outputCol="__raw"), T.StandardScaler(inputCol="__raw", outputCol="__s", withMean=True), T.PCA(k=k, inputCol="__s", outputCol="__pc")
    ]).fit(df)
    arr = vector_to_array("__pc")
    return model.transform(df).select(*df.columns, *[arr[i].alias(f"pc_{i + 1}") for i in range(k)])


def train_regression(df: DataFrame, key: list[str], target: str | None = None, candidates: tuple[str, ...] = ("final_score", "score", "G3"), test: float = 0.2) -> DataFrame:
    """Linear regression with one-hot strings (sparse, of any number of values) on a hold-out share; the target is the first candidate present."""
    from edlens.operators.prep import one_hot_vectors
    from edlens.operators.profile import string_columns

    target = target or next((c for c in candidates if c in df.columns), None)
    if target is None:
        raise ValueError(f"none of {candidates} present")
    data = df.dropna(subset=[target])
    features = [c for c in numeric_columns(data) if c not in (*key, target)]
    for c in [c for c in string_columns(data) if c not in key]:
        data = one_hot_vectors(data, data, c, f"{c}_levels", drop_base=True)
        features.append(f"{c}_levels")
    placed = shuffled_position(data, [], key, SEED)
    cut = F.round(F.col("__size") * test)
    m = fit_model(placed.where(F.col("__pos") > cut), features, target, "linear", "regression")
    return regression_metrics(m.score(placed.where(F.col("__pos") <= cut), "yhat"), [], target, "yhat")


def early_risk(df: DataFrame, key: list[str], features: list[str], label: str, group: str, folds: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-validated quality, group fairness and importances of a model on early grades."""
    scored = cross_predict(df, key, features, label, "random_forest", folds=folds, numTrees=20).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    fair = fairness_by_group(scored, [group], label)
    return evaluate(scored, label), fair, fit_model(df, features, label, "random_forest", numTrees=20).importances()


def segment(df: DataFrame, features: list[str], grade: str, k: int = 3) -> DataFrame:
    """Count and mean grade per cluster of k-means and bisecting k-means on scaled features."""
    prep = Pipeline(stages=[T.VectorAssembler(inputCols=features, outputCol="__raw"), T.StandardScaler(inputCol="__raw", outputCol="features", withMean=True)]).fit(df)
    data = materialise(prep.transform(df).select("features", grade))
    out = None
    for name, est in (("kmeans", G.KMeans(k=k, seed=0)), ("bisecting_kmeans", G.BisectingKMeans(k=k, seed=0))):
        s = est.fit(data).transform(data).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("count"), F.avg(grade).alias(f"avg_{grade}"))
        s = s.select(F.lit(name).alias("algorithm"), "cluster", "count", f"avg_{grade}")
        out = s if out is None else out.unionByName(s)
    return out


def transfer_experiment(source: DataFrame, target: DataFrame, key: str, cols: list[str], label: str, group: str, kinds: list[str], names: tuple[str, str] = ("source", "target"), both_ways: bool = True) -> DataFrame:
    """Train on one side, score the other; quality and accuracy of the worst group, per direction and model."""
    from edlens.operators.mapping import joint_prepare

    out = None
    for (a, an), (b, bn) in [((source, names[0]), (target, names[1])), ((target, names[1]), (source, names[0]))][: 1 + both_ways]:
        table = materialise(joint_prepare(a, b, cols, [key, label, group], products=0))
        for kind in kinds:
            m = fit_model(table.where("domain = 0"), cols, label, kind)
            s = m.score(table.where("domain = 1")).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
            row = evaluate(s, label).withColumn("worst_group_accuracy", worst_group_accuracy(s, group, label).select("worst_accuracy").scalar())
            row = row.select(F.lit(an).alias("source"), F.lit(bn).alias("target"), F.lit(kind).alias("model"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def ablation_plan(flags: list[str], pairs: bool = True, named: dict[str, list[str]] | None = None) -> dict[str, dict[str, bool]]:
    """Experiments: baseline without flags, each flag alone, pairs, and named combinations."""
    sets: dict[str, list[str]] = {"baseline": [], **{f: [f] for f in flags}}
    if pairs:
        sets.update({f"{a}+{b}": [a, b] for a, b in combinations(flags, 2)})
    sets.update(named or {})
    return {name: {f: f in on for f in flags} for name, on in sets.items()}


def ablation(plan: dict[str, dict[str, bool]], run: Callable[[dict[str, bool]], DataFrame]) -> DataFrame:
    """One row per experiment: its flags and the one-row metric table that ``run`` returns."""
    out = None
    for name, flags in plan.items():
        row = run(flags).select(F.lit(name).alias("experiment"), *[F.lit(v).alias(f) for f, v in flags.items()], "*")
        out = row if out is None else out.unionByName(row)
    return out


# Shares of target rows mixed in.
MIX_SHARES = (0.2, 0.5, 0.8, 1.0)


def progressive_mix(source: DataFrame, train: DataFrame, test: DataFrame, key: list[str], features: list[str], label: str, kind: str = "random_forest", shares: tuple[float, ...] = MIX_SHARES, **params) -> DataFrame:
    """Growing target share with a shrinking source sample; metrics per share, the best F1 flagged."""
    a, b = shuffled_position(source, [], key, SEED), shuffled_position(train, [], key, SEED)
    out = None
    for share in shares:
        part = lambda df, s: df.where(F.col("__pos") <= F.floor(F.col("__size") * F.lit(s))).select(*features, label)
        mixed = part(a, max(0.1, 1 - share)).unionByName(part(b, share))
        row = evaluate(fit_model(mixed, features, label, kind, **params).score(test), label).withColumn("target_share", F.lit(share))
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.max("f1")).scalar()
    return out.withColumn("best", F.col("f1") == best)


def learning_curve(df: DataFrame, key: list[str], features: list[str], label: str, kind: str = "linear", shares: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5) -> DataFrame:
    """Mean RMSE on training and validation rows per training share; smaller subsets lie inside larger ones."""
    parts = materialise(stratified_kfold(df, key, [], folds).withColumn("__u", key_unit(key, "curve")))
    out = None
    for f in range(folds):
        val = parts.where(F.col("fold") == f)
        for share in shares:
            train = parts.where((F.col("fold") != f) & (F.col("__u") <= share))
            m = fit_model(train, features, label, kind, "regression")
            for side, d in (("train", train), ("validation", val)):
                row = regression_metrics(m.score(d, "yhat"), [], label, "yhat").select(F.lit(share).alias("share"), F.lit(side).alias("side"), "rmse", "n")
                out = row if out is None else out.unionByName(row)
    return out.groupBy("share", "side").agg(F.avg("rmse").alias("rmse"), F.avg("n").alias("rows"))


def calibration_grid(cal: DataFrame, test: DataFrame, metrics: tuple[str, ...] = ("f1", "youden")) -> DataFrame:
    """Quality on the target for every calibration method and threshold rule, thresholds taken from the calibration rows."""
    from edlens.operators.calibration import optimal_threshold

    out = None
    methods = {"none": lambda d: d.withColumn("calibrated", F.col("p")), "platt": lambda d: platt(cal, d), "isotonic": lambda d: isotonic(cal, d)}
    for name, apply in methods.items():
        fitted, scored = apply(cal).drop("p").withColumnRenamed("calibrated", "p"), apply(test).drop("p").withColumnRenamed("calibrated", "p")
        for metric in metrics:
            t = optimal_threshold(fitted, [], metric).select("threshold").scalar()
            row = classification_metrics(scored.withColumn("pred", (F.col("p") >= t).cast("int")), []).select(F.lit(name).alias("method"), F.lit(metric).alias("rule"), "accuracy", "precision", "recall", "f1")
            out = row if out is None else out.unionByName(row)
    return out
