"""How well features predict a label, which ones carry it, and whether the label leaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.plans.longform import level
from specula.plans.sequence import with_position

MAX_LEVELS = 30


@dataclass
class Task:
    """What is predicted from what; ``kind`` is binary, multiclass or regression."""
    label: str
    numeric: list[str]
    nominal: list[str]
    kind: str
    row_id: str
    seed: int = 7

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.nominal]

    @property
    def metric(self) -> str:
        return {"binary": "roc_auc", "multiclass": "accuracy", "regression": "r2"}[self.kind]

    def without(self, columns: list[str]) -> "Task":
        keep = lambda names: [c for c in names if c not in columns]
        return Task(self.label, keep(self.numeric), keep(self.nominal), self.kind, self.row_id, self.seed)


def feature_set(features: list[str], leakage: list[str], label: str, types: dict[str, str]) -> list[str]:
    """The partition's features without leakage, label and text."""
    return [c for c in features if c not in leakage and c != label and types.get(c) != "text"]


def prepare(df: DataFrame, task: Task) -> DataFrame:
    """Typed columns and a numeric ``target``; class names are indexed in order of name."""
    out = df.filter(F.col(task.label).isNotNull()).select(
        task.row_id, *[F.col(c).cast("double").alias(c) for c in task.numeric], *[level(c).alias(c) for c in task.nominal],
        F.col(task.label).alias("_label"))
    if task.kind == "regression":
        return out.withColumn("target", F.col("_label").cast("double")).drop("_label")
    names = [r["v"] for r in out.select(F.col("_label").cast("string").alias("v")).distinct().orderBy("v").limit(101).collect()]
    if len(names) > 100:
        raise ValueError(f"{task.label!r} has more than 100 classes")
    place = F.array_position(F.array(*[F.lit(v) for v in names]), F.col("_label").cast("string"))
    return out.withColumn("target", (place - 1).cast("double")).drop("_label")


def baseline(rows: DataFrame, task: Task) -> DataFrame:
    """(kind, score) to beat: the majority share, 0.5 for a ranking metric, 0 for R squared."""
    if task.kind == "regression":
        return rows.agg(F.lit("mean").alias("kind"), F.lit(0.0).alias("score"))
    if task.kind == "binary":
        return rows.agg(F.lit("majority").alias("kind"), F.lit(0.5).alias("score"))
    counts = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.lit("majority").alias("kind"), (F.max("n") / F.sum("n")).alias("score"))


def model_pipeline(task: Task, model: str) -> Pipeline:
    """Median imputation, one-hot categories, scaling for the linear model, then the estimator."""
    stages = []
    inputs = []
    if task.numeric:
        stages.append(Imputer(inputCols=task.numeric, outputCols=[f"{c}_f" for c in task.numeric], strategy="median"))
        stages.append(VectorAssembler(inputCols=[f"{c}_f" for c in task.numeric], outputCol="numbers"))
        inputs.append("numbers")
        if model == "linear":
            stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
            inputs[-1] = "scaled"
    if task.nominal:
        stages.append(StringIndexer(inputCols=task.nominal, outputCols=[f"{c}_i" for c in task.nominal], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_i" for c in task.nominal], outputCols=[f"{c}_v" for c in task.nominal], handleInvalid="keep"))
        inputs += [f"{c}_v" for c in task.nominal]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    common = {"featuresCol": "features", "labelCol": "target"}
    if model == "linear":
        stages.append(LinearRegression(**common, regParam=1e-3, elasticNetParam=0.0) if task.kind == "regression"
                      else LogisticRegression(**common, regParam=1e-3, elasticNetParam=0.0))
    elif task.kind == "regression":
        stages.append(GBTRegressor(**common, maxIter=10, seed=task.seed))
    elif task.kind == "binary":
        stages.append(GBTClassifier(**common, maxIter=10, seed=task.seed))
    else:
        stages.append(RandomForestClassifier(**common, numTrees=20, seed=task.seed))
    return Pipeline(stages=stages)


def fold_rare(rows: DataFrame, task: Task) -> DataFrame:
    """Keep the most frequent levels of wide category columns; the others share one level."""
    for c in task.nominal:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        top = [r[c] for r in counts.orderBy(F.col("n").desc(), c).limit(MAX_LEVELS).collect()]
        if len(top) == MAX_LEVELS:
            rows = rows.withColumn(c, F.when(F.col(c).isin(top[:-1]), F.col(c)).otherwise("<other>"))
    return rows


def evaluate(predicted: DataFrame, task: Task) -> float:
    if task.kind == "binary":
        return float(BinaryClassificationEvaluator(labelCol="target", metricName="areaUnderROC").evaluate(predicted))
    if task.kind == "multiclass":
        return float(MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(predicted))
    return float(RegressionEvaluator(labelCol="target", metricName="r2").evaluate(predicted))


def dealt(rows: DataFrame, task: Task) -> DataFrame:
    """Add ``_deal``: each row's place in a seeded order of its class, which folds and hold-outs read."""
    draw = F.pmod(F.xxhash64(F.col(task.row_id), F.lit(task.seed)), F.lit(1 << 52)).cast("double")
    group = F.lit(0.0) if task.kind == "regression" else F.col("target")
    return with_position(rows.withColumn("_draw", draw).withColumn("_class", group), ["_class"], "_draw", task.row_id, "_deal").drop("_draw", "_class")


def cross_validate(rows: DataFrame, task: Task, model: str, folds: int = 5) -> list[float]:
    placed = dealt(rows, task).withColumn("_fold", F.col("_deal") % folds).cache()
    scores = []
    for k in range(folds):
        fitted = model_pipeline(task, model).fit(placed.filter(F.col("_fold") != k))
        scores.append(evaluate(fitted.transform(placed.filter(F.col("_fold") == k)), task))
    placed.unpersist()
    return scores


def model_scores(df: DataFrame, task: Task, models=("linear", "boosting"), folds: int = 5) -> DataFrame:
    """(model, metric, score, ci_low, ci_high, folds) by stratified cross-validation."""
    rows = fold_rare(prepare(df, task), task)
    out = []
    for m in models:
        scores = cross_validate(rows, task, m, folds)
        mean = sum(scores) / folds
        half = 1.96 * (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5 / folds ** 0.5
        out.append((m, task.metric, mean, mean - half, mean + half, scores))
    return df.sparkSession.createDataFrame(out, "model string, metric string, score double, ci_low double, ci_high double, folds array<double>")


def hold_out(rows: DataFrame, task: Task) -> tuple[DataFrame, DataFrame]:
    """A stratified quarter for testing, the rest for training."""
    placed = dealt(rows, task)
    return placed.filter(F.col("_deal") % 4 != 3), placed.filter(F.col("_deal") % 4 == 3)


def permutation_importance(df: DataFrame, task: Task, model: str = "linear", repeats: int = 10) -> DataFrame:
    """(feature, mean, ci_low, ci_high): the drop in score when a feature is dealt to other rows.

    A repetition pairs each row's place along its id with a place along a hash: one join.
    """
    train, test = hold_out(fold_rare(prepare(df, task), task), task)
    fitted = model_pipeline(task, model).fit(train)
    home = with_position(test.withColumn("_one", F.lit(0)).withColumn("_at", F.col(task.row_id).cast("double")), ["_one"], "_at", task.row_id, "_to").drop("_one", "_at").cache()
    base = evaluate(fitted.transform(home), task)
    drops: dict[str, list[float]] = {c: [] for c in task.features}
    for r in range(repeats):
        draw = F.pmod(F.xxhash64(F.col(task.row_id), F.lit(task.seed + r + 1)), F.lit(1 << 52)).cast("double")
        mixed = with_position(home.select(task.row_id, *task.features).withColumn("_one", F.lit(0)).withColumn("_at", draw), ["_one"], "_at", task.row_id, "_to")
        for c in task.features:
            swapped = home.drop(c).join(mixed.select("_to", c), "_to")
            drops[c].append(base - evaluate(fitted.transform(swapped), task))
    home.unpersist()
    rows = []
    for c, d in drops.items():
        mean = sum(d) / repeats
        half = 1.96 * (sum((x - mean) ** 2 for x in d) / repeats) ** 0.5 / repeats ** 0.5
        rows.append((c, mean, mean - half, mean + half))
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, ci_low double, ci_high double").orderBy(F.col("mean").desc(), "feature")


def leakage_probe(df: DataFrame, task: Task, derivation: list[str], model: str = "linear", folds: int = 5) -> DataFrame:
    """(score_with, score_without, delta, near_perfect): what the label's own defining columns carried."""
    present = [c for c in derivation if c in task.features]
    full = cross_validate(fold_rare(prepare(df, task), task), task, model, folds)
    bare_task = task.without(present)
    bare = cross_validate(fold_rare(prepare(df, bare_task), bare_task), bare_task, model, folds) if present else full
    a, b = sum(full) / folds, sum(bare) / folds
    return df.sparkSession.createDataFrame([(present, a, b, a - b, a > 0.99)], "suspects array<string>, score_with double, score_without double, delta double, near_perfect boolean")


def learning_curve(df: DataFrame, task: Task, model: str = "linear", fractions=(0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(fraction, n, score) on a fixed hold-out, training on growing prefixes of the seeded order."""
    train, test = hold_out(fold_rare(prepare(df, task), task), task)
    per = train.groupBy("target").agg(F.count(F.lit(1)).alias("_k")) if task.kind != "regression" else train.groupBy(F.lit(0.0).alias("_all")).agg(F.count(F.lit(1)).alias("_k"))
    sized = train.join(F.broadcast(per), "target") if task.kind != "regression" else train.join(F.broadcast(per), F.lit(True))
    sized, rows = sized.cache(), []
    for f in fractions:
        part = sized.filter(F.col("_deal") * 3 / 4 < F.greatest(F.lit(15.0), f * F.col("_k")))
        n = part.count()
        rows.append((float(f), n, evaluate(model_pipeline(task, model).fit(part).transform(test), task)))
    sized.unpersist()
    return df.sparkSession.createDataFrame(rows, "fraction double, n long, score double")
