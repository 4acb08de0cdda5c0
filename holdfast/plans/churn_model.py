"""Churn classifiers, their evaluation, and the scores built on the better one (m01-m16)."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from holdfast.functions.business import HIGH_RISK, MEDIUM_RISK, annualised, priority_tier, risk_tier
from holdfast.functions.scalars import dec_round, ratio
from holdfast.operators.quantiles import exact_median
from holdfast.operators.ranking import global_rank
from holdfast.operators.running import running_totals
from holdfast.operators.stable import stable
from holdfast.plans.features import features
from holdfast.sources.tables import Tables

# Model inputs and settings.
NUMERIC = [
    "age", "monthly_price", "discount_percentage", "premium_support", "tenure_days", "avg_sessions",
    "avg_session_minutes", "avg_feature_usage", "engagement_trend_ratio", "total_tickets", "avg_satisfaction",
    "avg_resolution_time", "unresolved_tickets", "total_revenue", "total_transactions", "recency_days",
]
CATEGORICAL = ["acquisition_channel", "plan_name", "billing_cycle"]
TEST_SHARE = 0.25
SEED = 42
LOGISTIC, FOREST = "Logistic Regression", "Random Forest"
TREES, DEPTH, MIN_LEAF, MAX_ITER = 300, 10, 5, 1000
# rows a task holds at most during a fit: counts and node ids of 300 trees take about 2.5 kB a row
FIT_ROWS = 250_000
TOP_FEATURES = 15
TOP_WORKLIST = 10

# modulus and multipliers of the split's id hash
_PRIME, _MULT, _SEED_MULT = 2147483647, 48271, 69621


def with_split(df: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Exact stratified split: within each label the lowest hashes, rounded up, are the test rows."""
    mixed = ((F.col("customer_id") % _PRIME) * _MULT + seed * _SEED_MULT) % _PRIME
    hashed = df.select("customer_id", "churn", mixed.alias("h"))
    ranked = global_rank(hashed, ["churn", "h", "customer_id"])
    sizes = df.agg(F.struct(F.count_if(F.col("churn") == 0).alias("n0"), F.count_if(F.col("churn") == 1).alias("n1"))).scalar()
    n0, n1 = sizes.getField("n0"), sizes.getField("n1")
    churned = F.col("churn") == 1
    place = F.when(churned, F.col("rank") - n0).otherwise(F.col("rank"))
    tests = F.ceil(F.when(churned, n1).otherwise(n0) * test_share)
    # the last test row of each label; rows are compared with it, so they are neither moved nor joined
    ends = ranked.where(place == tests).select("churn", "h", "customer_id").collect()
    is_test = F.lit(False)
    for end in ends:
        up_to = (mixed < end["h"]) | ((mixed == end["h"]) & (F.col("customer_id") <= end["customer_id"]))
        is_test = is_test | ((F.col("churn") == end["churn"]) & up_to)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def split_features(t: Tables) -> DataFrame:
    """The feature table with its split; written once, since the ranking and every later step read it."""
    return t.once("split", lambda: with_split(stable(features(t))))


def with_class_weight(train: DataFrame) -> DataFrame:
    """n / (2 n_c), so both labels weigh the same in total."""
    sizes = train.agg(F.struct(F.count("*").alias("n"), F.sum("churn").alias("n1"))).scalar()
    n, n1 = sizes.getField("n"), sizes.getField("n1")
    return train.withColumn("weight", n / (2 * F.when(F.col("churn") == 1, n1).otherwise(n - n1)))


def preprocessing() -> list:
    """Standardised numerics plus one column per category; a category not seen in training is all zero."""
    indexed, encoded = [f"{c}_index" for c in CATEGORICAL], [f"{c}_is" for c in CATEGORICAL]
    return [
        StringIndexer(inputCols=CATEGORICAL, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=NUMERIC, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *encoded], outputCol="features"),
    ]


def classifiers(n_train: int, trees: int = TREES) -> dict:
    common = dict(featuresCol="features", labelCol="churn", weightCol="weight")
    return {
        # the mean loss is penalised here, so C = 1 becomes 1 / total weight; balanced weights sum to n
        LOGISTIC: LogisticRegression(
            **common, regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False, maxIter=MAX_ITER
        ),
        FOREST: RandomForestClassifier(
            **common, numTrees=trees, maxDepth=DEPTH, minInstancesPerNode=MIN_LEAF, featureSubsetStrategy="sqrt", seed=SEED,
            maxBins=64, cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=256,
        ),
    }


def fit_partitions(train: DataFrame) -> int:
    """As many partitions as cores, a multiple of it beyond ``FIT_ROWS`` rows a core. Every partition of a fit sends the statistics
    of all nodes at every level, and every task that scores unpacks the model, so with a partition for some megabytes of rows
    both grow with rows times nodes."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-train.count() // (cores * FIT_ROWS)))


class Scorer(ABC):
    """Models of the churn probability over a feature table with its split, and their predictions on the test rows."""

    table: DataFrame
    names: tuple[str, ...] = (LOGISTIC, FOREST)

    def __init__(self):
        self._scores: DataFrame | None = None
        self._predicted: dict[str, DataFrame] = {}

    @abstractmethod
    def probability(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows with the model's ``prediction`` and probability ``p``."""

    def predictions(self, name: str) -> DataFrame:
        """One model's predictions on the test rows; the other model is not needed for them."""
        if name not in self._predicted:
            test = self.table.where(F.col("split") == "test")
            rows = self.probability(name, test).select(F.lit(name).alias("model"), "churn", "prediction", "p")
            self._predicted[name] = stable(rows)
        return self._predicted[name]

    @property
    def predicted(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.predictions, self.names))

    @property
    def scores(self) -> DataFrame:
        """The feature table with the better model's probability, rounded before tiers are cut."""
        if self._scores is None:
            name = best_model(self).first()["model"]
            scored = self.probability(name, self.table).select(*self.table.columns, dec_round("p", 4).alias("churn_probability"))
            self._scores = stable(scored.withColumn("risk_level", risk_tier(F.col("churn_probability"))))
        return self._scores


class Models(dict):
    """The trained classifiers by name; each is trained when it is first asked for."""

    def __init__(self, train: Callable[[str], PipelineModel]):
        super().__init__()
        self._train = train

    def __missing__(self, name: str) -> PipelineModel:
        self[name] = self._train(name)
        return self[name]


class Fitted(Scorer):
    """The two classifiers trained on the train rows."""

    def __init__(self, t: Tables, trees: int = TREES):
        super().__init__()
        self.table = split_features(t)
        # training makes many passes over its rows
        self.train = stable(with_class_weight(self.table.where(F.col("split") == "train")))
        self.prepare = Pipeline(stages=preprocessing()).fit(self.train)
        self.trees = trees
        self.partitions = fit_partitions(self.train)
        self.models = Models(self._fit)

    def _fit(self, name: str) -> PipelineModel:
        rows = self.prepare.transform(self.train.coalesce(self.partitions))
        ready = rows.select("features", "churn", "weight").persist()
        model = PipelineModel([self.prepare, classifiers(ready.count(), self.trees)[name].fit(ready)])
        ready.unpersist()
        return model

    def probability(self, name: str, rows: DataFrame) -> DataFrame:
        scored = self.models[name].transform(rows.coalesce(self.partitions))
        return scored.withColumn("p", vector_to_array("probability")[1])


class FixedFormula(Scorer):
    """Two stated formulas in place of the classifiers: what follows from a score can be checked without a fit.

    z / (1 + |z|) moved to 0..1 needs no exponential, so every engine gives the same digits."""

    def __init__(self, t: Tables):
        super().__init__()
        self.table = split_features(t)

    def probability(self, name: str, rows: DataFrame) -> DataFrame:
        c = F.col
        z = {
            LOGISTIC: (c("recency_days") - 150) / 60 + c("unresolved_tickets") - c("tenure_days") / 2000,
            FOREST: (c("recency_days") - 200) / 40 - c("avg_sessions") / 10 + c("total_tickets") / 5,
        }[name]
        p = dec_round((1 + z / (1 + F.abs(z))) / 2, 4)
        return rows.withColumn("p", p).withColumn("prediction", (F.col("p") >= 0.5).cast("double"))


def fitted(t: Tables) -> Scorer:
    """The bundle's one fit, made when it is first asked for."""
    return t.once("fit", lambda: Fitted(t))


def with_fixed_formula(t: Tables) -> Tables:
    """The bundle with the stated formulas as its fit."""
    return t.given(fit=FixedFormula(t))


# ---- evaluation -----------------------------------------------------------------------------------------------------


def roc_points(predicted: DataFrame) -> DataFrame:
    """Rates at every distinct score, highest first, with the area gained since the previous score."""
    counts = predicted.groupBy("model", F.col("p").alias("threshold")).agg(
        F.count_if(F.col("churn") == 1).alias("pos"), F.count_if(F.col("churn") == 0).alias("neg")
    )
    curve = running_totals(counts, "model", "threshold", ["pos", "neg"], descending=True)
    mean_height = F.col("cum_pos") - F.col("pos") / 2
    return curve.select(
        "model", "threshold", ratio("cum_neg", "all_neg").alias("fpr"), ratio("cum_pos", "all_pos").alias("tpr"),
        ratio(F.col("neg") * mean_height, F.col("all_pos") * F.col("all_neg")).alias("area"),
    )


def evaluate(predicted: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the churned class at 0.5, and the exact area under the curve."""
    yes, said = F.col("churn") == 1, F.col("prediction") == 1
    counts = predicted.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(yes == said).alias("right"), F.count_if(yes & said).alias("hit"),
        F.count_if(said).alias("said"), F.count_if(yes).alias("yes"),
    )
    area = roc_points(predicted).groupBy("model").agg(F.sum("area").alias("auc"))
    return counts.join(area, "model").select(
        "model", dec_round(ratio("right", "n"), 4).alias("accuracy"),
        dec_round(F.coalesce(ratio("hit", "said"), F.lit(0.0)), 4).alias("precision"),
        dec_round(F.coalesce(ratio("hit", "yes"), F.lit(0.0)), 4).alias("recall"),
        dec_round(F.coalesce(ratio(2 * F.col("hit"), F.col("said") + F.col("yes")), F.lit(0.0)), 4).alias("f1_score"),
        dec_round("auc", 4).alias("roc_auc"),
    )


def best_model(fit: Scorer) -> DataFrame:
    return evaluate(fit.predicted).agg(F.max_by("model", F.struct("roc_auc", "model")).alias("model"))


def confusion(predicted: DataFrame) -> DataFrame:
    """All four cells per model, empty ones as 0."""
    cells = [
        F.struct(
            F.lit(label).alias("churn"), F.lit(guess).alias("prediction"),
            F.count_if((F.col("churn") == label) & (F.col("prediction") == guess)).alias("n"),
        )
        for label in (0, 1) for guess in (0, 1)
    ]
    return predicted.groupBy("model").agg(F.array(*cells).alias("cells")).select("model", F.inline("cells"))


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    both = Window.partitionBy("model")
    # four rows per model
    diagonal = F.col("churn") == F.col("prediction")
    cells = confusion(predicted)
    hits = cells.where(diagonal).select("model", F.col("churn").alias("label"), F.col("n").alias("hit"))
    support = cells.groupBy("model", F.col("churn").alias("label")).agg(F.sum("n").alias("support"))
    said = cells.groupBy("model", F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    report = hits.join(support, ["model", "label"]).join(said, ["model", "label"])
    return report.select(
        "model", F.when(F.col("label") == 1, "Churned").otherwise("Retained").alias("class"),
        dec_round(F.coalesce(ratio("hit", "said"), F.lit(0.0)), 4).alias("precision"),
        dec_round(F.coalesce(ratio("hit", "support"), F.lit(0.0)), 4).alias("recall"),
        dec_round(F.coalesce(ratio(2 * F.col("hit"), F.col("said") + F.col("support")), F.lit(0.0)), 4).alias("f1_score"),
        "support", dec_round(ratio("support", F.sum("support").over(both)), 4).alias("share"),
    )


def feature_importance(fit: Fitted, top: int | None = None) -> DataFrame:
    """Forest importances by input name; as many rows as the model has inputs."""
    pipeline = fit.models[FOREST]
    prepare, forest = pipeline.stages[0], pipeline.stages[1]
    labels = prepare.stages[0].labelsArray
    names = NUMERIC + [f"{c}_{value}" for c, values in zip(CATEGORICAL, labels) for value in values]
    rows = list(zip(names, map(float, forest.featureImportances.toArray())))
    ordered = fit.table.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))
    return ordered.limit(top) if top else ordered


# ---- scores and priorities ------------------------------------------------------------------------------------------


def revenue_at_risk(scored: DataFrame) -> DataFrame:
    """Active customers with yearly value, and the part of it at risk rounded per row."""
    value = annualised()
    return scored.where(F.col("churn") == 0).withColumn("annualized_value", value).withColumn(
        "revenue_at_risk", dec_round(F.col("annualized_value") * F.col("churn_probability"))
    )


def retention_priority(at_risk: DataFrame) -> DataFrame:
    """High value means at or above the median yearly value of the active customers."""
    typical = exact_median(at_risk, "annualized_value")
    tier = priority_tier(F.col("churn_probability"), F.col("annualized_value") >= typical)
    return at_risk.withColumn("retention_priority", tier)


def worklist(scored: DataFrame) -> DataFrame:
    return retention_priority(revenue_at_risk(scored)).select(
        "customer_id", "plan_name", F.col("annualized_value").alias("annualized_revenue"), "churn_probability",
        "risk_level", "retention_priority", "revenue_at_risk",
    )


# ---- reports --------------------------------------------------------------------------------------------------------


def split_report(t: Tables) -> DataFrame:
    return split_features(t).select("customer_id", "churn", "split")


def preprocess_report(t: Tables) -> DataFrame:
    """Mean and deviation each numeric input is standardised with, over the training rows."""
    train = split_features(t).where(F.col("split") == "train")
    stats = train.agg(*[
        F.struct(F.lit(c).alias("feature"), dec_round(F.avg(c), 4).alias("mean"), dec_round(F.stddev_samp(c), 4).alias("deviation"))
        .alias(c) for c in NUMERIC
    ])
    return stats.select(F.inline(F.array(*NUMERIC)))


def one_hot_report(t: Tables) -> DataFrame:
    """Which column each category value sets, and how many training rows do; the most frequent value comes first, ties in
    alphabetical order. The columns of an input follow each other in this order."""
    train = split_features(t).where(F.col("split") == "train")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in CATEGORICAL])
    counts = train.select(F.inline(cells)).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    # one row per category value
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value")) - 1
    return counts.select("feature", "value", "n", place.alias("position"))


def class_weight_report(t: Tables) -> DataFrame:
    train = with_class_weight(split_features(t).where(F.col("split") == "train"))
    return train.groupBy("churn").agg(F.count("*").alias("n"), dec_round(F.max("weight"), 6).alias("weight"))


def logistic_report(t: Tables) -> DataFrame:
    return evaluate(fitted(t).predictions(LOGISTIC))


def forest_report(t: Tables) -> DataFrame:
    return evaluate(fitted(t).predictions(FOREST))


def metrics_report(t: Tables) -> DataFrame:
    return evaluate(fitted(t).predicted)


def confusion_report(t: Tables) -> DataFrame:
    return confusion(fitted(t).predicted)


def class_report_table(t: Tables) -> DataFrame:
    return class_report(fitted(t).predicted)


def roc_report(t: Tables) -> DataFrame:
    """The curve with its origin, whose threshold is empty."""
    points = roc_points(fitted(t).predicted).select("model", "threshold", "fpr", "tpr")
    origin = points.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def importance_report(t: Tables) -> DataFrame:
    return feature_importance(fitted(t))


def top_importance_report(t: Tables) -> DataFrame:
    return feature_importance(fitted(t), TOP_FEATURES)


def best_model_report(t: Tables) -> DataFrame:
    return best_model(fitted(t))


def scores(t: Tables) -> DataFrame:
    """(customer_id, churn_probability, risk_level) of every customer, training rows included."""
    return fitted(t).scores.select("customer_id", "churn_probability", "risk_level")


def scores_report(t: Tables) -> DataFrame:
    return scores(t).orderBy(F.desc("churn_probability"), "customer_id")


def risk_distribution(t: Tables) -> DataFrame:
    return scores(t).groupBy("risk_level").agg(F.count("*").alias("customers"))


def revenue_at_risk_report(t: Tables) -> DataFrame:
    return revenue_at_risk(fitted(t).scores).select(
        "customer_id", "annualized_value", "churn_probability", "revenue_at_risk"
    )


def revenue_at_risk_total(t: Tables) -> DataFrame:
    return revenue_at_risk(fitted(t).scores).agg(
        F.count("*").alias("active_customers"), dec_round(F.sum("revenue_at_risk")).alias("total_revenue_at_risk")
    )


def priority_report(t: Tables) -> DataFrame:
    return worklist(fitted(t).scores).groupBy("retention_priority").agg(F.count("*").alias("customers"))


def worklist_report(t: Tables) -> DataFrame:
    return worklist(fitted(t).scores).orderBy(F.desc("churn_probability"), "customer_id")


def worklist_top(t: Tables) -> DataFrame:
    return worklist_report(t).limit(TOP_WORKLIST)


def run_summary(t: Tables) -> DataFrame:
    """One row: chosen model, both models' metrics, totals and thresholds; written as JSON by the sink."""
    fit = fitted(t)
    # two rows, one per model
    comparison = evaluate(fit.predicted).agg(
        F.max_by("model", F.struct("roc_auc", "model")).alias("best_model"),
        F.sort_array(F.collect_list(F.struct("model", "accuracy", "precision", "recall", "f1_score", "roc_auc")))
        .alias("model_comparison"),
    )
    tiers = fit.scores.agg(F.struct(*[
        F.count_if(F.col("risk_level") == tier).alias(f"{tier.lower()}_risk_customers") for tier in ("High", "Medium", "Low")
    ])).scalar()
    at_risk = revenue_at_risk(fit.scores).agg(dec_round(F.sum("revenue_at_risk"))).scalar()
    return comparison.withColumn("total_revenue_at_risk", at_risk).withColumn("tiers", tiers).select(
        "best_model", "model_comparison", "total_revenue_at_risk", "tiers.*",
        F.struct(F.lit(HIGH_RISK).alias("high"), F.lit(MEDIUM_RISK).alias("medium")).alias("risk_thresholds"),
    )
