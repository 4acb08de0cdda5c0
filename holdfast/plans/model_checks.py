"""The trained classifiers as tables, and checks that recompute from these tables what the models report (m04, m05, m09)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.operators.stable import ensure_checkpoint_dir
from holdfast.plans.churn_model import CATEGORICAL, DEPTH, FOREST, LOGISTIC, NUMERIC, Fitted, fitted, with_class_weight
from holdfast.sources.tables import Tables

# A component of the gradient that still counts as zero, and the largest difference of equal numbers.
FLAT = 1e-4
SAME = 1e-9
INTERCEPT = "intercept"


def input_names(fit: Fitted) -> list[str]:
    """Names of the columns the models are given: the numbers, then every category value."""
    labels = fit.prepare.stages[0].labelsArray
    return NUMERIC + [f"{c}_{value}" for c, values in zip(CATEGORICAL, labels) for value in values]


def input_rows(fit: Fitted, rows: DataFrame) -> DataFrame:
    """The rows with ``x``, the array of the models' inputs."""
    return fit.prepare.transform(rows).withColumn("x", vector_to_array("features")).drop("features")


# ---- forest ---------------------------------------------------------------------------------------------------------


def forest_nodes(t: Tables) -> DataFrame:
    """One row per node of the trained forest: what it tests, its children and the weight of either label in it.

    A numeric input goes left up to ``left_values[0]`` (``categories`` -1), a categorical one if it is among ``left_values``.
    A leaf has feature -1 and no children; ``p`` is its share of the churned weight."""
    return t.once("forest_nodes", lambda: _forest_nodes(fitted(t)))


def _forest_nodes(fit: Fitted) -> DataFrame:
    spark = fit.table.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{fit.models[FOREST].uid}"
    fit.models[FOREST].stages[1].write().overwrite().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stats = node["impurityStats"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), split["featureIndex"].alias("feature"),
        F.get(F.array(*map(F.lit, input_names(fit))), F.when(split["featureIndex"] >= 0, split["featureIndex"])).alias("feature_name"),
        split["leftCategoriesOrThreshold"].alias("left_values"), split["numCategories"].alias("categories"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["gain"].alias("gain"),
        stats[0].alias("retained_weight"), stats[1].alias("churned_weight"), (stats[1] / (stats[0] + stats[1])).alias("p"))


def walked(nodes: DataFrame, rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows (with inputs ``x``) and ``p``, the mean of the leaves that the walks down all trees end in.

    The forest, whose size the settings bound, goes to the rows as one array of trees; rows are neither joined nor moved."""
    fields = ["feature", "left_values", "categories", "left", "right", "p"]
    per_tree = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("node", *fields))).alias("n")).select(
        F.struct(*[F.col(f"n.{f}").alias(f) for f in fields]).alias("tree"))
    trees = per_tree.agg(F.collect_list("tree")).scalar()

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            feature, values = F.get(tree["feature"], at), F.get(tree["left_values"], at)
            value = F.get(F.col("x"), feature)
            goes_left = F.when(F.get(tree["categories"], at) >= 0, F.array_contains(values, value)).otherwise(value <= F.get(values, F.lit(0)))
            return F.when(feature < 0, at).when(goes_left, F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)

    total = F.aggregate(F.col("trees"), F.lit(0.0), lambda s, tree: s + F.get(tree["p"], leaf(tree)))
    return rows.withColumn("trees", trees).withColumn("p", total / F.size("trees")).drop("trees")


def forest_walk_check(t: Tables) -> DataFrame:
    """Test rows, and how many of them get another probability from the node table than from the model."""
    fit = fitted(t)
    test = fit.table.where(F.col("split") == "test")
    own = walked(forest_nodes(t), input_rows(fit, test)).select("customer_id", F.col("p").alias("walked"))
    both = fit.probability(FOREST, test).select("customer_id", "p").join(own, "customer_id", "left")
    differs = F.coalesce(F.abs(F.col("p") - F.col("walked")) > SAME, F.lit(True))
    return both.agg(F.count("*").alias("rows"), F.count_if(differs).alias("differing"))


def node_importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): the weighted decrease of impurity at the nodes that test an input, each tree scaled to one,
    averaged over the trees; inputs that no node tests are left out."""
    weight = F.col("retained_weight") + F.col("churned_weight")
    per_tree = nodes.where("feature >= 0").groupBy("tree", F.col("feature_name").alias("feature")).agg(F.sum(F.col("gain") * weight).alias("drop"))
    # at most one row per tree and input from here on
    whole = per_tree.groupBy("tree").agg(F.sum("drop").alias("whole"))
    shares = per_tree.join(whole, "tree").groupBy("feature").agg(F.sum(F.when(F.col("whole") > 0, F.col("drop") / F.col("whole")).otherwise(0.0)).alias("share"))
    total = shares.agg(F.sum("share")).scalar()
    return shares.select("feature", (F.col("share") / total).alias("importance"))


def importance_check(t: Tables) -> DataFrame:
    """Every input of the forest, and whether its reported importance is what the node table gives."""
    from holdfast.plans.churn_model import feature_importance

    reported = feature_importance(fitted(t))
    own = node_importances(forest_nodes(t)).withColumnRenamed("importance", "own")
    return reported.join(own, "feature", "left").select(
        "feature", (F.abs(F.col("importance") - F.coalesce("own", F.lit(0.0))) <= SAME).alias("agrees"))


# ---- logistic regression --------------------------------------------------------------------------------------------


def coefficients(t: Tables) -> DataFrame:
    """(position, feature, coefficient): the logistic model, its intercept last."""
    fit = fitted(t)
    model = fit.models[LOGISTIC].stages[1]
    values = [*map(float, model.coefficients.toArray()), float(model.intercept)]
    rows = [(i, name, value) for i, (name, value) in enumerate(zip([*input_names(fit), INTERCEPT], values))]
    return fit.table.sparkSession.createDataFrame(rows, "position int, feature string, coefficient double")


def penalised_gradient(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(feature, coefficient, gradient) of the weighted mean log loss plus half the squared coefficients over the number of
    rows; ``rows``: churn, weight and inputs ``x``. It is zero at the one minimum, whatever method looks for it."""
    betas = terms.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "coefficient"))), lambda s: s["coefficient"])).scalar()
    held = rows.select("churn", "weight", F.concat("x", F.array(F.lit(1.0))).alias("x"), betas.alias("b"))
    z = F.aggregate(F.zip_with("x", "b", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    error = held.select("x", "weight", (F.col("weight") * (1 / (1 + F.exp(-z)) - F.col("churn"))).alias("e"))
    sums = error.select("weight", "e", F.posexplode("x").alias("position", "value")).groupBy("position").agg(
        (F.sum(F.col("e") * F.col("value")) / F.sum("weight")).alias("pull"), F.count("*").alias("n"))
    penalty = F.when(F.col("feature") == INTERCEPT, 0.0).otherwise(F.col("coefficient") / F.col("n"))
    return sums.join(terms, "position").select("feature", "coefficient", (F.col("pull") + penalty).alias("gradient"))


def gradient(t: Tables) -> DataFrame:
    fit = fitted(t)
    train = with_class_weight(fit.table.where(F.col("split") == "train"))
    return penalised_gradient(input_rows(fit, train), coefficients(t))


def optimality_check(t: Tables) -> DataFrame:
    """Every term of the logistic model, and whether the training loss is flat along it."""
    return gradient(t).select("feature", (F.abs("gradient") <= FLAT).alias("flat"))
