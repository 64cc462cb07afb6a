"""Models: expected consumption, anomaly score and fraud probability."""
from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from wattlens import constants as K
from wattlens.functions.columns import num, ratio
from wattlens.operators import forest, iforest, metrics
from wattlens.plans.joins import lookup_join
from wattlens.plans.selection import at_ranks, group_quantile
from wattlens.plans.staging import stage

TREES_A_PART, PARTS_AT_ONCE = 10, 12
LEAST_ROWS = 3  # of a leaf of the expected consumption
MAX_DEPTH = 30  # trees without a limit stop at Spark's deepest; a parameter of every fit


def feature_frame(df: DataFrame, features: list[str]) -> DataFrame:
    """The features as numbers under `f_*`: missing columns and columns without a value become 0."""
    present = [f for f in features if f in df.columns]
    known = df.agg(*[F.count(num(F.col(f))).alias(f) for f in present]).first() if present else {}
    return df.withColumns({f"f_{f}": num(F.col(f)) if f in present and known[f] else F.lit(0.0) for f in features})


def medians(frame: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median of each feature's known values (NaN is unknown); one run for all features."""
    names = [f"f_{f}" for f in features]
    long = frame.select(*names).unpivot([], names, "name", "value").filter(~F.isnan("value"))
    found = group_quantile(long, ["name"], "value", 0.5, "median").collect()  # one row per feature
    return {r["name"][2:]: r["median"] for r in found}


def input_stages(frame: DataFrame, features: list[str]) -> list:
    """Pipeline stages that fill gaps with the exact medians of `frame` and build the feature vector."""
    middle = medians(frame, features)
    filled = ", ".join(f"coalesce(nanvl(`f_{f}`, null), {middle.get(f, 0.0)!r}D) AS `i_{f}`" for f in features)
    return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"i_{f}" for f in features], outputCol="features")]


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("f_", "i_", "_part_"))], "features")


def feature_vector(df: DataFrame, features: list[str] = K.MODEL_FEATURES, id_column: str = "customer_id") -> DataFrame:
    """Id and imputed feature array `x`."""
    frame = stage(feature_frame(df, features).select(id_column, *[f"f_{f}" for f in features]), "frame")
    fitted = Pipeline(stages=input_stages(frame, features)).fit(frame)
    return fitted.transform(frame).select(id_column, vector_to_array("features").alias("x"))


def random_share(df: DataFrame, id_column: str, seed: int = 42):
    """Hash of the id as a number in [0, 1): a split that does not depend on partitioning."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)


def stratified_split(df: DataFrame, label: str, id_column: str = "customer_id", share: float = 0.25,
                     seed: int = 42) -> DataFrame:
    """Adds `is_holdout`: the same share of every class, the rows with the smallest hashes of the id (equal ones by id).

    Only the hash at which the share ends is looked for, so the rows stay where they are. Ids must be unique.
    """
    draw = F.xxhash64(F.col(id_column), F.lit(seed))
    drawn = df.select(F.col(label).alias("_class"), draw.alias("_draw"), F.col(id_column).alias("_id"))
    last = at_ranks(drawn, ["_class"], "_draw", [share], [(0, F.greatest(F.round(F.lit(share) * F.col("n")), F.lit(1)))], "_id")
    cuts = last.select("_class", F.when(F.round(F.lit(share) * F.col("n")) >= 1, F.struct("v", "tie")).alias("_cut"))
    joined = lookup_join(df.withColumn("_class", F.col(label)), cuts, ["_class"], spread=[id_column], null_safe=True)
    own = F.struct(draw.alias("v"), F.col(id_column).alias("tie"))
    return joined.withColumn("is_holdout", F.coalesce(own <= F.col("_cut"), F.lit(False))).drop("_class", "_cut")


def part_sizes(trees: int) -> list[int]:
    return [min(TREES_A_PART, trees - first) for first in range(0, trees, TREES_A_PART)]


def training_rows(features: DataFrame, *keep: str) -> tuple[PipelineModel, DataFrame]:
    """The stages that fill gaps, and their output over the rows of `features` with a label."""
    label = F.coalesce(num(F.col("last_30_mean")), F.lit(0.0)).alias("label")
    frame = feature_frame(features, K.EXPECTED_FEATURES).select(*keep, label, *[f"f_{f}" for f in K.EXPECTED_FEATURES])
    frame = stage(frame, "training")  # read several times while fitting
    prepared = Pipeline(stages=input_stages(frame, K.EXPECTED_FEATURES)).fit(frame)
    return prepared, prepared.transform(frame)


def fit_expected(features: DataFrame, trees: int = 120, seed: int = 42, depth: int = MAX_DEPTH) -> PipelineModel:
    """Random forest for the mean of the last 30 readings.

    The forest is fitted in parts of `TREES_A_PART` trees, several at a time, each by one task over all rows (`forest`). The
    prediction is the mean of all trees.
    """
    prepared, rows = training_rows(features)
    sizes = part_sizes(trees)

    def fit(part: int):
        return forest.fit(rows, "label", [f"i_{f}" for f in K.EXPECTED_FEATURES], sizes[part], seed + part, depth,
                          LEAST_ROWS, prediction=f"_part_{part}")

    with ThreadPool(min(len(sizes), PARTS_AT_ONCE)) as pool:
        forests = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(len(sizes)))
    total = " + ".join(f"`_part_{part}` * {size}" for part, size in enumerate(sizes))
    mean = SQLTransformer(statement=f"SELECT *, ({total}) / {trees} AS `prediction` FROM __THIS__")
    return PipelineModel(stages=[*prepared.stages, *forests, mean])


def expected_consumption(features: DataFrame, model: PipelineModel | None = None, trees: int = 120,
                         seed: int = 42) -> DataFrame:
    """Predicted mean of the last 30 readings and the relative shortfall.

    Without a model, the trees of `fit_expected` are grown and applied to their rows in the same tasks; none reaches the driver.
    """
    if model:
        predicted = model.transform(feature_frame(features, K.EXPECTED_FEATURES))
    else:
        numbered = stage(features.withColumn("_part_row", F.monotonically_increasing_id()), "numbered")
        _, rows = training_rows(numbered, "_part_row")
        parts = [(size, seed + part) for part, size in enumerate(part_sizes(trees))]
        found = stage(forest.fitted_predictions(rows, "_part_row", "label", [f"i_{f}" for f in K.EXPECTED_FEATURES], parts,
                                                MAX_DEPTH, LEAST_ROWS, PARTS_AT_ONCE), "predictions")
        predicted = numbered.join(found.withColumnRenamed("row", "_part_row"), "_part_row")
    expected = F.greatest(F.col("prediction"), F.lit(0.01))
    gap = ratio(F.col("expected_last_30_consumption") - F.col("last_30_mean"), F.col("expected_last_30_consumption"))
    return (drop_helpers(predicted).withColumn("expected_last_30_consumption", expected).drop("prediction")
            .withColumn("expected_deviation_pct", F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0))))


def expected_error(features: DataFrame, trees: int = 120, seed: int = 42) -> DataFrame:
    """Mean absolute error on a 25 % hold-out; no row for 50 customers or fewer."""
    split = features.withColumn("_holdout", random_share(features, "customer_id", seed) < 0.25)
    if features.count() <= 50:
        return features.sparkSession.createDataFrame([], "expected_consumption_mae double")
    model = fit_expected(split.filter(~F.col("_holdout")), trees, seed)
    tested = model.transform(feature_frame(split.filter("_holdout"), K.EXPECTED_FEATURES))
    return metrics.mae(tested, "last_30_mean", "prediction").withColumnRenamed("mae", "expected_consumption_mae")


def anomaly_score(df: DataFrame, features: list[str], name: str = "ai_anomaly_score",
                  id_column: str = "customer_id", trees: int = 250, seed: int = 42) -> DataFrame:
    """Isolation-forest score 0-100 and flag per row.

    Cuts are drawn between the extremes of a feature, so scaling the features would not change a tree.
    """
    used = [f for f in features if f in df.columns]
    scored = iforest.forest_score(feature_vector(df, used, id_column), id_column, trees, seed)
    scores = stage(scored.select(id_column, "isolation_score"), "scores")  # read twice: range, then values
    out = iforest.scale_scores(scores, name)
    out = out.withColumn("isolation_forest_flag", (F.col("isolation_score") > 0.5).cast("int"))
    return df.join(out.drop("isolation_score"), id_column, "left")


def class_weights(labelled: DataFrame, label: str) -> DataFrame:
    """Weight n / (2 * class size)."""
    sizes = labelled.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("ones"))).scalar()
    per_class = F.when(F.col(label) == 1, sizes["ones"]).otherwise(sizes["n"] - sizes["ones"])
    return labelled.withColumn("_weight", sizes["n"] / (2.0 * per_class))


def fit_classifier(labelled: DataFrame, features: list[str], label: str = "fraud_label", trees: int = 350,
                   depth: int = MAX_DEPTH, seed: int = 42) -> PipelineModel:
    forest = RandomForestClassifier(labelCol="_label", featuresCol="features", weightCol="_weight",
                                    numTrees=trees, minInstancesPerNode=3, maxDepth=depth,
                                    featureSubsetStrategy="sqrt", seed=seed)
    weighted = class_weights(feature_frame(labelled, features), label).withColumn("_label", F.col(label).cast("int"))
    frame = stage(weighted.select("_label", "_weight", *[f"f_{f}" for f in features]), "training")
    return Pipeline(stages=[*input_stages(frame, features), forest]).fit(frame)


def classify(df: DataFrame, model: PipelineModel, features: list[str], name: str) -> DataFrame:
    """Probability of the positive class, 0-1."""
    scored = model.transform(feature_frame(df, features))
    scored = scored.withColumn(name, vector_to_array("probability").getItem(1))
    return drop_helpers(scored).drop("rawPrediction", "probability", "prediction")


def label_counts(df: DataFrame, label: str):
    """(known labels, positives): one small aggregate."""
    value = num(F.col(label)) if label in df.columns else F.lit(None).cast("double")
    row = df.agg(F.count(value).alias("known"), F.count_if(value == 1).alias("ones")).first()
    return row["known"], row["ones"]


def classifier_features(df: DataFrame, features: list[str] = K.MODEL_FEATURES) -> list[str]:
    return [f for f in [*features, "expected_deviation_pct"] if f in df.columns]


def enough_labels(df: DataFrame, label: str = "fraud_label") -> bool:
    """Whether more than 20 labels of two classes are known."""
    known, ones = label_counts(df, label)
    return known > 20 and ones not in (0, known)


def fraud_probability(df: DataFrame, features: list[str] = K.MODEL_FEATURES, trees: int = 350,
                      seed: int = 42, model: PipelineModel | None = None) -> DataFrame:
    """Probability of fraud in percent, by the given model, or by a new one if there are enough labels; else NULL."""
    if model is None and not enough_labels(df):
        return df.withColumn("fraud_probability", F.lit(None).cast("double"))
    used = classifier_features(df, features)
    model = model or fit_classifier(df.filter(F.col("fraud_label").isNotNull()), used, trees=trees, seed=seed)
    return classify(df, model, used, "_p").withColumn("fraud_probability", F.col("_p") * 100).drop("_p")


def classifier_metrics(df: DataFrame, features: list[str], label: str = "fraud_label",
                       id_column: str = "customer_id", share: float = 0.25, trees: int = 350,
                       depth: int = MAX_DEPTH, seed: int = 42) -> DataFrame:
    """Quality on a stratified hold-out: AUC, average precision, precision and recall of the top tenth."""
    labelled = df.filter(num(F.col(label)).isNotNull()).withColumn(label, num(F.col(label)))
    split = stage(stratified_split(labelled, label, id_column, share, seed), "split")
    used = [f for f in features if f in df.columns]
    model = fit_classifier(split.filter(~F.col("is_holdout")), used, label, trees, depth, seed)
    tested = stage(classify(split.filter("is_holdout"), model, used, "p").select(id_column, label, "p"), "tested")
    auc = metrics.roc_auc(tested, label, "p").scalar()
    precision = metrics.average_precision(tested, label, "p").scalar()
    top = metrics.topk_metrics(tested, label, "p", id_column)
    return top.withColumns({"fraud_classifier_roc_auc": auc, "fraud_classifier_avg_precision": precision})


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Importances, largest first; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_models(features: DataFrame, trees: tuple[int, int, int] = (120, 250, 350), seed: int = 42,
                 saved: dict[str, PipelineModel] | None = None, keep: dict[str, PipelineModel] | None = None) -> DataFrame:
    """All three models in order: expected consumption, anomaly, fraud probability.

    `saved` may hold models of an earlier run (`expected`, `fraud`), which are then used and not fitted again; `keep` is
    filled with the models that were used.
    """
    saved, keep = saved or {}, {} if keep is None else keep
    keep["expected"] = saved.get("expected") or fit_expected(features, trees[0], seed)
    expected = stage(expected_consumption(features, keep["expected"]), "expected")
    scored = stage(anomaly_score(expected, [*K.MODEL_FEATURES, "expected_deviation_pct"], trees=trees[1], seed=seed), "anomaly")
    if saved.get("fraud"):
        keep["fraud"] = saved["fraud"]
    elif enough_labels(scored):
        keep["fraud"] = fit_classifier(scored.filter(F.col("fraud_label").isNotNull()), classifier_features(scored),
                                       trees=trees[2], seed=seed)
    return fraud_probability(scored, model=keep.get("fraud"))


def model_metrics(scored: DataFrame, trees: tuple[int, int, int] = (120, 250, 350), seed: int = 42) -> DataFrame:
    """One row: the error of the expected consumption and the classifier's quality on hold-outs; NULL where a model has too
    few rows."""
    error = expected_error(scored, trees[0], seed)
    row = scored.sparkSession.range(1).select(error.select("expected_consumption_mae").agg(
        F.max("expected_consumption_mae")).scalar().alias("expected_consumption_mae"))
    if not enough_labels(scored):
        return row
    quality = classifier_metrics(scored, classifier_features(scored), trees=trees[2], seed=seed)
    return quality.withColumn("expected_consumption_mae", row.select("expected_consumption_mae").scalar())
