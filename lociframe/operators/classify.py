"""Classifiers on feature vectors: split, fit, cross-validation, reports."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import mid_rank, ordinal_rank, ranked_counts, running_sums
from lociframe.session import cut_lineage


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (classes · n of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    n, k = df.agg(F.count(F.lit(1))).scalar(), df.agg(F.count_distinct(label)).scalar()
    return df.join(per.withColumn("weight", n / (k * F.col("__c"))).drop("__c"), label)


def build_classifier(model: str, select_k: int | None = None, seed: int = 42, trees: int = 100, binary: bool = True, boosting_rounds: int = 300) -> Pipeline:
    """Scaler, optional F-test selection and a classifier with balanced weights."""
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)]
    col = "scaled"
    if select_k:
        sel = UnivariateFeatureSelector(featuresCol="scaled", labelCol="label", outputCol="chosen", selectionMode="numTopFeatures")
        stages.append(sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(select_k))
        col = "chosen"
    common = {"featuresCol": col, "labelCol": "label"}
    if model == "random_forest":
        clf = RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, seed=seed, featureSubsetStrategy="sqrt", weightCol="weight", **common)
    elif model == "logistic":
        clf = LogisticRegression(maxIter=100, regParam=0.01, weightCol="weight", **common)
    elif model == "svm":
        svc = LinearSVC(maxIter=100, regParam=0.01, weightCol="weight", **common)
        clf = svc if binary else OneVsRest(classifier=svc, weightCol="weight", **common)
    elif model == "boosted_trees":
        clf = GBTClassifier(maxIter=boosting_rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=seed, weightCol="weight", **common)
    else:
        raise ValueError(f"unknown model {model}")
    return Pipeline(stages=[*stages, clf])


def stratified_order(df: DataFrame, seed: int = 42, key: str = "id", label: str = "label") -> DataFrame:
    """Rows with a seeded order ``__i`` inside their class and its size ``__n``."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")
    out = ordinal_rank(df.withColumn("__h", h), [label], "__h", key, "__i").drop("__h")
    return out.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")), label)


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: a seeded share of each class, at least one row."""
    o = stratified_order(df, seed)
    return o.withColumn("is_test", F.col("__i") <= F.greatest(F.lit(1), F.floor(F.col("__n") * test_size))).drop("__i", "__n")


def assign_folds(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    return stratified_order(df, seed).withColumn("fold", F.pmod(F.col("__i"), F.lit(folds)).cast("int")).drop("__i", "__n")


def confusion_matrix(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy on each row."""
    cm = confusion_matrix(pred)
    sides = cm.select(F.explode(F.array(
        F.struct(F.col("label").cast("double").alias("cls"), F.lit("t").alias("k"), "count"),
        F.struct(F.col("prediction").cast("double").alias("cls"), F.lit("p").alias("k"), "count"),
        F.struct(F.when(F.col("label") == F.col("prediction"), F.col("label").cast("double")).alias("cls"), F.lit("h").alias("k"), "count"),
    )).alias("s")).select("s.*").where("cls is not null")
    agg = sides.groupBy("cls").agg(*[F.sum(F.when(F.col("k") == k, F.col("count")).otherwise(0)).alias(k) for k in "tph"])
    prec, rec = F.col("h") / (F.col("p") + 1e-10), F.col("h") / (F.col("t") + 1e-10)
    acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).scalar()
    return agg.select(F.col("cls").alias("label"), prec.alias("precision"), rec.alias("recall"),
                      (2 * prec * rec / (prec + rec + 1e-10)).alias("f1"), F.col("t").alias("support"), acc.alias("accuracy"))


def roc_curve(pred: DataFrame, score: str = "score", positive: str = "is_positive") -> DataFrame:
    """False and true positive rates at each distinct score, from the highest down."""
    r = ranked_counts(pred, [], score, sums={"pos": F.sum(F.col(positive).cast("long"))})
    run = running_sums(r.select(score, "cnt", "pos"), [], score, ["cnt", "pos"])
    tp = F.col("pos_all") - F.col("pos_run") + F.col("pos")
    seen = F.col("cnt_all") - F.col("cnt_run") + F.col("cnt")
    return run.select(F.col(score).alias("threshold"), F.try_divide(seen - tp, F.col("cnt_all") - F.col("pos_all")).alias("fpr"),
                      F.try_divide(tp, F.col("pos_all")).alias("tpr"))


def auc(pred: DataFrame, score: str = "score", positive: str = "is_positive", keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives."""
    keys = keys or []
    r = ranked_counts(pred, keys, score, sums={"pos": F.sum(F.col(positive).cast("long"))})
    p = F.sum("pos")
    n = F.max("n") - p
    u = F.sum(F.col("pos") * mid_rank()) - p * (p + 1) / 2.0
    return r.groupBy(*keys).agg(F.try_divide(u, p * n).alias("auc"), p.alias("n_pos"))


def weighted_ovr_auc(pred: DataFrame) -> DataFrame:
    """Mean over classes of the one-versus-rest area, weighted by class size.

    pred has label and probability (one entry per class).
    """
    probs = vector_to_array("probability")
    long = pred.select(F.col("label").cast("int").alias("label"), F.posexplode(probs).alias("cls", "score")).withColumn(
        "is_positive", F.col("label") == F.col("cls"))
    per = auc(long, keys=["cls"]).where("n_pos > 0")
    return per.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc"))


def cross_validate(df: DataFrame, model: str = "logistic", folds: int = 5, select_k: int | None = None, seed: int = 42,
                   trees: int = 50) -> DataFrame:
    """Accuracy, weighted F1 and weighted one-versus-rest area per fold (the area is null for a margin model), and the mean row."""
    data = cut_lineage(assign_folds(class_weights(df), folds, seed))
    classes = data.agg(F.count_distinct("label")).first()[0]
    rows = []
    for f in range(folds):
        fitted = build_classifier(model, select_k, seed, trees, classes == 2).fit(data.where(F.col("fold") != f))
        pred = cut_lineage(fitted.transform(data.where(F.col("fold") == f)))
        rep = classification_report(pred).agg(
            F.first("accuracy").alias("a"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f")).first()
        area = weighted_ovr_auc(pred).first()["auc"] if "probability" in pred.columns else None
        rows.append((str(f + 1), float(rep["a"]), float(rep["f"]), None if area is None else float(area)))
    means = [sum(v) / len(v) if (v := [r[i] for r in rows if r[i] is not None]) else None for i in (1, 2, 3)]
    rows.append(("mean", *means))
    return df.sparkSession.createDataFrame(rows, "fold string, accuracy double, f1 double, auc double")


def feature_importance(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """Importances, or absolute coefficients, of the fitted features, ranked."""
    clf = model.stages[-1]
    kept = names
    if len(model.stages) == 3:
        kept = [names[i] for i in sorted(model.stages[1].selectedFeatures)]
    if hasattr(clf, "featureImportances"):
        values = clf.featureImportances.toArray()
    elif hasattr(clf, "coefficientMatrix"):
        values = abs(clf.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = abs(clf.coefficients.toArray())
    order = sorted(zip(kept, values), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(order)], "feature string, importance double, place int")
