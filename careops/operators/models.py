"""Spark ML pipelines for visit risk (model A) and claim outcome (model B).

Preprocessing mirrors the reference's column transformer: numeric columns
standardized (fit on train), categoricals one-hot encoded with unseen and
NULL categories mapped to the all-zero vector (StringIndexer "keep" slot,
which OneHotEncoder's dropLast removes).  ``chronic_flag`` is selected by the
reference but dropped by its transformer; ``include_chronic_flag`` keeps the
same default.

Model B's boosted trees are three binary boosters (one per class) whose
positive-class probabilities are normalized to sum to 1 -- Spark's GBT is binary
only and ``OneVsRest`` produces no probabilities.  They are what ``GBTClassifier``
fits, but all three grow in the same jobs (:mod:`careops.operators.boosting`).
Cross-validation folds are stratified by ranking rows inside their class
with distributed cumulative counts (no window over a whole class).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops import schema as S
from careops.functions.joins import lookup_join
from careops.operators import boosting
from careops.operators.boosting import JointBoostingModel, OneVsRestGBTModel
from careops.session import cut_lineage

# --- fixed values: hyper-parameter grids of the reference's searches ---
RF_GRID = {"numTrees": [50, 100], "maxDepth": [10, 15, 30], "minInstancesPerNode": [1, 2]}
GBT_GRID = {"maxIter": [50, 100], "maxDepth": [5, 8, 10], "stepSize": [0.05, 0.1]}
CV_FOLDS = 3
LR_MAX_ITER = 1000
# --- end of fixed values ---
BLANK_CATEGORY = "<blank>"


@dataclass(frozen=True)
class FeatureSpec:
    label: str
    classes: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    forbidden: tuple[str, ...]


SPEC_A = FeatureSpec("risk_label", tuple(S.RISK_CLASSES), tuple(S.NUMERIC_A), tuple(S.CATEGORICAL_A),
                     tuple(S.FORBIDDEN_A))
SPEC_B = FeatureSpec("claim_label", tuple(S.CLAIM_CLASSES), tuple(S.NUMERIC_B), tuple(S.CATEGORICAL_B),
                     tuple(S.FORBIDDEN_B))


def check_features(spec: FeatureSpec, include_chronic_flag: bool = False) -> list[str]:
    """Feature columns of a spec; raises if a forbidden (leaking) column is among them."""
    cols = list(spec.numeric) + (["chronic_flag"] if include_chronic_flag else []) + list(spec.categorical)
    leaked = sorted(set(cols) & set(spec.forbidden))
    if leaked:
        raise ValueError(f"forbidden feature columns: {leaked}")
    return cols


def model_input(df: DataFrame, spec: FeatureSpec, include_chronic_flag: bool = False,
                passthrough: Sequence[str] = ()) -> DataFrame:
    """Numeric features as DOUBLE, categoricals as strings, label as DOUBLE (M1 rows only)."""
    check_features(spec, include_chronic_flag)
    nums = list(spec.numeric) + (["chronic_flag"] if include_chronic_flag else [])
    keep = [c for c in ("visit_id", "bill_id", "split", "billed_amount", "gender", "city",
                        "insurance_provider", "visit_date", *passthrough) if c in df.columns]
    cols = {c: F.col(c) for c in keep}
    cols.update({c: F.col(c).cast("double") for c in nums})
    # a blank category stays its own category; ML attribute names cannot be empty
    cols.update({c: F.when(F.trim(F.col(c).cast("string")) == "", F.lit(BLANK_CATEGORY))
                 .otherwise(F.col(c).cast("string")) for c in spec.categorical})
    if spec.label in df.columns:
        cols[spec.label] = F.col(spec.label).cast("double")
    return df.select(*[v.alias(k) for k, v in cols.items()])


def preprocessing(spec: FeatureSpec, include_chronic_flag: bool = False) -> list:
    """M3 + M4 stages: fill and scale numerics, index + one-hot categoricals, assemble all.

    A missing numeric value is filled with the training mean (0 after scaling),
    so that every row is fitted on and scored; :func:`predictions` counts the
    filled values of each row.
    """
    nums = list(spec.numeric) + (["chronic_flag"] if include_chronic_flag else [])
    cats = list(spec.categorical)
    # one indexer for all columns: its fit reads the rows once
    idx = StringIndexer(inputCols=cats, outputCols=[f"{c}__idx" for c in cats], handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__ohe" for c in cats],
                        dropLast=True)
    fill = Imputer(inputCols=nums, outputCols=[f"{c}__filled" for c in nums], strategy="mean")
    num_vec = VectorAssembler(inputCols=fill.getOutputCols(), outputCol="num__raw")
    scaler = StandardScaler(inputCol="num__raw", outputCol="num__scaled", withMean=True, withStd=True)
    allv = VectorAssembler(inputCols=["num__scaled"] + [f"{c}__ohe" for c in cats], outputCol="features")
    return [idx, ohe, fill, num_vec, scaler, allv]


def category_labels(prep) -> list[tuple[str, list[str]]]:
    """The categorical columns of fitted preprocessing and their categories, in the order of the one-hot slots."""
    return [(c, list(labels)) for stage in prep.stages if isinstance(stage, StringIndexerModel)
            for c, labels in zip(stage.getInputCols(), stage.labelsArray)]


def prepare(rows: DataFrame, spec: FeatureSpec) -> tuple[PipelineModel, DataFrame]:
    """M3 + M4 fitted on the training rows, and all rows with their ``features``.

    The rows are stored, so that the passes of a fit and the scoring after it read one result of
    the preprocessing.
    """
    prep = Pipeline(stages=preprocessing(spec)).fit(rows.where(F.col("split") == "train"))
    return prep, cut_lineage(prep.transform(rows).select(*rows.columns, "features"))


def fit_prepared(pipeline: Pipeline, prep: PipelineModel, train: DataFrame) -> PipelineModel:
    """The pipeline with its last stage fitted on rows that :func:`prepare` prepared."""
    return PipelineModel([*prep.stages, pipeline.getStages()[-1].fit(train)])


def encoded_rows(prep: PipelineModel, df: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """M3 + M4 as columns: ``num_<column>`` (filled and scaled) and ``cat_<column>``, the category whose
    one-hot slot is set (NULL: none, as for unseen and missing categories)."""
    out = prep.transform(df)
    scaled = vector_to_array("num__scaled")
    nums = [scaled[i].alias(f"num_{c}") for i, c in enumerate(spec.numeric)]
    cats = []
    for c, known in category_labels(prep):
        slot = F.array_position(vector_to_array(f"{c}__ohe"), 1.0).cast("int")
        labels = F.array(*[F.lit(x) for x in known])
        cats.append(F.when(slot > 0, F.element_at(labels, slot)).alias(f"cat_{c}"))
    return out.select(*keys, *nums, *cats)


def class_weights(df: DataFrame, label: str, weight_col: str = "class_weight") -> DataFrame:
    """M5: weight n / (k * n_c) of each of the k classes."""
    counts = cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")))  # one row a class, read three times
    total = counts.agg(F.sum("_nc")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, (total / (k * F.col("_nc"))).alias(weight_col))


def balanced_weights(df: DataFrame, label: str, weight_col: str = "class_weight") -> DataFrame:
    """Every row with its class's weight (M5)."""
    w = class_weights(df, label, weight_col)
    return lookup_join(df, w, label)


def with_folds(df: DataFrame, keys: Sequence[str] = ("visit_id", "bill_id"), folds: int = CV_FOLDS,
               fold_col: str = "fold", label: str | None = None) -> DataFrame:
    """Deterministic folds.

    With ``label`` the folds are stratified: rows are ranked inside their
    class by a hash of the row keys (distributed cumulative counts grouped by
    class, so a large class is spread over range buckets, never one task) and
    fold = rank mod ``folds`` -- every fold holds each class's rows to within
    one.  Without ``label``: fold = hash mod ``folds``.
    """
    if label is None:
        return df.withColumn(fold_col, F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int"))
    from careops.functions.ranks import cumulative_counts
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    cum = cumulative_counts(hashed.select(label, "_h"), "_h", None, [label])
    ranks = cum.select(label, "_h", F.pmod(F.col("cum_n") - 1, F.lit(folds)).cast("int").alias(fold_col))
    return hashed.join(ranks, [label, "_h"], "left").drop("_h")


def logistic(spec: FeatureSpec, n_train: int, weighted: bool = False,
             include_chronic_flag: bool = False) -> Pipeline:
    """M6 / M8: multinomial logistic regression, L2 with C = 1 (regParam = 1 / n)."""
    lr = LogisticRegression(featuresCol="features", labelCol=spec.label, family="multinomial",
                            maxIter=LR_MAX_ITER, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                            standardization=False)
    if weighted:
        lr.setWeightCol("class_weight")
    return Pipeline(stages=preprocessing(spec, include_chronic_flag) + [lr])


def forest(spec: FeatureSpec, include_chronic_flag: bool = False, seed: int = 42) -> tuple[Pipeline, object]:
    """M7 estimator (random forest) and its classifier stage for grids."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=spec.label, seed=seed)
    return Pipeline(stages=preprocessing(spec, include_chronic_flag) + [rf]), rf


def grid(stage, values: dict) -> list:
    b = ParamGridBuilder()
    for name, vals in values.items():
        b = b.addGrid(stage.getParam(name), vals)
    return b.build()


def cross_validate(pipeline: Pipeline, stage, values: dict, train: DataFrame, label: str,
                   parallelism: int = 2) -> PipelineModel:
    """3-fold CV over the grid on accuracy, best refit on all train rows."""
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid(stage, values), evaluator=ev,
                        numFolds=CV_FOLDS, foldCol="fold", parallelism=parallelism, seed=42)
    folded = with_folds(train, label=label).persist(StorageLevel.MEMORY_AND_DISK)
    best = cv.fit(folded).bestModel
    folded.unpersist()
    return best


def search_forest(train: DataFrame, spec: FeatureSpec, values: dict | None = None, parallelism: int = 4,
                  seed: int = 42) -> tuple[list[dict], PipelineModel]:
    """M7 + M10: the table of (grid point, fold) results on stratified folds, and the best point refitted on all rows.

    Each fold's rows are prepared once for all points, and points are fitted side by side.
    """
    from concurrent.futures import ThreadPoolExecutor
    values = values or RF_GRID
    folded = cut_lineage(with_folds(train, label=spec.label))
    points = [dict(zip(values, p)) for p in itertools.product(*values.values())]
    table = []
    for fold in range(CV_FOLDS):
        prep = Pipeline(stages=preprocessing(spec)).fit(folded.where(F.col("fold") != fold))
        rows = cut_lineage(prep.transform(folded).select("features", spec.label, "fold"))
        learned, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)

        def result(point: dict) -> dict:
            rf = RandomForestClassifier(featuresCol="features", labelCol=spec.label, seed=seed, **point)
            got = rf.fit(learned).transform(held).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col(spec.label)).alias("right")).first()
            return {**point, "fold": fold, "rows": got["n"], "right": got["right"], "accuracy": got["right"] / max(got["n"], 1)}

        with ThreadPoolExecutor(parallelism) as pool:
            table += pool.map(result, points)
    best = boosting.best_point(table, tuple(values))
    pipe, rf = forest(spec, seed=seed)
    for name, value in best.items():
        rf.set(rf.getParam(name), value)
    return table, pipe.fit(train)


def fit_ovr_gbt(train: DataFrame, spec: FeatureSpec, max_iter: int = 50, max_depth: int = 5,
                step_size: float = 0.1, weighted: bool = True, include_chronic_flag: bool = False) -> OneVsRestGBTModel:
    """M9: the shared preprocessing, and one weighted binary booster per class; all classes grow in the same jobs."""
    data = balanced_weights(train, spec.label) if weighted else train
    return boosting.fit_joint(data, spec, preprocessing(spec, include_chronic_flag), max_iter, max_depth, step_size,
                              "class_weight" if weighted else None, loss=boosting.OneVsRest,
                              numeric=len(spec.numeric) + include_chronic_flag)


def search_ovr_gbt(train: DataFrame, spec: FeatureSpec, values: dict | None = None) -> OneVsRestGBTModel:
    """M9 + M10: grid over (maxIter, maxDepth, stepSize) with hash folds; best refit on all train."""
    values = values or GBT_GRID
    # every (grid point, fold) fit reads the folded rows: materialize them once
    folded = with_folds(train, label=spec.label).persist(StorageLevel.MEMORY_AND_DISK)
    best, best_acc = None, -1.0
    names = list(values)
    for combo in itertools.product(*[values[n] for n in names]):
        p = dict(zip(names, combo))
        accs = []
        for f in range(CV_FOLDS):
            m = fit_ovr_gbt(folded.where(F.col("fold") != f), spec, p["maxIter"], p["maxDepth"], p["stepSize"])
            scored = m.transform(folded.where(F.col("fold") == f))
            accs.append(scored.agg(F.avg((F.col("prediction") == F.col(spec.label)).cast("double")))
                        .first()[0] or 0.0)
        acc = sum(accs) / len(accs)
        if acc > best_acc:
            best, best_acc = p, acc
    folded.unpersist()
    return fit_ovr_gbt(train, spec, best["maxIter"], best["maxDepth"], best["stepSize"])


def fit_joint_boosting(train: DataFrame, spec: FeatureSpec, max_iter: int = 50, max_depth: int = 5, step_size: float = 0.1,
                       weighted: bool = True, losses: list | None = None) -> JointBoostingModel:
    """M9: one booster for all classes (:mod:`careops.operators.boosting`)."""
    data = balanced_weights(train, spec.label) if weighted else train
    return boosting.fit_joint(data, spec, preprocessing(spec), max_iter, max_depth, step_size,
                              "class_weight" if weighted else None, losses)


def search_joint_boosting(train: DataFrame, spec: FeatureSpec, values: dict | None = None,
                          weighted: bool = True, refit: bool = True) -> tuple[list[dict], JointBoostingModel | None]:
    """M9 + M10: the table of (grid point, fold) results on stratified folds, and the best point refitted on all rows."""
    data = balanced_weights(train, spec.label) if weighted else train
    data = cut_lineage(with_folds(data, label=spec.label))
    table = boosting.search_joint(data, spec, preprocessing(spec), values or GBT_GRID, CV_FOLDS,
                                  weight="class_weight" if weighted else None)
    if not refit:
        return table, None
    best = boosting.best_point(table)
    return table, fit_joint_boosting(train, spec, best["maxIter"], best["maxDepth"], best["stepSize"], weighted)


def predictions(model, df: DataFrame, spec: FeatureSpec, version: str = "v1") -> DataFrame:
    """Every row with predicted class name, per-class probability map, model version.

    ``n_filled`` counts the row's missing numeric features (filled with training means).  Rows that
    :func:`prepare` prepared are scored by the model's last stage.
    """
    scored = model.transform(df)
    names = F.array(*[F.lit(c) for c in spec.classes])
    probs = vector_to_array("probability")
    keep = [c for c in df.columns if c not in ("features",)]
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("pred_label"),
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_class"),
        F.map_from_arrays(names, probs).alias("probabilities"),
        F.lit(version).alias("model_version"),
        sum((F.col(c).isNull().cast("int") for c in spec.numeric), F.lit(0)).alias("n_filled"))


def feature_names(model, spec: FeatureSpec, include_chronic_flag: bool = False) -> list[str]:
    """Expanded feature names: numerics, then ``<col>_<category>`` per one-hot slot."""
    prep = getattr(model, "prep", model)
    nums = list(spec.numeric) + (["chronic_flag"] if include_chronic_flag else [])
    names = list(nums)
    for col, labels in category_labels(prep):
        names += [f"{col}_{lab}" for lab in labels]
    return names


def feature_importances(model, spec: FeatureSpec, spark, top: int = 10,
                        include_chronic_flag: bool = False) -> DataFrame:
    """V6: top features by importance; linear models use |coefficient| of class 0."""
    names = feature_names(model, spec, include_chronic_flag)
    if isinstance(model, JointBoostingModel):
        imp = model.importances()
    else:
        clf = model.stages[-1]
        if hasattr(clf, "featureImportances"):
            imp = list(clf.featureImportances.toArray())
        else:
            imp = [abs(x) for x in clf.coefficientMatrix.toArray()[0]]
    rows = sorted(zip(names, (float(x) for x in imp)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")
