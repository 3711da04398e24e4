"""Model scoring and training on Spark ML.

* anomaly model: standardise -> PCA(k) fitted on benign rows; the per-row
  reconstruction error is ``(|z|^2 - |P^T z|^2) / d`` (PCA is the linear
  counterpart of the autoencoder with a k-wide bottleneck; its errors are not
  the reference's network's errors).
* tree model: gradient-boosted trees; probability of class 1.
* hybrid scorers: live (additive) and batch (min-max) ensembles of the two.

Fitting is a distributed ``treeAggregate`` (scaler, PCA Gramian) or tree
learning over the whole training DataFrame; scoring is a map over rows with
the fitted parameters shipped to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.functions.columns import THRESHOLD, dl_score
from packetlens.operators.clean import drop_nonfinite, impute_nonfinite
from packetlens.operators.scoring import ensemble_batch, ensemble_live
from packetlens.session import write_once
from packetlens.schemas import fcol

VEC = "_vec"
# Rows in a partition that trees are fitted on: Spark ML keeps some 600 bytes a row of 30 features.
TREE_ROWS = 500_000


def with_vector(df: DataFrame, features) -> DataFrame:
    """Attach the feature vector column from an array column or a list of columns."""
    if isinstance(features, str):
        return df.withColumn(VEC, array_to_vector(F.col(features)))
    asm = VectorAssembler(inputCols=list(features), outputCol=VEC, handleInvalid="keep")
    # VectorAssembler resolves names itself; quote-free names are required.
    tmp = [f"_f{i}" for i in range(len(features))]
    d = df.withColumns({t: F.col(fcol(c)).cast("double") for t, c in zip(tmp, features)})
    asm.setInputCols(tmp)
    return asm.transform(d).drop(*tmp)


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))


def imputed(df: DataFrame, features) -> DataFrame:
    """P4 on the model's features: an array column or a list of columns."""
    if isinstance(features, str):
        return df.withColumn(features, F.transform(features, lambda x: F.when(_finite(x), x).otherwise(F.lit(0).cast("double"))))
    return impute_nonfinite(df, list(features))


def finite_only(df: DataFrame, features) -> DataFrame:
    """P5 on the model's features."""
    if isinstance(features, str):
        return df.where(F.coalesce(F.forall(features, _finite), F.lit(False)))
    return drop_nonfinite(df, list(features))


def fit_standardiser(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """M1 fit: mean and sample std per column in one distributed aggregate (one row)."""
    row = df.agg(*[F.avg(fcol(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_samp(fcol(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def apply_standardiser(df: DataFrame, stats: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """M1 transform: (x - mean) / std with the fitted numbers as literals.

    A column with zero (or undefined) spread maps to 0.0, as Spark ML's
    StandardScaler does. Works on streaming DataFrames too.
    """
    out = {}
    for c, (m, s) in stats.items():
        if s is None or s == 0 or m is None:
            out[c] = F.lit(0.0)
        else:
            out[c] = (F.col(fcol(c)) - F.lit(float(m))) / F.lit(float(s)) + F.lit(0.0)
    return df.withColumns(out)


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M1: (x - mean) / sample std per column, statistics from ``fit_on`` (default df)."""
    return apply_standardiser(df, fit_standardiser(fit_on if fit_on is not None else df, columns))


def _sumsq(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)


@dataclass
class AnomalyModel:
    """Scaler + PCA pipeline; error = mean squared residual of the reconstruction."""
    pipeline: PipelineModel
    features: object
    dims: int

    def errors(self, df: DataFrame, out: str = "dl_error") -> DataFrame:
        d = with_vector(df, self.features)
        t = self.pipeline.transform(d)
        z, p = vector_to_array(F.col("_z")), vector_to_array(F.col("_p"))
        err = F.greatest((_sumsq(z) - _sumsq(p)) / F.lit(float(self.dims)), F.lit(0.0))
        return t.withColumn(out, err).drop(VEC, "_z", "_p")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def fit_anomaly(df: DataFrame, features, k: int = 8, benign: str | None = None) -> AnomalyModel:
    """M2 + M11: scaler and PCA(k) fitted on the benign rows only."""
    train = df.where(F.col(benign)) if benign else df
    d = with_vector(train, features)
    dims = len(d.select(VEC).first()[0]) if isinstance(features, str) else len(features)
    pipe = Pipeline(stages=[
        StandardScaler(inputCol=VEC, outputCol="_z", withMean=True, withStd=True),
        PCA(k=min(k, dims), inputCol="_z", outputCol="_p"),
    ]).fit(d)
    return AnomalyModel(pipe, features, dims)


def in_tree_parts(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows at most. Files are read by their packed size, so
    a partition of a well-packed table holds millions of rows, which tree learning keeps
    unpacked and reads again in one task at every level."""
    need = -(-df.count() // (rows or TREE_ROWS))
    return df if need <= max(1, df.rdd.getNumPartitions()) else df.repartition(need)


def _named_outputs(est):
    est.setProbabilityCol("_prob")
    est.setRawPredictionCol("_raw")
    return est


@dataclass
class TreeModel:
    pipeline: PipelineModel
    features: object

    def probability(self, df: DataFrame, out: str = "ml_prob") -> DataFrame:
        t = self.pipeline.transform(with_vector(df, self.features))
        return (t.withColumn(out, vector_to_array(F.col("_prob"))[1])
                .drop(VEC, "_prob", "_raw", "_pred"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def fit_trees(df: DataFrame, features, label: str, max_iter: int = 300, max_depth: int = 8,
              step: float = 0.05, subsample: float = 0.8, colsample: str = "0.8",
              seed: int = 7) -> TreeModel:
    """Boosted trees (defaults: 300 trees, depth 8, lr 0.05, row and column rate 0.8)."""
    d = with_vector(df, features).withColumn("_y", F.col(label).cast("double"))
    gbt = _named_outputs(GBTClassifier(
        featuresCol=VEC, labelCol="_y", maxIter=max_iter, maxDepth=max_depth, stepSize=step,
        subsamplingRate=subsample, featureSubsetStrategy=colsample, predictionCol="_pred", seed=seed))
    return TreeModel(Pipeline(stages=[gbt]).fit(in_tree_parts(d.select(VEC, "_y"))), features)


def rank_features(df: DataFrame, features, label: str, names: list[str] | None = None,
                  top: int = 30, num_trees: int = 50, seed: int = 7) -> DataFrame:
    """M10 + T3: random-forest importance, highest first, top ``top``."""
    d = with_vector(df, features).withColumn("_y", F.col(label).cast("double"))
    rf = RandomForestClassifier(featuresCol=VEC, labelCol="_y", numTrees=num_trees, seed=seed)
    imp = rf.fit(in_tree_parts(d.select(VEC, "_y"))).featureImportances.toArray().tolist()
    names = names or (list(features) if not isinstance(features, str) else [f"x{i}" for i in range(len(imp))])
    spark = df.sparkSession
    t = spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature string, importance double")
    return t.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def permutation_importance(df: DataFrame, model: TreeModel, label: str, order: str,
                           buckets: int | None = None, seed: int = 7) -> DataFrame:
    """M15 (b): per feature, the rise of the model's log loss when that feature's
    values are exchanged between rows; one job for all features.

    Rows are dealt to random buckets by a hash of the row id ``order``; in its
    bucket each row takes the values of the next row (the last row those of the
    first). Each row then gives one scored copy per feature, reduced by a
    partial aggregate. ``buckets`` sets how many rows a window holds (default:
    about 1,000, from a count), as a row alone in its bucket keeps its values.
    """
    features = list(model.features)
    if buckets is None:
        buckets = max(1, df.count() // 1000)
    names = [f"_v{i}" for i in range(len(features))]
    rows = df.select(F.col(fcol(order)).alias("_id"), F.col(fcol(label)).cast("double").alias("_t"),
                     F.array(*[F.col(fcol(c)).cast("double") for c in features]).alias("_x"))
    at = Window.partitionBy("_b").orderBy(F.xxhash64("_id", F.lit(seed + 1)), "_id")
    whole = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(buckets)))
            .withColumn("_other", F.coalesce(F.lead("_x").over(at), F.first("_x").over(whole))))
    # copy -1 is the row as it is, copy j has feature j from the other row
    copies = rows.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    copies = copies.select("_t", "_j", *[
        F.when(F.col("_j") == i, F.col("_other")[i]).otherwise(F.col("_x")[i]).alias(n) for i, n in enumerate(names)])
    scored = TreeModel(model.pipeline, names).probability(copies, "_p")
    p = F.least(F.greatest(F.col("_p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = scored.groupBy("_j").agg(
        F.avg(-F.col("_t") * F.log(p) - (1 - F.col("_t")) * F.log(1 - p)).alias("loss"))
    # one row per feature and one for the base
    base = F.max(F.when(F.col("_j") < 0, F.col("loss"))).over(Window.partitionBy())
    return (loss.withColumn("importance", F.col("loss") - base).where(F.col("_j") >= 0)
            .select(F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_j") + 1).alias("feature"), "importance")
            .orderBy(F.col("importance").desc(), "feature"))


@dataclass
class HybridModel:
    """Anomaly model + tree model + threshold (the hybrid detector)."""
    anomaly: AnomalyModel
    trees: TreeModel
    threshold: float = THRESHOLD

    def score_live(self, df: DataFrame) -> DataFrame:
        """M7: impute (P4) -> error -> dl score -> tree probability -> additive ensemble -> verdict."""
        e = self.anomaly.errors(imputed(df, self.anomaly.features), "dl_error")
        p = self.trees.probability(e, "ml_prob")
        return ensemble_live(p, "dl_error", "ml_prob", threshold=self.threshold)

    def score_batch(self, df: DataFrame) -> DataFrame:
        """M8: drop rows with non-finite features (P5) -> error -> min-max over the batch -> 0.5/0.5 ensemble -> verdict.
        Errors and probabilities are written once: the extremes and the verdicts read them."""
        e = self.anomaly.errors(finite_only(df, self.anomaly.features), "dl_error")
        p = write_once(self.trees.probability(e, "ml_prob"), "batch-scores")
        return ensemble_batch(p, "dl_error", "ml_prob")


def fit_hybrid(df: DataFrame, features, label: str, benign: str, k: int = 8,
               quantile: float | None = 0.9, **tree_kw) -> HybridModel:
    """Train both models on rows with finite features; the threshold is the
    benign error quantile (M12), or 0.5 without one."""
    from packetlens.operators.stats import exact_quantile
    df = finite_only(df, features)
    if df.where(F.col(benign)).isEmpty():
        raise ValueError("the anomaly model needs benign rows with finite features")
    an = fit_anomaly(df, features, k=k, benign=benign)
    thr = THRESHOLD
    if quantile is not None:
        errs = an.errors(df.where(F.col(benign)), "_err")
        found = exact_quantile(errs, "_err", quantile)
        thr = THRESHOLD if found is None else found
    trees = fit_trees(df, features, label, **tree_kw)
    return HybridModel(an, trees, float(thr))


def tree_only_labels(df: DataFrame, features, label: str, max_iter: int = 20, max_depth: int = 4,
                     seed: int = 7) -> DataFrame:
    """M9: string label -> index -> scaler -> trees -> predicted label string."""
    from pyspark.ml.feature import IndexToString, StringIndexer

    from packetlens.operators.boost import fit_boosted
    idx = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    sc = StandardScaler(inputCol=VEC, outputCol="_z", withMean=True, withStd=True)
    index, scaler = Pipeline(stages=[idx, sc]).fit(with_vector(df, features)).stages
    if len(index.labels) > 2:
        raise ValueError(f"boosted trees tell two labels apart, the table holds {len(index.labels)}")
    if isinstance(features, str):
        values = [F.col(features)[i].cast("double") for i in range(len(scaler.mean))]
    else:
        values = [F.col(fcol(c)).cast("double") for c in features]
    trees = fit_boosted(index.transform(df), values, "_y", scaler.mean.toArray(), scaler.std.toArray(),
                        max_iter=max_iter, max_depth=max_depth, seed=seed)
    inv = IndexToString(inputCol="_pred", outputCol="predicted_label", labels=index.labels)
    return inv.transform(trees.predict(df, values, "_pred")).drop("_pred")


def evaluate_models(df: DataFrame, features, label: str, benign: str, k: int = 8,
                    test_fraction: float = 0.2, seed: int = 17, quantile: float | None = 0.9,
                    **tree_kw) -> DataFrame:
    """Held-out quality of the anomaly model alone, the trees alone and the hybrid.

    Rows are split at random (seeded) into train / test; models are fitted on
    train only. Predictions on test: anomaly = error above the calibrated
    threshold, trees = probability > 0.5, hybrid = live verdict. One metrics
    row per model (see ``stats.evaluate``).
    """
    from packetlens.operators.stats import evaluate_all
    train, test = df.randomSplit([1 - test_fraction, test_fraction], seed=seed)
    h = fit_hybrid(train, features, label, benign, k=k, quantile=quantile, **tree_kw)
    scored = h.score_live(test).withColumn("truth", F.col(label).cast("int"))
    thr = F.lit(float(h.threshold))
    verdicts = {"anomaly": (F.col("dl_error") > thr, "dl_error"), "trees": (F.col("ml_prob") > 0.5, "ml_prob"),
                "hybrid": (F.col("label") == "ATTACK", "final_score")}
    # one long table: the scored rows are read once for all models
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), hit.cast("int").alias("prediction"), F.col(score).alias("score"))
                               for name, (hit, score) in verdicts.items()]))
    out = evaluate_all(scored.select("truth", each.alias("x")).select("truth", "x.*"))
    return out.withColumn("threshold", thr)


def save_hybrid(model: HybridModel, path: str) -> None:
    """Both pipelines plus the threshold as ``{"threshold": x}`` JSON."""
    import os

    from packetlens.sources.files import threshold_json
    model.anomaly.pipeline.write().overwrite().save(os.path.join(path, "anomaly"))
    model.trees.pipeline.write().overwrite().save(os.path.join(path, "trees"))
    meta = {"dims": model.anomaly.dims,
            "features": model.anomaly.features if isinstance(model.anomaly.features, str)
            else list(model.anomaly.features)}
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    s.createDataFrame([(threshold_json(model.threshold), __import__("json").dumps(meta))],
                      "threshold string, meta string").coalesce(1).write.mode("overwrite").parquet(
        os.path.join(path, "meta"))


def load_hybrid(spark, path: str) -> HybridModel:
    """Load what ``save_hybrid`` wrote."""
    import json
    import os
    row = spark.read.parquet(os.path.join(path, "meta")).first()
    meta = json.loads(row["meta"])
    thr = json.loads(row["threshold"])["threshold"]
    feats = meta["features"]
    return HybridModel(AnomalyModel(PipelineModel.load(os.path.join(path, "anomaly")), feats, meta["dims"]),
                       TreeModel(PipelineModel.load(os.path.join(path, "trees")), feats), float(thr))
