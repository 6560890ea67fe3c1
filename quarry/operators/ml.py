"""Machine learning with Spark ML (SURVEY M*).

Fits are distributed Spark ML estimators; closed-form pieces (scaling,
one-feature least squares, metrics, OLS cross-validation) are plain
aggregates so they have SQL twins. Fits are not bit-comparable with
sklearn (which the reference names but does not install).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscore_minmax(df: DataFrame, column: str) -> DataFrame:
    """M1: z-score (sample sd) and min-max scaling; statistics are scalar subqueries."""
    x = F.col(column).cast("double")
    st = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    m, s = st.select("m").scalar(), st.select("s").scalar()
    lo, hi = st.select("lo").scalar(), st.select("hi").scalar()
    return df.select("*", ((x - m) / F.nullif(s, F.lit(0.0))).alias(f"{column}_z"),
                     ((x - lo) / F.nullif(hi - lo, F.lit(0.0))).alias(f"{column}_minmax"))


def standard_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M1 (Spark ML form): assembled vector scaled to unit variance and zero mean."""
    va = VectorAssembler(inputCols=list(columns), outputCol="_f")
    sc = StandardScaler(inputCol="_f", outputCol="scaled", withMean=True, withStd=True)
    out = Pipeline(stages=[va, sc]).fit(df).transform(df)
    return out.withColumn("scaled", vector_to_array("scaled")).drop("_f")


def encode(df: DataFrame, column: str) -> DataFrame:
    """M2: StringIndexer (frequency desc, ties alphabetical) + OneHotEncoder."""
    si = StringIndexer(inputCol=column, outputCol=f"{column}_index", stringOrderType="frequencyDesc")
    oh = OneHotEncoder(inputCols=[f"{column}_index"], outputCols=[f"{column}_onehot"], dropLast=False)
    return Pipeline(stages=[si, oh]).fit(df).transform(df)


def variance_selection(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """M3: VarianceThresholdSelector; returns (feature, variance, selected)."""
    va = VectorAssembler(inputCols=list(columns), outputCol="_f")
    vec = va.transform(df.select(*columns))
    model = VarianceThresholdSelector(featuresCol="_f", outputCol="_sel", varianceThreshold=threshold).fit(vec)
    chosen = set(model.selectedFeatures)
    var = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    return var.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance"),
                                                  F.lit(i in chosen).alias("selected"))
                                         for i, c in enumerate(columns)])))


def label_selection(df: DataFrame, features: Sequence[str], label: str, bins: int = 10, top: int | None = None) -> DataFrame:
    """M3: how much each numeric feature tells about the label: ``feature, mutual_information`` (in
    nats), ``chi_square``, ``dof`` and ``selected`` (one of the ``top`` by mutual information, ties by
    the order given; all without ``top``).

    A feature is cut into ``bins`` equal parts of its range. One table counts (feature, bin, label)
    for all features; it has at most features x bins x labels rows, and the margins are sums over
    it. Rows without a value or a label do not count.
    """
    x = [F.col(f).cast("double") for f in features]
    ends = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))])
    cells = []
    for i, c in enumerate(x):
        lo, hi = ends.select(f"lo{i}").scalar(), ends.select(f"hi{i}").scalar()
        part = F.least(F.floor((c - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))
        cells.append(F.struct(F.lit(i).alias("i"), F.when(c.isNotNull(), F.coalesce(part, F.lit(0))).alias("bin")))
    counts = df.select(F.inline(F.array(*cells)), F.col(label).alias("label")).filter("bin is not null and label is not null") \
        .groupBy("i", "bin", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = [Window.partitionBy("i", *by) for by in (["bin"], ["label"], [])]
    c = counts.select("*", *[F.sum("n").over(w).alias(m) for w, m in zip(over, ("of_bin", "of_label", "of_all"))])
    expected = F.col("of_bin") * F.col("of_label") / F.col("of_all")
    told = c.groupBy("i").agg(
        F.sum(F.col("n") / F.col("of_all") * F.ln(F.col("n") / expected)).alias("mutual_information"),
        # cells without rows add what they expect: all rows less the cells that have some
        (F.sum(F.pow(F.col("n") - expected, 2) / expected) + F.first("of_all") - F.sum(expected)).alias("chi_square"),
        ((F.count_distinct("bin") - 1) * (F.count_distinct("label") - 1)).alias("dof"))
    names = F.array(*[F.lit(f) for f in features])
    place = F.row_number().over(Window.orderBy(F.desc("mutual_information"), "i"))      # one row per feature
    return told.select(F.get(names, F.col("i")).alias("feature"), "mutual_information", "chi_square", "dof",
                       (place <= (len(features) if top is None else top)).alias("selected"))


def embedding_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """M4: k-means cluster per row (features vector)."""
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df)
    return model.transform(df)


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def logistic(train: DataFrame, label: str, features: Sequence[str], score: DataFrame | None = None,
             forest: bool = False) -> DataFrame:
    """M5: logistic regression (or a random forest) fitted on ``train``, predictions for every row
    of ``score`` (of ``train`` if none is given)."""
    va = VectorAssembler(inputCols=list(features), outputCol="features")
    model = (RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, seed=7) if forest else
             LogisticRegression(featuresCol="features", labelCol=label, maxIter=50))
    return Pipeline(stages=[va, model]).fit(train).transform(train if score is None else score)


def linear_one_feature(df: DataFrame, y: str, x: str) -> DataFrame:
    """M6: LinearRegression with the normal-equation solver (equals T14)."""
    va = VectorAssembler(inputCols=[x], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol=y, solver="normal", regParam=0.0)
    m = lr.fit(va.transform(df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))))
    spark = df.sparkSession
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept), float(m.summary.r2))],
                                 "slope double, intercept double, r2 double")


def feature_importance(df: DataFrame, label: str, features: Sequence[str], seed: int = 7) -> DataFrame:
    """M7: random-forest importances per feature."""
    va = VectorAssembler(inputCols=list(features), outputCol="features")
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, seed=seed, maxDepth=5)
    model = rf.fit(va.transform(df))
    imp = model.featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, map(float, imp))), "feature string, importance double")


def correlation_ranking(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """M7 twin: features ranked by |Pearson r| with the label."""
    from quarry.functions.columns import safe_corr
    wide = df.agg(*[safe_corr(f, label).alias(f) for f in features])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f)).alias("abs_r"))
                                         for f in features])))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M8: accuracy, precision, recall, F1 for the positive class 1."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    g = pred.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("correct"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"))
    prec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return g.select((F.col("correct") / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    (2 * prec * rec / F.nullif(prec + rec, F.lit(0.0))).alias("f1"))


def r2_score(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """M8: R^2 = 1 - SSE / SST from sums."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    mean = pred.agg(F.avg(y)).scalar()
    g = pred.agg(F.sum((y - p) * (y - p)).alias("sse"), F.sum((y - mean) * (y - mean)).alias("sst"))
    return g.select((1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M9: count per (label, prediction)."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def ols_kfold(df: DataFrame, y: str, x: str, fold: str, k: int) -> DataFrame:
    """K-fold CV of one-feature OLS. Training sums for fold f are the
    totals minus fold f's sums (one grouped aggregate); the k coefficient
    rows are then applied to the held-out fold. The fold is ``fold mod k``,
    so there are at most k coefficient rows to broadcast. Returns RMSE per
    fold."""
    df = df.withColumn(fold, F.pmod(F.col(fold), F.lit(k)))
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    per = df.groupBy(F.col(fold).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(xx).alias("sx"), F.sum(yy).alias("sy"),
        F.sum(xx * xx).alias("sxx"), F.sum(xx * yy).alias("sxy"))
    tot = Window.partitionBy()
    tr = per.select("fold", *[(F.sum(c).over(tot) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    coef = (tr.withColumn("b", slope)
              .select("fold", "b", ((F.col("sy") - F.col("b") * F.col("sx")) / F.col("n")).alias("a")))
    test = df.select(F.col(fold).alias("fold"), xx.alias("_x"), yy.alias("_y")).join(F.broadcast(coef), "fold")
    err = test.groupBy("fold").agg(F.sqrt(F.avg((F.col("_y") - F.col("a") - F.col("b") * F.col("_x")) ** 2)).alias("rmse"))
    return err


def pca(df: DataFrame, k: int = 2) -> DataFrame:
    """PCA projection to k components (for cluster plots)."""
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(df)
    return model.transform(df).withColumn("pcs", vector_to_array("pcs"))


def learning_curve(df: DataFrame, label: str, features: Sequence[str], key: str,
                   fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """Training-set fraction (by key hash) -> accuracy of a logistic
    model on a held-out fold (key mod 5 = 0), the same for every fraction
    and never trained on; one fit per fraction, rows unioned."""
    spark = df.sparkSession
    rows = []
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(1000)) / 1000.0
    held = F.pmod(F.col(key), F.lit(5)) == 0
    for frac in fractions:
        pred = logistic(df.filter(~held & (bucket < frac)), label, features, df.filter(held))
        acc = classification_metrics(pred, label, "prediction").select("accuracy")
        rows.append(acc.select(F.lit(float(frac)).alias("fraction"), "accuracy"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out if out is not None else spark.createDataFrame([], "fraction double, accuracy double")


def cross_validate_linear(df: DataFrame, label: str, features: Sequence[str], fold_col: str, k: int,
                          reg_params: Sequence[float] = (0.0, 0.1)) -> DataFrame:
    """M10 (Spark ML form): CrossValidator over LinearRegression with a user
    fold column (fold = key mod k), one RMSE per parameter setting."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    va = VectorAssembler(inputCols=list(features), outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol=label)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, numFolds=k, foldCol=fold_col,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"))
    model = cv.fit(va.transform(df).withColumn(fold_col, F.col(fold_col).cast("int")))
    rows = [(float(p), float(m)) for p, m in zip(reg_params, model.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "reg_param double, mean_rmse double")
