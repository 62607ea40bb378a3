"""Label permutation of group differences over time, and classification of groups."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..records import ParameterError
from . import series as S
from .windowed import is_bookkeeping


def label_permutations(units: DataFrame, n_permutations: int, seed: int = 0) -> DataFrame:
    """permutation, subject, g: permutation 0 keeps the labels, the others deal the same labels anew.

    units: subject, g (0 or 1), one row each. The order of hashes of seed, permutation and subject says
    who gets a 1, so a permutation is the same on every cluster."""
    ones = F.sum("g").over(Window.partitionBy("permutation"))
    order = F.row_number().over(Window.partitionBy("permutation").orderBy(F.xxhash64(F.lit(seed), F.col("permutation"), F.col("subject").cast("string")), "subject"))
    each = units.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(n_permutations))))
    return each.select("permutation", "subject", F.when(F.col("permutation") == 0, F.col("g")).otherwise((order <= ones).cast("int")).alias("g"))


def auc_curves(values: DataFrame, labels: DataFrame, min_per_group: int) -> DataFrame:
    """permutation, metric, window, auc, n_a, n_b. values: subject, metric, window, value; labels: permutation,
    subject, g. Ranks do not depend on labels: they are found once. auc is null where a group is too small."""
    w = Window.partitionBy("metric", "window")
    known = values.where(F.col("value").isNotNull() & ~F.isnan("value")).join(labels.select("subject").distinct(), "subject")
    ranks = known.withColumn("r", F.rank().over(w.orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy("metric", "window", "value")) - 1) / 2)
    n = ranks.join(labels, "subject").groupBy("permutation", "metric", "window").agg(F.count_if(F.col("g") == 0).alias("n_a"), F.count_if(F.col("g") == 1).alias("n_b"), F.sum(F.col("r") * F.col("g")).alias("rb"))
    u = F.col("rb") - F.col("n_b") * (F.col("n_b") + 1) / 2
    full = (F.col("n_a") >= max(1, min_per_group)) & (F.col("n_b") >= max(1, min_per_group))
    return n.select("permutation", "metric", "window", F.when(full, u / (F.col("n_a") * F.col("n_b"))).alias("auc"), "n_a", "n_b")


def group_timecourse(values: DataFrame, units: DataFrame, n_permutations: int = 2000, min_per_group: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(curve, summary). The labels of whole subjects are permuted. summary: metric, n_windows_tested,
    auc_peak, peak_window, trend_per_window, p_peak (largest |auc - 0.5| over windows), p_trend."""
    curves = auc_curves(values, label_permutations(units, n_permutations, seed), min_per_group)
    far = F.round(F.abs(F.col("auc") - 0.5), 9)
    known = F.col("auc").isNotNull()
    trend = F.when(F.count("auc") >= 3, F.round(F.regr_slope("auc", F.col("window").cast("double")), 9))
    best = F.max(F.when(known, F.struct(far.alias("far"), (-F.col("window")).alias("at"), "auc")))
    each = curves.groupBy("metric", "permutation").agg(F.count("auc").alias("n"), best.alias("best"), trend.alias("trend"))
    own = each.where("permutation = 0 and n > 0").select("metric", F.col("n").alias("n_windows_tested"), F.col("best.auc").alias("auc_peak"), (-F.col("best.at")).alias("peak_window"), F.col("best.far").alias("__far"), F.col("trend").alias("trend_per_window"))
    share = lambda hit: (1 + F.count_if(hit)) / (1 + F.lit(n_permutations))
    null = each.where("permutation > 0").join(own.select("metric", "__far", F.abs("trend_per_window").alias("__trend")), "metric")
    p = null.groupBy("metric").agg(share(F.col("best.far") >= F.col("__far")).alias("p_peak"), F.when(F.first("__trend").isNotNull(), share(F.abs("trend") >= F.col("__trend"))).alias("p_trend"))
    return curves.where("permutation = 0").drop("permutation"), own.drop("__far").join(p, "metric", "left")


MODELS = ("logistic", "forest", "linear_svm", "rbf_svm")
# prefixes of measures by family (fixed vocabulary)
FAMILIES = {"classical": ("mvl", "mi_", "plv", "aac", "mod_", "preferred_"), "rqa": ("RR", "DET", "L", "Lmax", "DIV", "ENT", "LAM", "TT", "V", "W", "RTE", "recurrence_rate", "epsilon"), "dynamics": ("mobility", "complexity", "petrosian", "katz", "permutation", "sample", "higuchi", "dfa", "D2", "lambda_")}


def select_features(columns: list[str], families: str = "both") -> list[str]:
    """The measures among some columns; `both` is classical and rqa, `all` takes the dynamics too."""
    wanted = {"both": ("classical", "rqa"), "all": tuple(FAMILIES)}.get(families, (families,))
    if not set(wanted) <= set(FAMILIES):
        raise ParameterError(f"families must be one of {('both', 'all', *FAMILIES)}")
    starts = tuple(p for f in wanted for p in FAMILIES[f])
    return [c for c in columns if not is_bookkeeping(c) and c.startswith(starts)]


def build_features(table: DataFrame, features: list[str], level: str = "subject", aggregate: str = "mean", order: str = "window") -> DataFrame:
    """One row a subject (mean; with aggregate="all" also std and trend over the rows in order), or the rows as they are."""
    if level == "window":
        return table.select("subject", order, *features)
    if level != "subject" or aggregate not in ("mean", "all"):
        raise ParameterError("level is subject or window, aggregate mean or all")
    at = F.row_number().over(Window.partitionBy("subject").orderBy(order)).cast("double")
    each = {"mean": [("mean", F.avg)], "all": [("mean", F.avg), ("std", F.stddev_samp), ("trend", lambda c: F.regr_slope(c, "__at"))]}[aggregate]
    return table.withColumn("__at", at).groupBy("subject").agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in features for n, f in each])


def align_labels(table: DataFrame, labels: DataFrame) -> DataFrame:
    """table with the label of each row's subject; rows without one go. labels: subject, label, one row a subject."""
    return table.join(labels.select("subject", "label").where("label is not null").dropDuplicates(["subject"]), "subject")


def folds(subjects: DataFrame, n_splits: int, repeat: int, seed: int = 0) -> DataFrame:
    """subject, label, fold: each label's subjects dealt over the folds in turn, in the order of a hash."""
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), F.lit(repeat), F.col("subject").cast("string")), "subject"))
    return subjects.select("subject", "label", ((order - 1 + F.col("label")) % n_splits).cast("int").alias("fold"))


def scores(predicted: DataFrame, by: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """Scores of label, prediction (0 or 1) and score for each fold; ones without meaning are null."""
    k = list(by)
    w = Window.partitionBy(*k)
    r = F.rank().over(w.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy(*k, "score")) - 1) / 2
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p)).cast("double")
    c = predicted.withColumn("r", r).groupBy(*k).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), F.sum(F.col("r") * F.col("label")).alias("rb"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: F.when(b > 0, a / b)
    sens, spec = over(tp, tp + fn), over(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    auc = over(F.col("rb") - (tp + fn) * (tp + fn + 1) / 2, (tp + fn) * (tn + fp))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.select(*k, auc.alias("auc"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), over(tp, tp + fp).alias("precision"), zero(over(2 * tp, 2 * tp + fp + fn)).alias("f1"), zero(over(tp * tn - fp * fn, root)).alias("mcc"))


def classify_groups(table: DataFrame, features: list[str], model: str = "logistic", n_splits: int = 5, n_repeats: int = 1, seed: int = 0) -> DataFrame:
    """repeat, fold and the scores on subjects that a fit has not seen.

    table: subject, label (0 or 1) and features; rows of a subject stay in one fold. Medians stand in for
    missing values and features are standardised, both learned in the training part; labels weigh alike.
    Every fit is a distributed one of pyspark.ml, so rows are never gathered. rbf_svm is a linear machine on random
    Fourier features of the standardised ones, which stand for the radial kernel of width 1 / number of features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model not in MODELS:
        raise ParameterError(f"model must be one of {MODELS}")
    data = table.select("subject", F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    # every fit reads this table: it is computed once, and its storage goes when the session ends
    data = data.persist(StorageLevel.DISK_ONLY_2)
    subjects = data.groupBy("subject").agg(F.max("label").alias("label"))
    filled = [f"__{f}" for f in features]
    kw = {"featuresCol": "scaled", "labelCol": "label", "weightCol": "weight"}
    fit = {"logistic": lambda: LogisticRegression(regParam=0.01, **kw), "forest": lambda: RandomForestClassifier(numTrees=100, seed=seed, **kw), "linear_svm": lambda: LinearSVC(regParam=0.01, maxIter=25, **kw), "rbf_svm": lambda: LinearSVC(regParam=0.01, maxIter=25, **(kw | {"featuresCol": "waves"}))}[model]
    out = None
    for repeat in range(n_repeats):
        dealt = data.join(folds(subjects, n_splits, repeat, seed).select("subject", "fold"), "subject")
        for fold in range(n_splits):
            train = dealt.where(F.col("fold") != fold)
            ones, n = train.agg(F.sum("label"), F.count(F.lit(1))).first()
            if not ones or ones == n:
                raise ParameterError("a training part has one label only; use fewer folds")
            train = train.withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones))))
            steps = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True)]
            ready = Pipeline(stages=steps).fit(train)
            train, test = ready.transform(train), ready.transform(dealt.where(F.col("fold") == fold))
            if model == "rbf_svm":
                train, test = with_waves(train, len(features), seed), with_waves(test, len(features), seed)
            told = fit().fit(train).transform(test)
            one = told.select(F.lit(repeat).alias("repeat"), "fold", "subject", "label", F.col("prediction").cast("int").alias("prediction"), vector_to_array("rawPrediction")[1].alias("score"))
            out = one if out is None else out.union(one)
    return scores(out)


def with_waves(df: DataFrame, n_features: int, seed: int = 0, n_waves: int = 100) -> DataFrame:
    """df plus `waves`: cosines of random projections of `scaled`, whose products near the radial kernel."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 / n_features), (n_waves, n_features))
    b = rng.uniform(0, 2 * np.pi, n_waves)
    x = [F.col("__x")[k] for k in range(n_features)]
    turn = lambda j: sum((float(v) * c for v, c in zip(w[j], x, strict=True)), F.lit(float(b[j])))
    cells = F.array(*[F.cos(turn(j)) * float(np.sqrt(2 / n_waves)) for j in range(n_waves)])
    return df.withColumn("__x", vector_to_array("scaled")).withColumn("waves", array_to_vector(cells)).drop("__x")


def permuted_scores(table: DataFrame, features: list[str], n_permutations: int, score: str = "auc", seed: int = 0, **options) -> DataFrame:
    """observed, p, n_permutations: the mean score against that of fits on labels dealt anew among subjects; p = (1 + those
    that reach it) / (1 + n). Each permutation is a whole cross-validation."""
    units = table.groupBy("subject").agg(F.max("label").alias("g"))
    dealt = label_permutations(units.withColumn("g", F.col("g").cast("int")), n_permutations, seed)
    values = []
    for k in range(n_permutations + 1):
        labels = dealt.where(F.col("permutation") == k).select("subject", F.col("g").alias("label"))
        values.append(classify_groups(table.drop("label").join(labels, "subject"), features, seed=seed, **options).agg(F.avg(score)).first()[0] or 0.0)
    hits = sum(round(v, 9) >= round(values[0], 9) for v in values[1:])
    return table.sparkSession.createDataFrame([(float(values[0]), (1 + hits) / (1 + n_permutations), n_permutations)], "observed double, p double, n_permutations int")


def classify_timecourse(table: DataFrame, features: list[str], time: str = "window", min_per_group: int = 5, n_permutations: int = 0, score: str = "auc", seed: int = 0, **options) -> DataFrame:
    """time, n_a, n_b, score, peak, p_peak: a cross-validation in each window that has enough of both labels. With
    permutations the labels of whole subjects are dealt anew for all windows at once, and p_peak holds the best window
    against the best ones of the permutations."""
    sizes = table.groupBy(time).agg(F.countDistinct(F.when(F.col("label") == 0, F.col("subject"))).alias("n_a"), F.countDistinct(F.when(F.col("label") == 1, F.col("subject"))).alias("n_b"))
    windows = sizes.orderBy(time).collect()  # one row a window of the grid
    units = table.groupBy("subject").agg(F.max("label").cast("int").alias("g"))
    dealt = label_permutations(units, n_permutations, seed)
    usable = [w for w in windows if min(w.n_a, w.n_b) >= min_per_group]

    def curve(k: int) -> dict:
        labels = dealt.where(F.col("permutation") == k).select("subject", F.col("g").alias("label"))
        of = table.drop("label").join(labels, "subject")
        return {w[time]: classify_groups(of.where(F.col(time) == w[time]), features, seed=seed, **options).agg(F.avg(score)).first()[0] for w in usable}

    own = curve(0)
    peak = max(own, key=lambda w: own[w] or 0.0) if own else None
    p = None
    if n_permutations and peak is not None:
        hits = sum(round(max((v or 0.0) for v in curve(k).values()), 9) >= round(own[peak] or 0.0, 9) for k in range(1, n_permutations + 1))
        p = (1 + hits) / (1 + n_permutations)
    rows = [(int(w[time]), w.n_a, w.n_b, own.get(w[time]), w[time] == peak, p if w[time] == peak else None) for w in windows]
    return table.sparkSession.createDataFrame(rows, f"{time} int, n_a long, n_b long, score double, peak boolean, p_peak double")


def importances(table: DataFrame, features: list[str]) -> DataFrame:
    """feature, weight: standardised mean difference of the labels, the largest first."""
    g = lambda c, k: F.when(F.col("label") == k, F.col(c))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs((F.avg(g(c, 1)) - F.avg(g(c, 0))) / F.when(F.stddev_pop(c) > 0, F.stddev_pop(c))).alias("weight")) for c in features])
    return table.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*").orderBy(F.desc_nulls_last("weight"), "feature")


def label_baseline(table: DataFrame) -> DataFrame:
    """Accuracy of the more frequent label."""
    return table.agg((F.greatest(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)) / F.count(F.lit(1))).alias("accuracy"))
