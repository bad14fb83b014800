"""Classification with ``pyspark.ml``: train, predict, evaluate, tune.

The text pipeline is Spark ML stages (tokenise, stop words, counts, IDF,
L2) so the fitted ``PipelineModel`` is saved / loaded / broadcast by Spark.
Spark's IDF is ln((n+1)/(df+1)); the smooth sklearn form adds 1, which is
applied with an ``ElementwiseProduct`` stage built from the fitted IDF.
"""

from __future__ import annotations

import itertools
import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (CountVectorizer, ElementwiseProduct, IDF, IndexToString, Normalizer,
                                RegexTokenizer, StopWordsRemover, StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.functions.text import TOKEN2_RE, default_stopwords
from ticketscope.operators.textproc import txt_preprocess
from ticketscope.session import materialize


def make_classifier(model_type: str, *, n_train: int | None = None, C: float = 1.0, seed: int = 42, **params):
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
    if model_type == "random_forest":
        return RandomForestClassifier(numTrees=params.get("numTrees", 100), maxDepth=params.get("maxDepth", 10),
                                      featureSubsetStrategy=params.get("featureSubsetStrategy", "sqrt"),
                                      minInstancesPerNode=params.get("minInstancesPerNode", 1), seed=seed,
                                      labelCol="label", featuresCol="features")
    if model_type == "logistic_regression":
        # sklearn: sum(loss) + ||w||^2 / (2C)  ==  Spark: mean(loss) + regParam ||w||^2 / 2
        reg = 1.0 / (C * n_train) if n_train else 0.0
        # tol 1e-4 = scikit-learn's default stopping tolerance (Spark's is 1e-6)
        return LogisticRegression(maxIter=params.get("maxIter", 1000), regParam=reg, elasticNetParam=0.0,
                                  tol=params.get("tol", 1e-4), standardization=False, family="multinomial",
                                  labelCol="label", featuresCol="features")
    if model_type == "linear_svm":
        return OneVsRest(classifier=LinearSVC(regParam=params.get("regParam", 0.0), maxIter=params.get("maxIter", 100)),
                         labelCol="label", featuresCol="features")
    raise ValueError(f"unknown model type {model_type!r} (random_forest, logistic_regression, linear_svm)")


def _training_texts(df: DataFrame, text_col: str, label_col: str, *keep: Column | str) -> DataFrame:
    """Cleaned texts (``processed_text``) with words and a class, and the columns ``keep``; kept,
    since every stage's fit reads the texts again."""
    d = txt_preprocess(df.where(F.col(label_col).isNotNull()), text_col=text_col)
    # filtered when kept: a filter on a text that is still to be cleaned would clean it a second time
    return materialize(d.select(label_col, "processed_text", *keep)).where(F.length("processed_text") > 0)


def _fit(d: DataFrame, label_col: str, model_type: str, max_features: int, C: float, seed: int,
         params: dict) -> tuple[PipelineModel, DataFrame]:
    """The pipeline of ``ml_train_pipeline`` over ``_training_texts``, and their kept vectors (``label``, ``features``)."""
    indexer = StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc").fit(d)
    split = RegexTokenizer(inputCol="processed_text", outputCol="_tok", pattern=TOKEN2_RE, gaps=False)
    stop = StopWordsRemover(inputCol="_tok", outputCol="_tok2", stopWords=list(default_stopwords()))
    # what these two stages make of a cleaned text, that is of letters and single blanks without stop words
    toks = F.filter(F.split("processed_text", " "), lambda w: F.length(w) >= 2)
    d = indexer.transform(d).select("label", toks.alias("_tok2"))
    counts = CountVectorizer(inputCol="_tok2", outputCol="_tf", vocabSize=max_features).fit(d)
    # counted once: the weights and the classifier's passes read vectors and labels only, not texts and tokens
    tf = materialize(counts.transform(d).select("label", "_tf"))
    idf_model = IDF(inputCol="_tf", outputCol="_idf0").fit(tf)
    plus_one = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf",
                                  scalingVec=Vectors.dense([v + 1.0 for v in idf_model.idf.toArray()]))
    norm = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)
    prepared = norm.transform(plus_one.transform(tf)).select("label", "features")
    clf = make_classifier(model_type, n_train=tf.count(), C=C, seed=seed, **params).fit(prepared)
    back = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=list(indexer.labelsArray[0]))
    return PipelineModel(stages=[indexer, split, stop, counts, plus_one, norm, clf, back]), prepared


def ml_train_vectors(df: DataFrame, *, text_col: str = "customer_message", label_col: str = "category",
                     model_type: str = "logistic_regression", max_features: int = 10000, C: float = 1.0,
                     seed: int = 42, **params) -> tuple[PipelineModel, DataFrame]:
    """``ml_train_pipeline`` and the vectors (``label``, ``features``) it was fitted on."""
    return _fit(_training_texts(df, text_col, label_col), label_col, model_type, max_features, C, seed, params)


def ml_train_pipeline(df: DataFrame, **args) -> PipelineModel:
    """preprocess -> tokens -> stop words -> counts -> smooth IDF -> L2 -> classifier.

    Returns a PipelineModel whose output has ``predicted_category``; arguments as of ``ml_train_vectors``.
    """
    return ml_train_vectors(df, **args)[0]


#: The record that a training job saves beside its model.
TRAINING_RECORD = ("model_type string, accuracy double, n long, training_samples long, validation_samples long, "
                   "label_mapping array<string>, classification_report array<struct<class: string, precision: double, "
                   "recall: double, support: long, f1: double>>")


def ml_train_job(df: DataFrame, path: str, *, id_col: str, text_col: str = "customer_message", label_col: str = "category",
                 model_type: str = "logistic_regression", max_features: int = 10000, C: float = 1.0, test: float = 0.2,
                 val: float = 0.1, seed: int = 42, **params) -> DataFrame:
    """preprocess -> stratified split -> vectorise and fit on the training part -> evaluate on the
    test part -> save the model (``path``/model) with its record (``path``/info.json).

    Returns the saved record, one row: ``accuracy`` and class report of the ``n`` test texts. Neither the
    vocabulary nor the classifier sees a test or validation text; texts without words or class are in no part.
    """
    from ticketscope.operators.features import txt_stratified_split
    from ticketscope.sources.sinks import export
    d = _training_texts(df, text_col, label_col, F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"))
    # ids may repeat: a text meets its part by its row; only ids are sorted
    part = txt_stratified_split(d.select("_id", label_col, "_row"), id_col="_id", label_col=label_col, test=test, val=val,
                                seed=seed).select("_row", "split")
    d = materialize(d.join(part, "_row").select(label_col, "processed_text", "split"))
    model, _ = _fit(d.where("split = 'train'").drop("split"), label_col, model_type, max_features, C, seed, params)
    scorer = PipelineModel(stages=model.stages[1:])  # without the class index
    pred = materialize(scorer.transform(d.where("split = 'test'")).select(label_col, "predicted_category"))
    columns = dict(label_col=label_col)
    report = ev_class_report(pred, **columns).agg(F.array_sort(F.collect_list(F.struct("class", "precision", "recall", "support", "f1")))
                                                  .alias("classification_report"))
    sizes = d.agg(*[F.count_if(F.col("split") == s).alias(n) for s, n in (("train", "training_samples"), ("val", "validation_samples"))])
    info = ev_accuracy(pred, **columns).crossJoin(sizes).crossJoin(report).select(  # one row each
        F.lit(model_type).alias("model_type"), "accuracy", "n", "training_samples", "validation_samples",
        F.array(*[F.lit(x) for x in model_labels(model)]).alias("label_mapping"), "classification_report")
    model.write().overwrite().save(f"{path}/model")
    export(info, f"{path}/info.json")
    return df.sparkSession.read.schema(TRAINING_RECORD).json(f"{path}/info.json")


def model_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def token_stages(model: PipelineModel) -> PipelineModel:
    """The fitted stages after stop-word removal (counts -> ... -> label), fed
    with a token array column ``_tok2``; lets callers score token arrays
    without re-running text preprocessing."""
    idx = next(i for i, st in enumerate(model.stages) if st.__class__.__name__ == "CountVectorizerModel")
    return PipelineModel(stages=model.stages[idx:])


def model_tokens(model: PipelineModel, df: DataFrame, *, text_col: str) -> DataFrame:
    """df + ``_tok2`` (preprocessed, tokenised, stop words removed) using the model's own stages."""
    idx = next(i for i, st in enumerate(model.stages) if st.__class__.__name__ == "CountVectorizerModel")
    pre = PipelineModel(stages=[st for st in model.stages[:idx] if st.__class__.__name__ != "StringIndexerModel"])
    return pre.transform(txt_preprocess(df, text_col=text_col))


def ml_predict_batch(model: PipelineModel, df: DataFrame, *, text_col: str = "customer_message",
                     with_prob_columns: bool = True) -> DataFrame:
    """Category, confidence (max probability), processed text, probability map and
    ``prob_<class>`` columns; empty processed text -> General Inquiry at 0.0."""
    from ticketscope.operators.aggs import prj_prob_columns
    labels = model_labels(model)
    d = txt_preprocess(df, text_col=text_col)
    cols_needed = set(d.columns)
    # scoring needs no label: a category that training did not see, or none, must not fail the job
    scorer = PipelineModel(stages=[st for st in model.stages if st.__class__.__name__ != "StringIndexerModel"])
    out = scorer.transform(d.withColumn("_has", F.length("processed_text") > 0))
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:  # one-vs-rest margins: softmax, so that they rank and sum like probabilities
        raw = vector_to_array("rawPrediction")
        odds = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        probs = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
    pm = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probs)
    out = out.withColumn("probabilities", pm).withColumn("confidence", F.array_max(probs))
    out = (out.withColumn("predicted_category", F.when(F.col("_has"), F.col("predicted_category"))
                          .otherwise(F.lit("General Inquiry")))
           .withColumn("confidence", F.when(F.col("_has"), F.col("confidence")).otherwise(F.lit(0.0))))
    keep = [c for c in out.columns if c in cols_needed] + ["predicted_category", "confidence", "probabilities"]
    out = out.select(*keep)
    return prj_prob_columns(out, labels) if with_prob_columns else out


# ------------------------------------------------------------- evaluation

def ev_accuracy(pred: DataFrame, *, label_col: str = "true_category", pred_col: str = "predicted_category") -> DataFrame:
    return pred.agg(F.avg((F.col(label_col) == F.col(pred_col)).cast("int")).alias("accuracy"),
                    F.count("*").alias("n"))


def ev_confusion(pred: DataFrame, *, label_col: str = "true_category", pred_col: str = "predicted_category") -> DataFrame:
    """Long confusion matrix (actual, predicted, count); ``pivot`` it for the wide form."""
    return pred.groupBy(F.col(label_col).alias("actual"), F.col(pred_col).alias("predicted")).agg(
        F.count("*").alias("count"))


def ev_class_report(pred: DataFrame, *, label_col: str = "true_category",
                    pred_col: str = "predicted_category") -> DataFrame:
    """Precision, recall, F1, support per class plus macro / weighted averages:
    one scan counts the confusion matrix, everything else follows from its few rows."""
    zero, n = F.lit(0).cast("long"), F.col("count")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(F.struct(F.col("actual").alias("class"), n.alias("support"), zero.alias("n_pred"), hit.alias("tp")),
                    F.struct(F.col("predicted").alias("class"), zero.alias("support"), n.alias("n_pred"), zero.alias("tp")))
    j = ev_confusion(pred, label_col=label_col, pred_col=pred_col).select(F.explode(sides).alias("s")).select("s.*")
    j = j.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "n_pred", "tp")]).where(F.col("support") > 0)
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    j = j.select("class", p.alias("precision"), (F.col("tp") / F.col("support")).alias("recall"), "support")
    j = j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(F.lit(0.0)))
    scores = ["precision", "recall", "f1"]
    g = j.groupingSets([[F.col("class")], []], "class").agg(
        F.grouping_id().alias("total"), F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in scores],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in scores])

    def row(name, prefix=""):
        return F.struct(name.alias("class"), F.col(f"{prefix}precision").alias("precision"),
                        F.col(f"{prefix}recall").alias("recall"), F.col("support"), F.col(f"{prefix}f1").alias("f1"))

    rows = F.when(F.col("total") == 1, F.array(row(F.lit("macro avg")), row(F.lit("weighted avg"), "w_"))) \
        .otherwise(F.array(row(F.col("class"))))
    return g.select(F.explode(rows).alias("r")).select("r.*")


# ------------------------------------------------------------------ tuning

# Search spaces of the distributed-capable model types.
SEARCH_SPACES = {
    "random_forest": {"n_estimators": [50, 100, 200, 300, 500], "max_depth": [None, 10, 20, 30],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                      "max_features": ["sqrt", "log2", None]},
    "svm": {"C": [0.1, 1, 10, 100], "kernel": ["linear", "rbf", "poly"],
            "gamma": ["scale", "auto", 0.001, 0.01, 0.1], "class_weight": [None, "balanced"]},
    "logistic_regression": {"C": [0.1, 1, 10, 100], "penalty": ["l1", "l2", "elasticnet"],
                            "solver": ["liblinear", "saga", "lbfgs"], "max_iter": [100, 500, 1000]},
}


def tune_param_grid(spark, model_type: str, *, max_combinations: int = 50, seed: int = 42) -> DataFrame:
    """Cartesian grid (>5 values thinned to 5 evenly spaced), sampled to
    ``max_combinations`` by hash order. Rows: (combo_id, params JSON)."""
    space = SEARCH_SPACES.get(model_type, {})
    lists = {}
    for k, vals in space.items():
        if len(vals) > 5:
            idx = [round(i * (len(vals) - 1) / 4) for i in range(5)]
            vals = [vals[i] for i in idx]
        lists[k] = vals
    combos = [json.dumps(dict(zip(lists, c))) for c in itertools.product(*lists.values())]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(combos)], "combo_id int, params string")
    if len(combos) > max_combinations:
        df = df.orderBy(F.xxhash64("params", F.lit(seed))).limit(max_combinations)
    return df


def spark_params(model_type: str, p: dict) -> dict:
    """Map a sklearn-style parameter set onto the Spark estimator's."""
    if model_type == "random_forest":
        return {"numTrees": p.get("n_estimators", 100), "maxDepth": min(p.get("max_depth") or 30, 30),
                "minInstancesPerNode": p.get("min_samples_leaf", 1),
                "featureSubsetStrategy": {"sqrt": "sqrt", "log2": "log2", None: "all"}[p.get("max_features", "sqrt")]}
    if model_type == "logistic_regression":
        return {"C": p.get("C", 1.0), "maxIter": p.get("max_iter", 1000)}
    if model_type == "svm":
        if p.get("kernel", "linear") != "linear":
            raise ValueError(f"no such SVM kernel here: {p['kernel']!r}")
        return {"regParam": 1.0 / max(p.get("C", 1.0), 1e-9)}
    return {}


def tune_cross_validate(prepared: DataFrame, model_type: str, grid: list[dict], *, folds: int = 3,
                        parallelism: int = 4, seed: int = 42) -> DataFrame:
    """k-fold CV accuracy for each parameter set on an already vectorised
    (features, label) table; one row per set, best first."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    prepared = materialize(prepared.select("features", "label"))  # read by every fold and setting
    n = prepared.count()
    est = make_classifier(model_type if model_type != "svm" else "linear_svm", n_train=n, seed=seed)
    builder = ParamGridBuilder()
    maps = []
    for g in grid:
        sp = spark_params(model_type, g)
        pm = {}
        for k, v in sp.items():
            if k == "C":
                pm[est.regParam] = 1.0 / (v * n)
            elif est.hasParam(k):
                pm[est.getParam(k)] = v
            elif model_type == "svm":  # the parameter of the two-class machine inside one-vs-rest
                inner = est.getClassifier().copy()
                pm[est.classifier] = inner.copy({inner.getParam(k): v})
        maps.append(pm)
    del builder
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, numFolds=folds, parallelism=parallelism, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"))
    model = cv.fit(prepared)
    rows = [(i, json.dumps(grid[i]), float(m)) for i, m in enumerate(model.avgMetrics)]
    return prepared.sparkSession.createDataFrame(rows, "combo_id int, params string, cv_accuracy double") \
        .orderBy(F.desc("cv_accuracy"))


def join_pareto_dominance(trials: DataFrame, objectives: list[str], *, id_col: str = "trial") -> DataFrame:
    """Non-dominated rows (all objectives maximised), see ``skyline``."""
    from ticketscope.operators.skyline import skyline
    return skyline(trials, objectives, id_col=id_col)


def tune_pareto(front: DataFrame, objectives: list[str], weights=(0.5, 0.3, 0.2), *, id_col: str = "trial") -> DataFrame:
    """Weighted-sum pick among Pareto solutions (ties by id)."""
    score = sum(F.col(o) * w for o, w in zip(objectives, weights))
    f = front.withColumn("weighted_score", score)
    return f.orderBy(F.desc("weighted_score"), id_col).limit(1)


def tune_best(history: DataFrame) -> DataFrame:
    """Best parameters per model type (highest score, ties by earliest run)."""
    w = Window.partitionBy("model_type").orderBy(F.desc("score"), "ts")
    return history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def tune_compare(history: DataFrame) -> DataFrame:
    return history.groupBy("model_type", "method").agg(F.max("score").alias("best_score"),
                                                      F.count("*").alias("n_trials"),
                                                      F.max("ts").alias("ts")).orderBy("model_type", "method")
