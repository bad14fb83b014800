"""Explanations: global TF-IDF feature importance, specificity, bias parity,
class lexicon, counterfactual candidates and local surrogates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.operators.features import txt_tfidf

# Default sensitive attribute keyword sets.
SENSITIVE_ATTRIBUTES = {
    "gender": ["he", "she", "his", "her", "him", "male", "female", "man", "woman"],
    "age": ["young", "old", "elderly", "teen", "adult", "senior"],
    "urgency": ["urgent", "asap", "immediately", "emergency", "critical"],
}


def ex_global_features(df: DataFrame, *, id_col: str, text_col: str, label_col: str, per_doc: int = 20,
                       per_class: int = 15, max_features: int = 1000) -> DataFrame:
    """Per class and term over each document's top-20 TF-IDF terms: mean, max,
    frequency, population std; top 15 per class by mean x frequency."""
    tf = txt_tfidf(df, id_col=id_col, text_col=text_col, max_features=max_features, min_df=2, max_df=0.95)
    top = tf.where(F.col("tfidf") > 0).withColumn("_r", F.row_number().over(
        Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), F.desc("term")))).where(F.col("_r") <= per_doc)
    lab = df.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    j = top.join(lab, "doc_id")
    g = j.groupBy("label", "term").agg(F.avg("tfidf").alias("mean_score"), F.max("tfidf").alias("max_score"),
                                       F.count("*").alias("frequency"), F.stddev_pop("tfidf").alias("std_score"))
    w = Window.partitionBy("label").orderBy(F.desc(F.col("mean_score") * F.col("frequency")), "term")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_class)


def ex_specificity(global_features: DataFrame) -> DataFrame:
    """Per term: max class mean / (sum of class means + 1e-10)."""
    return global_features.groupBy("term").agg(
        (F.max("mean_score") / (F.sum("mean_score") + 1e-10)).alias("specificity"))


def ex_bias_parity(df: DataFrame, *, text_col: str, label_col: str, attributes: dict | None = None) -> DataFrame:
    """Per attribute and class: share with vs without the attribute keywords
    (substring match), difference, and the attribute's max |difference|."""
    attributes = attributes or SENSITIVE_ATTRIBUTES
    lo = F.lower(F.col(text_col))
    flags = F.array(*[F.struct(F.lit(a).alias("attribute"),
                               F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: F.contains(lo, k)).alias("has"))
                      for a, kws in attributes.items()])
    long = df.select(F.col(label_col).alias("label"), F.explode(flags).alias("f")).select("label", "f.*")
    c = long.groupBy("attribute", "label").agg(F.count_if("has").alias("n_with"), F.count_if(~F.col("has")).alias("n_without"))
    w = Window.partitionBy("attribute")
    c = c.withColumn("tot_with", F.sum("n_with").over(w)).withColumn("tot_without", F.sum("n_without").over(w))
    c = c.where((F.col("tot_with") > 0) & (F.col("tot_without") > 0))
    c = c.withColumn("share_with", F.col("n_with") / F.col("tot_with")) \
        .withColumn("share_without", F.col("n_without") / F.col("tot_without")) \
        .withColumn("bias_score", F.col("share_with") - F.col("share_without"))
    c = c.withColumn("max_bias", F.max(F.abs("bias_score")).over(w))
    return c.withColumn("biased", F.abs("bias_score") > 0.1)


def ex_bias_pivot(bias: DataFrame, attributes: Iterable[str] | None = None) -> DataFrame:
    """class x attribute matrix of bias scores, over the attributes that the
    caller gave to ``ex_bias_parity`` (the default ones without); 0 where an
    attribute has no score."""
    attrs = list(SENSITIVE_ATTRIBUTES if attributes is None else attributes)
    return bias.groupBy("label").pivot("attribute", attrs).agg(F.first("bias_score")).na.fill(0.0)


# Class keyword and phrase lexicon used for counterfactuals.
CLASS_LEXICON = {
    "Billing": (["payment", "charge", "invoice", "refund", "subscription", "fee", "cost", "price"],
                ["I was charged incorrectly", "billing issue", "payment problem"]),
    "Technical Issue": (["error", "bug", "crash", "broken", "not working", "issue", "problem", "fix"],
                        ["this is not working", "I found a bug", "system error"]),
    "Feature Request": (["feature", "suggest", "enhancement", "improvement", "add", "new", "would like"],
                        ["it would be great if", "can you add", "feature suggestion"]),
    "Account Management": (["account", "login", "password", "profile", "settings", "access", "register"],
                           ["I cannot login", "password reset", "account settings"]),
    "Product Information": (["information", "details", "specifications", "about", "how", "what", "explain"],
                            ["I need more information", "can you explain", "how does this work"]),
    "Refund & Return": (["refund", "return", "cancel", "money back", "reverse", "undo", "revert"],
                        ["I want a refund", "return this item", "cancel my order"]),
    "General Inquiry": (["question", "help", "support", "assistance", "inquiry", "ask", "wondering"],
                        ["I have a question", "need help with", "general support"]),
}


def ex_class_lexicon(spark) -> DataFrame:
    rows = [(c, "keyword", i + 1, t) for c, (kw, _) in CLASS_LEXICON.items() for i, t in enumerate(kw)]
    rows += [(c, "phrase", i + 1, t) for c, (_, ph) in CLASS_LEXICON.items() for i, t in enumerate(ph)]
    return spark.createDataFrame(rows, "class string, kind string, rank int, term string")


def join_counterfactual_cand(df: DataFrame, lexicon: DataFrame, *, id_col: str, text_col: str, target_col: str,
                             top_keywords: int = 5, texts: bool = True) -> DataFrame:
    """Candidate rewrites: every word replaced by each of the target class's top
    keywords, plus each target phrase appended. ``pos`` (null for phrases) and
    ``term_rank`` give their order, ``length`` the rewritten text's characters.

    ``texts=True`` also builds each rewritten text (``candidate``), which grows
    with the square of a text; without it a candidate is its word and term, and
    ``counterfactual.changed_text`` builds the few texts that are wanted.
    """
    n = F.length(F.col(text_col))
    carried = [id_col, target_col, n.alias("_n"), *([text_col] if texts else [])]
    terms = F.broadcast(lexicon.select(F.col("class").alias(target_col), "kind", F.col("term"),
                                       F.col("rank").alias("term_rank")))  # lexicon: config-sized
    rep = (df.select(*carried, F.posexplode(F.split(F.col(text_col), " ")).alias("pos", "replaced"))
           .join(terms.where((F.col("kind") == "keyword") & (F.col("term_rank") <= top_keywords)), target_col))
    add = df.select(*carried).join(terms.where(F.col("kind") == "phrase"), target_col)
    out = [F.col(id_col), F.col(target_col)]

    def text(c):
        return [c.alias("candidate")] if texts else []

    swapped = F.array_join(F.transform(F.split(F.col(text_col), " "),
                                       lambda x, i: F.when(i == F.col("pos"), F.col("term")).otherwise(x)), " ")
    return rep.select(*out, F.lit("word_replacement").alias("change_type"), *text(swapped), "pos", "term_rank", "replaced",
                      "term", (F.col("_n") - F.length("replaced") + F.length("term")).alias("length")).unionByName(
        add.select(*out, F.lit("phrase_addition").alias("change_type"), *text(F.concat_ws(" ", F.col(text_col), F.col("term"))),
                   F.lit(None).cast("int").alias("pos"), "term_rank", F.lit(None).cast("string").alias("replaced"), "term",
                   (F.col("_n") + 1 + F.length("term")).alias("length")))


def ex_counterfactual(candidates: DataFrame, model, *, id_col: str, target_col: str, max_out: int = 5,
                      max_replacements: int = 3) -> DataFrame:
    """Score all candidates with one ``model.transform`` (any model; for linear text
    models ``counterfactual.ex_counterfactual_linear`` needs no rewritten texts);
    keep those predicted as the target class: per text the first ``max_replacements`` word replacements
    (by position, then keyword) and every phrase, at most ``max_out`` (highest
    confidence first)."""
    scored = model.transform(candidates)
    hit = scored.where(F.col("predicted_category") == F.col(target_col))
    first = Window.partitionBy(id_col, "change_type").orderBy("pos", "term_rank", "candidate")
    hit = hit.withColumn("_r", F.row_number().over(first)).where(
        (F.col("change_type") != "word_replacement") | (F.col("_r") <= max_replacements)).drop("_r")
    w = Window.partitionBy(id_col).orderBy(F.desc("confidence"), "candidate")
    return hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_out).drop("_r")


def ex_local_surrogate(df: DataFrame, predict_tokens, *, id_col: str, tokens_col: str, n_samples: int = 500,
                       top_k: int = 10, seed: int = 42) -> DataFrame:
    """Local linear explanation per document (LIME-style), as a batch job.

    Features are the document's distinct words. Perturbation ``s`` drops
    every occurrence of a word when ``xxhash64(doc, s, word)`` is odd
    (sample 1 keeps everything). ``predict_tokens`` is the model: a function
    (DataFrame with ``toks_kept`` -> DataFrame with ``p``), to which the kept
    token array of each sample goes straight, or a ``counterfactual.LinearText``,
    whose scores come from the masks alone (``surrogate.linear_surrogate``,
    rows with the same id being explained each by its own text). A weighted
    least-squares fit per document runs in a task on an (n_samples x distinct
    words) matrix: bounded by the sample count and one document's vocabulary.
    """
    import numpy as np
    import pandas as pd

    from ticketscope.operators.counterfactual import LinearText
    from ticketscope.operators.surrogate import linear_surrogate, surrogate_weights

    if isinstance(predict_tokens, LinearText):
        return linear_surrogate(df, predict_tokens, id_col=id_col, tokens_col=tokens_col, n_samples=n_samples, top_k=top_k,
                                seed=seed)
    base = df.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("toks"))
    base = base.withColumn("words", F.array_distinct("toks"))
    s = base.select("doc_id", "toks", "words", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"))

    def keep(w):
        return (F.col("sample") == 1) | (F.pmod(F.xxhash64(F.col("doc_id"), F.col("sample"), w, F.lit(seed)), F.lit(2)) == 0)

    s = s.withColumn("mask", F.transform("words", keep)).withColumn("toks_kept", F.filter("toks", keep))
    scored = predict_tokens(s.drop("toks"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.array([np.asarray(m, dtype=float) for m in pdf["mask"]])
        if X.ndim != 2 or X.shape[1] == 0:
            return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "pos": pd.Series([], dtype="int32"),
                                 "weight": pd.Series([], dtype="float64")})
        coef = surrogate_weights(X, pdf["p"].to_numpy(dtype=float))
        order = np.argsort(-np.abs(coef), kind="stable")[:top_k]
        return pd.DataFrame({"doc_id": np.full(len(order), pdf["doc_id"].iloc[0], dtype="int64"),
                             "pos": order.astype("int32"), "weight": coef[order].astype("float64")})

    fitted = scored.select("doc_id", "mask", "p").groupBy("doc_id").applyInPandas(
        fit, "doc_id long, pos int, weight double")
    # words travel once per document, joined back by position
    return fitted.join(base.select("doc_id", "words"), "doc_id").select(
        "doc_id", F.element_at("words", F.col("pos") + 1).alias("word"), "weight")
