"""Vectorisation and feature extraction.

Vocabularies are built with a distributed ``groupBy`` over the n-grams counted
in slices of documents (``grams``) and cut to ``max_features`` (a proven size
bound), so the term -> index table may be broadcast. Documents are scored as
sparse rows, given in long form ``(doc, term, weight)``; model inputs get sparse
vectors from Spark ML's ``CountVectorizer`` (JVM side, never densified).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.functions.text import (EMAIL_RE, PUNCT_RE, TOKEN2_RE, WORD_RE, default_stopwords, fn_contains_any,
                                        fn_count_contained, fn_regex_count, fn_substring_count,
                                        txt_clean_light, words)
from ticketscope.operators.grams import MOST_KNOWN, by_document, count_grams, term_rows
from ticketscope.session import materialize

# Domain pattern groups of the feature engineer.
URGENCY_WORDS = ["urgent", "asap", "immediately", "critical", "emergency"]
EMOTION_WORDS = ["frustrated", "angry", "disappointed", "pleased", "satisfied"]
ACTION_WORDS = ["refund", "cancel", "fix", "resolve", "help", "support"]
TECHNICAL_WORDS = ["error", "bug", "issue", "problem", "failure", "crash"]
GREETING_PATTERNS = [r"\b(hi|hello|dear|greetings)\b", r"\bthank you\b"]
QUESTION_PATTERNS = [r"\?", r"\bhow\b", r"\bwhat\b", r"\bwhen\b", r"\bwhere\b", r"\bwhy\b"]
TIME_PATTERNS = [r"\b\d{1,2}:\d{2}\b", r"\b(today|tomorrow|yesterday)\b",
                 r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"]
POLITE_WORDS = ["please", "help", "support"]
NEGATION_RE = r"\b(can't|cannot|won't|doesn't|isn't)\b"
SHOUT_RE = r"\ball caps\b|[A-Z]{10,}"
MONEY_RE = r"\$\d+\.?\d*"
POSITIVE_WORDS = ["good", "great", "excellent", "satisfied", "happy", "pleased"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "frustrated", "angry", "disappointed"]
# Keras tokenizer default filter characters.
KERAS_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"


def _stop_list(stopwords) -> list[str]:
    return list(stopwords if stopwords is not None else default_stopwords())


def tokens_expr(text: Column, *, stopwords=None, token_re=TOKEN2_RE) -> Column:
    """sklearn-style tokens: lower, ``\\w\\w+`` runs, stop words out."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(token_re), 0)
    if stopwords is not False:
        stop = _stop_list(stopwords)
        # isin over > 10 literals is planned as a hash-set lookup (InSet)
        toks = F.filter(toks, lambda t: ~t.isin(stop))
    return toks


def ngrams_expr(toks: Column, ngram_range=(1, 2)) -> Column:
    """n-grams of an ALREADY MATERIALISED token column (a column reference,
    so the lambdas do not re-run the tokenizer per element). Built with
    ``zip_with`` over shifted slices: one pass per n, no per-gram slice copy."""
    parts = []
    lo, hi = ngram_range
    size = F.size(toks)
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(toks)
            continue
        length = F.greatest(size - (n - 1), F.lit(0))
        grams = F.slice(toks, 1, length)
        for k in range(1, n):
            shifted = F.slice(toks, 1 + k, length)
            grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(F.when(size >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def documents_tokens(df: DataFrame, *, id_col: str, text_col: str, stopwords=None, token_re=TOKEN2_RE) -> DataFrame:
    """(doc_id, toks) as ``grams.by_document`` gives them; a null text has no token."""
    return by_document(df, id_col=id_col, text_col=text_col, tokens=tokens_expr(F.col("t"), stopwords=stopwords, token_re=token_re))


def fit_vocabulary(docs: DataFrame, *, ngram_range=(1, 2), max_features: int | None = 10000, min_df=1, max_df=1.0,
                   n_docs: int | None = None) -> DataFrame:
    """(term, df, total, index) of ``documents_tokens`` rows: df pruning, then top
    ``max_features`` by corpus count (ties by term), indexed alphabetically like
    sklearn's vocabulary_.

    Words are counted first. The last of the ``max_features`` most frequent words
    that pass the pruning bounds the count of what the vocabulary takes from
    below, so longer n-grams are counted only where all their words reach it.
    """
    if max_features is None:
        raise ValueError("fit_vocabulary needs max_features: the term index is a bounded broadcast table")
    lo, hi = ngram_range
    least, fits = 1, F.lit(True)
    if n_docs is not None:
        least = min_df if isinstance(min_df, int) else math.ceil(n_docs * min_df)
        fits = (F.col("df") >= least) & (F.col("df") <= (max_df if isinstance(max_df, int) else math.floor(n_docs * max_df)))

    def top(counts: DataFrame) -> DataFrame:
        return counts.where(fits).orderBy(F.desc("total"), "term").limit(max_features)

    if hi == 1:
        v = top(count_grams(docs, 1, 1))
    else:
        words = materialize(count_grams(docs, 1, 1))
        known = None
        if lo == 1:
            n, last = top(words).agg(F.count("*"), F.min("total")).first()
            frequent = words.where((F.col("total") >= (last if n == max_features else 1)) & (F.col("df") >= least)).select("term")
            # a word more than the bound: nothing is left out then
            some = [r["term"] for r in frequent.limit(MOST_KNOWN + 1).collect()]
            known = some if len(some) <= MOST_KNOWN else None
        longer = top(count_grams(docs, max(2, lo), hi, known))
        v = top(top(words).unionByName(longer)) if lo == 1 else longer
    # at most max_features rows are collected and numbered
    rows = sorted(tuple(r) for r in v.select("term", "df", "total").collect())
    return docs.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], "term string, df long, total long, index int")


def vocabulary_rows(docs: DataFrame, vocabulary: DataFrame, weight_col: str | None = None) -> DataFrame:
    """``grams.term_rows`` of a fitted vocabulary (term, index and the weight's column)."""
    rows = vocabulary.orderBy("index").collect()  # at most max_features rows
    return term_rows(docs, [r["term"] for r in rows], [r["index"] for r in rows], [r[weight_col] for r in rows] if weight_col else None)


def _long_rows(rows: DataFrame, vocabulary: DataFrame, value: str, out: str) -> DataFrame:
    """(doc_id, term, index, ``out``) from rows of index and value arrays."""
    long = rows.select("doc_id", F.explode(F.arrays_zip("idx", value)).alias("e")).select(
        "doc_id", F.col("e.idx").alias("index"), F.col(f"e.{value}").alias(out))
    # vocab has at most max_features rows: a fixed bound, safe to broadcast
    return long.join(F.broadcast(vocabulary.select("index", "term")), "index").select("doc_id", "term", "index", out)


def smooth_idf(n: int) -> Column:
    return F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1


def txt_tfidf(df: DataFrame, *, id_col: str, text_col: str, max_features: int = 10000,
              ngram_range=(1, 2), stopwords=None, min_df=1, max_df=1.0, norm: bool = True,
              fallback: dict | None = None) -> DataFrame:
    """Long-form TF-IDF: (doc_id, term, index, tfidf).

    idf = ln((1 + n) / (1 + df)) + 1 (smooth), raw counts, L2 rows. If pruning
    leaves no term, ``fallback`` (other arguments of this function) is used.
    """
    docs = documents_tokens(df, id_col=id_col, text_col=text_col, stopwords=stopwords)
    n = df.count()
    vocab = fit_vocabulary(docs, ngram_range=ngram_range, max_features=max_features, min_df=min_df, max_df=max_df, n_docs=n)
    if fallback is not None and vocab.isEmpty():
        return txt_tfidf(df, id_col=id_col, text_col=text_col, norm=norm, **fallback)
    vocab = vocab.select("term", "index", smooth_idf(n).alias("idf"))
    if norm:
        return _long_rows(vocabulary_rows(docs, vocab, "idf"), vocab, "val", "tfidf")
    long = _long_rows(vocabulary_rows(docs, vocab), vocab, "tf", "tf")
    return long.join(F.broadcast(vocab.select("index", "idf")), "index").select(
        "doc_id", "term", "index", (F.col("tf") * F.col("idf")).alias("tfidf"))


def txt_counts(df: DataFrame, *, id_col: str, text_col: str, max_features: int = 5000, min_df=2,
               max_df=0.95, ngram_range=(1, 3)) -> DataFrame:
    """Raw counts over a pruned vocabulary: (doc_id, term, index, count).

    If pruning leaves no term, the fallback vocabulary is <= 1,000 single words,
    unpruned, stop words kept.
    """
    docs = documents_tokens(df, id_col=id_col, text_col=text_col)
    vocab = fit_vocabulary(docs, ngram_range=ngram_range, max_features=max_features, min_df=min_df, max_df=max_df, n_docs=df.count())
    if vocab.isEmpty():
        docs = documents_tokens(df, id_col=id_col, text_col=text_col, stopwords=False)
        vocab = fit_vocabulary(docs, ngram_range=(1, 1), max_features=1000)
    return _long_rows(vocabulary_rows(docs, vocab), vocab, "tf", "count")


def keras_vocabulary(df: DataFrame, *, id_col: str, text_col: str, num_words: int) -> tuple[DataFrame, DataFrame]:
    """All tokens of the whole texts (doc_id, pos, word), and the index of the most
    frequent words (word, idx from 2 on; ties by word)."""
    filt = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in KERAS_FILTERS) + "]"
    toks = F.filter(F.split(F.regexp_replace(F.lower(F.col(text_col)), filt, " "), " "), lambda x: x != "")
    pos = df.repartition(F.col(id_col)).select(F.col(id_col).alias("doc_id"), F.posexplode(toks).alias("pos", "word"))
    counts = pos.groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(num_words - 2)
    return pos, top.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 1).alias("idx"))


def join_vocab_lookup(df: DataFrame, *, id_col: str, text_col: str, num_words: int = 10000) -> DataFrame:
    """Per document: tokens of the whole text, and those outside the vocabulary.

    Tokens are counted per word before they meet the vocabulary.
    """
    pos, vocab = keras_vocabulary(df, id_col=id_col, text_col=text_col, num_words=num_words)
    per_word = pos.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    # the vocabulary has at most num_words rows: bounded, broadcast
    hit = per_word.join(F.broadcast(vocab), "word", "left")
    c = hit.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("idx").isNull(), F.col("n")).otherwise(0)).alias("oov_tokens"))
    docs = df.select(F.col(id_col).alias("doc_id"))
    return docs.join(c, "doc_id", "left").na.fill(0, ["tokens", "oov_tokens"])


def txt_token_sequence(df: DataFrame, *, id_col: str, text_col: str, num_words: int = 10000,
                       max_len: int = 100) -> DataFrame:
    """Keras-style integer sequences: index by frequency (ties by word),
    OOV = 1, post-padded / post-truncated to ``max_len``.

    The vocabulary is counted over whole texts; only the first ``max_len``
    tokens of a text are encoded, which is exactly what post-truncation keeps.
    """
    pos, vocab = keras_vocabulary(df, id_col=id_col, text_col=text_col, num_words=num_words)
    head = pos.where(F.col("pos") < max_len)
    enc = head.join(F.broadcast(vocab), "word", "left").select(
        "doc_id", "pos", F.coalesce("idx", F.lit(1)).alias("idx"))
    seq = enc.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))),
                                                lambda s: s["idx"]).alias("s"))
    padded = F.slice(F.concat(F.col("s"), F.array_repeat(F.lit(0), max_len)), 1, max_len)
    docs = df.select(F.col(id_col).alias("doc_id"))
    return docs.join(seq, "doc_id", "left").select(
        "doc_id", F.coalesce(padded, F.array_repeat(F.lit(0), max_len)).alias("sequence"))


def txt_label_encode(df: DataFrame, label_col: str = "category", out: str = "label") -> DataFrame:
    """Alphabetical label index (StringIndexer alphabetAsc)."""
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol=label_col, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int"))


def txt_label_decode(df: DataFrame, labels: list[str], col: str = "label", out: str = "category") -> DataFrame:
    from pyspark.ml.feature import IndexToString
    return IndexToString(inputCol=col, outputCol=out, labels=labels).transform(df.withColumn(col, F.col(col).cast("double")))


def txt_stratified_split(df: DataFrame, *, id_col: str, label_col: str, test: float = 0.2,
                         val: float = 0.1, seed: int = 42) -> DataFrame:
    """Exact per-class proportions, reproducible: rank rows inside each class by
    md5(id:seed); the first round(test*n) are test, the next round(val*n) validation."""
    from ticketscope.operators.drift import running_totals
    key = F.struct(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col))
    df = df.where(F.col(label_col).isNotNull())  # a row without a class is in no part of the split
    n = df.groupBy(label_col).agg(F.count("*").alias("_n"))
    # exact rank inside each class without a per-class ordered window
    x = running_totals(df.withColumn("_ok", key).withColumn("_one", F.lit(1.0)), key=label_col, order="_ok",
                       cols=["_one"]).withColumnRenamed("rank", "_rn").drop("_ok", "_one", "cum__one")
    x = x.join(n, label_col)  # one row per class
    n_test = F.floor(F.col("_n") * test + 0.5)
    n_val = F.floor(F.col("_n") * val + 0.5)
    split = (F.when(F.col("_rn") <= n_test, F.lit("test"))
             .when(F.col("_rn") <= n_test + n_val, F.lit("val")).otherwise(F.lit("train")))
    return x.withColumn("split", split).drop("_rn", "_n")


# --------------------------------------------------------- text features

STAT_FEATURES = ["char_count", "word_count", "sentence_count", "upper_count", "digit_count",
                 "punct_count", "question_count", "exclaim_count", "acronym_count", "url_count",
                 "email_count", "avg_word_length", "words_per_sentence"]


def ft_statistical(df: DataFrame, text_col: str = "text") -> DataFrame:
    """13 text statistics. URL / e-mail counts use the raw text (quirk 2), the
    rest the lightly cleaned text."""
    df = df.withColumn("_t", txt_clean_light(F.col(text_col)))
    raw = F.col(text_col)
    t = F.col("_t")
    df = df.withColumn("_w", words(t))
    w = F.col("_w")
    nw = F.size(w)
    sent = fn_regex_count(t, r"[.!?]+")
    tokens = F.regexp_extract_all(t, F.lit(WORD_RE), 0)
    acr = F.size(F.filter(tokens, lambda x: x.rlike(r"^[A-Z]{2,}$")))
    avg_len = F.when(nw > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / nw).otherwise(F.lit(0.0))
    wps = F.when((sent > 0) & (nw > 0), nw / sent).otherwise(F.lit(0.0))
    cols = [F.length(t), nw, sent, fn_regex_count(t, "[A-Z]"), fn_regex_count(t, "[0-9]"),
            fn_regex_count(t, PUNCT_RE), fn_substring_count(t, "?"), fn_substring_count(t, "!"), acr,
            fn_regex_count(raw, r"http[s]?://\S+"), fn_regex_count(raw, EMAIL_RE), avg_len, wps]
    return df.select("*", *[c.cast("double").alias(n) for c, n in zip(cols, STAT_FEATURES)]).drop("_t", "_w")


DOMAIN_FEATURES = ["urgency_words", "emotion_words", "action_words", "technical_words", "greeting_patterns",
                   "question_patterns", "time_patterns", "politeness", "negation", "multi_exclaim",
                   "shouting", "money_mentions"]


def ft_domain(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Pattern-group counts; regex groups use regex semantics (quirk 1)."""
    df = df.withColumn("_t", txt_clean_light(F.col(text_col))).withColumn("_lo", F.lower("_t"))
    t, lo = F.col("_t"), F.col("_lo")

    def n_match(patterns):
        out = F.lit(0)
        for p in patterns:
            out = out + lo.rlike(p).cast("int")
        return out

    cols = [fn_count_contained(lo, URGENCY_WORDS), fn_count_contained(lo, EMOTION_WORDS),
            fn_count_contained(lo, ACTION_WORDS), fn_count_contained(lo, TECHNICAL_WORDS),
            n_match(GREETING_PATTERNS), n_match(QUESTION_PATTERNS), n_match(TIME_PATTERNS),
            fn_contains_any(lo, POLITE_WORDS).cast("int"), lo.rlike(NEGATION_RE).cast("int"),
            fn_regex_count(t, "[!]{2,}"), t.rlike(SHOUT_RE).cast("int"), fn_regex_count(t, MONEY_RE)]
    return df.select("*", *[c.cast("double").alias(n) for c, n in zip(cols, DOMAIN_FEATURES)]).drop("_t", "_lo")


def ft_sentiment_lexicon(df: DataFrame, text_col: str = "text") -> DataFrame:
    df = df.withColumn("_lo", F.lower(txt_clean_light(F.col(text_col))))
    lo = F.col("_lo")
    pos = fn_count_contained(lo, POSITIVE_WORDS)
    neg = fn_count_contained(lo, NEGATIVE_WORDS)
    score = F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(F.lit(0.0))
    return df.select("*", score.alias("sentiment_score"), pos.cast("double").alias("positive_count"),
                     F.lit(0.0).alias("neutral_count"), neg.cast("double").alias("negative_count")).drop("_lo")


def ft_category_keywords(df: DataFrame, *, text_col: str, label_col: str, top: int = 20,
                         stopwords=None) -> DataFrame:
    """Per category: the 20 most common ``\\b\\w+\\b`` words, then drop <= 2 chars and stop words."""
    w = df.select(label_col, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_RE), 0)).alias("word"))
    c = w.groupBy(label_col, "word").agg(F.count("*").alias("count"))
    ranked = c.withColumn("rank", F.row_number().over(
        Window.partitionBy(label_col).orderBy(F.desc("count"), "word"))).where(F.col("rank") <= top)
    return ranked.where((F.length("word") > 2) & ~F.col("word").isin(_stop_list(stopwords)))


def ft_assemble_scale(df: DataFrame, features: list[str], *, out: str = "features") -> DataFrame:
    """Standardise each feature with its mean and POPULATION std (std 0 -> 1),
    then ``VectorAssembler``. Statistics come from one aggregate, inlined as
    scalar subqueries (no join)."""
    from pyspark.ml.feature import VectorAssembler
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    scaled = []
    for c in features:
        m = stats.select(f"m_{c}").scalar()
        s = stats.select(F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}"))).scalar()
        scaled.append(((F.col(c) - m) / s).alias(f"z_{c}"))
    z = df.select("*", *scaled)
    return VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol=out).transform(z)


def ft_catalog(groups: dict[str, list[str]], spark, n: int | None = None) -> DataFrame:
    """Feature name -> group listing (first n per group)."""
    rows = [(g, i, name) for g, names in groups.items() for i, name in enumerate(names) if n is None or i < n]
    return spark.createDataFrame(rows, "feature_group string, position int, feature string")


def ft_topics(counts_vec: DataFrame, *, k: int = 20, max_iter: int = 20, seed: int = 42,
              features_col: str = "features") -> DataFrame:
    """Online LDA (20 topics, 20 iterations, learning offset 50); per-doc topic mix."""
    from pyspark.ml.clustering import LDA
    lda = LDA(k=k, maxIter=max_iter, optimizer="online", learningOffset=50.0, seed=seed,
              featuresCol=features_col, topicDistributionCol="topic_distribution")
    return lda.fit(counts_vec).transform(counts_vec)


def ft_pca(vec: DataFrame, *, k: int = 100, features_col: str = "features", out: str = "pca") -> DataFrame:
    """PCA coordinates of mean-centred vectors.

    Spark's components already belong to the centred covariance, but its
    transform does not centre: the mean's own coordinates are subtracted
    afterwards, so sparse vectors stay sparse. (``sparse_pca`` also bounds the
    driver's work for thousands of terms.)
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    mean = vec.agg(Summarizer.mean(F.col(features_col)).alias("m")).first()["m"]  # one row
    model = PCA(k=min(k, len(mean)), inputCol=features_col, outputCol=out).fit(vec)
    shift = F.array(*[F.lit(float(x)) for x in mean.toArray() @ model.pc.toArray()])
    return model.transform(vec).withColumn(out, array_to_vector(F.zip_with(vector_to_array(out), shift, lambda a, b: a - b)))


def strip_accents(c: Column) -> Column:
    """Map accented Latin letters to their base letter (NFKD, combining marks
    dropped), built by rule from ``unicodedata`` for U+00C0..U+024F."""
    import unicodedata
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return F.translate(c, "".join(src), "".join(dst))


def txt_tfidf_pruned(df: DataFrame, *, id_col: str, text_col: str, max_features: int = 10000,
                     ngram_range=(1, 3), min_df=2, max_df=0.95) -> DataFrame:
    """Light-cleaned, accent-stripped TF-IDF with document-frequency pruning
    (min_df 1 when there are <= 5 documents); if pruning leaves no term, the
    fallback vocabulary is <= 1000 uni/bigrams, unpruned, stop words kept."""
    t = df.select(F.col(id_col), strip_accents(txt_clean_light(F.col(text_col))).alias("_t"))
    lo = 1 if df.count() <= 5 else min_df
    return txt_tfidf(t, id_col=id_col, text_col="_t", max_features=max_features, ngram_range=ngram_range,
                     min_df=lo, max_df=max_df, fallback={"max_features": 1000, "ngram_range": (1, 2), "stopwords": False})
