"""Text cleaning, vectorisation and text-feature queries over v_tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.functions import text as T
from ticketscope.operators import features as FE
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"


def rcount(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


def sq_squeeze(expr: str) -> str:
    return f"trim({rx(expr, T.WS_RE, ' ')}, ' ')"


def sq_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(T.WS_RE)}), lambda x: x <> '')"


def sq_clean(expr: str) -> str:
    t = f"lower(coalesce(CAST({expr} AS VARCHAR), ''))"
    t = rx(rx(rx(rx(t, T.URL_RE), T.EMAIL_RE), T.PHONE_RE), T.NON_LETTER_RE)
    return sq_squeeze(t)


def sq_light(expr: str) -> str:
    return rx(rx(sq_squeeze(expr), T.LIGHT_URL_RE), T.EMAIL_RE)


def sq_contained(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {lit(w)}) AS INTEGER)" for w in words) + ")"


STOP_SQL = "[" + ", ".join(lit(w) for w in T.default_stopwords()) + "]"


def _tk(s, sf):
    return spark_view(s, sf, "v_tickets")


def _clean(s, sf):
    return _tk(s, sf).select("ticket_id", "category", T.txt_clean("customer_message").alias("clean"))


CLEAN_SQL = f"clean AS (SELECT ticket_id, category, {sq_clean('customer_message')} AS clean FROM v_tickets)"

reg("txt_clean", _clean, f"WITH {CLEAN_SQL} SELECT * FROM clean", ["v_tickets"])
reg("fn_lower_strip", lambda s, sf: _tk(s, sf).select("ticket_id", T.fn_lower_strip("customer_message").alias("t")),
    f"SELECT ticket_id, {sq_squeeze('lower(customer_message)')} AS t FROM v_tickets", ["v_tickets"])
for name, fn, pat in [("fn_strip_urls", T.fn_strip_urls, T.URL_RE), ("fn_strip_emails", T.fn_strip_emails, T.EMAIL_RE),
                      ("fn_strip_phones", T.fn_strip_phones, T.PHONE_RE),
                      ("fn_letters_only", T.fn_letters_only, T.NON_LETTER_RE)]:
    reg(name, (lambda f: lambda s, sf: _tk(s, sf).select(
        "ticket_id", F.length(f("customer_message")).alias("len_after")))(fn),
        f"SELECT ticket_id, length({rx('customer_message', pat)}) AS len_after FROM v_tickets", ["v_tickets"])

reg("txt_stopwords",
    lambda s, sf: _clean(s, sf).select("ticket_id", T.txt_stopwords("clean").alias("t")),
    f"""WITH {CLEAN_SQL} SELECT ticket_id,
        array_to_string(list_filter({sq_words('clean')}, lambda w: NOT list_contains({STOP_SQL}, w)), ' ') AS t
        FROM clean""", ["v_tickets"])


def _preprocess(s, sf):
    from ticketscope.operators.textproc import txt_preprocess
    return txt_preprocess(_tk(s, sf), text_col="customer_message").select("ticket_id", "processed_text")


reg("txt_preprocess", _preprocess,
    f"""WITH {CLEAN_SQL} SELECT ticket_id,
        array_to_string(list_filter({sq_words('clean')}, lambda w: NOT list_contains({STOP_SQL}, w)), ' ')
          AS processed_text FROM clean""", ["v_tickets"])


def _lemma(s, sf):
    from ticketscope.operators.textproc import txt_lemma
    c = _clean(s, sf)
    lemmas = (c.select(F.explode(F.array_distinct(F.split("clean", " "))).alias("word")).distinct()
              .where(F.col("word").endswith("s") & (F.length("word") > 3))
              .select("word", F.expr("substring(word, 1, length(word) - 1)").alias("lemma")))
    return txt_lemma(c, "clean", lemmas, id_col="ticket_id").select("ticket_id", "lemmatized")


reg("txt_lemma", _lemma,
    f"""WITH {CLEAN_SQL},
    toks AS (SELECT ticket_id, unnest({sq_words('clean')}) AS w, generate_subscripts({sq_words('clean')}, 1) AS pos FROM clean)
    SELECT c.ticket_id, coalesce(string_agg(CASE WHEN w LIKE '%s' AND length(w) > 3 THEN substring(w, 1, length(w) - 1)
                                                 ELSE w END, ' ' ORDER BY pos), '') AS lemmatized
    FROM clean c LEFT JOIN toks USING (ticket_id) GROUP BY c.ticket_id""", ["v_tickets"])

reg("txt_clean_light", lambda s, sf: _tk(s, sf).select("ticket_id", T.txt_clean_light("customer_message").alias("t")),
    f"SELECT ticket_id, {sq_light('customer_message')} AS t FROM v_tickets", ["v_tickets"])

reg("fn_regex_count",
    lambda s, sf: _tk(s, sf).select("ticket_id", T.fn_regex_count("customer_message", "[.!?]+").alias("n")),
    f"SELECT ticket_id, {rcount('customer_message', '[.!?]+')} AS n FROM v_tickets", ["v_tickets"])
reg("fn_substring_count",
    lambda s, sf: _tk(s, sf).select("ticket_id", T.fn_substring_count("customer_message", "?").alias("q"),
                                    T.fn_substring_count("customer_message", "!").alias("e")),
    """SELECT ticket_id, CAST((length(customer_message) - length(replace(customer_message, '?', ''))) AS BIGINT) AS q,
              CAST((length(customer_message) - length(replace(customer_message, '!', ''))) AS BIGINT) AS e FROM v_tickets""",
    ["v_tickets"])
reg("fn_contains_any",
    lambda s, sf: _tk(s, sf).where(T.fn_contains_any(F.lower("customer_message"), FE.TECHNICAL_WORDS)).select("ticket_id"),
    "SELECT ticket_id FROM v_tickets WHERE " + " OR ".join(
        f"contains(lower(customer_message), {lit(w)})" for w in FE.TECHNICAL_WORDS), ["v_tickets"])


def _tfidf(s, sf):
    c = _clean(s, sf)
    return FE.txt_tfidf(c, id_col="ticket_id", text_col="clean", max_features=10000).select("doc_id", "term", "tfidf")


def tfidf_sql(max_features: int, ngrams: int = 2) -> str:
    toks = f"list_filter(regexp_extract_all(lower(clean), {lit(T.TOKEN2_RE)}), lambda t: NOT list_contains({STOP_SQL}, t))"
    grams = "toks" if ngrams == 1 else (
        "list_concat(toks, CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), "
        "lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END)")
    return f"""{CLEAN_SQL},
    tk AS (SELECT ticket_id, {toks} AS toks FROM clean),
    terms AS (SELECT ticket_id AS doc_id, unnest({grams}) AS term FROM tk),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT {max_features}),
    nd AS (SELECT count(*) AS n FROM v_tickets),
    w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1 + n) / (1 + vocab.df)) + 1) AS w FROM tf JOIN vocab USING (term), nd)"""


reg("txt_tfidf", _tfidf,
    f"WITH {tfidf_sql(10000)} SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w",
    ["v_tickets"], ["tfidf"])


#: One to three neighbouring tokens of ``toks``, joined by blanks.
GRAMS3_SQL = ("list_concat(toks, list_concat(list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1]), "
              "list_transform(range(1, greatest(len(toks) - 1, 1)), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])))")


def _counts(s, sf):
    c = _clean(s, sf)
    return FE.txt_counts(c, id_col="ticket_id", text_col="clean", max_features=5000, min_df=2, max_df=0.95,
                         ngram_range=(1, 3)).select("doc_id", "term", "count")


reg("txt_counts", _counts,
    f"""WITH {CLEAN_SQL},
    tk AS (SELECT ticket_id, list_filter(regexp_extract_all(lower(clean), {lit(T.TOKEN2_RE)}),
                                          lambda t: NOT list_contains({STOP_SQL}, t)) AS toks FROM clean),
    tf AS (SELECT ticket_id AS doc_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest({GRAMS3_SQL}) AS term FROM tk) GROUP BY 1, 2),
    nd AS (SELECT count(*) AS n FROM v_tickets),
    vocab AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1
              HAVING count(*) >= 2 AND count(*) <= floor((SELECT n FROM nd) * 0.95)
              ORDER BY total DESC, term LIMIT 5000)
    SELECT doc_id, term, tf AS count FROM tf JOIN vocab USING (term)""", ["v_tickets"])


def _seq(s, sf):
    c = _clean(s, sf)
    r = FE.txt_token_sequence(c, id_col="ticket_id", text_col="clean", num_words=10000, max_len=100)
    return r.select("doc_id", F.array_join("sequence", ",").alias("sequence"))


reg("txt_token_sequence", _seq,
    f"""WITH {CLEAN_SQL},
    tk AS (SELECT ticket_id, list_filter(string_split(lower(clean), ' '), lambda x: x <> '') AS toks FROM clean),
    pos AS (SELECT ticket_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM tk),
    vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS idx FROM
              (SELECT word, count(*) AS n FROM pos GROUP BY 1 ORDER BY n DESC, word LIMIT 9998)),
    enc AS (SELECT ticket_id, pos, coalesce(idx, 1) AS idx FROM pos LEFT JOIN vocab USING (word) WHERE pos < 100),
    seq AS (SELECT ticket_id, list(idx ORDER BY pos) AS s FROM enc GROUP BY 1)
    SELECT c.ticket_id AS doc_id,
           array_to_string(list_concat(coalesce(s, []), list_transform(range(100 - len(coalesce(s, []))), lambda x: 0)), ',')
             AS sequence
    FROM clean c LEFT JOIN seq USING (ticket_id)""", ["v_tickets"])

reg("txt_label_encode",
    lambda s, sf: FE.txt_label_encode(_tk(s, sf).select("ticket_id", "category"), "category"),
    "SELECT ticket_id, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS label FROM v_tickets",
    ["v_tickets"])

reg("txt_label_decode",
    lambda s, sf: FE.txt_label_decode(FE.txt_label_encode(_tk(s, sf).select("ticket_id", "category"), "category")
                                      .withColumnRenamed("category", "original"),
                                      ["de", "en", "es", "fr"]).select("ticket_id", "original", "category"),
    "SELECT ticket_id, category AS original, category FROM v_tickets", ["v_tickets"])

reg("txt_stratified_split",
    lambda s, sf: FE.txt_stratified_split(_tk(s, sf).select("ticket_id", "category"), id_col="ticket_id",
                                          label_col="category").groupBy("category", "split").count(),
    """WITH r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY md5(CAST(ticket_id AS VARCHAR) || ':42')) AS rn,
                         count(*) OVER (PARTITION BY category) AS n FROM v_tickets)
    SELECT category, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test'
                          WHEN rn <= floor(n * 0.2 + 0.5) + floor(n * 0.1 + 0.5) THEN 'val' ELSE 'train' END AS split,
           count(*) AS count FROM r GROUP BY 1, 2""", ["v_tickets"])

WORD_SQL = lit(T.WORD_RE)
STAT_SQL = f"""WITH b AS (SELECT ticket_id, customer_message AS raw, {sq_light('customer_message')} AS t FROM v_tickets),
w AS (SELECT *, {sq_words('t')} AS w FROM b)
SELECT ticket_id,
  CAST(length(t) AS DOUBLE) AS char_count, CAST(len(w) AS DOUBLE) AS word_count,
  CAST({rcount('t', '[.!?]+')} AS DOUBLE) AS sentence_count,
  CAST({rcount('t', '[A-Z]')} AS DOUBLE) AS upper_count, CAST({rcount('t', '[0-9]')} AS DOUBLE) AS digit_count,
  CAST({rcount('t', T.PUNCT_RE)} AS DOUBLE) AS punct_count,
  CAST(length(t) - length(replace(t, '?', '')) AS DOUBLE) AS question_count,
  CAST(length(t) - length(replace(t, '!', '')) AS DOUBLE) AS exclaim_count,
  CAST(len(list_filter(regexp_extract_all(t, {WORD_SQL}), lambda x: regexp_full_match(x, '[A-Z]{{2,}}'))) AS DOUBLE) AS acronym_count,
  CAST({rcount('raw', r'http[s]?://\S+')} AS DOUBLE) AS url_count,
  CAST({rcount('raw', T.EMAIL_RE)} AS DOUBLE) AS email_count,
  CASE WHEN len(w) > 0 THEN CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w) ELSE 0.0 END AS avg_word_length,
  CASE WHEN {rcount('t', '[.!?]+')} > 0 AND len(w) > 0 THEN CAST(len(w) AS DOUBLE) / {rcount('t', '[.!?]+')} ELSE 0.0 END
    AS words_per_sentence
FROM w"""

reg("ft_statistical",
    lambda s, sf: FE.ft_statistical(_tk(s, sf).select("ticket_id", "customer_message"), "customer_message")
    .drop("customer_message"), STAT_SQL, ["v_tickets"], FE.STAT_FEATURES)


def _n_match(expr, patterns):
    return "(" + " + ".join(f"CAST(regexp_matches({expr}, {lit(p)}) AS INTEGER)" for p in patterns) + ")"


DOMAIN_SQL = f"""WITH b AS (SELECT ticket_id, {sq_light('customer_message')} AS t FROM v_tickets),
l AS (SELECT *, lower(t) AS lo FROM b)
SELECT ticket_id,
  CAST({sq_contained('lo', FE.URGENCY_WORDS)} AS DOUBLE) AS urgency_words,
  CAST({sq_contained('lo', FE.EMOTION_WORDS)} AS DOUBLE) AS emotion_words,
  CAST({sq_contained('lo', FE.ACTION_WORDS)} AS DOUBLE) AS action_words,
  CAST({sq_contained('lo', FE.TECHNICAL_WORDS)} AS DOUBLE) AS technical_words,
  CAST({_n_match('lo', FE.GREETING_PATTERNS)} AS DOUBLE) AS greeting_patterns,
  CAST({_n_match('lo', FE.QUESTION_PATTERNS)} AS DOUBLE) AS question_patterns,
  CAST({_n_match('lo', FE.TIME_PATTERNS)} AS DOUBLE) AS time_patterns,
  CAST({' OR '.join(f'contains(lo, {lit(w)})' for w in FE.POLITE_WORDS)} AS DOUBLE) AS politeness,
  CAST(regexp_matches(lo, {lit(FE.NEGATION_RE)}) AS DOUBLE) AS negation,
  CAST({rcount('t', '[!]{2,}')} AS DOUBLE) AS multi_exclaim,
  CAST(regexp_matches(t, {lit(FE.SHOUT_RE)}) AS DOUBLE) AS shouting,
  CAST({rcount('t', FE.MONEY_RE)} AS DOUBLE) AS money_mentions
FROM l"""

reg("ft_domain",
    lambda s, sf: FE.ft_domain(_tk(s, sf).select("ticket_id", "customer_message"), "customer_message")
    .drop("customer_message"), DOMAIN_SQL, ["v_tickets"], FE.DOMAIN_FEATURES)

SENT_SQL = f"""WITH l AS (SELECT ticket_id, lower({sq_light('customer_message')}) AS lo FROM v_tickets),
c AS (SELECT ticket_id, {sq_contained('lo', FE.POSITIVE_WORDS)} AS p, {sq_contained('lo', FE.NEGATIVE_WORDS)} AS n FROM l)
SELECT ticket_id, CASE WHEN p + n > 0 THEN CAST(p - n AS DOUBLE) / (p + n) ELSE 0.0 END AS sentiment_score,
       CAST(p AS DOUBLE) AS positive_count, 0.0 AS neutral_count, CAST(n AS DOUBLE) AS negative_count FROM c"""

reg("ft_sentiment_lexicon",
    lambda s, sf: FE.ft_sentiment_lexicon(_tk(s, sf).select("ticket_id", "customer_message"), "customer_message")
    .drop("customer_message"), SENT_SQL, ["v_tickets"],
    ["sentiment_score", "positive_count", "neutral_count", "negative_count"])

reg("ft_category_keywords",
    lambda s, sf: FE.ft_category_keywords(_tk(s, sf), text_col="customer_message", label_col="category"),
    f"""WITH w AS (SELECT category, unnest(regexp_extract_all(lower(customer_message), {lit(T.WORD_RE)})) AS word FROM v_tickets),
    c AS (SELECT category, word, count(*) AS count FROM w GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, word) AS rank FROM c)
    SELECT * FROM r WHERE rank <= 20 AND length(word) > 2 AND NOT list_contains({STOP_SQL}, word)""", ["v_tickets"])

QUERIES = Q


def pruned_tfidf_sql(max_features: int, min_df: int, max_df: float) -> str:
    """CTEs ending in ``n2(doc_id, term, tfidf)``: uni+bigram TF-IDF over the
    cleaned text with document-frequency pruning (min_df docs, max_df share)."""
    toks = f"list_filter(regexp_extract_all(lower(clean), {lit(T.TOKEN2_RE)}), lambda t: NOT list_contains({STOP_SQL}, t))"
    grams = ("list_concat(toks, CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), "
             "lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END)")
    return f"""{CLEAN_SQL},
    tk AS (SELECT ticket_id, {toks} AS toks FROM clean),
    terms AS (SELECT ticket_id AS doc_id, unnest({grams}) AS term FROM tk),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    nd AS (SELECT count(*) AS n FROM v_tickets),
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1
              HAVING count(*) >= {min_df} AND count(*) <= floor((SELECT n FROM nd) * {max_df})
              ORDER BY total DESC, term LIMIT {max_features}),
    w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1 + n) / (1 + vocab.df)) + 1) AS w FROM tf JOIN vocab USING (term), nd),
    n2 AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


GLOBAL_SQL = f"""WITH {pruned_tfidf_sql(1000, 2, 0.95)},
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term DESC) AS r
                           FROM n2 WHERE tfidf > 0) WHERE r <= 20),
    g AS (SELECT c.category AS label, term, avg(tfidf) AS mean_score, max(tfidf) AS max_score, count(*) AS frequency,
                 stddev_pop(tfidf) AS std_score FROM top JOIN clean c ON c.ticket_id = top.doc_id GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_score * frequency DESC, term) AS rank FROM g)
    SELECT * FROM ranked WHERE rank <= 15"""
