"""Responses (v_response_req), multi-modal (v_modal), explanations (v_tickets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.constants import CATEGORIES
from ticketscope.functions.text import txt_clean
from ticketscope.operators import explain as EX
from ticketscope.operators import modal as MM
from ticketscope.operators import responses as R
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TPL_SQL = "tpl AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(c + '_' + u)}, {lit(t)}, {lit(o)})" for c, u, t, o in R.TEMPLATES) + ") v(key, template, tone))"
RENDER_SQL = f"""{TPL_SQL},
rendered AS (
  SELECT q.*, coalesce(t1.template, t2.template, (SELECT template FROM tpl WHERE key = 'general_medium')) AS response_text,
         CASE WHEN t1.template IS NOT NULL THEN lower(category) || '_' || lower(urgency)
              WHEN t2.template IS NOT NULL THEN 'general_' || lower(urgency) ELSE 'general_medium' END AS template_used,
         coalesce(t1.tone, t2.tone, (SELECT tone FROM tpl WHERE key = 'general_medium')) AS template_tone
  FROM v_response_req q
  LEFT JOIN tpl t1 ON t1.key = lower(category) || '_' || lower(urgency)
  LEFT JOIN tpl t2 ON t2.key = 'general_' || lower(urgency))"""


def _req(s, sf):
    return spark_view(s, sf, "v_response_req")


def _rendered(s, sf):
    return R.rsp_template(_req(s, sf), R.templates_df(s))


reg("rsp_template", lambda s, sf: _rendered(s, sf).select("request_id", "response_text", "template_used", "template_tone"),
    f"WITH {RENDER_SQL} SELECT request_id, response_text, template_used, template_tone FROM rendered",
    ["v_response_req"])
reg("join_template_fallback", lambda s, sf: _rendered(s, sf).groupBy("template_used").count(),
    f"WITH {RENDER_SQL} SELECT template_used, count(*) AS count FROM rendered GROUP BY 1", ["v_response_req"])

ACT_SQL = ("array_to_string(list_concat(CASE WHEN urgency = 'high' THEN " +
           "[" + ", ".join(lit(a) for a in R.HIGH_URGENCY_ACTIONS) + "] ELSE [] END, CASE " +
           " ".join(f"WHEN lower(category) = {lit(c)} THEN [" + ", ".join(lit(a) for a in acts) + "]"
                    for c, acts in R.CATEGORY_ACTIONS.items()) + " ELSE [] END), '|')")
ESC_SQL = ("(urgency = 'high' OR confidence < 0.6 OR (lower(category) = 'complaint' AND urgency IN ('medium', 'high')) "
           "OR coalesce(previous_complaints, 0) > 2)")

reg("rsp_actions",
    lambda s, sf: _req(s, sf).select("request_id", F.array_join(R.rsp_actions(F.col("category"), F.col("urgency")), "|").alias("actions")),
    f"SELECT request_id, {ACT_SQL} AS actions FROM v_response_req", ["v_response_req"])
reg("rsp_escalate",
    lambda s, sf: _req(s, sf).select("request_id", R.rsp_escalate(F.col("category"), F.col("urgency"), F.col("confidence"),
                                                                  F.col("previous_complaints")).alias("escalate")),
    f"SELECT request_id, {ESC_SQL} AS escalate FROM v_response_req", ["v_response_req"])


def quality_sql(resp: str, cat: str) -> str:
    parts = [f"CASE WHEN length({resp}) BETWEEN 50 AND 300 THEN 0.2 ELSE 0.0 END"]
    parts += [f"CASE WHEN contains(lower({resp}), {lit(w)}) THEN 0.05 ELSE 0.0 END" for w in R.PROFESSIONAL_WORDS]
    parts.append(f"CASE WHEN lower({cat}) = 'complaint' AND (contains(lower({resp}), 'sorry') OR contains(lower({resp}), 'apologize')) THEN 0.1 ELSE 0.0 END")
    parts.append(f"CASE WHEN lower({cat}) = 'compliment' AND (contains(lower({resp}), 'thank') OR contains(lower({resp}), 'appreciate')) THEN 0.1 ELSE 0.0 END")
    return "least(0.5 + " + " + ".join(parts) + ", 1.0)"


reg("rsp_quality",
    lambda s, sf: _rendered(s, sf).select("request_id", R.rsp_quality(F.col("response_text"), F.col("category")).alias("quality")),
    f"WITH {RENDER_SQL} SELECT request_id, {quality_sql('response_text', 'category')} AS quality FROM rendered",
    ["v_response_req"], ["quality"])


def _generate(s, sf):
    g = R.rsp_generate(_req(s, sf), R.templates_df(s))
    return g.select("request_id", "response_text", "template_used", "generation_method", "confidence_score",
                    F.array_join("suggested_actions", "|").alias("actions"), "escalation_recommended", "original_ticket")


reg("rsp_generate", _generate,
    f"""WITH {RENDER_SQL}
    SELECT request_id, response_text, template_used, 'template' AS generation_method, 0.8 AS confidence_score,
           {ACT_SQL} AS actions, {ESC_SQL} AS escalation_recommended,
           CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS original_ticket
    FROM rendered""", ["v_response_req"], ["confidence_score"])
reg("rsp_batch", lambda s, sf: _generate(s, sf).groupBy("template_used", "escalation_recommended").count(),
    f"""WITH {RENDER_SQL} SELECT template_used, {ESC_SQL} AS escalation_recommended, count(*) AS count
        FROM rendered GROUP BY 1, 2""", ["v_response_req"])
reg("rsp_fallback",
    lambda s, sf: _req(s, sf).select("request_id", R.rsp_fallback(F.col("category"), F.col("customer_name"))["response_text"].alias("t")),
    """SELECT request_id, 'Thank you for contacting us, ' || customer_name || '. We have received your ' || category ||
              ' inquiry and will respond within 24 hours. We appreciate your patience.' AS t FROM v_response_req""",
    ["v_response_req"])


def _stats(s, sf):
    g = R.rsp_generate(_req(s, sf), R.templates_df(s))
    return R.agg_response_stats(g)


reg("agg_response_stats", _stats,
    f"""WITH {RENDER_SQL}, g AS (SELECT category, urgency, 'template' AS generation_method, 0.8 AS confidence_score,
                                        response_text, {ESC_SQL} AS esc FROM rendered)
    SELECT CASE WHEN grouping(category, urgency, generation_method) = 7 THEN 'total'
                WHEN grouping(category, urgency, generation_method) = 3 THEN 'category'
                WHEN grouping(category, urgency, generation_method) = 5 THEN 'urgency' ELSE 'generation_method' END AS dimension,
           CASE WHEN grouping(category, urgency, generation_method) = 7 THEN 'all'
                WHEN grouping(category, urgency, generation_method) = 3 THEN category
                WHEN grouping(category, urgency, generation_method) = 5 THEN urgency ELSE generation_method END AS value,
           count(*) AS count, avg(confidence_score) AS avg_confidence, avg(length(response_text)) AS avg_response_length,
           avg(CAST(esc AS INTEGER)) AS escalation_rate
    FROM g GROUP BY GROUPING SETS ((category), (urgency), (generation_method), ())""",
    ["v_response_req"], ["avg_confidence", "avg_response_length", "escalation_rate"])


def _recent_responses(s, sf):
    g = R.rsp_generate(_req(s, sf), R.templates_df(s))
    return R.agg_response_recent(g, ["request_id"]).select(
        "request_id", "category", "urgency", "generation_method", "confidence_score", "response_length", "recency")


reg("agg_response_recent", _recent_responses,
    f"""WITH {RENDER_SQL} SELECT request_id, category, urgency, 'template' AS generation_method, 0.8 AS confidence_score,
           length(response_text) AS response_length, row_number() OVER (ORDER BY request_id DESC) AS recency
    FROM rendered ORDER BY request_id DESC LIMIT 10""", ["v_response_req"], ["confidence_score"])

reg("fn_clean_generated",
    lambda s, sf: s.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", R.fn_clean_generated(F.col("text")).alias("t")),
    r"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
            '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '<.*?>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM conversations),
    b AS (SELECT conv_id, turn, CASE WHEN length(t) > 0 AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END AS t FROM a)
    SELECT conv_id, turn, CASE WHEN length(t) > 0 THEN upper(substring(t, 1, 1)) || substring(t, 2) ELSE t END AS t FROM b""")

CONF = {"text": "text_conf", "images": "image_conf", "audio": "audio_conf", "documents": "document_conf"}


def _modal(s, sf):
    d = spark_view(s, sf, "v_modal").withColumn("base", F.lit(0.5))
    r = MM.mm_classify(d, CONF, prediction_col="text", confidence_col="base")
    return r.select("input_id", "predicted_category", "confidence", "primary_modality",
                    *[f"contrib_{m}" for m, _ in MM.MODALITY_WEIGHTS],
                    F.array_join("modalities_used", ",").alias("modalities_used"))


W_SQL = {m: f"coalesce({CONF[m]}, 0.0) * {w}" for m, w in MM.MODALITY_WEIGHTS}
TOT = " + ".join(f"({v})" for v in W_SQL.values())
MODAL_SQL = f"""WITH w AS (SELECT *, {', '.join(f'{v} AS w_{m}' for m, v in W_SQL.items())}, {TOT} AS tot FROM v_modal),
c AS (SELECT *, {', '.join(f'CASE WHEN tot > 0 THEN w_{m} / tot ELSE w_{m} END AS contrib_{m}' for m in W_SQL)},
             {' + '.join(f'CAST(coalesce({c}, 0.0) > 0.3 AS INTEGER)' for c in CONF.values())} AS nmod FROM w)
SELECT input_id, text AS predicted_category,
       CASE WHEN nmod > 1 THEN least(1.0, 0.5 + least(0.2, (nmod - 1) * 0.1)) ELSE 0.5 END AS confidence,
       CASE {' '.join(f"WHEN contrib_{m} >= greatest({', '.join(f'contrib_{o}' for o in W_SQL)}) THEN '{m}'" for m in W_SQL)} END
         AS primary_modality,
       {', '.join(f'contrib_{m}' for m in W_SQL)},
       concat_ws(',', {', '.join(f"CASE WHEN coalesce({c}, 0.0) > 0 THEN '{m}' END" for m, c in CONF.items())}) AS modalities_used
FROM c"""

reg("mm_classify", _modal, MODAL_SQL, ["v_modal"],
    ["confidence"] + [f"contrib_{m}" for m, _ in MM.MODALITY_WEIGHTS])
reg("mm_contributions", lambda s, sf: _modal(s, sf).groupBy("primary_modality").count(),
    f"SELECT primary_modality, count(*) AS count FROM ({MODAL_SQL}) GROUP BY 1", ["v_modal"])
reg("mm_confidence_boost", lambda s, sf: _modal(s, sf).groupBy("confidence").count(),
    f"SELECT confidence, count(*) AS count FROM ({MODAL_SQL}) GROUP BY 1", ["v_modal"], ["confidence"])


def _modal_model(s, sf):
    """Tickets with attachments of other modalities: a seventh of them without a
    message, a third with a text read from an image (the channel's name)."""
    from ticketscope.operators import ml as ML
    t = spark_view(s, sf, "v_tickets")
    model = ML.ml_train_pipeline(t, model_type="logistic_regression")
    k = F.col("ticket_id")
    d = t.select(k.alias("input_id"), F.when(k % 7 != 0, F.col("customer_message")).alias("message"),
                 F.when(k % 3 == 0, F.col("channel")).alias("image_text"), F.when(k % 7 != 0, F.lit(1.0)).alias("text_conf"),
                 F.when(k % 3 == 0, (k % 100) / 100.0).alias("image_conf"), F.when(k % 5 == 0, F.lit(0.9)).alias("document_conf"))
    r = MM.mm_classify_model(d, model, {"text": "text_conf", "images": "image_conf", "documents": "document_conf"},
                             text_cols=["message", "image_text"])
    return r.select("input_id", "predicted_category", "base_confidence", "confidence", "primary_modality",
                    F.array_join("modalities_used", ",").alias("modalities_used"))


reg("mm_classify_model", _modal_model)


def _usage(s, sf):
    d = spark_view(s, sf, "v_modal")
    return MM.agg_modality_usage(d, has_text=F.col("text").isNotNull(), has_images=F.col("image_conf").isNotNull(),
                                 has_audio=F.col("audio_conf").isNotNull(), has_documents=F.col("document_conf").isNotNull())


N_SQL = ("CAST(text IS NOT NULL AS INTEGER) + CAST(image_conf IS NOT NULL AS INTEGER) + "
         "CAST(audio_conf IS NOT NULL AS INTEGER) + CAST(document_conf IS NOT NULL AS INTEGER)")
reg("agg_modality_usage", _usage,
    f"""SELECT count(*) AS total_processed, count(image_conf) AS with_images, count(audio_conf) AS with_audio,
               count(document_conf) AS with_documents, count(*) FILTER (WHERE text IS NOT NULL AND {N_SQL} = 1) AS text_only,
               count(*) FILTER (WHERE {N_SQL} > 1) AS multi_modal FROM v_modal""", ["v_modal"])
reg("mm_combine_text",
    lambda s, sf: s.read.parquet(f"{sf}/pages.parquet").select("page_id", MM.mm_combine_text(F.col("url"), F.col("html")).alias("combined")),
    "SELECT page_id, trim(concat_ws(' ', url, html), ' ') AS combined FROM pages")
reg("mm_text_features",
    lambda s, sf: MM.mm_text_features(spark_view(s, sf, "v_tickets").select("ticket_id", F.col("customer_message").alias("text")))
    .select("ticket_id", "length", "word_count"),
    """SELECT ticket_id, length(customer_message) AS length,
              len(list_filter(regexp_split_to_array(customer_message, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS word_count
       FROM v_tickets""", ["v_tickets"])


def _bias(s, sf):
    b = EX.ex_bias_parity(spark_view(s, sf, "v_tickets"), text_col="customer_message", label_col="category")
    return b.select("attribute", "label", "n_with", "n_without", "share_with", "share_without", "bias_score",
                    "max_bias", "biased")


def bias_sql() -> str:
    flags = " UNION ALL ".join(
        f"SELECT {lit(a)} AS attribute, category AS label, (" +
        " OR ".join(f"contains(lower(customer_message), {lit(k)})" for k in kws) + ") AS has FROM v_tickets"
        for a, kws in EX.SENSITIVE_ATTRIBUTES.items())
    return f"""WITH f AS ({flags}),
    c AS (SELECT attribute, label, count(*) FILTER (WHERE has) AS n_with, count(*) FILTER (WHERE NOT has) AS n_without FROM f GROUP BY 1, 2),
    t AS (SELECT *, sum(n_with) OVER (PARTITION BY attribute) AS tw, sum(n_without) OVER (PARTITION BY attribute) AS two FROM c),
    s AS (SELECT attribute, label, n_with, n_without, CAST(n_with AS DOUBLE) / tw AS share_with,
                 CAST(n_without AS DOUBLE) / two AS share_without FROM t WHERE tw > 0 AND two > 0)
    SELECT *, share_with - share_without AS bias_score,
           max(abs(share_with - share_without)) OVER (PARTITION BY attribute) AS max_bias,
           abs(share_with - share_without) > 0.1 AS biased FROM s"""


reg("ex_bias_parity", _bias, bias_sql(), ["v_tickets"], ["share_with", "share_without", "bias_score", "max_bias"])
reg("ex_bias_pivot",
    lambda s, sf: EX.ex_bias_pivot(EX.ex_bias_parity(spark_view(s, sf, "v_tickets"), text_col="customer_message",
                                                     label_col="category")),
    f"""WITH b AS ({bias_sql()})
    SELECT label, {', '.join(f"coalesce(max(bias_score) FILTER (WHERE attribute = {lit(a)}), 0.0) AS {a}" for a in EX.SENSITIVE_ATTRIBUTES)}
    FROM b GROUP BY label""", ["v_tickets"], list(EX.SENSITIVE_ATTRIBUTES))


def _global(s, sf):
    t = spark_view(s, sf, "v_tickets").select("ticket_id", "category", txt_clean("customer_message").alias("clean"))
    return EX.ex_global_features(t, id_col="ticket_id", text_col="clean", label_col="category").select(
        "label", "term", "mean_score", "max_score", "frequency", "std_score", "rank")


def _global_sql():
    from ticketscope.plans.q_text import GLOBAL_SQL
    return GLOBAL_SQL


reg("ex_global_features", _global, _global_sql(), ["v_tickets"], ["mean_score", "max_score", "std_score"])
reg("ex_specificity", lambda s, sf: EX.ex_specificity(_global(s, sf)),
    f"""WITH gf AS ({_global_sql()})
    SELECT term, max(mean_score) / (sum(mean_score) + 1e-10) AS specificity FROM gf GROUP BY term""",
    ["v_tickets"], ["specificity"])


def _cands(s, sf):
    t = spark_view(s, sf, "v_tickets").select(
        "ticket_id", txt_clean("customer_message").alias("clean"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("ticket_id") % 7 + 1).cast("int")).alias("target"))
    c = EX.join_counterfactual_cand(t, EX.ex_class_lexicon(s), id_col="ticket_id", text_col="clean", target_col="target",
                                    texts=False)
    return c.groupBy("ticket_id", "change_type").agg(F.count("*").alias("n"), F.max("length").alias("max_len"))


def _cands_sql():
    from ticketscope.plans.q_text import CLEAN_SQL
    lex_rows = []
    for c, (kws, phs) in EX.CLASS_LEXICON.items():
        lex_rows += [f"({lit(c)}, 'keyword', {i + 1}, {lit(t)})" for i, t in enumerate(kws)]
        lex_rows += [f"({lit(c)}, 'phrase', {i + 1}, {lit(t)})" for i, t in enumerate(phs)]
    cats = "[" + ", ".join(lit(c) for c in CATEGORIES) + "]"
    return f"""WITH {CLEAN_SQL},
    lex AS (SELECT * FROM (VALUES {', '.join(lex_rows)}) v(class, kind, rank, term)),
    t AS (SELECT ticket_id, clean, {cats}[ticket_id % 7 + 1] AS target, string_split(clean, ' ') AS words FROM clean),
    w AS (SELECT ticket_id, clean, target, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM t),
    rep AS (SELECT ticket_id, 'word_replacement' AS change_type, length(clean) - length(w) + length(lex.term) AS len
            FROM w JOIN lex ON lex.class = w.target AND lex.kind = 'keyword' AND lex.rank <= 5),
    ph AS (SELECT ticket_id, 'phrase_addition' AS change_type, length(clean) + 1 + length(lex.term) AS len
           FROM t JOIN lex ON lex.class = t.target AND lex.kind = 'phrase')
    SELECT ticket_id, change_type, count(*) AS n, max(len) AS max_len FROM (SELECT * FROM rep UNION ALL SELECT * FROM ph)
    GROUP BY 1, 2"""


reg("join_counterfactual_cand", _cands, _cands_sql(), ["v_tickets"])

QUERIES = Q
