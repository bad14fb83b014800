"""Templated responses, follow-up actions, escalation and response statistics.

Templates are a small configuration table (15 built-ins plus custom ones):
a ticket table is joined to it twice (``category_urgency`` then
``general_urgency``) with broadcast left joins, and ``general_medium`` is
the last fallback. Everything else is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.functions.text import fn_replace_vars

# The built-in response templates (category, urgency, text, tone).
TEMPLATES = [
    ("billing", "high", "I understand your billing concern is urgent. Let me immediately review your account and resolve this issue. I'll personally ensure this gets the highest priority.", "empathetic"),
    ("billing", "medium", "Thank you for contacting us about your billing inquiry. I'll review your account details and provide you with a comprehensive explanation within 24 hours.", "professional"),
    ("billing", "low", "Thank you for your billing question. I'll look into this and respond with detailed information within 2-3 business days.", "friendly"),
    ("technical", "high", "I see you're experiencing a critical technical issue. Our technical team is being immediately notified, and we'll have someone working on this within the hour.", "urgent"),
    ("technical", "medium", "Thank you for reporting this technical issue. I've documented the details and will escalate this to our technical team for resolution within 24 hours.", "professional"),
    ("technical", "low", "Thanks for the technical question. I'll research this and provide you with detailed troubleshooting steps or solutions within 2-3 business days.", "helpful"),
    ("general", "high", "Thank you for contacting us. I understand this is important to you, and I'll personally ensure you get a response within 4 hours.", "attentive"),
    ("general", "medium", "Thank you for your inquiry. I'll review this and provide you with a comprehensive response within 24 hours.", "professional"),
    ("general", "low", "Thank you for reaching out. I'll look into this and respond within 2-3 business days with the information you need.", "friendly"),
    ("complaint", "high", "I sincerely apologize for the experience you've had. This is absolutely not the level of service we strive for. I'm escalating this immediately to management and will personally follow up within 2 hours.", "apologetic"),
    ("complaint", "medium", "I'm sorry to hear about your experience. Your feedback is valuable to us, and I want to make this right. I'll investigate this thoroughly and respond within 24 hours.", "empathetic"),
    ("complaint", "low", "Thank you for bringing this to our attention. I'll review your concerns and respond with our plan to address this within 2-3 business days.", "understanding"),
    ("compliment", "high", "Wow, thank you so much for this wonderful feedback! I'll make sure to share this with the team mentioned. Your kind words truly make our day!", "enthusiastic"),
    ("compliment", "medium", "Thank you so much for taking the time to share this positive feedback! I'll make sure the team knows about your appreciation.", "grateful"),
    ("compliment", "low", "Thank you for your kind words! We really appreciate customers like you who take the time to share positive feedback.", "appreciative"),
]

# Template variable defaults.
VARIABLE_DEFAULTS = {
    "account_id": "your account", "issue_details": "your issue", "issue_type": "technical issue",
    "complaint_details": "your concerns", "incident_date": "recently", "team_mentioned": "our team",
    "specific_praise": "your positive experience", "inquiry_type": "your inquiry",
}

# Follow-up actions.
HIGH_URGENCY_ACTIONS = ["Schedule immediate follow-up within 4 hours", "Escalate to senior support if not resolved"]
CATEGORY_ACTIONS = {
    "billing": ["Review customer account details", "Check recent transactions", "Verify billing information"],
    "technical": ["Gather system logs", "Test reproduction steps", "Check known issues database"],
    "complaint": ["Document complaint details", "Schedule management review", "Prepare compensation if applicable"],
}
PROFESSIONAL_WORDS = ["thank", "appreciate", "understand", "resolve", "assist", "help"]


def templates_df(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """Built-in templates keyed ``category_urgency``; custom rows override by key."""
    base = spark.createDataFrame(TEMPLATES, "category string, urgency string, template string, tone string")
    base = base.withColumn("key", F.concat_ws("_", "category", "urgency"))
    if custom is None:
        return base
    c = custom.select(F.lower("category").alias("category"), F.lower("urgency").alias("urgency"), "template",
                      F.coalesce("tone", F.lit("professional")).alias("tone")).withColumn(
        "key", F.concat_ws("_", "category", "urgency"))
    return base.join(c.select("key"), "key", "left_anti").unionByName(c)


def rsp_template(tickets: DataFrame, templates: DataFrame, *, category_col="category", urgency_col="urgency",
                 name_col="customer_name", context_col: str | None = None) -> DataFrame:
    """Rendered template per ticket with the three-step key fallback."""
    t = F.broadcast(templates.select("key", "template", "tone"))  # config-sized table
    k1 = F.concat(F.lower(F.col(category_col)), F.lit("_"), F.lower(F.col(urgency_col)))
    k2 = F.concat(F.lit("general_"), F.lower(F.col(urgency_col)))
    d = tickets.withColumn("_k1", k1).withColumn("_k2", k2)
    d = d.join(t.select(F.col("key").alias("_k1"), F.col("template").alias("_t1"), F.col("tone").alias("_o1")), "_k1", "left")
    d = d.join(t.select(F.col("key").alias("_k2"), F.col("template").alias("_t2"), F.col("tone").alias("_o2")), "_k2", "left")
    gm = templates.where(F.col("key") == "general_medium")
    gm_t = gm.select("template").scalar()
    gm_o = gm.select("tone").scalar()
    used = F.when(F.col("_t1").isNotNull(), F.col("_k1")).when(F.col("_t2").isNotNull(), F.col("_k2")).otherwise(
        F.lit("general_medium"))
    text = F.coalesce("_t1", "_t2", gm_t)
    values = {"customer_name": F.coalesce(F.col(name_col), F.lit("Customer"))}
    for var, default in VARIABLE_DEFAULTS.items():
        v = F.try_element_at(F.col(context_col), F.lit(var)) if context_col else F.lit(None).cast("string")
        values[var] = F.coalesce(v, F.lit(default))
    return (d.withColumn("response_text", fn_replace_vars(text, values))
            .withColumn("template_used", used)
            .withColumn("template_tone", F.coalesce("_o1", "_o2", gm_o))
            .withColumn("generation_method", F.lit("template"))
            .withColumn("confidence_score", F.lit(0.8))
            .drop("_k1", "_k2", "_t1", "_t2", "_o1", "_o2"))


def rsp_actions(category: Column, urgency: Column) -> Column:
    hi = F.when(urgency == "high", F.array(*[F.lit(a) for a in HIGH_URGENCY_ACTIONS])).otherwise(
        F.array().cast("array<string>"))
    cat = F.array().cast("array<string>")
    for c, acts in reversed(list(CATEGORY_ACTIONS.items())):
        cat = F.when(F.lower(category) == c, F.array(*[F.lit(a) for a in acts])).otherwise(cat)
    return F.concat(hi, cat)


def rsp_escalate(category: Column, urgency: Column, confidence: Column, previous_complaints: Column | None = None,
                 *, threshold: float = 0.6) -> Column:
    prev = F.coalesce(previous_complaints, F.lit(0)) if previous_complaints is not None else F.lit(0)
    return ((urgency == "high") | (confidence < threshold)
            | ((F.lower(category) == "complaint") & urgency.isin("medium", "high")) | (prev > 2))


def rsp_quality(response: Column, category: Column) -> Column:
    """0.5 + 0.2 (50-300 chars) + 0.05 per professional word + 0.1 category cue, <= 1."""
    lo = F.lower(response)
    score = F.lit(0.5) + F.when(F.length(response).between(50, 300), F.lit(0.2)).otherwise(F.lit(0.0))
    for w in PROFESSIONAL_WORDS:
        score = score + F.when(F.contains(lo, F.lit(w)), F.lit(0.05)).otherwise(F.lit(0.0))
    cat = F.lower(category)
    score = score + F.when((cat == "complaint") & (F.contains(lo, F.lit("sorry")) | F.contains(lo, F.lit("apologize"))),
                           F.lit(0.1)).otherwise(F.lit(0.0))
    score = score + F.when((cat == "compliment") & (F.contains(lo, F.lit("thank")) | F.contains(lo, F.lit("appreciate"))),
                           F.lit(0.1)).otherwise(F.lit(0.0))
    return F.least(score, F.lit(1.0))


def rsp_fallback(category: Column, name: Column) -> Column:
    return F.struct(
        F.concat(F.lit("Thank you for contacting us, "), F.coalesce(name, F.lit("Customer")),
                 F.lit(". We have received your "), category,
                 F.lit(" inquiry and will respond within 24 hours. We appreciate your patience.")).alias("response_text"),
        F.lit(0.7).alias("confidence_score"), F.lit("fallback").alias("template_used"),
        F.lit("fallback").alias("generation_method"),
        F.array(F.lit("Review ticket manually"), F.lit("Assign to appropriate agent")).alias("suggested_actions"),
        F.lit(True).alias("escalation_recommended"))


def fn_clean_generated(c: Column) -> Column:
    """Drop [..] (..) <..>, squeeze spaces, end with punctuation, capitalise."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", ""), r"<.*?>", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "), F.lit(" "))
    t = F.when((F.length(t) > 0) & ~t.rlike(r"[.!?]$"), F.concat(t, F.lit("."))).otherwise(t)
    return F.when(F.length(t) > 0, F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))).otherwise(t)


def rsp_generate(tickets: DataFrame, templates: DataFrame, *, escalate_threshold: float = 0.6,
                 **cols) -> DataFrame:
    """Template path (no generation model is loaded), with actions, escalation,
    preview metadata, and the fallback response for rows without a category."""
    r = rsp_template(tickets, templates, **{k: v for k, v in cols.items() if k in
                                            ("category_col", "urgency_col", "name_col", "context_col")})
    cat, urg = F.col(cols.get("category_col", "category")), F.col(cols.get("urgency_col", "urgency"))
    prev = F.col("previous_complaints") if "previous_complaints" in tickets.columns else None
    r = r.withColumn("suggested_actions", rsp_actions(cat, urg)).withColumn(
        "escalation_recommended", rsp_escalate(cat, urg, F.col("confidence"), prev, threshold=escalate_threshold))
    text_col = cols.get("text_col", "text")
    if text_col in tickets.columns:
        r = r.withColumn("original_ticket", F.when(F.length(text_col) > 100,
                                                   F.concat(F.substring(text_col, 1, 100), F.lit("..."))).otherwise(F.col(text_col)))
    bad = cat.isNull() | urg.isNull() | F.col("confidence").isNull()
    fb = rsp_fallback(F.coalesce(cat, F.lit("general")), F.col(cols.get("name_col", "customer_name")))
    for f in ["response_text", "confidence_score", "template_used", "generation_method", "suggested_actions",
              "escalation_recommended"]:
        r = r.withColumn(f, F.when(bad, fb[f]).otherwise(F.col(f)))
    return r


def agg_response_stats(responses: DataFrame) -> DataFrame:
    """Totals, mean confidence and length, escalation rate, counts by category /
    urgency / method from one GROUPING SETS shuffle: (dimension, value, count)."""
    g = responses.groupingSets([[F.col("category")], [F.col("urgency")], [F.col("generation_method")], []],
                               "category", "urgency", "generation_method").agg(
        F.count("*").alias("count"), F.avg("confidence_score").alias("avg_confidence"),
        F.avg(F.length("response_text")).alias("avg_response_length"),
        F.avg(F.col("escalation_recommended").cast("int")).alias("escalation_rate"),
        F.grouping_id().alias("gid"))
    # grouping_id bits: category (4), urgency (2), method (1); 7 = grand total
    dims = F.when(F.col("gid") == 7, F.lit("total")).when(F.col("gid") == 3, F.lit("category")) \
        .when(F.col("gid") == 5, F.lit("urgency")).otherwise(F.lit("generation_method"))
    val = F.when(F.col("gid") == 7, F.lit("all")).when(F.col("gid") == 3, F.col("category")) \
        .when(F.col("gid") == 5, F.col("urgency")).otherwise(F.col("generation_method"))
    return g.select(dims.alias("dimension"), val.alias("value"), "count", "avg_confidence", "avg_response_length",
                    "escalation_rate")


def agg_response_recent(responses: DataFrame, order: list[str], *, n: int = 10) -> DataFrame:
    """The last ``n`` responses in ``order`` (all columns, ``recency`` 1 = newest)
    with their length: a top-k, each task keeps ``n`` rows."""
    last = responses.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)
    # n rows reach this single-partition numbering
    rank = F.row_number().over(Window.orderBy(*[F.desc_nulls_last(c) for c in order]))
    return last.withColumn("response_length", F.length("response_text")).withColumn("recency", rank)
