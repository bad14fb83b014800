"""Mixing to target weights with soft domain membership.

A classifier trained on the labelled table gives every document a posterior
over domains. Projected-gradient least squares then fits a nonnegative rate per
document such that the expected token total of each domain,
``sum(rate * tokens * posterior)``, matches its target, staying near rate 1.
DataFrame operations and Spark ML only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.common import cut, fresh

DOMAINS = ("good", "toxic", "poor")
#: Target share of all expected tokens of each domain.
TARGETS = {"good": 0.97, "toxic": 0.025, "poor": 0.005}
#: At most about this many labelled documents train the classifier, chosen by a hash of their ids.
MAX_LABELLED = 20_000
#: Terms of the classifier: the commonest of those that stand in at least this share of the sample's documents.
MAX_TERMS, MIN_SHARE = 1 << 14, 0.005
#: Words, and the runs of other signs that follow a letter, as tokens of their own.
SPLIT = r"\s+|(?<=\p{L})(?=[^\p{L}\s])"
#: Largest share of all tokens that a domain's total may miss its target by at the end of the fit.
TOLERANCE = 1e-4


def domain(quality: Column, toxic: Column) -> Column:
    """Index in ``DOMAINS`` of a label row; null if a label is missing."""
    return F.when(toxic == 1, 1.0).when(quality == 1, 0.0).when((quality == 0) & (toxic == 0), 2.0)


def tokenised(docs: DataFrame, *keep: str) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), *keep).select(
        "doc_id", *keep, F.xxhash64("text").alias("text_hash"), F.array_remove(F.split("text", SPLIT), "").alias("tokens"))


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> PipelineModel | None:
    """Logistic regression over the terms a text has, from a bounded hash sample of
    the labelled documents; None if fewer than two domains have a label."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("quality"), F.col("toxic")).alias("label"))
             .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")))
    known = cut(known)
    n, kinds = known.agg(F.count("*"), F.count_distinct("label")).first()
    if kinds < 2:
        return None
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, max_labelled / n)))
    # the sample's size is bounded by max_labelled, whatever the number of documents
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(part), "doc_id")
    rows = cut(tokenised(own, "label").select("tokens", "label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return Pipeline(stages=[
        CountVectorizer(inputCol="terms", outputCol="features", vocabSize=MAX_TERMS, minDF=MIN_SHARE, binary=True),
        LogisticRegression(maxIter=20, regParam=1e-3, standardization=False, family="multinomial",
                           probabilityCol="p", rawPredictionCol="raw", predictionCol="domain"),
    ]).fit(with_terms(rows))


def with_terms(rows: DataFrame) -> DataFrame:
    """The tokens and the empty term, which every document has, so that there is a vocabulary."""
    return rows.withColumn("terms", F.concat(F.array(F.lit("")), "tokens"))


def posteriors(docs: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``doc_id, text_hash, n_tokens, p0..``: words and domain posteriors of
    every row. Without a model all of a document belongs to the first domain."""
    rows = tokenised(docs)
    n = F.size("tokens").cast("long").alias("n_tokens")
    if model is None:
        return rows.select("doc_id", "text_hash", n, *[F.lit(float(k == 0)).alias(f"p{k}") for k in range(len(DOMAINS))])
    seen = int(model.stages[-1].numClasses)  # labels above the largest one seen have no posterior
    p = model.transform(with_terms(rows)).select("doc_id", "text_hash", n, vector_to_array("p").alias("p"))
    return p.select("doc_id", "text_hash", "n_tokens", *[
        (F.get("p", F.lit(k)) if k < seen else F.lit(0.0)).alias(f"p{k}") for k in range(len(DOMAINS))])


@dataclass
class Fit:
    """Steps of the projected gradient (one number per domain each), the targets
    and the reached totals."""
    steps: list[list[float]]
    targets: list[float]
    totals: list[float]

    def misfit(self, budget: float = 1.0) -> float:
        """Largest difference of a total from its target as a share of all tokens."""
        whole = sum(self.targets) / budget if budget else 0.0
        return max(abs(a - b) for a, b in zip(self.totals, self.targets)) / whole if whole else 0.0


def rate(steps: list[list[float]]) -> Column:
    """Rate of a document after the steps: from 1, each step down its posterior's
    gradient, projected on the nonnegative numbers."""
    r = F.lit(1.0)
    for u in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p{k}") * float(x) for k, x in enumerate(u)), F.lit(0.0)))
    return r


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivots; one row per domain."""
    m = [[*r, x] for r, x in zip(a, b)]
    for i in range(len(m)):
        p = max(range(i, len(m)), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(len(m)):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [r[-1] / r[i] for i, r in enumerate(m)]


#: Step sizes tried along a direction until one lessens the objective (mostly the first).
SIZES = (1.0, 0.25, 1 / 16, 1 / 128)


def fit_rates(rows: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, max_steps: int = 100,
              at_most: tuple[str, ...] = ()) -> Fit:
    """Projected-gradient least squares over ``rows`` (n_tokens, p0..).

    Domain k's target is ``targets[k] * budget`` times all tokens; for domains in
    ``at_most`` no more than they have at rate 1 (a few documents are not repeated
    many times to fill them), and the first domain gets the rest. Among the
    nonnegative rates that reach the targets, the one nearest to rate 1 (squares
    weighted by tokens) is the projection of 1 minus a combination of the
    posteriors; its gradient is the domains' misfit. Gradient steps, scaled by
    the joint token matrix of the documents at a positive rate, accumulate and
    the projection acts on their sum. A step is one aggregate over all documents;
    one that does not lessen the objective is shortened (``SIZES``). Only those
    sums and one number per domain are on the driver. The fit ends within
    ``TOLERANCE`` of every target, or where no step lessens the objective
    (targets that no rates reach): ``Fit.totals`` tells how near it came.
    """
    K = range(len(DOMAINS))
    t, p = F.col("n_tokens").cast("double"), [F.col(f"p{k}") for k in K]
    pairs = [(i, j) for i in K for j in K if i <= j]

    def sums(x):
        """All tokens, the tokens times squared rates, the totals and the joint matrix at the multipliers ``x``."""
        at = rows.select("n_tokens", *p, rate([x]).alias("r"))
        r = F.col("r")
        row = list(at.agg(*[F.coalesce(F.sum(v), F.lit(0.0)) for v in (
            t, t * r * r, *[r * t * p[k] for k in K], *[F.when(r > 0, t * p[i] * p[j]) for i, j in pairs])]).first())
        joint = dict(zip(pairs, row[2 + len(K):]))
        return row[0], (row[1], row[2:2 + len(K)], [[joint[min(i, j), max(i, j)] for j in K] for i in K])

    whole, (square, reached, joint) = sums([0.0] * len(DOMAINS))
    goal = [targets[d] * budget * whole for d in DOMAINS]
    for k in range(1, len(DOMAINS)):
        if DOMAINS[k] in at_most and goal[k] > reached[k]:
            goal[0] += goal[k] - reached[k]
            goal[k] = reached[k]

    def objective(square, x):
        return square / 2 + sum(g * v for g, v in zip(goal, x))

    at = [0.0] * len(DOMAINS)
    for _ in range(max_steps if whole else 0):
        miss = [(s - g) / whole for s, g in zip(reached, goal)]
        if max(map(abs, miss)) < TOLERANCE:
            break
        way = _solve([[joint[i][j] / whole + 1e-9 * (i == j) for j in K] for i in K], miss)
        for z in SIZES:
            point = [x + z * w for x, w in zip(at, way)]
            _, there = sums(point)
            if objective(there[0], point) < objective(square, at):
                at, (square, reached, joint) = point, there
                break
        else:
            break
    return Fit([at], goal, reached)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0,
                 max_labelled: int = MAX_LABELLED, at_most: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text_hash, n_tokens, p_<domain>.., rate, misfit`` of every row of
    ``docs`` (doc_id, text); ``misfit`` is the largest difference of a domain's
    expected total from its target, as a share of all tokens.

    The posterior reads the text alone. Null and empty texts have no tokens (any
    rate keeps the totals) and get the rate of their posterior; repeated rows
    get equal rates and count once each; null ids pass through; extra columns
    are ignored. Without labels of two domains the whole corpus is one domain.
    An empty table gives no row.
    """
    rows = cut(posteriors(docs, fit_classifier(docs, labels, max_labelled)))
    fit = fit_rates(rows, targets, budget, at_most=at_most)
    return rows.select("doc_id", "text_hash", "n_tokens", *[
        F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate(fit.steps).alias("rate"),
        F.lit(fit.misfit(budget)).alias("misfit"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0,
        at_most: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part of the
    rate, and once more for the share of ids (by hash) that its fraction is.

    Null and empty texts have the rate of their posterior; repeated rows are
    kept or dropped alike; an empty table stays empty.
    """
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), F.lit(1 << 20)) / float(1 << 20)
    of_id, of_text, own, n = (fresh(docs, x) for x in ("rate_id", "rate_text", "own_text", "n_copies"))
    copies = (mixing_rates(docs, labels, targets, budget, at_most=at_most)
              .select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text),
                      F.floor(F.col("rate") + u).cast("int").alias(n)).where(F.col(n) > 0).distinct())
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return (rows.join(copies, F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_text)))
            .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(own)).select(*docs.columns))
