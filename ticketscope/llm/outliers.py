"""Quality rules with robust multivariate outliers.

Per language and source, minimum-covariance-determinant estimates of location
and scatter are fitted to transformed text statistics; documents whose
Mahalanobis distance is too large are rejected, besides those that fail the
base rules. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import BROADCAST_ROWS, cut, fresh

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Transformed statistics (see ``transformed``).
X = ["x1", "x2", "x3", "x4", "x5"]
CELLS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
GROUP = ["lang", "source"]
#: Variance added to each transformed statistic, on the scale of its own range:
#: a spread that is never held against a document, also where over half of a
#: group does not vary at all. Each alone can pass ``CUTOFF``: x4 reaches 0.3,
#: so its floor is that of a spread of 3 % repeated words.
FLOOR = (0.25, 0.04, 0.04, 0.001, 0.1)
#: Words of the usual kind (5 characters, no symbol, no repeat) that each rate is
#: smoothed with, so that few words give no extreme rate.
SMOOTH = 50
#: Share of a group's documents in the subset of least determinant.
SUBSET = 0.75
#: Makes the scatter of a normal sample's nearest 75 % that of the sample (5 dimensions).
CONSISTENCY = 1.42
#: Concentration steps from each start.
STEPS = 3
#: Distances are ranked in bins of this width of their logarithm; a subset ends with a whole bin.
BIN = 1 / 64
#: Squared distance above which a document is rejected: the 0.999 quantile of
#: chi-square with 5 degrees of freedom.
CUTOFF = 20.515
#: Parts that a hot group is dealt into where the estimates are too many to broadcast.
SALTS = 32


def _once(rows: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """``rows`` with the columns ``made`` as a generator's output: unlike a
    projection, neither a filter nor a later expression inlines it, so the
    arrays below are built once per row and not once per element."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def base_stats(docs: DataFrame) -> DataFrame:
    """Counts over the words of every whole text and the base verdict.

    ``n_repeat_words``: words inside windows of 8 words that occur twice or
    more in the text. Windows are compared by hash within their row; only rows
    with an equal pair are sorted, so a text of n words costs n log n at most.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = ["doc_id", *GROUP]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), t.alias("t"))
    rows = _once(
        rows, *ids,
        lines=F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        word_chars=F.length(F.regexp_replace("t", SPACE, "")).cast("long"),
        n_symbols=F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        h=F.transform(F.array_remove(F.split("t", SPACE), ""), lambda w: F.xxhash64(w)))
    rows = _once(
        rows, *ids, "word_chars", "n_symbols", n_words=F.size("h").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        win=F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)),
                                                      lambda i: F.xxhash64(F.slice("h", i, WINDOW)))))
    rows = _once(rows, *ids, *counts, s=F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = F.filter("s", lambda e, k: F.coalesce(F.get("s", k - 1)["h"] == e["h"], F.lit(False))
                    | F.coalesce(F.get("s", k + 1)["h"] == e["h"], F.lit(False)))
    rows = _once(rows, *ids, *counts, p=F.sort_array(F.transform(same, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    rows = _once(rows, *ids, *counts, n_repeat_words=F.coalesce(covered, F.lit(0).cast("long")))
    return rows.withColumn("base_failed", (F.col("n_words") < 20)
                           | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def transformed(rows: DataFrame) -> DataFrame:
    """``rows`` with the group key ``g`` and the transformed statistics: log
    words, mean word length, log symbol rate, share of repeated words and log
    repeated lines."""
    n = F.col("n_words") + SMOOTH
    return rows.withColumns({
        "g": F.to_json(F.struct(*GROUP)),
        "x1": F.log1p("n_words"),
        "x2": (F.col("word_chars") + 5 * SMOOTH) / n,
        "x3": F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 5 * SMOOTH)),
        "x4": F.col("n_repeat_words") / n,
        "x5": F.log1p("n_dup_lines"),
    })


def _attach(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each row with its group's estimates. They are broadcast only if they are
    few; otherwise rows of a group are dealt into salted parts."""
    if estimates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(estimates), "g")
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *X), F.lit(SALTS)).cast("int")).join(
        salted, ["g", "salt"]).drop("salt")


def _cell(i: int, j: int) -> str:
    return f"l{max(i, j)}{min(i, j)}"


def _factor(scatter: DataFrame) -> DataFrame:
    """Cholesky factor of the scatter in columns ``s<i><j>``, as columns
    ``l<i><j>``, and the logarithm of its determinant."""
    out = scatter
    for j in range(len(X)):
        done = sum((F.col(_cell(j, k)) ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(_cell(j, j), F.sqrt(F.col(f"s{j}{j}") - done))
        out = out.withColumns({_cell(i, j): (F.col(f"s{i}{j}") - sum(
            (F.col(_cell(i, k)) * F.col(_cell(j, k)) for k in range(j)), F.lit(0.0))) / F.col(_cell(j, j))
            for i in range(j + 1, len(X))})
    log_det = sum((2 * F.log(_cell(i, i)) for i in range(len(X))), F.lit(0.0))
    return out.withColumn("log_det", log_det).drop(*[f"s{i}{j}" for i, j in CELLS])


def _with_distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution."""
    for i, x in enumerate(X):
        rest = sum((F.col(_cell(i, k)) * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(x) - F.col(f"m{i}") - rest) / F.col(_cell(i, i)))
    return rows.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(len(X))), F.lit(0.0))).drop(
        *[f"y{i}" for i in range(len(X))])


def _estimates(rows: DataFrame, scale: float) -> DataFrame:
    """Mean and factored scatter per group and start of ``rows`` (x1.., start),
    from sums of deviations from ``m0..``, the last location."""
    dev = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    sums = rows.groupBy("g", "start").agg(
        F.count("*").alias("n"), *[F.first(f"m{i}").alias(f"c{i}") for i in range(len(X))],
        *[F.avg(d).alias(f"a{i}") for i, d in enumerate(dev)],
        *[F.avg(dev[i] * dev[j]).alias(f"b{i}{j}") for i, j in CELLS])
    scatter = sums.select(
        "g", "start", *[(F.col(f"c{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(len(X))],
        *[(scale * F.greatest(F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}"), F.lit(0.0)) + FLOOR[i]
           if i == j else scale * (F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}"))).alias(f"s{i}{j}")
          for i, j in CELLS])
    return cut(_factor(scatter))


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts per group: the medians with the floors' scatter, and the
    classical mean and scatter of all its documents."""
    medians = cut(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)]))
    flat = medians.select("*", F.lit(0).alias("start"), *[
        F.lit((4 * FLOOR[i]) ** 0.5 if i == j else 0.0).alias(_cell(i, j)) for i, j in CELLS],
        F.lit(sum(math.log(4 * v) for v in FLOOR)).alias("log_det"))
    classical = _estimates(_attach(rows, medians.withColumn("start", F.lit(1))), 1.0)
    return cut(flat.unionByName(classical))


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: estimates from the ``SUBSET`` nearest documents
    of each group. Their border is read off a histogram of distances, one row
    per group and bin whatever the group's size."""
    near = _with_distance(_attach(rows, estimates)).withColumn(
        "bin", F.floor(F.log(F.col("d2") + 1e-9) / BIN).cast("int"))
    up = Window.partitionBy("g", "start").orderBy("bin")
    whole = Window.partitionBy("g", "start")
    border = (near.groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
              .withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(whole)})
              .where(F.col("upto") >= F.col("all") * SUBSET).groupBy("g", "start").agg(F.min("bin").alias("border")))
    bounded = cut(estimates.join(border, ["g", "start"]))
    inside = _with_distance(_attach(rows, bounded)).where(
        F.floor(F.log(F.col("d2") + 1e-9) / BIN).cast("int") <= F.col("border"))
    return _estimates(inside, CONSISTENCY)


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant location and factored scatter per group
    ``g``: of the starts' ends, the one of least determinant."""
    e = _starts(rows)
    for _ in range(steps):
        e = _concentrate(rows, e)
    best = Window.partitionBy("g").orderBy("log_det", "start")  # two rows a group
    return cut(e.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "start", "log_det"))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """Counts, base verdict, squared distance ``d2`` and ``kept`` of every row
    of ``docs`` (doc_id, text, lang, source).

    Estimates come from all documents that pass the base rules. The scatter of
    a group is its subset's plus ``FLOOR``, so a group of one document or of
    equal ones has a defined distance (0). Null lang and source are groups of
    their own; null and empty texts have no words and fail the base rules
    (``d2`` is null for these); rows without a doc_id and repeated rows each get
    a row; extra columns are ignored. Texts are read once; the steps read the
    table of counts.
    """
    rows = cut(transformed(base_stats(docs)))
    fit = rows.where(~F.col("base_failed")).select("doc_id", "g", *X)
    e = robust_estimates(fit, steps)
    judged = _with_distance(_attach(rows.where(~F.col("base_failed")), e))
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = rows.where("base_failed").select(*kept, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    return failed.unionByName(judged.select(*kept, (F.col("d2") <= cutoff).alias("kept"), "d2"))


def keep_regular(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    kept_id = fresh(docs, "kept_id")
    good = quality_rules(docs, cutoff).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
