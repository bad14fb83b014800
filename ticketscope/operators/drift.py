"""Two-sample drift statistics between a reference and a current sample.

Both samples are melted into one long table ``(feature, x, sample)``; every
statistic is then a grouped plan over it:

* KS and Wasserstein need the two empirical CDFs on the merged axis.
  Equal values are grouped first (counts per distinct value), then the
  running sums are computed by ``running_totals``: range partitioning on
  (feature, x), a streaming cumulative sum inside each partition, and a
  tiny (partitions x features) offset table. A hot feature is spread over
  many tasks instead of one ordered window.
* PSI and JS use equal-width bins over the joint [min, max] (numpy's
  ``linspace`` edges, last bin closed) with an explicit bin spine so empty
  bins count.
* Chi-square aligns label counts with a full outer join.

Only per-feature rows (a handful) ever carry p-values through Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ticketscope.constants import DRIFT_THRESHOLD, PSI_EPS
from ticketscope.functions.stats import chi2_sf_udf, ks_pvalue
from ticketscope.session import materialize


def melt(ref: DataFrame, cur: DataFrame, features: list[str]) -> DataFrame:
    """(feature, x, sample) for both samples; nulls dropped."""
    def one(df, tag):
        s = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                                          for f in features])).alias("s"))
        return s.select("s.feature", "s.x", F.lit(tag).alias("sample")).where(F.col("x").isNotNull())
    return one(ref, "ref").unionByName(one(cur, "cur"))


def running_totals(df: DataFrame, *, key: str, order: str, cols: list[str],
                   num_partitions: int | None = None) -> DataFrame:
    """Exact running sums of ``cols`` per ``key`` ordered by ``order`` (unique per key).

    Adds ``cum_<col>`` and ``rank`` (1-based position within the key).
    """
    spark = df.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(p, key, order).sortWithinPartitions(key, order)
    in_schema = ordered.schema
    out_schema = StructType(list(in_schema.fields)
                            + [StructField("_pid", IntegerType()), StructField("_lrank", LongType())]
                            + [StructField(f"_l_{c}", DoubleType()) for c in cols])

    def local(batches):
        # vectorised per batch: grouped cumulative sums plus the running
        # carry of each key from earlier batches of this partition
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            g = pdf.groupby(key, sort=False)
            ranks = g.cumcount() + 1
            sums = {c: pdf[c].fillna(0.0).astype("float64").groupby(pdf[key], sort=False).cumsum() for c in cols}
            base = pdf[key].map(lambda k: carry.get(k, (0, [0.0] * len(cols))))
            ranks = ranks + base.map(lambda b: b[0])
            out = {f"_l_{c}": sums[c] + base.map(lambda b, j=j: b[1][j]) for j, c in enumerate(cols)}
            pdf = pdf.assign(_pid=pid, _lrank=ranks.astype("int64"), **out)
            last = pdf.groupby(key, sort=False).tail(1)
            for _, row in last.iterrows():   # one row per key in this batch
                carry[row[key]] = (int(row["_lrank"]), [float(row[f"_l_{c}"]) for c in cols])
            yield pdf

    # materialised once: both the offsets and the rows below must see the
    # same partition ids
    loc = materialize(ordered.mapInPandas(local, schema=out_schema))
    tot = loc.groupBy(key, "_pid").agg(F.max("_lrank").alias("_t_rank"),
                                       *[F.max(f"_l_{c}").alias(f"_t_{c}") for c in cols])
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(key, "_pid", F.coalesce(F.sum("_t_rank").over(w), F.lit(0)).alias("_o_rank"),
                     *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0.0)).alias(f"_o_{c}") for c in cols])
    # off has at most (partitions x keys) rows: bounded, broadcast
    j = loc.join(F.broadcast(off), [key, "_pid"])
    return j.select(*in_schema.fieldNames(), (F.col("_lrank") + F.col("_o_rank")).alias("rank"),
                    *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols])


def _cdf_table(long: DataFrame, num_partitions: int | None = None) -> DataFrame:
    counts = long.groupBy("feature", "x").agg(F.count_if(F.col("sample") == "ref").cast("double").alias("c_ref"),
                                              F.count_if(F.col("sample") == "cur").cast("double").alias("c_cur"))
    cdf = running_totals(counts, key="feature", order="x", cols=["c_ref", "c_cur"], num_partitions=num_partitions)
    n = long.groupBy("feature").agg(F.count_if(F.col("sample") == "ref").alias("n_ref"),
                                    F.count_if(F.col("sample") == "cur").alias("n_cur"))
    return cdf.join(F.broadcast(n), "feature").select(
        "feature", "x", "rank", "n_ref", "n_cur",
        (F.col("cum_c_ref") / F.col("n_ref")).alias("F_ref"), (F.col("cum_c_cur") / F.col("n_cur")).alias("F_cur"))


def drift_ks(long: DataFrame, *, threshold: float = DRIFT_THRESHOLD, cdf: DataFrame | None = None) -> DataFrame:
    """Per feature: KS statistic, asymptotic p-value, drift flag."""
    cdf = cdf if cdf is not None else _cdf_table(long)
    g = cdf.groupBy("feature").agg(F.max(F.abs(F.col("F_ref") - F.col("F_cur"))).alias("ks_statistic"),
                                   F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))
    p = ks_pvalue(F.col("ks_statistic"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    return g.select("feature", "ks_statistic", p.alias("p_value")).withColumn(
        "drift_detected", F.col("p_value") < threshold)


def drift_wasserstein(long: DataFrame, *, cdf: DataFrame | None = None) -> DataFrame:
    """Per feature 1-D W1 = sum |F_ref - F_cur| * (next x - x) over distinct values.

    The next distinct value comes from an equi-join on (feature, rank + 1).
    """
    cdf = cdf if cdf is not None else _cdf_table(long)
    nxt = cdf.select("feature", (F.col("rank") - 1).alias("rank"), F.col("x").alias("x_next"))
    j = cdf.join(nxt, ["feature", "rank"])
    return j.groupBy("feature").agg(
        F.sum(F.abs(F.col("F_ref") - F.col("F_cur")) * (F.col("x_next") - F.col("x"))).alias("wasserstein_distance"))


def _binned(long: DataFrame, edges: int) -> DataFrame:
    """(feature, bin, r, c): shares per bin over numpy-style linspace edges, + eps."""
    nb = edges - 1
    rng = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                      F.count_if(F.col("sample") == "ref").alias("n_ref"),
                                      F.count_if(F.col("sample") == "cur").alias("n_cur"))
    w = F.col("hi") - F.col("lo")
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * nb / w), F.lit(nb - 1)))
    # rng has one row per feature: bounded, broadcast
    x = long.join(F.broadcast(rng), "feature").withColumn("bin", b.cast("int"))
    nbins = F.when(w == 0, F.lit(1)).otherwise(F.lit(nb))
    counts = x.groupBy("feature", "bin").agg(F.count_if(F.col("sample") == "ref").alias("cr"),
                                             F.count_if(F.col("sample") == "cur").alias("cc"))
    spine = rng.select("feature", "n_ref", "n_cur",
                       F.explode(F.sequence(F.lit(0), nbins - 1)).alias("bin"))
    s = spine.join(counts, ["feature", "bin"], "left").na.fill(0, ["cr", "cc"])
    return s.select("feature", "bin", (F.col("cr") / F.col("n_ref") + PSI_EPS).alias("r"),
                    (F.col("cc") / F.col("n_cur") + PSI_EPS).alias("c"))


def drift_psi(long: DataFrame, *, edges: int = 10) -> DataFrame:
    """Per feature PSI = sum (c - r) ln(c / r) over 9 bins."""
    b = _binned(long, edges)
    return b.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))


def psi_label(psi: Column) -> Column:
    return (F.when(psi < 0.1, F.lit("No significant change")).when(psi < 0.2, F.lit("Minor change"))
            .otherwise(F.lit("Major change - model may need retraining")))


def drift_js(long: DataFrame, *, edges: int = 20) -> DataFrame:
    """Per feature JS divergence (natural log) over 19 bins; both sides renormalised."""
    b = _binned(long, edges)
    w = Window.partitionBy("feature")
    b = b.withColumn("p", F.col("r") / F.sum("r").over(w)).withColumn("q", F.col("c") / F.sum("c").over(w))
    b = b.withColumn("m", 0.5 * (F.col("r") + F.col("c")))
    b = b.withColumn("mm", F.col("m") / F.sum("m").over(w))
    return b.groupBy("feature").agg(
        (0.5 * F.sum(F.col("p") * F.ln(F.col("p") / F.col("mm")))
         + 0.5 * F.sum(F.col("q") * F.ln(F.col("q") / F.col("mm")))).alias("js_divergence"))


def drift_chi2(ref: DataFrame, cur: DataFrame, *, label_col: str = "label",
               threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Chi-square of current label counts against reference counts scaled to
    the current total (quirk 3); unseen reference classes are listed, not summed."""
    r = ref.groupBy(label_col).agg(F.count("*").alias("ref_count"))
    c = cur.groupBy(label_col).agg(F.count("*").alias("cur_count"))
    j = r.join(c, label_col, "full_outer").na.fill(0, ["ref_count", "cur_count"])
    tot = j.agg(F.sum("ref_count").alias("nr"), F.sum("cur_count").alias("nc"))
    nr = tot.select("nr").scalar()
    nc = tot.select("nc").scalar()
    e = F.col("ref_count") * nc / nr
    g = j.agg(F.sum(F.when(F.col("ref_count") > 0, F.pow(F.col("cur_count") - e, 2) / e)).alias("chi2_statistic"),
              (F.count_if(F.col("ref_count") > 0) - 1).alias("dof"),
              F.array_sort(F.collect_list(F.when(F.col("ref_count") == 0, F.col(label_col)))).alias("unseen_classes"))
    return (g.withColumn("p_value", chi2_sf_udf(F.col("chi2_statistic"), F.col("dof").cast("double")))
            .withColumn("drift_detected", F.col("p_value") < threshold))


#: Bins of a feature, and the grid that log-odds are rounded to, in the domain classifier.
DOMAIN_BINS, DOMAIN_GRID = 20, 1 << 20


def drift_domain_classifier(ref: DataFrame, cur: DataFrame, features: list[str], *, id_col: str = "id",
                            threshold: float = 0.7) -> DataFrame:
    """Covariate shift by a cross-fitted domain classifier: (n, auc, drift_detected).

    Rows fall into two halves by a digest of their id. Per half, feature and
    bin, the log-odds of the current sample against the reference are learned
    (each class weighs the same whatever its size, one smoothing count per
    bin); a row's score adds the log-odds that the OTHER half learned, so no
    row is scored by itself. Scores are whole numbers on a fixed grid, ties
    count half. One plan: the odds table has halves x features x bins rows.
    """
    xs = F.array(*[F.col(f).cast("double") for f in features]).alias("x")

    def one(df, tag):
        return df.select(F.col(id_col).cast("string").alias("id"), F.lit(tag).alias("sample"), xs)

    half = F.when(F.substring(F.md5(F.concat_ws(":", "sample", "id")), 1, 1) < "8", 0).otherwise(1)
    both = one(ref, "ref").unionByName(one(cur, "cur")).withColumn("half", half)
    lo, hi = (both.agg(F.array(*[end(F.col("x")[i]) for i in range(len(features))]).alias("e")).scalar() for end in (F.min, F.max))

    def bin_of(x, i):
        a, b = F.get(F.col("lo"), i), F.get(F.col("hi"), i)
        inside = F.least(F.floor((x - a) * DOMAIN_BINS / (b - a)), F.lit(DOMAIN_BINS - 1))
        return F.when(x.isNull(), -1).when(a == b, 0).otherwise(inside).cast("int")

    binned = (both.withColumn("lo", lo).withColumn("hi", hi)
              .select("sample", "half", F.transform("x", bin_of).alias("bins")))
    # identical (sample, half, bins) rows count together from here on
    cells = binned.groupBy("sample", "half", "bins").agg(F.count("*").alias("c"))
    long = cells.select("half", "sample", "c", F.posexplode("bins").alias("feature", "bin"))
    n = cells.groupBy("half").agg(F.sum(F.when(F.col("sample") == "ref", F.col("c")).otherwise(0)).alias("n_ref"),
                                  F.sum(F.when(F.col("sample") == "cur", F.col("c")).otherwise(0)).alias("n_cur"))
    seen = long.groupBy("half", "feature", "bin").agg(
        F.sum(F.when(F.col("sample") == "ref", F.col("c")).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("sample") == "cur", F.col("c")).otherwise(0)).alias("c"))
    odds = F.ln((F.col("c") + 1.0) / (F.col("n_cur") + DOMAIN_BINS)) - F.ln((F.col("r") + 1.0) / (F.col("n_ref") + DOMAIN_BINS))
    learned = seen.join(F.broadcast(n), "half").select(
        (1 - F.col("half")).alias("half"), "feature", "bin", F.round(odds * DOMAIN_GRID).cast("long").alias("v"))
    # per half an array over features of arrays over bins: read by position, a map would be searched for every feature of every row
    by_bin = learned.groupBy("half", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m")).select(
        "half", "feature", F.transform(F.sequence(F.lit(-1), F.lit(DOMAIN_BINS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("long"))).alias("of"))
    tables = by_bin.groupBy("half").agg(F.map_from_entries(F.collect_list(F.struct("feature", "of"))).alias("f")).select(
        "half", F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.element_at("f", i)).alias("v"))
    # two rows of features x bins numbers: bounded, broadcast; a half that learned nothing gives zeros
    scored = cells.join(F.broadcast(tables), "half", "left").withColumn("score", F.aggregate(
        F.transform("bins", lambda b, i: F.coalesce(F.get(F.get("v", i), b + 1), F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, v: a + v))
    by_score = scored.groupBy("score").agg(F.sum(F.when(F.col("sample") == "ref", F.col("c")).otherwise(0)).cast("double").alias("c_ref"),
                                           F.sum(F.when(F.col("sample") == "cur", F.col("c")).otherwise(0)).cast("double").alias("c_cur"))
    cum = running_totals(by_score.withColumn("one", F.lit(1)), key="one", order="score", cols=["c_ref"])
    auc = F.sum(F.col("c_cur") * (F.col("cum_c_ref") - F.col("c_ref") / 2)) / (F.sum("c_cur") * F.sum("c_ref"))
    out = cum.agg(F.sum(F.col("c_ref") + F.col("c_cur")).cast("long").alias("n"), auc.alias("auc"))
    return out.withColumn("drift_detected", F.col("auc") > threshold)


def drift_report(ref: DataFrame, cur: DataFrame, features: list[str], *, label_col: str | None = "label",
                 id_col: str | None = "id", threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """One row per method: (method, score, drift_detected). Six methods; without
    ``label_col`` the chi-square row is left out, without ``id_col`` the
    covariate-shift row, as methods that could not run."""
    long = melt(ref, cur, features).cache()
    cdf = _cdf_table(long).cache()
    ks = drift_ks(long, threshold=threshold, cdf=cdf).agg(
        F.lit("ks_test").alias("method"), F.avg("p_value").alias("score"),
        F.bool_or("drift_detected").alias("drift_detected"))
    psi = drift_psi(long).agg(F.avg("psi").alias("score")).select(
        F.lit("psi").alias("method"), "score", (F.col("score") > 0.1).alias("drift_detected"))
    js = drift_js(long).agg(F.avg("js_divergence").alias("score")).select(
        F.lit("js_divergence").alias("method"), "score", (F.col("score") > 0.1).alias("drift_detected"))
    stds = ref.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features])
    ref_std = stds.select(sum(F.col(f) for f in features) / len(features)).scalar()
    wd = drift_wasserstein(long, cdf=cdf).agg(F.avg("wasserstein_distance").alias("w")).select(
        F.lit("wasserstein").alias("method"), (F.col("w") / ref_std).alias("score"),
        ((F.col("w") / ref_std) > 0.1).alias("drift_detected"))
    out = ks.unionByName(psi).unionByName(js).unionByName(wd)
    if label_col is not None:
        ch = drift_chi2(ref, cur, label_col=label_col, threshold=threshold).select(
            F.lit("chi2_test").alias("method"), F.col("p_value").alias("score"), "drift_detected")
        out = out.unionByName(ch)
    if id_col is not None:
        out = out.unionByName(drift_domain_classifier(ref, cur, features, id_col=id_col).select(
            F.lit("covariate_shift").alias("method"), F.col("auc").alias("score"), "drift_detected"))
    return out


def drift_assess(report: DataFrame) -> DataFrame:
    """Share of valid methods voting drift; > 0.5 means drift."""
    v = report.where(F.col("drift_detected").isNotNull())
    g = v.agg(F.avg(F.col("drift_detected").cast("int")).alias("drift_score"),
              F.count_if("drift_detected").alias("methods_detecting_drift"),
              F.count("*").alias("total_methods"))
    return g.withColumn("overall_drift_detected", F.col("drift_score") > 0.5).withColumn(
        "severity", F.when(F.col("drift_score") > 0.7, F.lit("high")).otherwise(F.lit("medium")))


def drift_recommend(report: DataFrame) -> DataFrame:
    """Recommendation messages from the method rows (one row)."""
    g = report.agg(F.max(F.when(F.col("method") == "psi", F.col("score"))).alias("psi"),
                   F.count_if("drift_detected").alias("n"),
                   F.bool_or(F.when(F.col("method") == "covariate_shift", F.col("drift_detected"))).alias("cov"))
    msgs = F.array(
        F.when(F.col("psi") > 0.2, F.lit("Major distribution shift detected - immediate model retraining recommended"))
        .when(F.col("psi") > 0.1, F.lit("Moderate distribution shift - monitor closely and consider retraining")),
        F.when(F.col("cov"), F.lit("Covariate shift detected - review feature engineering and data sources")),
        F.when(F.col("n") >= 3, F.lit("Multiple drift indicators - comprehensive model review needed"))
        .when(F.col("n") >= 2, F.lit("Some drift indicators present - increase monitoring frequency")))
    return g.select(F.filter(msgs, lambda m: m.isNotNull()).alias("recommendations"))


def drift_history(reports: DataFrame, *, as_of=None, days: int = 30) -> DataFrame:
    from ticketscope.operators._util import as_of_col
    t = as_of_col(reports, as_of)
    return reports.where(F.col("ts") > t - F.make_dt_interval(F.lit(days)))


def drift_summary(reports: DataFrame, *, as_of=None, days: int = 7) -> DataFrame:
    """7-day mean drift score, number of drift reports, latest report."""
    h = drift_history(reports, as_of=as_of, days=days)
    return h.agg(F.avg("drift_score").alias("avg_drift_score"),
                 F.count_if("overall_drift_detected").alias("drift_detections"),
                 F.count("*").alias("total_checks"),
                 F.max_by(F.struct("ts", "drift_score", "overall_drift_detected"), "ts").alias("latest"))


def drift_covariate_shift(ref: DataFrame, cur: DataFrame, features: list[str], *, id_col: str = "id",
                          seed: int = 42, threshold: float = 0.7) -> DataFrame:
    """Train a classifier to tell the samples apart; AUC > 0.7 means shift.

    Equal-size samples chosen by xxhash64(id) (quirk 19: no row order in a
    DataFrame), 70/30 split by a second hash, random forest of 100 trees.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    nr = ref.select(F.count("*")).scalar()
    nc = cur.select(F.count("*")).scalar()
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(2 ** 31)) / float(2 ** 31))

    def take(df, n_self, lab):
        # balanced sample by hash: keep a min(n, m) / n_self fraction of each
        # sample (deterministic, no global sort); sampling is this test's design
        frac = F.least(nr, nc) / n_self
        return df.where(u < frac).withColumn("label", F.lit(lab))

    both = take(ref.select(id_col, *features), nr, 0.0).unionByName(take(cur.select(id_col, *features), nc, 1.0))
    both = VectorAssembler(inputCols=features, outputCol="features").transform(both)
    split = F.abs(F.xxhash64(F.col(id_col), F.lit(seed + 1))) % 10 < 7
    train, test = both.where(split), both.where(~split)
    model = RandomForestClassifier(numTrees=100, seed=seed).fit(train)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(model.transform(test))
    return ref.sparkSession.createDataFrame([("covariate_shift", float(auc), bool(auc > threshold))],
                                            "method string, score double, drift_detected boolean")
