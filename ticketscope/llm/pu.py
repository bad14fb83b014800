"""Quality classifier from positive and unlabelled documents.

Trusted positives are labelled good; all web text is unlabelled. A linear score
over binned text statistics minimises the non-negative unbiased risk

    prior * E_pos[(1 - g)^2] + max(0, E_unl[(1 + g)^2] - prior * E_pos[(1 + g)^2])

whose squared loss needs the corpus through second moments only: one pass over
all documents gives the exact risk, whatever their number, and the minimisation
is small linear algebra. The squared loss makes (g + 1) / 2 an estimate of the
probability that a document is good.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.common import cut, map_arrow, texts, to_batch, arrow_schema

# The cut points of each statistic's bins.
SHARES = (0.001, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.8)
BINS = {
    "words": (1, 5, 20, 50, 200, 1000, 5000),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 15),
    "upper": SHARES,            # capitals among ASCII letters
    "symbols": SHARES,          # #$%&*+/<=>@\^_`{|}~ among characters
    "exclamation": SHARES,      # ! and ? a word
    "digits": SHARES,           # digits among characters
    "stops": (0.005, 0.02, 0.05, 0.08, 0.12, 0.2, 0.4),  # . and , a word
    "breaks": (0.005, 0.02, 0.05, 0.1, 0.2, 0.5),        # line ends a word
    "bare": SHARES,             # words without a letter or digit
    "same_as_last": SHARES,     # words equal to the word before
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),  # distinct words a word
    "most_common": (0.02, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5),           # share of the commonest word
    "repeated_lines": SHARES,   # lines with a word that an earlier line equals
    "long_words": SHARES,       # words of over 12 bytes
}
WIDTHS = [len(c) + 1 for c in BINS.values()]
OFFSETS = np.cumsum([1, *WIDTHS[:-1]])
#: Columns of the design: an intercept and one per bin.
SIZE = 1 + sum(WIDTHS)

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
WORDLESS = bytes(b for b in range(128) if not chr(b).isalnum())


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def codes(text: bytes) -> bytes:
    """Bin number of each statistic of a text (one byte per statistic)."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lower = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    letters = _count(text, LETTERS)
    x = (
        len(words),
        sum(map(len, words)) / n,
        _count(text, UPPER) / max(1, letters),
        _count(text, SYMBOLS) / size,
        _count(text, b"!?") / n,
        _count(text, DIGITS) / size,
        _count(text, b".,") / n,
        text.count(b"\n") / n,
        sum(c for w, c in lower.items() if not w.translate(None, WORDLESS)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(lower) / n,
        max(lower.values(), default=0) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(c for w, c in lower.items() if len(w) > 12) / n,
    )
    return bytes(int(np.searchsorted(c, v, "right")) for c, v in zip(_CUTS, x))


_CUTS = [np.array(c, float) for c in BINS.values()]


def coded(docs: DataFrame) -> DataFrame:
    """``doc_id, codes`` of every row; null texts count as empty."""
    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "codes": [codes(t) for t in texts(batch)]}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run,
                     "doc_id long, codes binary")


def design(rows: list[bytes]) -> np.ndarray:
    """0/1 matrix of the intercept and the bins."""
    at = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), len(WIDTHS)) + OFFSETS
    x = np.zeros((len(rows), SIZE))
    x[:, 0] = 1
    x[np.arange(len(rows))[:, None], at] = 1
    return x


@dataclass
class Moments:
    """Second moments and counts of the positives and of the unlabelled documents."""
    pos: np.ndarray
    unl: np.ndarray

    @property
    def n_pos(self) -> float:
        return self.pos[0, 0]

    @property
    def n_unl(self) -> float:
        return self.unl[0, 0]


def moments(rows: DataFrame) -> Moments:
    """Sums of x x' over ``rows`` (codes, positive): positives, and all rows.

    Each task adds up its rows; per matrix cell the tasks' sums are added by a
    shuffle, and ``SIZE``^2 cells reach the driver. Rows are few bytes each, so
    a task takes 16 partitions of the table.
    """
    schema = "cell int, pos double, unl double"
    _, target = arrow_schema(schema)

    def run(batches):
        pos, unl = np.zeros((SIZE, SIZE)), np.zeros((SIZE, SIZE))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = design(part.column("codes").to_pylist())
                unl += x.T @ x
                x = x[np.array(part.column("positive").to_pylist(), bool)]
                pos += x.T @ x
        cell = np.flatnonzero(unl)
        yield to_batch({"cell": cell.astype(np.int32), "pos": pos.ravel()[cell], "unl": unl.ravel()[cell]}, target)

    few = rows.select("codes", "positive").coalesce(max(1, rows.rdd.getNumPartitions() // 16))
    sums = few.mapInArrow(run, schema).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl")).toArrow()
    out = Moments(np.zeros(SIZE * SIZE), np.zeros(SIZE * SIZE))
    cell = sums.column("cell").to_numpy()
    out.pos[cell], out.unl[cell] = sums.column("pos").to_numpy(), sums.column("unl").to_numpy()
    return Moments(out.pos.reshape(SIZE, SIZE), out.unl.reshape(SIZE, SIZE))


def minimise(m: Moments, prior: float, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of the least non-negative risk, by preconditioned subgradient
    steps from the unbiased solution; the best iterate is kept."""
    a, b = m.pos / m.n_pos, m.unl / m.n_unl
    mean_p, mean_u, eye = a[0], b[0], ridge * np.eye(SIZE)

    def parts(w):
        up, dn = 1 - 2 * mean_p @ w + w @ a @ w, 1 + 2 * mean_p @ w + w @ a @ w
        return prior * up, 1 + 2 * mean_u @ w + w @ b @ w - prior * dn

    w = np.linalg.solve(b + eye, 2 * prior * mean_p - mean_u)  # where the unbiased risk is least
    scale = b + prior * a + eye
    best, least = w, np.inf
    for k in range(steps):
        up, rest = parts(w)
        risk = up + max(0.0, rest) + w @ eye @ w
        if risk < least:
            best, least = w, risk
        grad = prior * (a @ w - mean_p) + eye @ w
        if rest > 0:
            grad = grad + b @ w + mean_u - prior * (a @ w + mean_p)
        w = w - np.linalg.solve(scale, grad) / (1 + k) ** 0.5
    return best


def values(rows: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Score of each coded document, 0 to 1."""
    at = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), len(WIDTHS)) + OFFSETS
    return np.clip((weights[0] + weights[at].sum(1) + 1) / 2, 0, 1)


def estimate_prior(rows: DataFrame, m: Moments, bins: int = 200) -> float:
    """Share of good documents among the unlabelled, by the best bin of a
    positive-against-unlabelled score.

    Above any threshold the unlabelled hold at least prior times the positives'
    share, with equality where no bad document scores; the least ratio (with
    confidence bounds on both shares) estimates the prior. The scores' exact
    histograms come from all documents, ``bins`` rows each.
    """
    both = m.pos / m.n_pos + m.unl / m.n_unl
    w = np.linalg.solve(both / 2 + 1e-3 * np.eye(SIZE), (m.pos[0] / m.n_pos - m.unl[0] / m.n_unl) / 2)

    @F.pandas_udf("int")
    def spot(c: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(values(list(c), w) * bins, bins - 1).astype(int))

    h = (rows.groupBy(spot("codes").alias("bin"))
         .agg(F.count("*").alias("unl"), F.count_if("positive").alias("pos")).toPandas())
    unl, pos = np.zeros(bins), np.zeros(bins)
    unl[h.bin], pos[h.bin] = h.unl, h.pos
    share_u, share_p = unl[::-1].cumsum() / unl.sum(), pos[::-1].cumsum() / pos.sum()
    slack_u, slack_p = ((np.log(40) / (2 * n)) ** 0.5 for n in (unl.sum(), pos.sum()))
    ok = share_p > 0.05
    at = np.argmin((share_u[ok] + slack_u + slack_p) / share_p[ok])
    return float(np.clip(share_u[ok][at] / share_p[ok][at], 0.01, 0.99))


@dataclass
class Model:
    """Weights over the bins and the prior they were fitted with; ``weights``
    is None if there was no trusted positive, and every score is then 0.5."""
    weights: np.ndarray | None
    prior: float

    def score(self, rows: list[bytes]) -> np.ndarray:
        return np.full(len(rows), 0.5) if self.weights is None else values(rows, self.weights)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the crc32 of the id as text is 0 modulo ``folds`` (null ids: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Model from ``rows`` (doc_id, codes) and trusted positives: ids of
    ``labels`` with quality 1 (and no row that says 0) outside the held-out fold.

    Held-out documents are in neither set. The class prior is estimated unless
    given. Duplicate, null and unknown label rows are harmless.
    """
    good = (labels.selectExpr("cast(doc_id as long) doc_id", "quality").where("doc_id is not null")
            .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q"))
            .where("q = 1").select("doc_id", F.lit(True).alias("positive")))
    train = (rows.where(~held_out(F.col("doc_id"))).join(good, "doc_id", "left")
             .select("codes", F.coalesce("positive", F.lit(False)).alias("positive")))
    train = cut(train)
    m = moments(train)
    if m.n_pos == 0:
        return Model(None, 0.5 if prior is None else prior)
    prior = estimate_prior(train, m) if prior is None else prior
    return Model(minimise(m, prior), prior)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, prior: float | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (doc_id, text).

    The score reads the text alone; empty and null texts are scored like any
    other, repeated rows alike. Extra columns are ignored; without trusted
    positives every score is 0.5.
    """
    rows = cut(coded(docs))
    model = fit(rows, labels, prior)

    @F.pandas_udf("double")
    def score(c: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(c)))

    return (rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("codes").alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``."""
    model = fit(cut(coded(docs)), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score([codes((t or "").encode()) for t in text]))

    return docs.where(score(F.col("text").cast("string")) >= threshold)
