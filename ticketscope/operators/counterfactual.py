"""Counterfactual texts of a linear text model by incremental rescoring.

Replacing a word moves a document's TF-IDF vector in a handful of terms, so the
class scores and the vector's norm after the change follow from those before it
and the few terms; no rewritten text is built or scored. Works on the pipelines
of ``ml_train_pipeline`` with a logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ticketscope.functions.text import default_stopwords, txt_clean
from ticketscope.operators.explain import CLASS_LEXICON

#: Positions that are scored at a time; a text's scan ends with its last wanted hit.
POSITIONS = 256
#: Class and confidence of a text without words (as in ``ml_predict_batch``).
NO_TEXT = ("General Inquiry", 0.0)


@dataclass(frozen=True)
class LinearText:
    """A fitted pipeline as arrays: (term -> index), idf, weights (classes x terms), intercepts."""

    index: dict
    idf: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    labels: tuple
    stop: frozenset

    @staticmethod
    def of(model: PipelineModel) -> "LinearText":
        by = {type(s).__name__: s for s in model.stages}
        clf = by["LogisticRegressionModel"]
        weights, intercept = clf.coefficientMatrix.toArray(), clf.interceptVector.toArray()
        if len(intercept) == 1:  # binomial form: one row for the second class
            weights, intercept = np.vstack((-weights, weights)) / 2, np.array([-intercept[0], intercept[0]]) / 2
        idf = by["ElementwiseProduct"].getScalingVec().toArray()
        return LinearText({t: k for k, t in enumerate(by["CountVectorizerModel"].vocabulary)}, idf, weights * idf,
                          intercept, tuple(by["IndexToString"].getLabels()), frozenset(default_stopwords()))

    def term(self, word: str) -> int:
        """Index of a cleaned word, -1 if the model does not read it."""
        return self.index.get(word, -1) if len(word) > 1 and word not in self.stop else -1


class Scored:
    """One text: what each change of words does to its class scores."""

    def __init__(self, m: LinearText, words: list[str]):
        self.m = m
        self.terms = np.array([m.term(w) for w in words], np.int64)
        self.read = np.array([w not in m.stop for w in words], bool)  # words left in the processed text
        known, self.tf = np.unique(self.terms[self.terms >= 0], return_counts=True)
        self.times = dict(zip(known.tolist(), self.tf.tolist()))
        self.sums = m.weights[:, known] @ self.tf if len(known) else np.zeros(len(m.labels))
        self.square = float(((self.tf * m.idf[known]) ** 2).sum())

    def change(self, drop: np.ndarray, add: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (rows: one per entry of ``drop``) after dropping the word at
        that position (-1: none) and adding the words ``add``; whether words are left."""
        m = self.m
        gone = np.where(drop >= 0, self.terms[drop] if len(self.terms) else -1, -1)
        has = gone >= 0
        tf = np.array([self.times.get(t, 0) for t in gone.tolist()])
        sums = np.repeat(self.sums[None], len(drop), 0)
        sums[has] -= m.weights[:, gone[has]].T
        square = np.full(len(drop), self.square)
        square[has] -= m.idf[gone[has]] ** 2 * (2 * tf[has] - 1)
        count = self.tf.sum() - has
        for k, word in enumerate(add):
            t = m.term(word)
            if t < 0:
                continue
            already = self.times.get(t, 0) + sum(m.term(x) == t for x in add[:k]) - (gone == t)
            sums += m.weights[:, t]
            square += m.idf[t] ** 2 * (2 * already + 1)
            count = count + 1
        norm = np.sqrt(np.maximum(np.where(count > 0, square, 0.0), 0.0))
        logits = m.intercept + np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1.0)[:, None], 0.0)
        odds = np.exp(logits - logits.max(1, keepdims=True))
        dropped = self.read[drop] if len(self.read) else np.zeros(len(drop), bool)
        left = self.read.sum() - np.where(drop >= 0, dropped, False) + sum(w not in m.stop for w in add)
        return odds / odds.sum(1, keepdims=True), left > 0

    def label(self, probs: np.ndarray, has_words: bool) -> tuple[str, float]:
        return (self.m.labels[int(probs.argmax())], float(probs.max())) if has_words else NO_TEXT


def explain(m: LinearText, words: list[str], target: str | None, lexicon: dict, max_keywords: int, max_replacements: int,
            max_phrases: int, max_out: int) -> dict:
    """Counterfactuals of one cleaned text; ``lexicon`` maps a class to its keywords and phrases, as (term, cleaned words)."""
    s = Scored(m, words)
    probs, has = s.change(np.array([-1]), [])
    original, confidence = s.label(probs[0], bool(has[0]))
    if target is None:  # the second most likely class
        order = np.argsort(-probs[0], kind="stable")
        target = m.labels[order[1]] if len(order) > 1 else original
    keywords, phrases = lexicon.get(target, ((), ()))
    found: list[dict] = []

    def note(kind: str, pos: int | None, term: str, p: np.ndarray, has_words: bool) -> bool:
        label, conf = s.label(p, has_words)
        if label == target:
            found.append({"change_type": kind, "pos": pos, "replaced": None if pos is None else words[pos], "term": term,
                          "new_class": label, "confidence": conf, "confidence_change": conf - confidence})
        return label == target

    n_hits, at, tried = 0, 0, keywords[:max_keywords]
    goal = m.labels.index(target) if target in m.labels else -1
    while tried and at < len(words) and n_hits < max_replacements:
        drop = np.arange(at, min(at + POSITIONS, len(words)))
        scored = [s.change(drop, add) for _, add in tried]
        hit = np.stack([(p.argmax(1) == goal) & h | (~h & (target == NO_TEXT[0])) for p, h in scored], 1)
        for row, k in zip(*np.nonzero(hit)):
            n_hits += note("word_replacement", int(drop[row]), tried[k][0], scored[k][0][row], bool(scored[k][1][row]))
            if n_hits == max_replacements:
                break
        at += POSITIONS
    for term, add in phrases[:max_phrases]:
        p, h = s.change(np.array([-1]), add)
        note("phrase_addition", None, term, p[0], bool(h[0]))
    return {"original_class": original, "original_confidence": confidence, "target_class": target,
            "success_rate": sum(x["new_class"] == target for x in found) / max(1, len(found)),
            "counterfactuals": found[:max_out]}


RESULT = ("original_class string, original_confidence double, target_class string, success_rate double, "
          "counterfactuals array<struct<change_type:string,pos:int,replaced:string,term:string,new_class:string,"
          "confidence:double,confidence_change:double>>")


def ex_counterfactual_linear(df: DataFrame, model: PipelineModel, *, id_col: str, text_col: str, target_col: str | None = None,
                             lexicon: dict | None = None, max_keywords: int = 5, max_replacements: int = 3,
                             max_phrases: int = 3, max_out: int = 5) -> DataFrame:
    """Per text: its class and the changes that make it the target class (one row per row).

    The target is ``target_col``, where null (or without the column) the second
    most likely class. Every word of the cleaned text is tried with the class's
    first ``max_keywords`` keywords, by position and keyword, up to the third
    hit; then each phrase is appended. ``confidence_change`` is against the
    text's own confidence; ``success_rate`` is the share of listed changes that
    reach the target (0 without one). Null and empty texts have the class
    General Inquiry at 0.0. A map without a shuffle: the model's arrays (its
    vocabulary bound times the classes) are broadcast, a task holds one text.
    """
    spark = df.sparkSession
    m = spark.sparkContext.broadcast(LinearText.of(model))
    lex = {c: ([(t, clean_words(t)) for t in kw], [(t, clean_words(t)) for t in ph])
           for c, (kw, ph) in (lexicon or CLASS_LEXICON).items()}
    kind = StructType([df.schema[id_col]])
    schema = StructType([*kind.fields, *StructType.fromDDL(RESULT).fields])
    target = to_arrow_schema(schema)
    limits = (max_keywords, max_replacements, max_phrases, max_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, POSITIONS):
                part = batch.slice(at, POSITIONS)
                rows = [explain(m.value, text.split(), goal, lex, *limits)
                        for text, goal in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array([r[f.name] for r in rows], f.type) for f in list(target)[1:]], schema=target)

    goal = F.col(target_col).cast("string") if target_col else F.lit(None).cast("string")
    return df.select(F.col(id_col), txt_clean(text_col).alias("_text"), goal.alias("_goal")).mapInArrow(run, schema)


def clean_words(term: str) -> list[str]:
    """Words of a lexicon term as text cleaning leaves them (letters and blanks only, lower case)."""
    return "".join(c for c in term.lower() if "a" <= c <= "z" or c.isspace()).split()


def changed_text(text: Column, pos: Column, term: Column) -> Column:
    """The text a counterfactual stands for: word ``pos`` of the cleaned text replaced, or the term appended (null ``pos``)."""
    ws = F.split(text, " ")
    swapped = F.array_join(F.transform(ws, lambda w, i: F.when(i == pos, term).otherwise(w)), " ")
    return F.when(pos.isNull(), F.concat_ws(" ", text, term)).otherwise(swapped)
