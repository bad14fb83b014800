"""Ticket text preprocessing: clean -> stop words -> lemma (as column plans)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ticketscope.functions.text import squeeze, txt_clean, txt_stopwords
from ticketscope.session import materialize

#: A slice of texts has up to 2^SLICE_BITS rows and about that many times ROW_BYTES of text, or one row.
SLICE_BITS = 10
ROW_BYTES = 4096


def txt_lemma(df: DataFrame, text_col: str, lemmas: DataFrame | None = None, out: str = "lemmatized", *,
              id_col: str | None = None) -> DataFrame:
    """Replace each word by its lemma from a ``(word, lemma)`` table; identity
    without one (the behaviour when no language model is loaded).

    Texts are kept once, in slices of neighbouring rows. Only the different words
    of a slice meet the lemma table; a task then rewrites a slice's texts with the
    lemmas of its words, so rows stay as they are, whatever their ids (``id_col``)
    and however often they come. A word with several lemmas takes the first in
    order; a null text gives an empty one.
    """
    if lemmas is None:
        return df.withColumn(out, F.col(text_col))
    if id_col is None:
        raise ValueError("txt_lemma needs id_col: the column that names the texts")
    rows = [c for c in df.columns if c != out]
    kept = df.select(F.struct(*[df[c] for c in rows]).alias("row"), F.coalesce(squeeze(text_col), F.lit("")).alias("t"),
                     F.monotonically_increasing_id().alias("n"))
    # longer texts stand in slices of fewer rows: one bit less with each doubling
    longer = F.ceil(F.log2(F.greatest(F.octet_length("t"), F.lit(ROW_BYTES)) / ROW_BYTES)).cast("int")
    kept = kept.withColumn("bits", F.greatest(F.lit(SLICE_BITS) - longer, F.lit(0)))
    kept = materialize(kept.select("row", "t", "bits", F.expr("shiftright(n, bits)").alias("slice")))

    own = kept.select("slice", "bits", F.explode(F.array_distinct(F.split("t", " "))).alias("word")).distinct()
    one = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma")).where(F.col("lemma") != F.col("word"))
    known = own.join(one, "word").select(F.col("slice").alias("of_slice"), F.col("bits").alias("of_bits"), "word", "lemma")
    schema = StructType([*kept.schema["row"].dataType.fields]).add(out, StringType())
    target = to_arrow_schema(schema)

    def rewrite(texts: pa.Table, found: pa.Table) -> pa.Table:
        split = pc.split_pattern(texts["t"].combine_chunks(), " ")
        words = split.flatten().dictionary_encode()
        names = words.dictionary
        at = pc.index_in(names, found["word"].combine_chunks())
        names = pc.coalesce(found["lemma"].combine_chunks().take(at), names)
        joined = pc.binary_join(pa.ListArray.from_arrays(split.offsets, names.take(words.indices)), " ")
        row = texts["row"].combine_chunks()
        return pa.Table.from_arrays([*[x.cast(f.type) for x, f in zip(row.flatten(), target)], joined], schema=target)

    return kept.groupBy("slice", "bits").cogroup(known.groupBy("of_slice", "of_bits")).applyInArrow(rewrite, schema)


def txt_preprocess(df: DataFrame, *, text_col: str = "customer_message", remove_stopwords: bool = True,
                   lemmas: DataFrame | None = None, stopwords=None, out: str = "processed_text",
                   id_col: str | None = None) -> DataFrame:
    t = txt_clean(text_col)
    if remove_stopwords:
        t = txt_stopwords(t, stopwords)
    d = df.withColumn(out, t)
    if lemmas is not None:
        d = txt_lemma(d, out, lemmas, out="_lem", id_col=id_col).drop(out).withColumnRenamed("_lem", out)
    return d
