"""Text column expressions (JVM-side, whole-stage codegen friendly).

Regexes are Java syntax. Character classes spell out ASCII whitespace
``[ \\t\\n\\x0B\\f\\r]`` instead of ``\\s`` so the same pattern means the
same thing in Spark and in the DuckDB oracle (RE2's ``\\s`` lacks \\x0B).
Word-character classes that must be Unicode-aware use ``\\p{L}\\p{N}_``.
"""

from __future__ import annotations

import functools
import glob
import os
import string
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cleaning patterns.
URL_RE = r"http\S+|www\S+|https\S+"
EMAIL_RE = r"\S+@\S+"
PHONE_RE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
WS_CLASS = r" \t\n\x0B\f\r"
WS_RE = f"[{WS_CLASS}]+"
NON_LETTER_RE = f"[^a-zA-Z{WS_CLASS}]"
# same deletions, one replacement per run instead of per character; Java looks
# single characters up in a table, but tries the ranges of a class one by one
NON_LETTER_RUN_RE = f"[^{string.ascii_letters}{WS_CLASS}]+"
# whitespace runs that squeezing changes: any run holding a non-space
# whitespace char, or two or more chars (a lone space is left alone)
WS_CHANGE_RE = r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+"
LIGHT_URL_RE = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
# Word runs spelled out: Java's \b is Unicode-aware while its \w is not
# (and RE2's \b is ASCII), so explicit classes keep both engines and
# Python's Unicode \w in agreement.
WORD_RE = r"[\p{L}\p{N}_]+"
TOKEN2_RE = r"[\p{L}\p{N}_]{2,}"
PUNCT_RE = f"[^\\p{{L}}\\p{{N}}_{WS_CLASS}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """Collapse whitespace runs to one space and strip (``' '.join(s.split())``)."""
    return F.trim(F.regexp_replace(_col(c), WS_CHANGE_RE, " "), F.lit(" "))


def words(c) -> Column:
    """Whitespace tokens without empties (Python ``str.split()``)."""
    return F.filter(F.split(_col(c), WS_RE), lambda x: x != "")


def fn_lower_strip(c) -> Column:
    return squeeze(F.lower(_col(c)))


def _guarded(c: Column, needles: list[str], pattern: str) -> Column:
    """``regexp_replace`` only where a literal the pattern needs occurs: the
    replace is the identity elsewhere, and a substring test is far cheaper
    than a backtracking scan over long non-space runs."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(c, F.lit(n))
    return F.when(cond, F.regexp_replace(c, pattern, "")).otherwise(c)


def fn_strip_urls(c) -> Column:
    return _guarded(_col(c), ["http", "www"], URL_RE)


def fn_strip_emails(c) -> Column:
    return _guarded(_col(c), ["@"], EMAIL_RE)


def fn_strip_phones(c) -> Column:
    col = _col(c)
    return F.when(col.rlike("[0-9]"), F.regexp_replace(col, PHONE_RE, "")).otherwise(col)


def fn_letters_only(c) -> Column:
    """Delete (not blank) every char outside ASCII letters and whitespace."""
    return F.regexp_replace(_col(c), NON_LETTER_RUN_RE, "")


def txt_clean(c) -> Column:
    """null -> "", lower, strip URLs, e-mails, phones, non-letters, squeeze."""
    t = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    t = fn_letters_only(fn_strip_phones(fn_strip_emails(fn_strip_urls(t))))
    return squeeze(t)


def txt_clean_light(c) -> Column:
    """Squeeze whitespace, drop URLs and e-mails, keep case."""
    t = squeeze(_col(c).cast("string"))
    return _guarded(_guarded(t, ["http"], LIGHT_URL_RE), ["@"], EMAIL_RE)


def fn_regex_count(c, pattern: str) -> Column:
    return F.regexp_count(_col(c), F.lit(pattern))


def fn_substring_count(c, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    s = _col(c)
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def fn_contains_any(c, keywords) -> Column:
    s = _col(c)
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(s, k))


def fn_count_contained(c, keywords) -> Column:
    """How many of ``keywords`` occur as substrings."""
    s = _col(c)
    out = F.lit(0)
    for k in keywords:
        out = out + F.contains(s, F.lit(k)).cast("int")
    return out


@functools.lru_cache(maxsize=None)
def default_stopwords(language: str = "english") -> tuple[str, ...]:
    """Spark ML's built-in stop list (read from the mllib jar), apostrophes removed.

    Apostrophes are stripped because cleaning deletes them from the text
    before stop words are matched.
    """
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    words_ = []
    if jars:
        with zipfile.ZipFile(jars[0]) as z:
            words_ = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split()
    else:  # pragma: no cover - jar layout differs; ask the JVM
        from pyspark.ml.feature import StopWordsRemover
        words_ = StopWordsRemover.loadDefaultStopWords(language)
    out = []
    for w in words_:
        w = w.replace("'", "")
        if w not in out:
            out.append(w)
    return tuple(out)


def txt_stopwords(c, stopwords=None) -> Column:
    """Drop stop words from a cleaned (space separated) text."""
    stop = list(stopwords or default_stopwords())
    kept = F.filter(words(c), lambda w: ~w.isin(stop))  # InSet: hash lookup
    return F.array_join(kept, " ")


def fn_replace_vars(template: Column, values: dict) -> Column:
    """``{var}`` substitution; ``values`` maps var -> Column."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def fn_entropy(probs: Column, eps: float = 1e-10) -> Column:
    """Shannon entropy (natural log) of ``probs + eps`` renormalised (scipy)."""
    p = F.transform(probs, lambda x: x + eps)
    s = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + (x / s) * F.ln(x / s))


def fn_array_stats(arr: Column) -> Column:
    """struct(max, mean, population variance) of a numeric array."""
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.struct(F.array_max(arr).alias("max"), mean.alias("mean"), var.alias("variance"))


def fn_map_access(m: Column, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def fn_safe_div(num: Column, den: Column, default=None) -> Column:
    r = F.try_divide(num, den)
    return r if default is None else F.coalesce(r, F.lit(default))


def fn_hash_md5_bucket(c) -> Column:
    """``int(md5(id), 16) % 100 / 100`` without 128-bit integers.

    The hex digest is folded 32 bits at a time: h = (h * 2^32 + chunk) mod 100,
    and 2^32 mod 100 = 96.
    """
    hx = F.md5(_col(c).cast("string"))
    h = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(hx, 8 * i + 1, 8), 16, 10).cast("long")
        h = (h * 96 + chunk) % 100
    return h / F.lit(100.0)
