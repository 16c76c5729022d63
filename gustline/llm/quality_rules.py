"""Quality rules with adaptive thresholds.

Each document is measured once. The measures of each (lang, source) go into
mergeable quantile sketches: counts of logarithmic buckets, as in DDSketch, so
two sketches merge by adding counts and a quantile is within ``accuracy`` of
the true one. The upper fence of a measure, third quartile plus a multiple of
the spread, comes from the group's own sketch, from the merged sketch of its
language where the group is small, or from that of all documents. The spread is
the interquartile range, or, where that is less (most values of a rare event
are zero), what one event makes of a short document: one at the lower quartile
of the same sketch's lengths.
Joined to the measures, the fences decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import in_arrow, materialize, ship_package

_OUT = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_pipes long"
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(x for x in range(256) if x not in _SYMBOLS)
_SPACE = b" \t\n\x0b\x0c\r"
#: Measure: (numerator, denominator, what one event adds to the numerator; a repeat is two windows of three words).
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1),
    "repeats": ("n_repeat_words", "n_words", 6),
    "dup_lines": ("n_dup_lines", "n_words", 1),
    "uppers": ("n_upper", "n_words", 1),
    "word_length": ("word_chars", "n_words", 0),
}


def measure(text: str) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (words without a lower-case letter), n_pipes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw.translate(None, _NOT_SYMBOL))
    dups = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
        dups = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            many = {w for w, k in Counter(windows).items() if k > 1}
            upto = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if w in many:
                    repeats += i + 3 - max(i, upto)
                    upto = i + 3
    uppers = sum(w.isupper() for w in words)
    return n, word_chars, n_symbols, dups, repeats, uppers, raw.count(b"|")


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _OUT.split(", ")]
    for b in batches:
        got = [measure(t) for t in b.column(3).to_pylist()]
        cols = zip(*got) if got else [()] * 7
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in cols)], names=names)


def measures(docs: DataFrame) -> DataFrame:
    """The measures of every document; null texts have no words, null lang or source count as ''."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.transform(in_arrow, _kernel, _OUT)


def sketches(measured: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """One row per (lang, source, measure, bucket) with its count n; bucket null stands for zero; n_words is a measure too.

    Counted map-side first, so a hot source costs one row per task and bucket.
    """
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    shares = [(k, F.col(a) / F.col(b)) for k, (a, b, _) in MEASURES.items()] + [("n_words", F.col("n_words").cast("double"))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), x.alias("x")) for k, x in shares)))
    long = measured.where("n_words > 0").select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", F.when(F.col("m.x") > 0, F.ceil(F.log("m.x") / gamma)).alias("bucket"))
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], qs: list[float], accuracy: float = 0.01) -> DataFrame:
    """The quantiles q0, q1.. of each group: sketches merged over whatever ``by`` leaves out; n counts the values."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    value = F.coalesce(2 * F.exp(F.col("bucket") * gamma) / (1 + math.exp(gamma)), F.lit(0.0))
    over = Window.partitionBy(*by).orderBy(F.asc_nulls_first("bucket"))  # at most one row per bucket: a few hundred
    ranked = merged.withColumn("value", value).withColumn("upto", F.sum("n").over(over)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), *(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))).alias(f"q{i}") for i, q in enumerate(qs)))


def fences(sketch: DataFrame, spread: float = 3.0, least: int = 50, accuracy: float = 0.01) -> DataFrame:
    """One row per (lang, source) with a fence for each measure."""
    levels = []
    event = F.create_map(*(x for k, (_, _, e) in MEASURES.items() for x in (F.lit(k), F.lit(float(e)))))
    for by in (["lang", "source"], ["lang"], []):
        q = quantiles(sketch, [*by, "measure"], [0.25, 0.75], accuracy)
        short = F.max(F.when(F.col("measure") == "n_words", F.col("q0"))).over(Window.partitionBy(*by))  # six rows a group
        fence = F.col("q1") + spread * F.greatest(F.col("q1") - F.col("q0"), event[F.col("measure")] / short)
        levels.append(q.select(*by, "measure", F.col("n").alias(f"n{len(by)}"), fence.alias(f"f{len(by)}")).where("measure <> 'n_words'"))
    own, lang, every = levels
    joined = own.join(lang, ["lang", "measure"]).join(every, ["measure"])
    fence = F.when(F.col("n2") >= least, F.col("f2")).when(F.col("n1") >= least, F.col("f1")).otherwise(F.col("f0"))
    joined = joined.withColumn("fence", fence)
    return joined.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == k, F.col("fence"))).alias(f"fence_{k}") for k in MEASURES))


def judge(docs: DataFrame, spread: float = 3.0, least: int = 50, min_words: int = 50, max_repeat: float = 0.5, broadcast_rows: int = 50_000, salts: int = 16) -> DataFrame:
    """Measures, base_failed and kept for every document.

    base_failed: fewer than min_words words, or over max_repeat of the words in
    windows found before. kept: not base_failed, and no measure over its fence.
    The fences are broadcast while they are at most ``broadcast_rows`` rows
    (counted first); beyond, they are joined on (lang, source, salt), which
    deals a hot source over ``salts`` partitions. A null or empty text has no
    words and fails; rows with the same doc_id are judged each on their own; an
    empty table gives no rows.
    """
    measured = materialize(measures(docs), "measures")
    limit = materialize(fences(sketches(measured), spread, least), "fences")
    if limit.count() <= broadcast_rows:
        joined = measured.join(F.broadcast(limit), ["lang", "source"], "left")
    else:
        salted = limit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(salted, ["lang", "source", "salt"], "left").drop("salt")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > round(max_repeat * 100) * F.col("n_words"))
    over = [F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)) > F.col(f"fence_{k}"), F.lit(False)) for k, (a, b, _) in MEASURES.items()]
    broken = over[0]
    for x in over[1:]:
        broken = broken | x
    out = joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~broken)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", *(f"fence_{k}" for k in MEASURES))
