"""Quality rules with thresholds that adapt to each language and source.

Every document gets countable features. Their shares fall into integer bins; the counts of bins for
each (language, source) are a quantile sketch of fixed size that merges by addition, so the sketch of
a language is the sum of its sources' sketches. The octiles of a group are drawn towards those of its language, and these
towards those of all documents, as if each had ``PRIOR_DOCS`` documents of the wider group more: a large source has its
own, a small one leans on its language. A limit lies a number of octile spreads beyond the octile, so it moves with the
group's level and with how much its documents differ. A document is over it if its count is, by more than what one or
two single events make (``CHANCE``): the share of a short text says little.

Defined cases: a null or empty text has no words and fails the base rules. Null and empty ``lang`` or
``source`` form one group. Equal rows get equal verdicts. An empty table gives an empty result. Columns of the input
that are called like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewise.llm.common import Rolling, as_bytes, by_value, hash_words, store, text_pieces

by_value(__name__)

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Sketch: shares in thousandths, mean word length in tenths of a character, at most this bin.
TOP_BIN = 1000
#: Parameters of the thresholds: octile spreads beyond the octile, bins added for the rounding of shares, weight of the wider group.
SPREADS = 3
SLACK = 5
PRIOR_DOCS = 200
#: Features, each a count for so many units, and the counts over the limit that chance may bring.
SHARES = {"symbols": ("n_symbols", "word_chars"), "shouts": ("n_shouts", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
CHANCE = {"symbols": 5, "shouts": 5, "dup_lines": 3, "repeats": 60}
FEATURES = (*SHARES, "length")
#: Groups whose threshold table is known to be this small are joined by broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words")


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text in ``texts``."""
    raw = as_bytes(texts)
    n = len(raw)
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    words = [t.split() for t in raw]
    hashes, offsets = hash_words(words)
    for i, t in enumerate(raw):
        s = t.decode()
        out["word_chars"][i] = len(s) - sum(map(s.count, WHITE))
        out["n_symbols"][i] = sum(map(t.count, SYMBOLS.encode()))
        out["n_shouts"][i] = sum(map(t.count, SHOUTS.encode()))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    out["n_words"] = np.diff(offsets)
    out["n_repeat_words"] = repeats(hashes, offsets)
    return out


def repeats(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document inside 3-word windows that the document holds twice or more."""
    n, total = len(offsets) - 1, len(hashes)
    if total < 3:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    grams = Rolling(hashes).grams(3)
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    order = inside[np.lexsort((grams[inside], doc[inside]))]
    same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = np.zeros(total, bool)
    start[order[twice]] = True
    covered = start.copy()
    covered[1:] |= start[:-1]
    covered[2:] |= start[:-2]
    return np.bincount(doc[covered], minlength=n).astype(np.int64)


def count_udf():
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def run(texts: pa.Array) -> pa.Array:
        done = [counted(piece) for piece in text_pieces(texts)]
        if not done:
            return pa.array([], kind)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([d[c] for d in done])) for c in COUNTS], COUNTS)

    returns = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"
    return F.arrow_udf(run, returns).asNondeterministic()  # counted once, wherever it is used


def bins() -> dict:
    shares = {f: F.expr(f"least({count} * 1000 div greatest({units}, 1), {TOP_BIN})") for f, (count, units) in SHARES.items()}
    return shares | {"length": F.expr(f"least(word_chars * 10 div greatest(n_words, 1), {TOP_BIN})")}


def features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``_row`` (``columns`` of the input), its group, the counts, base verdict and bins."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
            F.coalesce("lang", F.lit("")).alias("_lang"),
            F.coalesce("source", F.lit("")).alias("_source"),
            count_udf()("text").alias("_n"),
        )
        .select("_row", "_lang", "_source", "_n.*")
        .withColumn("base_failed", failed)
        .withColumns({f"_{k}": v for k, v in bins().items()})
    )


def sketches(feats: DataFrame) -> DataFrame:
    """Counts of bins for each group and feature, over documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"_{k}").alias("bin")) for k in FEATURES]))
    return (
        feats.filter(~F.col("base_failed")).select("_lang", "_source", pairs.alias("p"))
        .groupBy("_lang", "_source", "p.feature", "p.bin").agg(F.count("*").alias("n"))
    )


def octiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Documents, first and last octile (smallest bin that reaches the share) for each key and feature."""
    merged = sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "feature")
    upto = group.orderBy("bin")
    ranked = merged.select(*keys, "feature", "bin", F.sum("n").over(upto).alias("cum"), F.sum("n").over(group).alias("total"))
    at = lambda k: F.min(F.when(F.col("cum") * 8 >= F.col("total") * k, F.col("bin")))
    return ranked.groupBy(*keys, "feature").agg(F.max("total").alias("total"), at(1).alias("low"), at(7).alias("high"))


def thresholds(feats: DataFrame, spreads: int = SPREADS, prior: int = PRIOR_DOCS) -> DataFrame:
    """One row for each group: ``_lang``, ``_source``, the upper limit of each feature and the lower one of length."""
    sketch = store(sketches(feats), "quality-sketch")
    own = octiles(sketch, "_lang", "_source").withColumnRenamed("total", "n0")
    lang = octiles(sketch, "_lang").toDF("_lang", "feature", "n1", "l_low", "l_high")
    every = octiles(sketch).select("feature", F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    merged = own.join(lang, ["_lang", "feature"]).join(F.broadcast(every), "feature")  # ``every`` has one row for each feature
    for c in ("low", "high"):
        merged = merged.withColumn(f"l_{c}", F.expr(f"(n1 * l_{c} + {prior} * a_{c}) div (n1 + {prior})"))
        merged = merged.withColumn(c, F.expr(f"(n0 * {c} + {prior} * l_{c}) div (n0 + {prior})"))
    room = (F.col("high") - F.col("low")) * spreads + SLACK
    limits = merged.withColumn("lo", F.col("low") - room).withColumn("hi", F.col("high") + room)
    of = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}_{f}")
    return limits.groupBy("_lang", "_source").agg(*[of(f, "hi") for f in FEATURES], of("length", "lo"))


def judged(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """``features`` of every document with its limits and ``kept``.

    If only some ``columns`` and not the text are asked for, the counts are stored and no text is counted twice.
    """
    feats = features(docs, docs.columns if columns is None else columns)
    if columns is not None and "text" not in columns:
        feats = store(feats, "quality-counts")
    limits = store(thresholds(feats, **options), "quality-limits")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    within = ~F.col("base_failed") & F.col("_length").between(F.col("_lo_length"), F.col("_hi_length"))
    for f, (count, units) in SHARES.items():
        within &= (F.col(count) - CHANCE[f]) * 1000 <= F.col(f"_hi_{f}") * F.col(units)
    return feats.join(limits, ["_lang", "_source"], "left").withColumn("kept", F.coalesce(within, F.lit(False)))


def quality(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """``columns`` of the input (all, if None) with the counts, ``base_failed`` and ``kept``; clashing columns are replaced."""
    new = [*COUNTS, "base_failed", "kept"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in new]
    return judged(docs, columns, **options).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], *new)


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    return judged(docs, **options).filter("kept").select("_row.*")
