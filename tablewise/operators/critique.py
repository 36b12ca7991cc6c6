"""Statistical checks on an answer: what can be measured about a result before it is believed.

Facts first, rules second. :func:`result_facts` measures a result in one aggregate, whatever the number of its columns;
:func:`source_facts` reads the profile table. Both are one row. A rule is a condition on those facts and the
sentence it stands for; all rules are columns of one projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.types import columns_where, ident, is_floating, is_numeric
from tablewise.operators.recipes import Answer
from tablewise.plans.profile import Profile

# Thresholds, the cost of each severity, and the names that give a column's role away.
MIN_ROWS = 30
MIN_GROUP_ROWS = 5
OUTLIER_RATE = 0.01
SKEW_LIMIT = 2.0
NULL_RATE = 0.05
MANY_COMPARISONS = 10
MIN_TREND_POINTS = 3
P_LIMIT = 0.05
WEIGHT = {"note": 0.05, "warning": 0.15, "serious": 0.30}
UNANSWERED_WEIGHT = 0.80
SEVERITY_ORDER = ("serious", "warning", "note")
WRONG_QUESTION = ("ungrouped-result", "empty-result")
TREND_WORDS = ("trend", "over time", "growth", "trajectory", "time series")
COUNT_NAMES = r"^(count|n|len|rows|n_rows|n_obs|num)$|_(count|n|len|rows)$"
SPREAD_NAMES = (
    r"^(std|stddev|sd|var|variance|stdev)$|^(std|stddev|sd|var|stdev)_"
    r"|_(std|stddev|sd|var|variance|stdev)$"
)
P_NAMES = r"^(p|pval|pvalue|p_value)$|_(p|pval|pvalue|p_value)$"
BREAKDOWN = r"(?i)\b(?:per|by|for each|for every|across|grouped by|broken down by)\s+(?:the\s+)?(?=((?:\S+\s*){1,3}))"
BREAKDOWN_WORDS = 3

FIGURES = "array<struct<column:string,n:bigint,least:string>>"


@dataclass(frozen=True)
class Caveat:
    code: str
    severity: str
    message: str
    fatal: bool = False


@dataclass(frozen=True)
class Critique:
    verdict: str
    confidence: float
    caveats: tuple[Caveat, ...]
    answered: bool | None
    rows: int


@dataclass(frozen=True)
class Rule:
    """Fires where ``when`` holds on the row of facts; ``says`` is a format with its arguments."""

    code: str
    severity: str
    when: Column
    says: str
    args: tuple[Column, ...] = ()
    fatal: bool = False

    def caveat(self, place: int) -> Column:
        named = {
            "rank": F.lit(SEVERITY_ORDER.index(self.severity)), "place": F.lit(place), "code": F.lit(self.code),
            "severity": F.lit(self.severity), "message": F.format_string(self.says, *self.args),
            "fatal": F.lit(self.fatal),
        }
        return F.when(self.when, F.struct(*[value.alias(name) for name, value in named.items()]))


# ---- facts ---------------------------------------------------------------------------------------


def _figures(columns: Sequence[str], count: Callable[[Column], Column]) -> Column:
    cells = [
        F.struct(F.lit(c), count(F.col(ident(c))), F.min(F.col(ident(c))).cast("string")) for c in columns
    ]
    return F.array(*cells).cast(FIGURES)


def result_facts(df: DataFrame) -> DataFrame:
    """One row: ``rows``, and for each role that columns play, (column, n, least) of those columns.

    ``small``: groups of too few rows; ``tests``: p-values below the limit; ``flat``: groups without spread; ``broken``:
    values that are not finite; ``blank``: the names of columns without any value.
    """

    def named(pattern: str) -> list[str]:
        return [c for c in columns_where(df, is_numeric) if re.search(pattern, c, re.IGNORECASE)]

    blank = [F.when(F.count(F.col(ident(c))) == 0, F.lit(c)) for c in df.columns]
    return df.agg(
        F.count("*").alias("rows"),
        _figures(named(COUNT_NAMES), lambda x: F.count_if(x < MIN_GROUP_ROWS)).alias("small"),
        _figures(named(P_NAMES), lambda x: F.count_if(x < P_LIMIT)).alias("tests"),
        _figures(named(SPREAD_NAMES), lambda x: F.count_if(x.isNull() | (x == 0))).alias("flat"),
        _figures(
            columns_where(df, is_floating), lambda x: F.count_if(F.isnan(x) | (F.abs(x) == float("inf")))
        ).alias("broken"),
        F.array_compact(F.array(F.lit(None).cast("string"), *blank)).alias("blank"),
    )


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _asked_for(question: str) -> Column:
    """Folded names that a breakdown in the question may mean: one, two or three words after "by" and the like."""
    tails = F.regexp_extract_all(F.lit(question), F.lit(BREAKDOWN), F.lit(1))
    sizes = F.sequence(F.lit(1), F.lit(BREAKDOWN_WORDS))
    return F.flatten(
        F.transform(
            tails,
            lambda tail: F.transform(
                sizes, lambda k: _folded(F.array_join(F.slice(F.split(tail, r"\s+"), F.lit(1), k), ""))
            ),
        )
    )


def source_facts(source: Profile, answer: Answer, question: str) -> DataFrame:
    """One row from the profile table: its size, and the columns used that have outliers, skew or nulls."""
    table = source.to_df(answer.df.sparkSession)
    used = F.col("name").isin(list(answer.columns))
    rows = source.sampled_rows or source.n_rows
    outliers = F.greatest("iqr_outliers", "modified_z_outliers") / F.nullif(F.lit(rows), F.lit(0))

    def names(test: Column, text: Column = F.col("name")) -> Column:
        return F.sort_array(F.collect_list(F.when(used & test, text)))

    nulls = F.format_string("%s (%.0f%%)", F.col("name"), F.col("null_rate") * 100)
    facts = table.agg(
        names(F.col("numeric").isNotNull() & (outliers >= OUTLIER_RATE)).alias("with_outliers"),
        names(F.abs("numeric.skew") >= SKEW_LIMIT).alias("skewed"),
        names(F.col("null_rate") >= NULL_RATE, nulls).alias("with_nulls"),
        F.min(F.when(F.array_contains(_asked_for(question), _folded(F.col("name"))), F.col("name"))).alias("breakdown"),
    )
    return facts.select(
        "*",
        F.lit(source.estimated).alias("estimated"),
        F.lit(source.n_rows).cast("long").alias("source_rows"),
        F.lit(source.sampled_rows).cast("long").alias("seen_rows"),
    )


# ---- rules ---------------------------------------------------------------------------------------


def result_rules(question: str = "") -> list[Rule]:
    """What the result alone gives away."""
    rows = F.col("rows")

    def hit(figures: str) -> Column:
        return F.get(F.filter(figures, lambda f: f["n"] > 0), F.lit(0))

    small, flat, broken = hit("small"), hit("flat"), hit("broken")
    significant = F.get("tests", F.lit(0))["n"]
    trend = F.lit(any(w in question.lower() for w in TREND_WORDS))
    return [
        Rule("tiny-groups", "warning", small.isNotNull(),
             f"%d of %d groups have fewer than {MIN_GROUP_ROWS} rows (smallest: %s)", (small["n"], rows, small["least"])),
        Rule("multiple-comparisons", "serious", significant.isNotNull() & (rows >= MANY_COMPARISONS),
             f"%d p-values, %d below {P_LIMIT}; chance alone gives about %.0f", (rows, significant, rows * P_LIMIT)),
        Rule("non-finite", "serious", broken.isNotNull(),
             "%s holds %d values that are not finite numbers", (broken["column"], broken["n"]), fatal=True),
        Rule("short-trend", "warning", trend & (rows < MIN_TREND_POINTS),
             "%d points are too few to show a direction", (rows,)),
        Rule("singleton-groups", "warning", flat.isNotNull() & (rows >= 2),
             "%d of %d groups have no spread in %s: they hold a single row", (flat["n"], rows, flat["column"])),
        Rule("empty-result", "serious", (rows > 0) & (F.size("blank") > 0),
             "null in every row: %s", (F.array_join("blank", ", "),), fatal=True),
    ]


def source_rules(answer: Answer) -> list[Rule]:
    """What the source says about the way the answer was computed."""
    rows, used = F.col("source_rows"), answer.aggregates
    pearson_only = F.lit("pearson" in used and "spearman" not in used)

    def listed(column: str) -> tuple[Column]:
        return (F.array_join(column, ", "),)

    return [
        Rule("sampled-source", "serious", F.col("estimated"),
             "computed on %d sampled rows of about %d: it describes the sample", (F.col("seen_rows"), rows)),
        Rule("small-source", "warning", rows.between(1, MIN_ROWS - 1), "the source has %d rows only", (rows,)),
        Rule("correlation-outliers", "serious", pearson_only & (F.size("with_outliers") > 0),
             "Pearson on columns with outliers (%s); a few rows can make or hide it. Add Spearman", listed("with_outliers")),
        Rule("mean-on-skewed", "warning", F.lit("mean" in used) & (F.size("skewed") > 0),
             "mean of heavily skewed %s; look at the median", listed("skewed")),
        Rule("unacknowledged-nulls", "warning", F.lit(not answer.handles_nulls) & (F.size("with_nulls") > 0),
             "nulls left the denominator unnoticed: %s", listed("with_nulls")),
        Rule("ungrouped-result", "serious", F.col("breakdown").isNotNull() & (F.col("rows") <= 1),
             "a breakdown by %s was asked for, one row came back", (F.col("breakdown"),)),
    ]


def fired(rules: Sequence[Rule]) -> Column:
    """The caveats of the rules that fire, most serious first."""
    return F.sort_array(F.array_compact(F.array(*[r.caveat(i) for i, r in enumerate(rules)])))


def caveats(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row for each caveat, of nulls if there is none. ``rows`` is the size of the result."""
    return facts.select("rows", F.inline_outer(fired(rules))).drop("rank", "place")


def result_caveats(df: DataFrame, question: str = "") -> DataFrame:
    return caveats(result_facts(df), result_rules(question))


def review(question: str, answer: Answer, source: Profile, answered: bool | None = None) -> Critique:
    """All caveats of an answer, most serious first, with the verdict they add up to."""
    facts = result_facts(answer.df).join(F.broadcast(source_facts(source, answer, question)))  # one row each
    listed = facts.select("rows", fired(source_rules(answer) + result_rules(question)).alias("listed"))
    each = listed.select("rows", "listed", F.lit(answered).cast("boolean").alias("answered"), F.inline_outer("listed"))
    judged = verdicts(each, ["rows", "listed"]).first()
    found = [Caveat(c["code"], c["severity"], c["message"], c["fatal"]) for c in judged["listed"]]
    return Critique(
        judged["verdict"], judged["confidence"], tuple(found), answered if judged["answered"] else False, judged["rows"]
    )


def verdicts(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Verdict and confidence of many findings at once.

    ``findings`` has one row for each caveat (code, severity, fatal), with a null code where a
    finding has none, and ``answered``. The confidence is an index for sorting, not a probability: every caveat
    multiplies it down.
    """
    weight = F.coalesce(
        F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.col("severity")], F.lit(0.0)
    )
    summed = findings.groupBy(*by).agg(
        F.count("code").alias("caveats"),
        F.max(F.coalesce("fatal", F.lit(False))).alias("fatal"),
        (
            F.min(F.coalesce("answered", F.lit(True)))
            & ~F.max(F.coalesce(F.col("code").isin(*WRONG_QUESTION), F.lit(False)))
        ).alias("answered"),
        F.exp(F.sum(F.log(1 - weight))).alias("score"),
    )
    unsound = ~F.col("answered") | F.col("fatal")
    keep = F.when(F.col("answered"), F.lit(1.0)).otherwise(F.lit(1 - UNANSWERED_WEIGHT))
    return summed.select(
        *by,
        "caveats",
        "answered",
        F.when(unsound, "unsound").when(F.col("caveats") > 0, "qualified").otherwise("sound").alias("verdict"),
        # Half a hundredth (0.595, 0.665) goes down.
        F.round(F.col("score") * keep - 1e-12, 2).alias("confidence"),
    )
