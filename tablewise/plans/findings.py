"""From a question to a checked, masked finding; and many questions over one source."""

from __future__ import annotations

import datetime as dt
import inspect
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.errors import (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException,
    SparkRuntimeException,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.operators import critique, recipes, retrieval
from tablewise.operators.shapes import SHAPES
from tablewise.plans.card import Card, build_card, masked_preview
from tablewise.plans.profile import Profile, profile
from tablewise.sources.catalogue import catalogue
from tablewise.sources.loaders import UnsupportedFormat, load

RECIPES: dict[str, Callable[..., recipes.Answer]] = {name: getattr(recipes, name) for name, *_ in SHAPES}

SCHEMA = (
    "question string, recipe string, status string, verdict string, confidence double,"
    " caveats array<struct<code:string,severity:string,message:string>>, code string,"
    " card_hash string, preview array<string>, dropped long, created timestamp, run string, place int"
)
#: What is wrong with a question, as opposed to what is wrong with the cluster.
UNANSWERABLE = (
    AnalysisException, IllegalArgumentException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
    NumberFormatException, SparkRuntimeException, ValueError, TypeError, KeyError,
)


@dataclass(frozen=True)
class Question:
    """A question in words, and the columns that play its roles (category, measure, when, ...)."""

    text: str
    columns: Mapping[str, Any]
    recipe: str | None = None


@dataclass
class Finding:
    question: str
    recipe: str | None
    status: str
    answer: recipes.Answer | None = None
    critique: critique.Critique | None = None
    reason: str = ""


@dataclass
class Source:
    """A profiled table with its card; shared by all questions about it."""

    df: DataFrame
    profile: Profile
    card: Card
    findings: list[Finding] = field(default_factory=list)


def look(df: DataFrame, name: str, key: str | None = None) -> Source:
    """Profile a table and describe it."""
    measured = profile(df, name=name)
    return Source(df, measured, build_card(measured, df, key=key))


def look_at(spark: SparkSession, path: str, name: str | None = None, key: str | None = None) -> Source:
    """Catalogue the files under ``path``, load them by what was found, profile and describe the table.

    Files of several kinds are no table: the error names the kinds. The driver receives one row for each kind.
    """
    kind = ["format", "compression", "dialect"]
    found = catalogue(spark, path).groupBy(*kind).agg(F.count("*").alias("files"), F.max("encoding").alias("encoding")).orderBy("format").collect()
    if len(found) != 1:
        kinds = ", ".join(f"{r['files']} {r['format']} ({r['compression']})" for r in found) or "no files"
        raise UnsupportedFormat(f"{path} is not one table: {kinds}")
    spec = found[0].asDict(recursive=True) | {"path": path}
    return look(load(spark, spec), name or path.rstrip("/").rpartition("/")[2], key)


def route_all(source: Source, questions: Sequence[Question]) -> list[str | None]:
    """The recipe of each question: the one it names, else the shape that fits its words best."""
    spark = source.df.sparkSession
    open_ones = [(i, q.text) for i, q in enumerate(questions) if q.recipe is None]
    chosen = {i: q.recipe for i, q in enumerate(questions)}
    if open_ones:
        shapes = retrieval.shapes_df(spark)
        asked = spark.createDataFrame(open_ones, "id long, question string")
        hits = retrieval.route(asked, "id", "question", shapes)
        names = hits.join(F.broadcast(shapes), hits["doc"] == shapes["shape"])
        chosen |= {r["query"]: r["recipe"] for r in names.select("query", "recipe").collect()}
    return [chosen.get(i) for i in range(len(questions))]


def ask(source: Source, question: Question, recipe: str | None) -> Finding:
    """Answer one question and check the answer. A question that cannot be answered is a finding too; a lost cluster is an error."""
    if recipe is None:
        return Finding(question.text, None, "unanswered", reason="no question shape fits")
    fn = RECIPES[recipe]
    accepted = inspect.signature(fn).parameters
    given = {k: v for k, v in question.columns.items() if k in accepted}
    try:
        answer = fn(source.df, **given)
        answer.df.persist(StorageLevel.DISK_ONLY)
        checked = critique.review(question.text, answer, source.profile)
    except UNANSWERABLE as e:  # recorded, not dropped: one bad question must not end the run
        return Finding(question.text, recipe, "unanswered", reason=f"{type(e).__name__}: {_message(e)}")
    return Finding(question.text, recipe, "answered", answer, checked)


def _message(e: Exception) -> str:
    """The whole message; of what Spark could not analyse without the plan behind it, whose numbers differ in each run."""
    return str(e).partition(";\n")[0] if isinstance(e, AnalysisException) else str(e)


def answer_all(source: Source, questions: Sequence[Question], run: str | None = None) -> DataFrame:
    """The findings table of many questions; each answer is computed once over the whole source.

    ``run`` and ``place`` identify a finding: a run that is repeated under its name adds nothing to a table of findings.

    An answer is kept on the executors' disks while it is checked and previewed, and forgotten then; lost parts are
    computed again.
    """
    rows, run = [], run or uuid.uuid4().hex
    for place, (question, recipe) in enumerate(zip(questions, route_all(source, questions)), 1):
        found = ask(source, question, recipe)
        rows.append((*_row(source, question, found), run, place))
        if found.answer is not None:
            found.answer.df.unpersist()
        source.findings.append(found)
    return source.df.sparkSession.createDataFrame(rows, SCHEMA)


def _row(source: Source, question: Question, found: Finding) -> tuple:
    columns = {k: v for k, v in question.columns.items() if isinstance(v, (str, int, float, list))}
    code = json.dumps({"recipe": found.recipe, "columns": columns})
    created = dt.datetime.now(dt.timezone.utc)
    if found.answer is None:
        return (found.question, found.recipe, found.status, None, None, [], code, source.card.hash,
                [found.reason], 0, created)
    df, c = found.answer.df, found.critique
    shown = masked_preview(df, total=c.rows).collect()
    preview = [" | ".join(r[c] for c in df.columns) for r in shown]
    dropped = shown[0]["rows_not_shown"] if shown else 0
    caveats = [(x.code, x.severity, x.message) for x in c.caveats]
    return (found.question, found.recipe, found.status, c.verdict, c.confidence, caveats, code,
            source.card.hash, preview, dropped, created)
