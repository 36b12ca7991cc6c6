"""Ranking texts against questions with BM25, and fitting what was found into a byte budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.functions.text import let, strip
from tablewise.functions.tokens import NOISE, SHAPE_NOISE, stem, tokens, words
from tablewise.operators.shapes import SHAPES
from tablewise.session import materialise, pin

# BM25 parameters, weights and budgets.
K1 = 1.5
B = 0.75
FOCUS_WEIGHT = 3.0
TITLE_WEIGHT = 3
LIMIT = 5
BUDGET = 2_560
JOIN_BYTES = 2
FENCE_BYTES = 4
MAX_TURNS = 6
TRANSCRIPT_BYTES = 1_800
HEADING = r"^(#{1,2}) (\d{1,2}(?:\.\d{1,2})?)\.? +(\S.*)$"
FENCE = "```"

#: Query terms that may be broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
#: Groups that one task of a search may hold at a time, some 200 bytes each, and how many are worth a task.
TASK_GROUPS = 1_000_000
LEAST_GROUPS = 50_000


def _tasks(df: DataFrame, groups: int) -> int:
    """Tasks for so many groups: none holds too many, and all cores work if there is enough for each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-groups // TASK_GROUPS), min(cores, groups // LEAST_GROUPS))


def runs(values: Column, cell: Callable[[Column, Column], Column]) -> Column:
    """``cell(value, n)`` for each different value of an array and the times that it is there."""

    def starts(ordered: Column) -> Column:
        return F.array_compact(
            F.transform(ordered, lambda v, i: F.when((i == 0) | ~v.eqNullSafe(F.get(ordered, i - 1)), i))
        )

    def counted(ordered: Column) -> Column:
        return let(
            starts(ordered),
            lambda at: F.transform(
                at, lambda a, i: cell(F.get(ordered, a), F.coalesce(F.get(at, i + 1), F.size(ordered)) - a)
            ),
        )

    return let(F.sort_array(values), counted)


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, n) over all texts. Raw words are counted first, so each is stemmed once."""
    raw = df.select(F.explode(words(F.col(text))).alias("word"))
    counts = raw.groupBy("word").agg(F.count("*").alias("n"))
    return counts.groupBy(stem(F.col("word")).alias("term")).agg(F.sum("n").alias("n"))


def query_terms(
    queries: DataFrame, query: str, text: str, focus: str | None = None, *, by_shape: bool = False
) -> DataFrame:
    """(query, term, weight): noise dropped, the focus text counting three times."""
    noise = NOISE + (SHAPE_NOISE if by_shape else ())
    dropped = F.array_distinct(F.transform(F.array(*map(F.lit, noise)), stem))

    def weighed(column: str, weight: float) -> DataFrame:
        kept = F.filter(tokens(F.col(column)), lambda t: ~F.array_contains(dropped, t))
        return queries.select(
            F.col(query).alias("query"), F.explode(kept).alias("term"), F.lit(weight).alias("w")
        )

    terms = weighed(text, 1.0)
    if focus:
        terms = terms.unionByName(weighed(focus, FOCUS_WEIGHT))
    return terms.groupBy("query", "term").agg(F.sum("w").alias("weight"))


def bm25(
    corpus: DataFrame, doc: str, terms: Column, queries: DataFrame, *, stemmed: bool = False, limit: int = LIMIT
) -> DataFrame:
    """(query, doc, score, rank): the best documents of every query, all queries at once.

    ``terms`` is the array of words of a corpus row, to be stemmed unless ``stemmed``; ``queries``
    comes from :func:`query_terms`. Only words that some query asks for leave the corpus scan, and
    they are counted by document before anything is joined, so a word that is in a third of the
    documents costs one row each. Tasks are as many as what they hold asks for: repeats are counted
    in the row of their document, and the groups of a shuffle are bounded before it is made.
    """
    asked = materialise(queries)
    small = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    vocabulary = asked.select("term").distinct()

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def listed(found: Column) -> Column:
        def cell(word: Column, n: Column) -> Column:
            return F.struct((word if stemmed else stem(word)).alias("term"), F.size(found).alias("length"), n.alias("n"))

        return runs(found, cell)

    whole = pin(
        corpus.agg(
            F.count("*").alias("docs"), F.avg(F.size(terms)).alias("average"), F.sum(F.size(terms)).alias("words")
        )
    )
    size, kinds = whole.first(), vocabulary.count()
    split = corpus.select(F.col(doc).alias("doc"), F.inline(let(terms, listed)))
    key = ["doc", "length", "term"]
    groups = min(size["words"] or 0, size["docs"] * kinds)
    found = materialise(  # read twice: document frequencies and scores
        split.join(hint(vocabulary), "term", "left_semi")
        .repartition(_tasks(corpus, groups), *key)
        .groupBy(key)
        .agg(F.sum("n").alias("tf"))
    )
    frequency = materialise(found.groupBy("term").agg(F.count("*").alias("df")))
    weights = asked.join(frequency, "term")
    matches = weights.agg(F.sum("df").alias("all"), F.count_distinct("query").alias("queries")).first()
    tasks = _tasks(corpus, min(matches["all"] or 0, size["docs"] * matches["queries"]))
    rare = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.join(F.broadcast(whole)).select(  # one row
        "query", "term", "average", (F.col("weight") * rare).alias("idf_weight")
    )
    norm = K1 * (1 - B + B * F.col("length") / F.col("average"))
    part = F.col("idf_weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    # With the matches of a document in one place its scores add up there, and the window below keeps
    # the best few of each task before anything moves: candidate pairs are never shuffled, unless the
    # questions are too many to broadcast.
    placed = found.repartition(tasks, "doc") if small else found
    scored = placed.join(hint(weights), "term")
    scored = scored if small else scored.repartition(tasks, "query", "doc")
    scores = scored.groupBy("query", "doc").agg(F.sum(part).alias("score"))
    # Sums differ in their last digits with the order of addition; ties must not depend on that.
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    ranked = scores.where("score > 0").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= limit)


def search(
    corpus: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str,
    focus: str | None = None, *, limit: int = LIMIT,
) -> DataFrame:
    """BM25 over the whole text of each document."""
    asked = query_terms(queries, query, query_text, focus)
    return bm25(corpus, doc, words(F.col(text)), asked, limit=limit)


def route(
    questions: DataFrame, question_id: str, question: str, shapes: DataFrame, *, limit: int = 1
) -> DataFrame:
    """The question shape (title, asks) that fits each question.

    A shape is indexed by its title, three times and without repeated words, and by the questions it
    answers.
    """
    title = F.array_distinct(tokens(F.col("title")))
    text = F.concat(F.flatten(F.array_repeat(title, TITLE_WEIGHT)), tokens(F.col("asks")))
    asked = query_terms(questions, question_id, question, by_shape=True)
    return bm25(shapes, "shape", text, asked, stemmed=True, limit=limit)


def fit_budget(ranked: DataFrame, size: str, budget: int = BUDGET) -> DataFrame:
    """Keep the best documents of each query while they fit, trying the next when one does not.

    ``ranked`` has (query, doc, rank) and a size in bytes, a few rows for each query. Skipping is a
    fold over those rows, not a running sum. A first document that is too big by itself is kept and
    marked ``clipped``.
    """
    cell = F.struct("rank", "doc", F.col(size).cast("long").alias("size"))
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(cell)).alias("found"))
    empty = F.array().cast("array<struct<rank:bigint,doc:bigint,size:bigint,clipped:boolean>>")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("done"), empty.alias("kept"))

    def step(state: Column, d: Column) -> Column:
        fits = ~state["done"] & (state["used"] + d["size"] <= budget)
        clipped = ~state["done"] & ~fits & (F.size(state["kept"]) == 0)
        row = F.struct(
            d["rank"].cast("long").alias("rank"), d["doc"].cast("long").alias("doc"),
            d["size"].alias("size"), clipped.alias("clipped"),
        )
        return F.struct(
            F.when(fits, state["used"] + d["size"] + JOIN_BYTES).otherwise(state["used"]).alias("used"),
            (state["done"] | clipped).alias("done"),
            F.when(fits | clipped, F.concat(state["kept"], F.array(row))).otherwise(state["kept"]).alias("kept"),
        )

    kept = F.aggregate("found", start, step, lambda s: s["kept"])
    return lists.select("query", F.inline(kept))


def clip(text: Column, budget: int) -> Column:
    """The lines that fit into the budget, with an open code fence closed."""
    start = F.struct(
        F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("lines")
    )

    def step(state: Column, line: Column) -> Column:
        used = state["used"] + F.octet_length(line) + 1
        full = state["full"] | (used > budget - FENCE_BYTES)
        return F.struct(
            F.when(full, state["used"]).otherwise(used).alias("used"),
            full.alias("full"),
            F.when(full, state["lines"]).otherwise(F.concat(state["lines"], F.array(line))).alias("lines"),
        )

    def close(state: Column) -> Column:
        fences = F.size(F.filter(state["lines"], lambda x: x.startswith(FENCE)))
        closed = F.concat(state["lines"], F.array(F.lit(FENCE)))
        return F.array_join(F.when(fences % 2 == 1, closed).otherwise(state["lines"]), "\n")

    return F.aggregate(F.split(text, "\n"), start, step, close)


def context(ranked: DataFrame, corpus: DataFrame, doc: str, text: str, budget: int = BUDGET) -> DataFrame:
    """(query, context): the kept documents of each query, whole, in rank order."""
    body = corpus.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("body"))
    hits = ranked.withColumn("doc", F.col("doc").cast("long")).join(body, "doc")
    sized = hits.withColumn("bytes", F.octet_length("body"))
    kept = fit_budget(sized, "bytes", budget).join(
        sized.select("query", "doc", "body"), ["query", "doc"]
    )
    shown = F.when(F.col("clipped"), clip(F.col("body"), budget)).otherwise(F.col("body"))
    lists = kept.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", shown.alias("s")))).alias("l"))
    return lists.select("query", F.array_join(F.transform("l", lambda e: e["s"]), "\n\n").alias("context"))


def sections(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section, number, title, parent, body): marked-up text cut at numbered headings.

    Headings inside code fences do not count, headings without a body are dropped, and a section
    carries the title of the top-level heading above it. Windows run within one text.
    """
    lines = df.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("fences", F.count_if(F.col("line").startswith(FENCE)).over(upto))
    outside = F.col("fences") % 2 == 0
    level = F.when(outside & F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 1))
    lines = lines.withColumn("level", level)
    heading = F.col("level").isNotNull()
    number, title = (F.regexp_extract("line", HEADING, i) for i in (2, 3))
    lines = lines.withColumns(
        {
            "section": F.count_if(heading).over(upto),
            "number": F.when(heading, number),
            "title": F.when(heading, strip(title)),
            "parent": F.last(F.when(F.col("level") == "#", strip(title)), ignorenulls=True).over(upto),
        }
    )
    grouped = lines.where("section > 0").groupBy("doc", "section").agg(
        F.max("number").alias("number"),
        F.max("title").alias("title"),
        F.first("parent", ignorenulls=True).alias("parent"),
        F.sort_array(F.collect_list(F.when(~heading, F.struct("pos", "line")))).alias("body"),
    )
    body = strip(F.array_join(F.transform("body", lambda e: e["line"]), "\n"))
    parent = F.coalesce("parent", F.lit(""))
    return grouped.select("doc", "section", "number", "title", parent.alias("parent"), body.alias("body")).where(
        F.col("body") != ""
    )


def recent_transcript(
    df: DataFrame, conversation: str, turn: str, text: str, *,
    limit: int = MAX_TURNS, budget: int = TRANSCRIPT_BYTES,
) -> DataFrame:
    """The newest turns of each conversation that fit the budget; the newest always stays.

    The row limit is applied map-side first, so a long conversation sends a few rows only.
    """
    newest = Window.partitionBy(conversation).orderBy(F.desc(turn))
    recent = df.withColumn("age", F.row_number().over(newest).cast("long")).where(F.col("age") <= limit)
    size = F.octet_length(text) + JOIN_BYTES
    used = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return recent.withColumn("used", used).where((F.col("age") == 1) | (F.col("used") <= budget))


def shapes_df(spark: SparkSession) -> DataFrame:
    """The built-in question shapes: (shape, title, asks)."""
    rows = [(i, name, title, asks) for i, (name, title, asks) in enumerate(SHAPES, 1)]
    return spark.createDataFrame(rows, "shape long, recipe string, title string, asks string")
