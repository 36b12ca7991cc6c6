"""T1-T6: tokens, BM25, routing, budgets, sections and transcripts."""

from pyspark.sql import functions as F

from queries.base import query
from tablewise.operators import retrieval as T
from tablewise.operators.shapes import SHAPES

# Fixed values, stated again so that the SQL does not lean on the code under test.
WORD = "[a-z][a-z0-9_]*|[0-9]+"
SUFFIXES = (("ation", "at", 7), ("ate", "at", 7), ("ing", "", 6), ("ed", "", 5), ("ly", "", 5))
NOISE = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "calculate", "can", "compute", "did", "do",
    "does", "each", "find", "for", "from", "get", "give", "had", "has", "have", "how", "i", "in", "into",
    "is", "it", "its", "like", "list", "make", "many", "me", "my", "need", "of", "on", "or", "our", "out",
    "please", "show", "so", "some", "tell", "that", "the", "their", "them", "then", "there", "these",
    "they", "this", "to", "us", "use", "want", "was", "we", "were", "what", "which", "who", "whose", "why",
    "will", "would", "you", "your",
)


def stem_sql(w):
    """The stemming rules as SQL."""
    singular = (
        f"CASE WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN {w}[:-4] || 'y' "
        f"WHEN length({w}) > 3 AND regexp_matches({w}, '[^sui]s$') THEN {w}[:-2] ELSE {w} END"
    )
    rules = " ".join(
        f"WHEN length(s) >= {n} AND suffix(s, '{end}') THEN s[:-{len(end) + 1}] || '{new}'"
        for end, new, n in SUFFIXES
    )
    return singular, f"CASE {rules} ELSE s END"


def tokens_sql(source, ident, text):
    """(id, term) for each token of a text."""
    singular, suffix = stem_sql("w")
    return f"""
SELECT id, {suffix} AS term FROM (SELECT id, {singular} AS s FROM (
  SELECT id, w FROM raw_{source}
  UNION ALL SELECT id, unnest(list_filter(string_split(w, '_'), lambda p: p <> '')) FROM raw_{source} WHERE contains(w, '_')
  UNION ALL SELECT id, replace(w, '_', '') FROM raw_{source} WHERE contains(w, '_')))"""


def raw_sql(source, ident, text):
    return f"raw_{source} AS (SELECT {ident} AS id, unnest(regexp_extract_all(lower({text}), '{WORD}')) AS w FROM {source})"


@query("t1_tokens", "documents", sql=f"""
WITH {raw_sql("documents", "doc_id", "text")} SELECT term, count(*) AS n FROM ({tokens_sql("documents", "doc_id", "text")}) GROUP BY 1""")
def t1(documents):
    return T.token_counts(documents, "text")


_NOISE_ROWS = ", ".join(f"('{w}')" for w in NOISE)
BM25_SQL = f"""
WITH {raw_sql("documents", "doc_id", "text")}, {raw_sql("benchmark", "item_id", "text")},
d AS MATERIALIZED ({tokens_sql("documents", "doc_id", "text")}),
noise AS (SELECT {stem_sql("s")[1]} AS term FROM (SELECT {stem_sql("w")[0]} AS s FROM (VALUES {_NOISE_ROWS}) v(w))),
q AS (SELECT id AS query, term, count(*) AS w FROM ({tokens_sql("benchmark", "item_id", "text")})
      WHERE term NOT IN (SELECT term FROM noise) GROUP BY 1, 2),
tf AS (SELECT id AS doc, term, count(*) AS tf FROM d GROUP BY 1, 2),
len AS (SELECT doc_id AS doc, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT id, count(*) AS n FROM d GROUP BY 1) ON doc_id = id),
st AS (SELECT count(*) AS docs, avg(n) AS average FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query, doc, sum(w * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / average))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc)
SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


@query("t2_bm25", "documents", "benchmark", sql=BM25_SQL)
def t2(documents, benchmark):
    found = T.search(documents, "doc_id", "text", benchmark, "item_id", "text")
    return found.withColumn("score", F.round("score", 6))


_SHAPES = ", ".join(f"({i}, '{title.lower()}', '{asks.lower()}')" for i, (_, title, asks) in enumerate(SHAPES, 1))
#: Titles count three times, each word once; two more words are noise.
ROUTE_SQL = f"""
WITH shapes(shape, title, asks) AS (VALUES {_SHAPES}),
asked AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'),
{raw_sql("shapes", "shape", "title").replace("raw_shapes", "raw_titles")}, {raw_sql("shapes", "shape", "asks").replace("raw_shapes", "raw_asks")},
{raw_sql("asked", "id", "text")},
d AS MATERIALIZED (SELECT id, term FROM (SELECT DISTINCT * FROM ({tokens_sql("titles", "", "")})), range(3)
                   UNION ALL SELECT * FROM ({tokens_sql("asks", "", "")})),
noise AS (SELECT {stem_sql("s")[1]} AS term FROM (SELECT {stem_sql("w")[0]} AS s FROM (VALUES {_NOISE_ROWS}, ('category'), ('per')) v(w))),
q AS (SELECT id AS query, term, count(*) AS w FROM ({tokens_sql("asked", "", "")}) WHERE term NOT IN (SELECT term FROM noise) GROUP BY 1, 2),
tf AS (SELECT id AS doc, term, count(*) AS tf FROM d GROUP BY 1, 2),
len AS (SELECT id AS doc, count(*) AS n FROM d GROUP BY 1),
st AS (SELECT count(*) AS docs, avg(n) AS average FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query, doc, sum(w * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / average))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc)
SELECT query, doc::BIGINT AS doc, round(score, 6) AS score, rank FROM r WHERE rank <= 1"""


@query("t3_route_questions", "conversations", sql=ROUTE_SQL)
def t3(conversations):
    questions = conversations.where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question")
    )
    found = T.route(questions, "question_id", "question", T.shapes_df(conversations.sparkSession))
    return found.withColumn("score", F.round("score", 6))


#: Documents by rank: one that fits is kept, one that does not is passed over; a first one that is too big is cut at a line, and ends it.
CONTEXT_SQL = f"""
WITH RECURSIVE found AS MATERIALIZED ({BM25_SQL}),
hit AS MATERIALIZED (SELECT query, rank, text, strlen(text) AS size FROM found JOIN documents ON doc_id = doc),
fit AS (
  SELECT DISTINCT query, 0::BIGINT AS rank, 0::BIGINT AS used, false AS kept, false AS clipped, false AS started, false AS done FROM hit
  UNION ALL
  SELECT h.query, h.rank, CASE WHEN NOT done AND used + size <= 4000 THEN used + size + 2 ELSE used END, NOT done AND used + size <= 4000,
         NOT done AND used + size > 4000 AND NOT started, started OR NOT done, done OR used + size > 4000 AND NOT started
  FROM fit f JOIN hit h ON h.query = f.query AND h.rank = f.rank + 1),
line AS (
  SELECT query, rank, i, x, sum(strlen(x) + 1) OVER (PARTITION BY query, rank ORDER BY i) AS used FROM (
    SELECT query, rank, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM hit JOIN fit USING (query, rank) WHERE clipped)),
cut AS (SELECT query, rank, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (used <= 3996), '') AS text,
               count(*) FILTER (used <= 3996 AND starts_with(x, '```')) % 2 = 1 AS open FROM line GROUP BY 1, 2),
part AS (SELECT query, rank, text FROM hit JOIN fit USING (query, rank) WHERE kept
         UNION ALL SELECT query, rank, CASE WHEN open THEN text || chr(10) || '```' ELSE text END FROM cut)
SELECT query, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM part GROUP BY 1"""


@query("t4_budgeted_context", "documents", "benchmark", sql=CONTEXT_SQL)
def t4(documents, benchmark):
    found = T.search(documents, "doc_id", "text", benchmark, "item_id", "text")
    return T.context(found, documents, "doc_id", "text", 4_000)


def marked_up(conversations):
    """Each turn as a small document with two numbered headings and a fence that holds a false one."""
    n = (F.col("turn") + 1).cast("string")
    text = F.concat(
        F.lit("# "), n, F.lit(". Turn of "), F.col("role"), F.lit("\n## "), n, F.lit(".1 Said\n"), F.col("text"),
        F.lit("\n```\n# 9 Not a heading\n```\n"),
    )
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc")
    return conversations.select(key, text.alias("text"))


@query("t5_sections", "conversations", sql=r"""
SELECT conv_id * 1000 + turn AS doc, 2::BIGINT AS section, (turn + 1)::VARCHAR || '.1' AS number, 'Said' AS title,
       'Turn of ' || role AS parent,
       md5(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g') || chr(10) || '```' || chr(10) || '# 9 Not a heading' || chr(10) || '```',
           '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS body FROM conversations""")
def t5(conversations):
    df = T.sections(marked_up(conversations), "doc", "text")
    return df.withColumn("body", F.md5("body"))


@query("t6_recent_transcript", "conversations", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations),
u AS (SELECT *, sum(strlen(text) + 2) OVER (PARTITION BY conv_id ORDER BY age) AS used FROM r WHERE age <= 6)
SELECT conv_id, turn, role, age, CAST(used AS BIGINT) AS used FROM u WHERE age = 1 OR used <= 1800""")
def t6(conversations):
    return T.recent_transcript(conversations, "conv_id", "turn", "text").drop("text")
