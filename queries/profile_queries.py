"""P, Q, M and K: profiling, quality, masking and the card."""

from pyspark.sql import functions as F

from queries.base import query
from tablewise.functions import masking
from tablewise.operators import quality, stats
from tablewise.plans import card, profile

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUMERIC = LINEITEM[:8]


def union(template, names):
    return "\nUNION ALL\n".join(template.replace("{c}", n) for n in names)


_CLASSES = ["l_returnflag", "l_linestatus"]
_PROFILE = """
SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, {kind} AS semantic,
       {numeric} AS numeric, {classes} AS classes, {when} AS period
FROM lineitem"""
_FIGURES = """{{'n': count({c}), 'minimum': round(min({c})::DOUBLE, 4), 'maximum': round(max({c})::DOUBLE, 4), 'mean': round(avg({c}), 4),
 'median': round(quantile_cont({c}::DOUBLE, 0.5), 4), 'std': round(stddev_samp({c}), 4), 'q1': round(quantile_cont({c}::DOUBLE, 0.25), 4),
 'q3': round(quantile_cont({c}::DOUBLE, 0.75), 4), 'zeros': count_if({c} = 0)::BIGINT, 'negatives': count_if({c} < 0)::BIGINT,
 'fence': (SELECT count_if({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))::BIGINT FROM lineitem,
   (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM lineitem)),
 'z': (SELECT count_if(abs({c} - m) * 0.6745 / d > 3.5)::BIGINT FROM lineitem,
   (SELECT m, quantile_cont(abs(x.{c} - m)::DOUBLE, 0.5) AS d FROM lineitem x, (SELECT quantile_cont({c}::DOUBLE, 0.5) AS m FROM lineitem) GROUP BY m))}}"""
_TOP = """(SELECT list(v || ' ' || n ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1))"""
_FIELDS = ("n", "minimum", "maximum", "mean", "median", "std", "q1", "q3", "zeros", "negatives")


def _profile_sql():
    for c in LINEITEM:
        parts = {"kind": "'numeric'", "numeric": "NULL", "classes": "NULL", "when": "NULL"}
        if c in LINEITEM_NUMERIC:
            parts["numeric"] = _FIGURES.format(c=c)
        elif c in _CLASSES:
            parts |= {"kind": "'categorical'", "classes": _TOP.format(c=c)}
        else:
            parts |= {"kind": "'temporal'", "when": "[substr(min(l_shipdate)::VARCHAR, 1, 10), substr(max(l_shipdate)::VARCHAR, 1, 10)]"}
        yield _PROFILE.format(c=c, **parts)


@query("p_profile_lineitem", "lineitem", sql="\nUNION ALL\n".join(_profile_sql()))
def p_profile(lineitem):
    table = profile.profile(lineitem, name="lineitem").to_df(lineitem.sparkSession)
    rounded = {"minimum", "maximum", "mean", "median", "std", "q1", "q3"}
    figures = [(F.round(f"numeric.{c}", 4) if c in rounded else F.col(f"numeric.{c}")).alias(c) for c in _FIELDS]
    numeric = F.struct(*figures, F.col("iqr_outliers").alias("fence"), F.col("modified_z_outliers").alias("z"))
    shown = F.transform("categorical.top", lambda t: F.concat_ws(" ", t["value"], t["n"]))
    ends = F.array(F.substring("temporal.earliest", 1, 10), F.substring("temporal.latest", 1, 10))
    return table.select(
        "name", "null_count", "n_unique", "semantic",
        F.when(F.col("numeric").isNotNull(), numeric).alias("numeric"), shown.alias("classes"), F.when(F.col("temporal").isNotNull(), ends).alias("period"),
    )


_WORDS = "CASE WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) <= 0.2 * count(*) THEN 'categorical' ELSE 'text' END"
_SEMANTIC = {"event_id": "'identifier'", "ts": "'temporal'", "user_id": "'numeric'", "event_type": _WORDS, "value": "'numeric'", "props": _WORDS}


@query("p_sampled_profile", "events", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, {kind.format(c=c)} AS semantic, true AS estimated, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique"
    " FROM events WHERE ('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT % 3 = 0" for c, kind in _SEMANTIC.items()))
def p_sampled(events):
    result = profile.profile(
        events, name="events", sample_key="event_id", stride=3
    )
    return result.to_df(events.sparkSession).select("name", "semantic", "estimated", "null_count", "n_unique")


@query("p_nulls_distinct", "orders", sql=union("""
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS "distinct" FROM o""",
["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
).replace("FROM o", """FROM (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)"""))
def p_nulls(orders):
    df = orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return stats.nulls_distinct(df).withColumn("null_rate", F.round("null_rate", 6))


@query("p_numeric_stats", "lineitem", sql=union("""
SELECT '{c}' AS "column", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS minimum,
CAST(max({c}) AS DOUBLE) AS maximum, round(avg({c}), 4) AS mean,
round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3,
CAST(count_if({c} = 0) AS BIGINT) AS zeros, CAST(count_if({c} < 0) AS BIGINT) AS negatives,
(SELECT round(avg((CAST(x.{c} AS DOUBLE) - m) ** 3) / pow(avg((CAST(x.{c} AS DOUBLE) - m) ** 2), 1.5) + 0.0, 3)
 FROM lineitem x, (SELECT avg({c}) AS m FROM lineitem)) AS skew
FROM lineitem""", LINEITEM_NUMERIC))
def p_numeric(lineitem):
    df = stats.numeric_stats(lineitem)
    return df.withColumns(
        {c: F.round(c, 4) for c in ("mean", "median", "std", "q1", "q3")} | {"skew": F.round("skew", 3) + 0.0}
    )


@query("p_value_counts", "lineitem", sql=union("""
SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2""",
LINEITEM))
def p_values(lineitem):
    return stats.value_counts(lineitem, lineitem.columns)


@query("p_categorical_stats", "part", sql=union("""
SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM part) AS "distinct", max(n) AS max_n, min(n) AS min_n,
round(max(n) / min(n), 6) AS imbalance_ratio, max(CASE WHEN rn = 1 THEN v END) AS top_value,
max(CASE WHEN rn = 5 THEN v END) AS fifth_value
FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn
      FROM part GROUP BY 1)""", ["p_brand", "p_type", "p_name"]))
def p_categorical(part):
    df = stats.categorical_stats(part, ["p_brand", "p_type", "p_name"])
    return df.select(
        "column", "distinct", "max_n", "min_n", F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
        F.get("top", F.lit(0))["value"].alias("top_value"), F.get("top", F.lit(4))["value"].alias("fifth_value"),
    )


@query("p_temporal_stats", "orders", sql="""
SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS earliest,
       strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(DISTINCT o_orderdate) AS "distinct" FROM orders
UNION ALL
SELECT 'as_text', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'),
       count(DISTINCT o_orderdate) FROM orders""")
def p_temporal(orders):
    df = orders.select("o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy").alias("as_text"))
    out = stats.temporal_stats(df, {"o_orderdate": None, "as_text": "%d.%m.%Y"})
    return out.withColumns({c: F.substring(c, 1, 10) for c in ("earliest", "latest")})


@query("p_text_stats", "documents", sql="""
SELECT 'text' AS "column", count(text) AS n, min(length(text)) AS min_length, max(length(text)) AS max_length,
       round(avg(length(text)), 4) AS mean_length,
       CAST(count_if(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') = '') AS BIGINT) AS empty_strings FROM documents""")
def p_text(documents):
    df = stats.text_stats(documents, ["text"])
    return df.withColumns(
        {"mean_length": F.round("mean_length", 4)}
        | {c: F.col(c).cast("long") for c in ("min_length", "max_length")}
    )


@query("p_semantic_types", "orders", sql="""
SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'),
  ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t("column", dtype)
JOIN (
""" + union("""SELECT '{c}' AS "column", CASE
  WHEN '{c}' = 'o_orderdate' THEN 'temporal'
  WHEN '{c}' IN ('o_orderstatus', 'o_orderpriority') THEN CASE
    WHEN count(DISTINCT {c}) = count(*) THEN 'identifier'
    WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count(*) <= 0.2 THEN 'categorical' ELSE 'text' END
  WHEN count(DISTINCT {c}) = count(*) AND regexp_matches('{c}', '(^|_)(id|uuid|guid|key|code|sku|isbn)($|_)')
    THEN 'identifier'
  ELSE 'numeric' END AS semantic, count(*) > count({c}) AS nullable FROM orders""",
  ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + """
) USING ("column")""")
def p_semantic(orders):
    return profile.semantic_types(orders)


@query("p_detect_dates", "orders", sql="""
SELECT 'day_first' AS "column", '%d/%m/%Y' AS format, count(*) AS parsed, false AS ambiguous FROM orders
UNION ALL SELECT 'short', '%m/%d/%y', count(*), false FROM orders
UNION ALL SELECT 'unclear', '%m/%d/%Y', CAST(count_if(day(o_orderdate) <= 12) AS BIGINT), true FROM orders""")
def p_dates(orders):
    df = orders.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"),
        F.date_format("o_orderdate", "MM/dd/yy").alias("short"),
        F.when(F.dayofmonth("o_orderdate") <= 12, F.date_format("o_orderdate", "MM/dd/yyyy")).alias("unclear"),
        "o_orderpriority",
    )
    return stats.detect_dates(df)


@query("p_numeric_text", "orders", sql="""
SELECT 'plain' AS "column", bool_and(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NOT NULL) AS numeric_text
FROM orders
UNION ALL SELECT 'grouped', bool_and(TRY_CAST(format('{:t,}', CAST(o_totalprice AS BIGINT)) AS DOUBLE) IS NOT NULL) FROM orders
UNION ALL SELECT 'o_orderpriority', bool_and(TRY_CAST(o_orderpriority AS DOUBLE) IS NOT NULL) FROM orders""")
def p_numeric_text(orders):
    df = orders.select(
        F.col("o_totalprice").cast("string").alias("plain"),
        F.format_number("o_totalprice", 2).alias("grouped"),
        "o_orderpriority",
    )
    return stats.numeric_text(df)


@query("p_candidate_keys", "orders", sql=f"""
SELECT "column" FROM ({union("SELECT '{c}' AS \"column\", count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS k FROM orders",
["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])}) WHERE k""")
def p_keys(orders):
    return quality.candidate_keys(orders)


@query("q_duplicates", "documents", sql="""
SELECT count(*) AS rows, count(*) - count(DISTINCT (text, lang, source)) AS duplicate_rows FROM documents""")
def q_duplicates(documents):
    return quality.duplicates(documents.select("text", "lang", "source")).select("rows", "duplicate_rows")


@query("q_near_duplicates", "documents", sql=r"""
SELECT count(*) AS rows, count(*) - count(DISTINCT (text, lang)) AS duplicate_rows,
  count(*) - count(DISTINCT (lower(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lower(lang)))
    AS near_duplicate_rows FROM documents""")
def q_near(documents):
    return quality.duplicates(documents.select("text", "lang"))


@query("q_null_issues", "lineitem", sql="""
SELECT 'l_nothing' AS "column", 'all_null' AS kind, 1.0::DOUBLE AS null_rate, 'warning' AS severity
UNION ALL SELECT * FROM (
  SELECT 'l_returnflag' AS "column", CASE WHEN r >= 0.6 THEN 'high_null_rate' WHEN r >= 0.2 THEN 'null_rate' END AS kind,
         round(r, 6), CASE WHEN r >= 0.6 THEN 'warning' ELSE 'info' END
  FROM (SELECT CAST(count_if(l_returnflag = 'A') AS BIGINT) / count(*) AS r FROM lineitem)
  UNION ALL
  SELECT 'l_quantity', CASE WHEN r >= 0.6 THEN 'high_null_rate' WHEN r >= 0.2 THEN 'null_rate' END,
         round(r, 6), CASE WHEN r >= 0.6 THEN 'warning' ELSE 'info' END
  FROM (SELECT CAST(count_if(l_quantity <= 40) AS BIGINT) / count(*) AS r FROM lineitem)) WHERE kind IS NOT NULL""")
def q_nulls(lineitem):
    df = lineitem.select(
        "l_orderkey",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_quantity") > 1e9, F.col("l_quantity")).alias("l_nothing"),
    )
    return quality.null_issues(df).withColumn("null_rate", F.round("null_rate", 6))


@query("q_shape_issues", "orders", sql="""
WITH d AS (SELECT o_orderkey::VARCHAR || '/' || o_custkey AS label, 'same' AS fixed,
                  CASE WHEN o_orderkey % 50 = 0 THEN 'rare' ELSE 'usual' END AS lopsided FROM orders),
s AS (""" + union("""SELECT '{c}' AS "column", count(*) AS "distinct", CAST(sum(n) AS BIGINT) AS n, max(n) AS max_n,
  min(n) AS min_n FROM (SELECT {c}, count(*) AS n FROM d GROUP BY 1)""", ["label", "fixed", "lopsided"]) + """)
SELECT *, 'constant' AS kind, 'warning' AS severity FROM s WHERE "distinct" = 1
UNION ALL SELECT *, 'near_constant', 'warning' FROM s WHERE "distinct" > 1 AND max_n / n >= 0.95
UNION ALL SELECT *, 'high_cardinality', 'info' FROM s WHERE "column" = 'label' AND "distinct" / n >= 0.9
UNION ALL SELECT *, 'class_imbalance', 'info' FROM s WHERE "column" = 'lopsided' AND max_n / min_n >= 10""")
def q_shapes(orders):
    df = orders.select(
        F.concat_ws("/", "o_orderkey", "o_custkey").alias("label"),
        F.lit("same").alias("fixed"),
        F.when(F.col("o_orderkey") % 50 == 0, "rare").otherwise("usual").alias("lopsided"),
    )
    return quality.shape_issues(df, {"label": "text", "fixed": "categorical", "lopsided": "categorical"})


@query("q_outliers_iqr", "events", sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'value' AS "column", count(*) AS iqr_outliers FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_iqr(events):
    return quality.outlier_counts(events, ["value"]).select("column", "iqr_outliers")


@query("q_outliers_mad", "events", sql="""
WITH m AS (SELECT median(value) AS med FROM events),
d AS (SELECT abs(value - med) AS dev FROM events, m),
s AS (SELECT median(dev) AS mad, avg(dev) AS mean_ad FROM d)
SELECT 'value' AS "column", CAST(count_if(CASE WHEN mad > 0 THEN dev * 0.6745 / mad
  WHEN mean_ad > 0 THEN dev / (1.253314 * mean_ad) END > 3.5) AS BIGINT) AS modified_z_outliers FROM d, s""")
def q_mad(events):
    return quality.outlier_counts(events, ["value"]).select("column", "modified_z_outliers")


@query("m_redact_customer", "customer", sql="""
SELECT c_custkey, '<redacted>' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def m_redact(customer):
    return masking.mask_table(customer)


_W = r"[\pL\pM\p{Nd}\p{Pc}"
PLAIN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    rf"'{_W}.+-]+@{_W}-]+\.{_W}.-]{{2,}}', '<email>', 'g'), "
    r"'\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b', '<iban>', 'g'), "
    r"'\b\d{3}-\d{2}-\d{4}\b', '<id>', 'g'), "
    r"'\b(?:\d{1,3}\.){3}\d{1,3}\b', '<ip>', 'g')"
)


@query("m_mask_documents", "documents", sql=f"SELECT doc_id, md5({PLAIN_SQL}) AS masked FROM documents")
def m_documents(documents):
    text = F.col("text")
    for kind in ("email", "iban", "national_id", "ip"):
        text = masking.mask_one(text, kind)
    return documents.select("doc_id", F.md5(text).alias("masked"))


# RE2 knows word boundaries between ASCII characters only, so letters beyond ASCII become "x" first.
@query("m_mask_cards", "documents", sql=r"""
WITH m AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'),
                                             '\b(?:\d[ -]?){13,19}\b') AS hits FROM documents)
SELECT doc_id, len(list_filter(hits, lambda h: list_sum(list_transform(
    string_split(reverse(regexp_replace(h, '[^0-9]', '', 'g')), ''),
    lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT * 2 > 9 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0
    )) AS cards FROM m""")
def m_cards(documents):
    masked = masking.mask_one(F.col("text"), "card")
    cards = F.regexp_count(masked, F.lit("<card>")).cast("long")
    return documents.select("doc_id", cards.alias("cards"))


# The same rules in RE2. Its word boundary knows ASCII only, so a character beyond ASCII stands between two "x" while a
# rule is applied. It has no look-behind: before "+" that is \\B, before a digit \\b.
def _wrapped(t):
    return rf"regexp_replace({t}, '([^\x00-\x7F])', 'x\1x', 'g')"


def _unwrapped(t):
    return rf"regexp_replace({t}, 'x([^\x00-\x7F])x', '\1', 'g')"


def _replaced(t, pattern, test, placeholder):
    """Each match ``h`` that passes ``test`` is replaced: the pieces between matches and the matches, joined again."""
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, '{pattern}'), regexp_extract_all({t}, '{pattern}')),"
        f" lambda p: p[1] || coalesce(list_transform([p[2]], lambda h: CASE WHEN {test} THEN '{placeholder}' ELSE h END)[1], '')), '')"
    )


_DIGITS = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"""len({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''),
  lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT * 2 > 9 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0"""
_DIALS = f"len({_DIGITS}) BETWEEN 7 AND 15 AND len(h) - len(replace(h, '(', '')) = len(h) - len(replace(h, ')', ''))"


def _cards(t):
    return _replaced(t, r"\b(?:\d[ -]?){13,19}\b", _LUHN, "<card>")


def _phones(t):
    return _replaced(t, r"(?:\B\+|\b)\d[\d\s().-]{7,17}\d\b", _DIALS, "<phone>")


_STEPS = rf"""
t0 AS (SELECT doc_id, source, text AS t, {_wrapped("text")} AS t0 FROM documents),
t1 AS (SELECT *, regexp_replace(t0, '{_W}.+-]+@{_W}-]+\.{_W}.-]{{2,}}', '<email>', 'g') AS t1 FROM t0),
t2 AS (SELECT *, regexp_replace(t1, '\b[A-Z]{{2}}\d{{2}}[A-Z0-9]{{10,30}}\b', '<iban>', 'g') AS t2 FROM t1),
t3 AS (SELECT *, regexp_replace(t2, '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '<id>', 'g') AS t3 FROM t2),
t4 AS (SELECT *, regexp_replace(t3, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '<ip>', 'g') AS t4 FROM t3),
t5 AS (SELECT *, {_cards("t4")} AS t5 FROM t4),
t6 AS (SELECT *, {_phones("t5")} AS t6 FROM t5)"""


@query("m_mask_phones", "documents", sql=f"""
WITH t0 AS (SELECT doc_id, {_wrapped("text")} AS t0 FROM documents), t1 AS (SELECT doc_id, {_phones("t0")} AS t1 FROM t0)
SELECT doc_id, {_unwrapped("t1")} AS masked FROM t1""")
def m_phones(documents):
    return documents.select("doc_id", masking.mask_one(F.col("text"), "phone").alias("masked"))


@query("m_mask_text", "documents", sql=f"WITH {_STEPS} SELECT doc_id, {_unwrapped('t6')} AS masked FROM t6")
def m_text(documents):
    return documents.select("doc_id", masking.mask_text(F.col("text")).alias("masked"))


@query("m_pii_report", "documents", sql=f"""
WITH {_STEPS}
SELECT source, kind, count(*) AS n FROM (
  SELECT source, unnest([CASE WHEN t1 <> t0 THEN 'email' END, CASE WHEN t2 <> t1 THEN 'iban' END, CASE WHEN t3 <> t2 THEN 'national_id' END,
                         CASE WHEN t4 <> t3 THEN 'ip' END, CASE WHEN t5 <> t4 THEN 'card' END, CASE WHEN t6 <> t5 THEN 'phone' END]) AS kind FROM t6)
WHERE kind IS NOT NULL GROUP BY 1, 2""")
def m_report(documents):
    return masking.kinds_by(documents, "text", ["source"])


@query("m_masked_preview", "customer", sql="""
SELECT format('{:t,}', c_custkey) AS c_custkey, '<redacted>' AS c_name, format('{:t,}', c_nationkey) AS c_nationkey, c_mktsegment,
  (SELECT count(*) FROM customer) - 25 AS rows_not_shown FROM customer ORDER BY customer.c_custkey DESC LIMIT 25""")
def m_preview(customer):
    return card.masked_preview(customer.drop("c_acctbal"), [F.desc("c_custkey")])


_RELATED = "l_quantity l_extendedprice l_tax net gross half tens".split()


@query("k_correlations", "lineitem", sql="""
WITH d AS (SELECT l_quantity, l_extendedprice, l_tax, l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, CASE WHEN l_linenumber <= 3 THEN l_quantity / 2 END AS half,
  CASE WHEN l_linenumber >= 3 THEN floor(l_quantity / 10) END AS tens FROM lineitem),
p AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM d"
    for i, a in enumerate(_RELATED) for b in _RELATED[i + 1 :]
) + """)
SELECT a, b, round(r, 2) AS r, count(*) OVER () AS pairs FROM p WHERE abs(r) >= 0.5 ORDER BY abs(r) DESC, a, b LIMIT 8""")
def k_correlations(lineitem):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = lineitem.select(
        "l_quantity", "l_extendedprice", "l_tax", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"),
        F.when(F.col("l_linenumber") <= 3, F.col("l_quantity") / 2).alias("half"),
        F.when(F.col("l_linenumber") >= 3, F.floor(F.col("l_quantity") / 10)).alias("tens"),
    )
    return card.correlation_shortlist(df, _RELATED)


@query("k_examples", "customer", sql="""
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1""")
def k_examples(customer):
    return card.first_by_category(customer, "c_mktsegment", "c_custkey").drop("c_name")


@query("k_examples_spaced", "events", sql="""
SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS pos,
  count(*) OVER () AS n FROM events) WHERE pos % (n // 5) = 0 AND pos // (n // 5) < 5""")
def k_spaced(events):
    df = events.select("event_id", "value")
    return card.evenly_spaced(df, "event_id", df.count(), 5)


_CARD_SCHEMA = (
    "name string, rows long, columns_count long, estimated boolean, candidate_keys array<string>, examples array<map<string, string>>, columns array<"
    "struct<name: string, type: string, unique: long, stats: struct<min: double, median: double, max: double>, top: array<struct<value: string, n: long>>,"
    " range: array<string>>>"
)
_CARD_COLUMNS = {  # type, least, middle, greatest, the three most frequent values
    **{c: ("numeric", f"min({c})", f"median({c})", f"max({c})", "NULL") for c in ("o_orderkey", "o_custkey", "o_totalprice")},
    **{c: ("categorical", "NULL", "NULL", "NULL",
           f"(SELECT string_agg({c} || ' ' || n, ', ' ORDER BY n DESC, {c}) FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3))")
       for c in ("o_orderstatus", "o_orderpriority")},
    "o_orderdate": ("temporal", "NULL", "NULL", "NULL", "strftime(min(o_orderdate), '%Y-%m-%d') || ', ' || strftime(max(o_orderdate), '%Y-%m-%d')"),
}


@query("k_card", "orders", sql=" UNION ALL ".join(f"""
SELECT 'orders' AS "table", count(*) AS rows, '{c}' AS "column", '{kind}' AS type, count(DISTINCT {c}) AS "unique", round({low}, 2)::DOUBLE AS least,
  round({middle}, 2)::DOUBLE AS middle, round({high}, 2)::DOUBLE AS greatest, {shown} AS shown, '{c}' = 'o_orderkey' AS candidate_key,
  true AS fits
FROM orders""" for c, (kind, low, middle, high, shown) in _CARD_COLUMNS.items()))
def k_card(orders):
    """The card, read back: one row for each of its columns."""
    result = profile.profile(orders, name="orders")
    made = card.build_card(result, orders, key="o_orderkey").to_df(orders.sparkSession)
    fits = (F.col("size_bytes") == F.octet_length("card")) & (F.col("size_bytes") <= 5_120) & (F.col("rows") == F.col("c.rows"))
    read = made.withColumn("c", F.from_json("card", _CARD_SCHEMA)).select(
        F.col("c.name").alias("table"), "rows", "c.candidate_keys", fits.alias("fits"), F.inline("c.columns")
    )
    top = F.array_join(F.transform("top", lambda t: F.concat_ws(" ", t["value"], t["n"])), ", ")
    ends = F.array_join(F.transform("range", lambda t: F.substring(t, 1, 10)), ", ")
    figures = {"least": "min", "middle": "median", "greatest": "max"}
    return read.select(
        "table", "rows", F.col("name").alias("column"), "type", "unique", *[F.round(f"stats.{c}", 2).alias(k) for k, c in figures.items()],
        F.coalesce(top, ends).alias("shown"), F.array_contains("candidate_keys", F.col("name")).alias("candidate_key"), "fits",
    )


def proposals(pages):
    """Each page asks for the parameters in the query string of its address."""
    return pages.select(
        "page_id",
        F.col("url").alias("question"),
        F.regexp_extract_all("url", F.lit(r"[?&#](\w+)"), F.lit(1)).alias("columns"),
    )


@query("k_validate_proposals", "pages", sql=r"""
WITH p AS (SELECT page_id, url AS question, regexp_extract_all(url, '[?&#](\w+)', 1) AS columns FROM pages)
SELECT page_id, question, row_number() OVER (ORDER BY page_id) AS rank FROM (
  SELECT * FROM p WHERE len(columns) > 0 AND list_has_all(['page', 'ref'], columns) ORDER BY page_id)""")
def k_validate(pages):
    return card.validate_proposals(proposals(pages), ["page", "ref"], "page_id").drop("columns")


@query("k_unknown_columns", "pages", sql=r"""
SELECT "column", count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(url, '[?&#](\w+)', 1))) AS "column"
FROM pages) WHERE "column" NOT IN ('page', 'ref') GROUP BY 1""")
def k_unknown(pages):
    return card.unknown_columns(proposals(pages), ["page", "ref"])
