"""Query of the licence scan."""

from tablewise.llm import licenses
from tablewise.llm.common import table
from tablewise.llm.registry import query


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    """Sentences exploded and joined in SQL, rules as a chain of replacements."""
    known = ", ".join(f"({_quoted(v)}, {_quoted('<' + k + '>')})" for k, v in licenses.SENTENCES.items())
    steps, last = [], "i"
    for n, (_, needed) in enumerate(licenses.RULES):
        pattern = _quoted("".join(f"<{k}>" for k in needed))
        steps.append(f"r{n} AS (SELECT *, contains(rest{n}, {pattern}) AS hit{n}, replace(rest{n}, {pattern}, '|') AS rest{n + 1} FROM {last})")
        last = f"r{n}"
    names = "[" + ", ".join(_quoted(name) for name, _ in licenses.RULES) + "]"
    hits = "[" + ", ".join(f"CASE WHEN hit{n} THEN {n} END" for n in range(len(licenses.RULES))) + "]"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n')) AS x,
      generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n'), 1) AS n FROM documents),
k AS (SELECT doc_id, string_agg(id, '' ORDER BY n) AS ids FROM s JOIN known ON trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = sentence GROUP BY 1),
i AS (SELECT doc_id, coalesce(ids, '') AS ids, coalesce(ids, '') AS rest0 FROM documents LEFT JOIN k USING (doc_id)),
{", ".join(steps)},
h AS (SELECT doc_id, ids, list_transform(list_filter({hits}, lambda x: x IS NOT NULL), lambda x: {names}[x + 1]) AS found FROM {last})
SELECT doc_id, rtrim(replace(replace(ids, '<', ''), '>', ' ')) AS license_sentences, (length(ids) - length(replace(ids, '<', '')))::BIGINT AS n_license_sentences,
       array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ', ') AS licenses
FROM h"""


@query("op9_license_scan", _sql())
def op9(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *licenses.NEW)
