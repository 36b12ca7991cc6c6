"""Words and identifiers of a text, stemmed crudely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewise.functions.text import let

# What a token is, the endings folded by the stemmer (ending, replacement, shortest
# word), and the words dropped from questions.
WORD = r"[a-z][a-z0-9_]*|[0-9]+"
SUFFIXES = (
    ("ation", "at", 7),
    ("ate", "at", 7),
    ("ing", "", 6),
    ("ed", "", 5),
    ("ly", "", 5),
)
# Words without weight in a search.
NOISE = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "calculate", "can", "compute", "did", "do",
    "does", "each", "find", "for", "from", "get", "give", "had", "has", "have", "how", "i", "in", "into",
    "is", "it", "its", "like", "list", "make", "many", "me", "my", "need", "of", "on", "or", "our", "out",
    "please", "show", "so", "some", "tell", "that", "the", "their", "them", "then", "there", "these",
    "they", "this", "to", "us", "use", "want", "was", "we", "were", "what", "which", "who", "whose", "why",
    "will", "would", "you", "your",
)
SHAPE_NOISE = ("category", "per")


def stem(word: Column) -> Column:
    """One plural rule, then the first suffix rule that applies."""
    size = F.length(word)
    singular = (
        F.when((size > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), size - 3), F.lit("y")))
        .when((size > 3) & word.rlike("[^sui]s$"), F.substring(word, F.lit(1), size - 1))
        .otherwise(word)
    )
    return let(singular, _strip_suffix)


def _strip_suffix(word: Column) -> Column:
    size = F.length(word)
    out = F.when(F.lit(False), word)
    for ending, replacement, shortest in SUFFIXES:
        cut = F.concat(F.substring(word, F.lit(1), size - len(ending)), F.lit(replacement))
        out = out.when((size >= shortest) & word.endswith(ending), cut)
    return out.otherwise(word)


def words(text: Column) -> Column:
    """Raw tokens. Identifiers also come as their parts and written together."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    parts = F.flatten(
        F.transform(
            F.filter(found, lambda w: w.contains("_")),
            lambda w: F.concat(
                F.filter(F.split(w, "_"), lambda p: p != ""),
                F.array(F.replace(w, F.lit("_"), F.lit(""))),
            ),
        )
    )
    return F.concat(found, parts)


def tokens(text: Column) -> Column:
    """Stemmed tokens, repeated as often as they occur."""
    return F.transform(words(text), stem)
