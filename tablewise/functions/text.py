"""Text helpers with Unicode semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind; ``trim`` removes spaces only.

    Most texts begin and end with a visible ASCII character, which is cheaper to see than to search for white space.
    """
    visible = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(visible, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def replace_first(text: Column, literal: str, replacement: str) -> Column:
    """Replace the first occurrence of a literal."""
    at = F.instr(text, literal)
    done = F.concat(
        F.substring(text, F.lit(1), at - 1),
        F.lit(replacement),
        F.substring(text, at + len(literal), F.length(text)),
    )
    return F.when(at > 0, done).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def substitute(text: Column, pattern: str, swap: Callable[[Column], Column]) -> Column:
    """Replace each match of ``pattern`` by ``swap(match)``.

    ``regexp_replace`` takes no callback, so the pieces between matches and the swapped matches are
    interleaved again. There is one piece more than matches; ``concat_ws`` skips the null that
    pads the shorter array.
    """

    def interleave(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1).alias("piece")
        pairs = F.arrays_zip(pieces, F.transform(matches, swap).alias("swap"))
        joined = F.array_join(F.transform(pairs, lambda p: F.concat_ws("", p["piece"], p["swap"])), "")
        return F.when(F.size(matches) > 0, joined).otherwise(text)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), interleave)
