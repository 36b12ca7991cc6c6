"""Licence scan: normalised sentences become identifiers, identifier sequences match ordered rules.

Only DataFrame functions: a text is normalised (lower case, everything but letters and digits one space) with marks
where sentences may end, and known licence sentences are taken from mark to mark, the longest first. Blank lines
and white space after a full stop, colon, semicolon, exclamation or question mark end every sentence. A single line
end, white space after an abbreviation (``v.``) and the number of a list item may end one or stand inside one, so
that wrapped licence texts are found like unwrapped ones. What is not known falls away. The rules, in their order, are then looked for in the sequence of identifiers; a match uses its identifiers up, so
that a rule for the whole text of a licence goes before one for a single line of it.

Each document is judged on its own: nothing is shuffled. Sentences and rules are parameters.

Defined cases: a null or empty text has no sentences. Repeated rows are judged alike, repeated licences count each
time but are named once. An empty table gives an empty result. Input columns called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of licence texts and notices, by identifier.
SENTENCES = {
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "ccbync_notice": "licensed under cc by nc 4 0",
    "mit_notice": "released under the mit license",
    "apache_notice": "licensed under the apache license version 2 0",
    "mit_name": "the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_grant": "you may not use this file except in compliance with the license",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl_free": "this program is free software",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccby_notice": "licensed under cc by 4 0",
    "ccbysa_notice": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
}
#: Ordered rules: licence and the identifiers that follow one another.
RULES = (
    ("MIT", ("mit_name", "mit_grant", "mit_condition", "as_is")),
    ("MIT", ("mit_grant", "mit_condition", "as_is")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_notice", "apache_grant", "apache_as_is")),
    ("GPL-3.0", ("gpl_free", "gpl_terms", "gpl_hope")),
    ("GPL-3.0", ("gpl_terms",)),
    ("GPL-3.0", ("gpl3_notice",)),
    ("CC-BY-NC-4.0", ("ccbync_notice",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_name",)),
    ("Apache-2.0", ("apache_notice",)),
    ("MPL-2.0", ("mpl_notice",)),
    ("CC-BY-4.0", ("ccby_notice",)),
    ("CC-BY-SA-4.0", ("ccbysa_notice",)),
    ("Proprietary", ("reserved",)),
)
#: Canonical sentences of the licence texts that say more than those above, by the same identifiers.
WHOLE = {
    "mit_name": ("mit license", "the mit license mit", "mit license mit"),
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit_condition": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "as_is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "apache_notice": ("licensed under the apache license version 2 0 the license",),
    "mpl_notice": ("this source code form is subject to the terms of the mozilla public license version 2 0",),
}
#: Every known sentence holds one of these words, so a text without them needs no search (a test holds this).
HINTS = "(?i)licensed|license|permission|warranty|redistribution|endorse|compliance|warranties|software|redistribute|reserved"
#: Marks in the normalised text: a sentence ends, and a sentence may end.
END, MAYBE = "\ue000", "\ue001"
SPACE = r"[\x20\x09-\x0D]+"
#: Where the marks go, in this order; lines of comment signs only are blank too.
MARKS = (
    (r"(?<=\n)[^\p{L}\p{N}\n]*(?:\p{N}{1,2}|[a-z])[.)]" + SPACE, MAYBE),
    (r"(?<=\b(?:v|ver|vers|inc|ltd|corp|co)\.)" + SPACE, MAYBE),
    (r"\n[^\p{L}\p{N}\n" + END + MAYBE + r"]*(?=\n)|(?<=[.;:!?])" + SPACE, END),
    (r"\n", MAYBE),
    (r"[^\p{L}\p{N}" + END + MAYBE + r"]+", " "),
    (" *([" + END + MAYBE + "]) *", "$1"),
    (END + "[" + END + MAYBE + "]+|" + MAYBE + "+(?:" + END + "[" + END + MAYBE + "]*)", END),
    (MAYBE + "+", MAYBE),
)
NEW = ["license_sentences", "n_license_sentences", "licenses"]


def known_sentences(sentences: Mapping[str, str], whole: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Identifiers by sentence, the longest sentence first."""
    every = {s: k for k, v in sentences.items() for s in (v, *whole.get(k, ()))}
    return dict(sorted(every.items(), key=lambda x: -len(x[0])))


def sentence_ids(text: Column, known: Mapping[str, str], hints: str | None) -> Column:
    """Identifiers ``<a><b>`` of the known sentences of ``text``, in order."""
    plain = F.lower(F.translate(text, END + MAYBE, "  "))
    for pattern, mark in MARKS:
        plain = F.regexp_replace(plain, pattern, mark)
    ends = f"[{END}{MAYBE}]"
    one = "|".join(s.replace(" ", f"[ {MAYBE}]") for s in known)
    found = F.regexp_extract_all(F.concat(F.lit(END), F.trim(plain), F.lit(END)), F.lit(f"(?<={ends})(?:{one})(?={ends})"), F.lit(0))
    names = F.create_map(*[F.lit(x) for s, k in known.items() for x in (s, f"<{k}>")])
    ids = F.array_join(F.transform(found, lambda s: names[F.translate(s, MAYBE, " ")]), "")
    ids = F.when(text.rlike(hints), ids) if hints else ids
    return F.coalesce(ids, F.lit(""))


def scanned(
    docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, hints: str | None = HINTS, whole: Mapping[str, Sequence[str]] = WHOLE
) -> DataFrame:
    """The input with the identifiers found (joined by a space), their number, and the licences (in the rules' order, joined by a comma).

    ``whole`` has further sentences for identifiers of ``sentences``. Give ``hints=None`` with sentences of your own
    that it does not cover.
    """
    old = [F.col(f"`{c}`") for c in docs.columns if c not in NEW]
    out = docs.select(*old, sentence_ids(F.col("text"), known_sentences(sentences, whole), hints).alias("_ids")).withColumn("_left", F.col("_ids"))
    for i, (_, needed) in enumerate(rules):
        pattern = "".join(f"<{k}>" for k in needed)
        out = out.select("*", F.contains("_left", F.lit(pattern)).alias(f"_hit{i}")).withColumn("_left", F.replace("_left", F.lit(pattern), F.lit("|")))
    found = F.array_distinct(F.filter(F.array(*[F.when(F.col(f"_hit{i}"), F.lit(r[0])) for i, r in enumerate(rules)]), lambda x: x.isNotNull()))
    names = F.rtrim(F.regexp_replace(F.regexp_replace("_ids", "<", ""), ">", " "))
    return out.select(*old, names.alias(NEW[0]), F.regexp_count("_ids", F.lit("<")).cast("bigint").alias(NEW[1]), F.array_join(found, ", ").alias(NEW[2]))
