"""Licence recognition by sentences and rules.

A text is normalised, the known licence sentences in it, wrapped or not, are mapped to identifiers, and
the identifiers of a text, in order, are matched against ordered rules: an early rule takes its sentences
before a later one sees them.  Everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of public licence texts, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "APACHE2_REF",
    "licensed under the apache license version 2 0 the license": "APACHE2_HEAD",
    "you may not use this file except in compliance with the license": "APACHE2_MAY",
    "you may obtain a copy of the license at": "APACHE2_COPY",
    "apache license version 2 0": "APACHE2_TITLE",
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "this project is licensed under the mit license": "MIT_REF",
    "the mit license": "MIT_TITLE",
    "the mit license mit": "MIT_TITLE",
    "mit license": "MIT_TITLE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "MIT_NOTICE",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "licensed under the gnu general public license version 3": "GPL3_REF",
    "this work is licensed under the gnu general public license version 2": "GPL2_REF",
    "licensed under the gnu general public license version 2": "GPL2_REF",
    "this program is free software": "GPL_FREE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version": "GPL3_LATER",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 2 of the license or at your option any later version": "GPL2_LATER",
    "licensed under cc by nc 4 0": "CC_BY_NC4_REF",
    "licensed under cc by sa 4 0": "CC_BY_SA4_REF",
    "licensed under cc by 4 0": "CC_BY4_REF",
    "licensed under cc0 1 0": "CC0_REF",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BSD_HEAD",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "BSD_NAME",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_HEAD",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_HEAD",
}
# Licences and the sequences of sentences that show them; early rules take precedence.
_ANY = "(?:[A-Z0-9_]+ )*?"
RULES = [
    ("BSD-3-Clause", f"BSD_HEAD {_ANY}BSD_SOURCE {_ANY}BSD_BINARY {_ANY}BSD_NAME "),
    ("BSD-2-Clause", f"BSD_HEAD {_ANY}BSD_SOURCE {_ANY}BSD_BINARY "),
    ("MIT", "(?:MIT_TITLE )?MIT_GRANT (?:MIT_NOTICE )?"),
    ("Apache-2.0", "APACHE2_HEAD (?:APACHE2_MAY )?(?:APACHE2_COPY )?"),
    ("GPL-3.0-or-later", "(?:GPL_FREE )?GPL3_LATER "),
    ("GPL-2.0-or-later", "(?:GPL_FREE )?GPL2_LATER "),
    ("ISC", "ISC_GRANT "),
    ("MPL-2.0", "MPL2_HEAD "),
    ("Unlicense", "UNLICENSE_HEAD "),
    ("CC-BY-NC-4.0", "CC_BY_NC4_REF "),
    ("CC-BY-SA-4.0", "CC_BY_SA4_REF "),
    ("CC-BY-4.0", "CC_BY4_REF "),
    ("CC0-1.0", "CC0_REF "),
    ("GPL-3.0-only", "GPL3_REF "),
    ("GPL-2.0-only", "GPL2_REF "),
    ("Apache-2.0", "APACHE2_REF |APACHE2_TITLE "),
    ("MIT", "MIT_REF |MIT_TITLE "),
]
_END = r"([.!?;:])[ \t\f\r]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What comments put before each line of a text.
_LEADER = r"(^|\n)[^A-Za-z0-9\n]*+(?:(?:REM|rem|dnl)[ \t][^A-Za-z0-9\n]*+)?"
# Places inside known sentences where the usual text has a full stop or a semicolon.
_INNER_STOPS = {"foundation either": "foundation;either", "license v 2 0": "license v;2 0"}


def _known_pattern() -> str:
    """Any known sentence, the longest first, from one boundary to another; lines may break between its words."""
    found = []
    for sentence in sorted(SENTENCES, key=lambda s: (-len(s.split()), s)):
        for plain, stopped in _INNER_STOPS.items():
            sentence = sentence.replace(plain, stopped)
        found.append(sentence.replace(" ", "[ \n]").replace(";", "[ \n;]"))
    return f"(?<![a-z0-9 ])(?:{'|'.join(found)})(?![a-z0-9 ])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, each followed by a space.

    A known sentence begins and ends at the end of a sentence, of a line or of the text.  Between its words
    a single line break, with what a comment puts before the next line, counts as a space; a blank line does not.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # Sentences and paragraphs end in ";", other lines in a line break.
    plain = F.regexp_replace(F.regexp_replace(text, _LEADER, "$1"), r"[.!?;:]\s+", "\n\n")
    plain = F.regexp_replace(F.translate(plain, _UPPER, _LOWER), "[^a-z0-9\n]+", " ")
    plain = F.regexp_replace(F.regexp_replace(F.trim(plain), " ?\n ?", "\n"), "\n{2,}+", ";")
    ids = F.transform(
        F.regexp_extract_all(plain, F.lit(_known_pattern()), F.lit(0)),
        lambda s: F.try_element_at(known, F.translate(s, "\n;", "  ")),
    )
    return F.array_join(F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.concat(i, F.lit(" "))), "")


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, license, rule, n_matches): a row for each rule that a document matches.

    ``rule`` counts from 1 in the order in which rules are tried.  Null and empty texts, and texts
    without known sentences, give no rows; other columns are ignored; repeated rows are each reported.
    """
    found = docs.select(F.col("doc_id").cast("long"), sentence_ids(F.col("text").cast("string")).alias("sentence_ids"))
    found = found.filter(F.length("sentence_ids") > 0)
    left, matches = F.col("sentence_ids"), []
    for i, (name, pattern) in enumerate(RULES):
        # A rule starts where an identifier starts.
        whole = rf"\b(?:{pattern})"
        matches.append(
            F.struct(
                F.lit(name).alias("license"),
                F.lit(i + 1).alias("rule"),
                F.regexp_count(left, F.lit(whole)).cast("long").alias("n_matches"),
            )
        )
        left = F.regexp_replace(left, whole, "")
    each = F.explode(F.filter(F.array(*matches), lambda m: m["n_matches"] > 0)).alias("m")
    return found.select("doc_id", F.trim("sentence_ids").alias("sentence_ids"), each).select(
        "doc_id", "sentence_ids", "m.license", "m.rule", "m.n_matches"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB's SQL."""
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES.items())
    steps, rows = [], []
    before = "ids"
    for i, (name, pattern) in enumerate(RULES):
        whole = _quoted(rf"\b(?:{pattern})")
        rows.append(
            f"SELECT doc_id, k, trim(ids) AS sentence_ids, {_quoted(name)} AS license, {i + 1} AS rule, "
            f"CAST(len(regexp_extract_all({before}, {whole})) AS BIGINT) AS n_matches FROM cut{i}"
        )
        source = "seq" if i == 0 else f"cut{i - 1}"
        last = "ids" if i == 0 else "rest"
        steps.append(f"cut{i} AS (SELECT doc_id, k, ids, {last} AS here, regexp_replace({last}, {whole}, '', 'g') AS rest FROM {source})")
        before = "here"
    rows = [r.replace("regexp_extract_all(ids,", "regexp_extract_all(here,") for r in rows]
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
plain AS (
  SELECT doc_id, row_number() OVER () AS k, string_split(regexp_replace(translate(
    regexp_replace(text, '{_END}', '\\1' || chr(10), 'g'), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS lines
  FROM documents),
each AS (SELECT doc_id, k, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM plain),
seq AS (
  SELECT doc_id, k, string_agg(id || ' ', '' ORDER BY n) AS ids
  FROM each JOIN known ON trim(line) = sentence GROUP BY doc_id, k),
{", ".join(steps)}
SELECT doc_id, sentence_ids, license, rule, n_matches FROM ({" UNION ALL ".join(rows)}) WHERE n_matches > 0
"""
