"""License scans by sentence-rule recognition, on DataFrame functions alone.

Texts are cut at blank lines (of comment marks too) and after a full stop, semicolon or
colon that is followed by space; a single line end is a space, as licence texts are
wrapped.  A sentence is normalised (lower case, runs of anything but letters and digits
become one space, so comment marks go).  Known sentences that stand in one as whole
words, whatever comes before or after them, get their
identifier; the others are dropped.  The identifiers of a document, in order, form a
sequence, and a rule fits where its own identifiers occur in that sequence in order,
without another identifier between them.  Rules are ordered: each part of the sequence
is claimed by the first rule that fits, so a long licence text wins over its short name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "licensed under the mit license": "mit",
    "the mit license": "mit",
    "mit license": "mit",
    "spdx license identifier mit": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "apache license version 2 0": "apache2",
    "spdx license identifier apache 2 0": "apache2",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-obtain",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "gnu general public license version 3": "gpl3",
    "spdx license identifier gpl 3 0 or later": "gpl3",
    "spdx license identifier gpl 3 0 only": "gpl3",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "spdx license identifier cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "spdx license identifier cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "spdx license identifier cc by sa 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "spdx license identifier bsd 3 clause": "bsd3",
    "all rights reserved": "reserved",
}

# Ordered rules, as (licence, sequence of sentence identifiers).
RULES = (
    ("MIT", ("mit", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2", "apache2-terms", "apache2-grant")),
    ("Apache-2.0", ("apache2", "apache2-comply", "apache2-obtain", "apache2-basis")),
    ("Apache-2.0", ("apache2", "apache2-comply", "apache2-obtain")),
    ("Apache-2.0", ("apache2", "apache2-comply")),
    ("GPL-3.0", ("gpl3", "gpl-copy")),
    ("BSD-3-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-notice", "as-is")),
    ("ISC", ("isc-grant", "isc-notice")),
    ("MPL-2.0", ("mpl2", "mpl2-obtain")),
    ("GPL-2.0", ("gpl2", "gpl-copy")),
    ("BSD-3-Clause", ("reserved", "bsd-grant")),
    ("MIT", ("mit",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2",)),
    ("GPL-3.0", ("gpl3",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("MPL-2.0", ("mpl2",)),
    ("GPL-2.0", ("gpl2",)),
    ("LGPL-3.0", ("lgpl3",)),
    ("AGPL-3.0", ("agpl3",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-3-Clause", ("bsd-grant",)),
    ("All-Rights-Reserved", ("reserved",)),
)

# Further wordings of the real notices, which the SQL does not have.
WORDINGS = {
    "gnu general public license as published by the free software foundation either version 3 of the license": "gpl3",
    "gnu general public license as published by the free software foundation version 3": "gpl3",
    "apache license 2 0": "apache2",
    "software is provided by the copyright holders and contributors as is": "as-is",
    "software is provided as is and the author disclaims all warranties": "as-is",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-notice",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2-obtain",
    "mozilla public license version 2 0": "mpl2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache2-basis",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license": "apache2-grant",
    "gnu general public license as published by the free software foundation either version 2 of the license": "gpl2",
    "gnu general public license version 2": "gpl2",
    "gnu lesser general public license as published by the free software foundation either version 3 of the license": "lgpl3",
    "gnu lesser general public license version 3": "lgpl3",
    "gnu affero general public license as published by the free software foundation either version 3 of the license": "agpl3",
    "gnu affero general public license version 3": "agpl3",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0",
    "spdx license identifier isc": "isc",
    "spdx license identifier mpl 2 0": "mpl2",
    "spdx license identifier bsd 2 clause": "bsd2",
    "spdx license identifier gpl 2 0 only": "gpl2",
    "spdx license identifier gpl 2 0 or later": "gpl2",
    "spdx license identifier lgpl 3 0 or later": "lgpl3",
    "spdx license identifier agpl 3 0 or later": "agpl3",
    "spdx license identifier cc0 1 0": "cc0",
    "spdx license identifier unlicense": "unlicense",
}

_CUT = r"(?<=[.;:])\s++|\n(?:[^\p{L}\p{N}\n]*+\n)++"


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences=None, rules=RULES) -> DataFrame:
    """doc_id, n_sentences, sequence and licenses of every row of docs that holds a known sentence.

    ``sequence`` has the identifiers in text order, joined by spaces; ``licenses`` the
    distinct licences claimed, sorted, joined by spaces; ``n_sentences`` the known ones.
    Of known sentences that begin at the same word the longest counts, and none
    overlaps another.  A full stop inside a number does not cut, since no space follows it.  Null and empty texts and texts without a known sentence give no row;
    very long texts are scanned whole; repeated rows each get theirs; other columns,
    whatever their names, are not read; an empty table gives an empty result.  All the
    work on a row happens in that row.
    """
    known = sentences or SENTENCES | WORDINGS
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    words = "|".join(sorted(known, key=len, reverse=True))
    # A control character stands at the cuts, so no known sentence reaches over one.
    marked = F.regexp_replace(F.lower(F.regexp_replace(F.col(text), _CUT, "\x01")), r"[^\p{L}\p{N}\x01]+", " ")
    spaced = F.concat(F.lit(" "), F.replace(marked, F.lit("\x01"), F.lit(" \x01 ")), F.lit(" "))
    ids = F.transform(F.regexp_extract_all(spaced, F.lit(f"(?<= )(?:{words})(?= )"), F.lit(0)), lambda s: F.try_element_at(table, s))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), ids.alias("ids")).where(F.size("ids") > 0)
    sequence = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    # Each rule in order claims its part of the sequence; a bar stands where it was.
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(wanted) + " ").alias("part")) for name, wanted in rules])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("got"))

    def claim(state, rule):
        got = F.when(F.contains(state["left"], rule["part"]), F.array_append(state["got"], rule["name"])).otherwise(state["got"])
        return F.struct(F.replace(state["left"], rule["part"], F.lit("|")).alias("left"), got.alias("got"))

    licenses = F.array_sort(F.array_distinct(F.aggregate(table, start, claim, lambda x: x["got"])))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sequence"), F.array_join(licenses, " ").alias("licenses"))


def oracle_sql() -> str:
    """The registered scan in DuckDB, over table documents."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    steps, last = [], "s0"
    for k, (name, wanted) in enumerate(RULES, 1):
        part = " " + "  ".join(wanted) + " "
        steps.append(f"s{k} AS (SELECT doc_id, n_sentences, sequence, replace(lft, '{part}', '|') AS lft, CASE WHEN contains(lft, '{part}') THEN list_append(got, '{name}') ELSE got END AS got FROM {last})")
        last = f"s{k}"
    longest = 2 * max(map(len, SENTENCES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT doc_id, i, generate_subscripts(p, 1) AS j, unnest(p) AS part FROM (SELECT doc_id, i, string_split(regexp_replace(line, '([.;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM lines)),
found AS (SELECT doc_id, i, j, id FROM (SELECT doc_id, i, j, part, trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n FROM marked WHERE length(part) BETWEEN 3 AND {longest}) JOIN known ON n = sentence),
s0 AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ' ' ORDER BY i, j) AS sequence, ' ' || string_agg(id, '  ' ORDER BY i, j) || ' ' AS lft, CAST([] AS VARCHAR[]) AS got FROM found GROUP BY doc_id),
{", ".join(steps)}
SELECT doc_id, n_sentences, sequence, array_to_string(list_sort(list_distinct(got)), ' ') AS licenses FROM {last}
"""
