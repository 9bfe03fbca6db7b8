"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (ASCII lower case, everything but letters and digits to one space) and
mapped to the identifier of a known licence sentence; the identifiers in order are matched against an ordered list of rules.
A rule names identifiers that must follow each other, with no other known sentence between them unless it says so.

Sentences end at punctuation before white space, at semicolons and at blank lines; a line break alone is white space, so wrapped
and commented texts (marks at the start of a line are left out) read like unwrapped ones. Titles and tags that stand on a line
of their own need no punctuation: a sentence that isn't known is tried without its first line, and then line by line.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import fresh

# Known sentences (normalised) of public licence texts and notices.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "apache license version 2 0": "apache2-title",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "gnu general public license version 3": "gpl3-title",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "gnu general public license version 2": "gpl2-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 2 of the license or at your option any later version": "gpl2-or-later",
    "either version 3 of the license or at your option any later version": "gpl3-or-later",
    "licensed under cc by nc 4 0": "ccbync4-notice",
    "licensed under cc by 4 0": "ccby4-notice",
    "licensed under cc by sa 4 0": "ccbysa4-notice",
    "licensed under cc by nd 4 0": "ccbynd4-notice",
    "licensed under cc by nc sa 4 0": "ccbyncsa4-notice",
    "licensed under cc0 1 0": "cc0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this is free and unencumbered software released into the public domain": "unlicense-title",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "all rights reserved": "reserved",
    "spdx license identifier mit": "mit-spdx",
    "spdx license identifier apache 2 0": "apache2-spdx",
    "spdx license identifier gpl 3 0 only": "gpl3-spdx",
    "spdx license identifier gpl 3 0 or later": "gpl3-spdx",
    "spdx license identifier gpl 2 0 only": "gpl2-spdx",
    "spdx license identifier bsd 3 clause": "bsd3-spdx",
    "spdx license identifier mpl 2 0": "mpl2-spdx",
}

# Rules in order of preference (rule, licence, class, identifiers in order; "..." lets others stand between).
RULES = (
    ("apache2-full", "Apache-2.0", "permissive", ("apache2-notice", "...", "apache2-comply", "...", "apache2-asis")),
    ("mit-full", "MIT", "permissive", ("mit-grant", "...", "mit-keep", "...", "mit-asis")),
    ("bsd3-full", "BSD-3-Clause", "permissive", ("bsd-grant", "...", "bsd-source", "...", "bsd-binary", "...", "bsd-name")),
    ("bsd2-full", "BSD-2-Clause", "permissive", ("bsd-grant", "...", "bsd-source", "...", "bsd-binary")),
    ("gpl3-full", "GPL-3.0-or-later", "copyleft", ("gpl3-later", "gpl-hope")),
    ("gpl2-full", "GPL-2.0-or-later", "copyleft", ("gpl2-later", "gpl-hope")),
    ("gpl3-parts", "GPL-3.0-or-later", "copyleft", ("gpl-terms", "gpl3-or-later")),
    ("gpl2-parts", "GPL-2.0-or-later", "copyleft", ("gpl-terms", "gpl2-or-later")),
    ("gpl3-spdx", "GPL-3.0", "copyleft", ("gpl3-spdx",)),
    ("gpl2-spdx", "GPL-2.0", "copyleft", ("gpl2-spdx",)),
    ("mit-spdx", "MIT", "permissive", ("mit-spdx",)),
    ("apache2-spdx", "Apache-2.0", "permissive", ("apache2-spdx",)),
    ("bsd3-spdx", "BSD-3-Clause", "permissive", ("bsd3-spdx",)),
    ("mpl2-spdx", "MPL-2.0", "weak copyleft", ("mpl2-spdx",)),
    ("gpl3-notice", "GPL-3.0", "copyleft", ("gpl3-notice",)),
    ("gpl3-later", "GPL-3.0-or-later", "copyleft", ("gpl3-later",)),
    ("gpl2-notice", "GPL-2.0", "copyleft", ("gpl2-notice",)),
    ("gpl2-later", "GPL-2.0-or-later", "copyleft", ("gpl2-later",)),
    ("ccbyncsa4", "CC-BY-NC-SA-4.0", "noncommercial", ("ccbyncsa4-notice",)),
    ("ccbync4", "CC-BY-NC-4.0", "noncommercial", ("ccbync4-notice",)),
    ("ccbynd4", "CC-BY-ND-4.0", "no derivatives", ("ccbynd4-notice",)),
    ("ccbysa4", "CC-BY-SA-4.0", "copyleft", ("ccbysa4-notice",)),
    ("ccby4", "CC-BY-4.0", "permissive", ("ccby4-notice",)),
    ("cc0", "CC0-1.0", "public domain", ("cc0-notice",)),
    ("unlicense", "Unlicense", "public domain", ("unlicense-title",)),
    ("mpl2-notice", "MPL-2.0", "weak copyleft", ("mpl2-notice",)),
    ("apache2-notice", "Apache-2.0", "permissive", ("apache2-notice",)),
    ("mit-notice", "MIT", "permissive", ("mit-notice",)),
    ("mit-title", "MIT", "permissive", ("mit-title",)),
    ("apache2-title", "Apache-2.0", "permissive", ("apache2-title",)),
    ("gpl3-title", "GPL-3.0", "copyleft", ("gpl3-title",)),
    ("gpl2-title", "GPL-2.0", "copyleft", ("gpl2-title",)),
    ("reserved", "proprietary", "reserved", ("reserved",)),
)

#: One of these is in every known sentence; texts without any are not cut at all.
HINTS = "licen|copyright|warranty|reserved|software|redistribut|permission"
#: Rewritten before the cut, in order: line breaks, marks at the start of lines, lines without letters or digits, "v. 2".
TIDY = ((r"\x0D\x0A?", "\n"), (r"\x0A[\x09\x20/*#;%>|!-]+", "\n"), (r"\x0A[^A-Za-z0-9\x0A]*\x0A", "\n\n"), (r"([vV])[.]\x20?([0-9])", "\x01 \x02"))
#: Where a sentence ends.
ENDS = r"[.!?][\x22')]*[\x09\x20\x0A]+|:[\x09\x20]*\x0A+|;|\x0A\x0A+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_pattern(identifiers: tuple[str, ...]) -> str:
    """A regular expression over identifiers that each stand between semicolons."""
    return "".join("(?:[^;]+;)*" if x == "..." else f"{x};" for x in identifiers)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, repeats included."""
    known = F.create_map(*[F.lit(x) for x in chain(*SENTENCES.items())])
    plain = lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " "))
    for pattern, to in TIDY:
        text = F.regexp_replace(text, pattern, to.replace("\x01", "$1").replace("\x02", "$2"))

    def of(sentence: Column) -> Column:
        name = lambda s: F.try_element_at(known, plain(s))
        first = F.substring_index(sentence, "\n", 1)
        rest = F.substring(sentence, F.char_length(first) + 2, F.char_length(sentence))
        lines = F.transform(F.split(sentence, "\n", -1), name)
        return F.when(name(sentence).isNotNull(), F.array(name(sentence))).when(name(rest).isNotNull(), F.array(name(first), name(rest))).otherwise(lines)

    return F.filter(F.flatten(F.transform(F.split(text, ENDS, -1), of)), lambda x: x.isNotNull())


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns sentence_ids, license_rules and licenses (all that fit, in order of preference), and license_rule,
    license and license_class of the first; no shuffle.

    Null and empty texts have no sentences and no licence (empty lists, nulls). Repeated rows are judged each for itself. Columns
    of these names are replaced, all others stay as they are.
    """
    names = ("sentence_ids", "license_rules", "licenses", "license_rule", "license", "license_class")
    [line, fits, source] = fresh(docs, "_line", "_fits", "_source")
    none = F.array().cast("array<string>")
    found = docs.withColumn(source, F.coalesce(F.col(text_col), F.lit("")))
    found = found.withColumn("sentence_ids", F.when(F.lower(source).rlike(HINTS), identifiers(F.col(source))).otherwise(none))
    found = found.withColumn(line, F.concat(F.lit(";"), F.array_join("sentence_ids", ";"), F.lit(";")))
    fit = F.filter(F.array(*[F.when(F.col(line).rlike(f";{rule_pattern(ids)}"), F.lit(k)) for k, (_, _, _, ids) in enumerate(RULES)]), lambda x: x.isNotNull())
    found = found.withColumn(fits, F.when(F.size("sentence_ids") > 0, fit).otherwise(F.array().cast("array<int>")))
    value = lambda at, k: F.get(F.array(*[F.lit(r[at]) for r in RULES]), k)
    first = F.get(F.col(fits), F.lit(0))
    added = {"license_rules": F.transform(fits, lambda k: value(0, k)), "licenses": F.array_distinct(F.transform(fits, lambda k: value(1, k))), "license_rule": value(0, first), "license": value(1, first), "license_class": value(2, first)}
    if text_col in names:
        raise ValueError(f"{text_col} is the name of a result")
    return found.withColumns(added).drop(line, fits, source)


def _oracle() -> str:
    q = lambda s: "'" + s + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())
    tidy = "coalesce(text, '')"
    for pattern, to in TIDY:
        said = to.replace("\x01", "\\1").replace("\x02", "\\2").replace("\n", "' || chr(10) || '")
        tidy = f"regexp_replace({tidy}, {q(pattern)}, '{said}', 'g')"
    rules = ", ".join(f"CASE WHEN regexp_matches(line, {q(';' + rule_pattern(ids))}) THEN {k} END" for k, (_, _, _, ids) in enumerate(RULES))
    value = lambda at: "[" + ", ".join(q(r[at]) for r in RULES) + "]"
    plain = lambda s: f"trim(regexp_replace(translate({s}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH k(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex({tidy}, '{ENDS.replace("'", "''")}') AS p FROM documents)),
l AS (SELECT doc_id, i, s, string_split(s, chr(10)) AS ls FROM s),
w AS (SELECT doc_id, i, s, ls, a.id AS whole, b.id AS rest FROM l LEFT JOIN k a ON a.sentence = {plain("s")} LEFT JOIN k b ON len(ls) > 1 AND b.sentence = {plain("array_to_string(ls[2:], chr(10))")}),
n AS (
  SELECT doc_id, i, 0 AS j, whole AS id FROM w WHERE whole IS NOT NULL
  UNION ALL SELECT doc_id, i, 1, rest FROM w WHERE whole IS NULL AND rest IS NOT NULL
  UNION ALL SELECT doc_id, i, CASE WHEN rest IS NULL THEN j ELSE 0 END, id FROM (SELECT doc_id, i, rest, unnest(CASE WHEN rest IS NULL THEN ls ELSE ls[:1] END) AS line, unnest(range(len(CASE WHEN rest IS NULL THEN ls ELSE ls[:1] END))) AS j FROM w WHERE whole IS NULL)
    JOIN k ON sentence = {plain("line")}),
g AS (SELECT doc_id, count(*) AS c, string_agg(id, ';' ORDER BY i, j) AS ids FROM n GROUP BY doc_id),
r AS (SELECT doc_id, c, ids, list_filter([{rules}], lambda x: x IS NOT NULL) AS fits FROM (SELECT *, ';' || ids || ';' AS line FROM g)),
f AS (SELECT doc_id, c, ids, list_transform(fits, lambda x: {value(0)}[x + 1]) AS rules, list_transform(fits, lambda x: {value(1)}[x + 1]) AS names, {value(2)}[fits[1] + 1] AS class FROM r)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(rules, ';'), '') AS license_rules,
  coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ';'), '') AS licenses, rules[1] AS license_rule, names[1] AS license, class AS license_class
FROM documents LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()
