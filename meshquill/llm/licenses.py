"""License scans by sentence rules.

Texts are cut into sentences twice, by lines and by paragraphs (where a sentence may run over line
ends); sentences are normalised and mapped to the identifiers of known licence sentences; a licence is
found where the identifiers of its rule stand in a row, sentences that are not known in between do
not count. A full text has a rule for each SPAN of its characteristic sentences, so that one altered
clause hides only the span that it is in. All of it is per-row expressions, without a shuffle, on whole texts.

Defined cases: null and empty texts have no sentence and no licence; rows with null or repeated
doc_ids each keep one result row; an empty input gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import ACCEPTANCE, CREATIVE_COMMONS, SENTENCES_OF

#: Where sentences end, in lines and in paragraphs; the same in Java, RE2 and Python.
BREAKS = {"lines": r"\n|[.!?;]+[ \t\r\n]+", "paragraphs": r"\n[ \t\r]*\n|[.!?;]+[ \t\r\n]+"}
_DROP = "[^a-z0-9]+"
#: Sentences of a full text that make a rule; where there are no more than these, each is one.
SPAN = 4

# Names of licences as notices give them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
OPENINGS = ["Licensed under", "Released under", "Distributed under", "Published under", "Available under", "This work is licensed under", "This file is licensed under", "This project is licensed under", "This software is released under", "SPDX-License-Identifier"]

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
# Licence texts and notices, as published.
TEXTS = {
    "MIT": [_MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
}


def normal(sentence: str) -> str:
    return re.sub(_DROP, " ", sentence.lower()).strip()


def sentences(text: str, cut: str = "paragraphs") -> list[str]:
    """The normalised sentences of two words or more; numbers of clauses and the like say nothing."""
    return [n for s in re.split(BREAKS[cut], text) if " " in (n := normal(s))]


def build() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Sentence to identifier, and (licence, rule) with the rule's identifiers in order."""
    known: dict[str, str] = {}
    rules: set[tuple[str, str]] = set()

    def add(licence: str, text: str) -> None:
        ids = [known.setdefault(s, f"S{len(known) + 1:03d}") for s in sentences(text)]
        rules.add((licence, ",".join(ids)))

    for licence, texts in TEXTS.items():
        for text in texts:
            add(licence, text)
    for licence, found in SENTENCES_OF.items():
        span = SPAN if len(found) > SPAN else 1
        for at in range(0, len(found), span):
            add(licence, ". ".join(found[at : at + span]))
    for licence, title in CREATIVE_COMMONS.items():
        add(licence, ACCEPTANCE.format(title))
    for licence, names in NAMES.items():
        for name in names:
            for opening in OPENINGS:
                for article in ("", " the", " a"):
                    add(licence, f"{opening}{article} {name}.")
    return known, sorted(rules)


SENTENCES, RULES = build()


def identifiers(text: Column, cut: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = F.str_to_map(F.lit(";".join(f"{s}={i}" for s, i in SENTENCES.items())), F.lit(";"), F.lit("="))  # one folded literal
    # The heads are few: a sentence that starts like none of them is neither normalised nor looked up.
    heads = "|".join(sorted({s.split(" ")[0] for s in SENTENCES}))
    likely = F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS[cut]), lambda s: s.rlike(f"(?i)^[^a-z0-9]*(?:{heads})(?:[^a-z0-9]|$)"))
    likely = F.transform(likely, lambda s: F.trim(F.regexp_replace(F.lower(s), _DROP, " ")))
    return F.filter(F.transform(likely, lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, line_ids, paragraph_ids (arrays of identifiers), licences (sorted array) for each row."""
    found = docs.select("doc_id", *(identifiers(F.col("text"), cut).alias(name) for cut, name in (("lines", "line_ids"), ("paragraphs", "paragraph_ids"))))
    by_rule = F.split(F.lit(";".join(f"{licence}=,{rule}," for licence, rule in RULES)), ";")

    def stands(ids: str, rule: Column) -> Column:
        return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).contains(rule)

    matched = F.filter(by_rule, lambda r: stands("line_ids", F.substring_index(r, "=", -1)) | stands("paragraph_ids", F.substring_index(r, "=", -1)))
    licences = F.when(F.size("line_ids") + F.size("paragraph_ids") > 0, F.array_sort(F.array_distinct(F.transform(matched, lambda r: F.substring_index(r, "=", 1))))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("licences", licences)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).select(
        "doc_id",
        F.array_join("line_ids", ",").alias("line_ids"),
        F.array_join("paragraph_ids", ",").alias("paragraph_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({quote(lic)}, {quote(rule)})" for lic, rule in RULES)

    def ids(cut: str) -> str:
        return f"""
  SELECT c.doc_id, string_agg(k.id, ',' ORDER BY c.pos) AS ids
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{BREAKS[cut]}') AS parts FROM documents)) c
  JOIN known k ON k.sentence = trim(regexp_replace(lower(c.part), '{_DROP}', ' ', 'g'))
  GROUP BY c.doc_id"""

    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(licence, rule) AS (VALUES {rules}),
lines AS ({ids("lines")}), paragraphs AS ({ids("paragraphs")}),
found AS (
  SELECT d.doc_id, coalesce(l.ids, '') AS line_ids, coalesce(p.ids, '') AS paragraph_ids
  FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN paragraphs p ON p.doc_id = d.doc_id
), matched AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM (
    SELECT DISTINCT f.doc_id, r.licence FROM found f JOIN rules r
    ON contains(',' || f.line_ids || ',', ',' || r.rule || ',') OR contains(',' || f.paragraph_ids || ',', ',' || r.rule || ',')
    WHERE f.line_ids <> '' OR f.paragraph_ids <> '') GROUP BY doc_id
)
SELECT f.doc_id, f.line_ids, f.paragraph_ids, coalesce(m.licences, '') AS licences FROM found f LEFT JOIN matched m ON m.doc_id = f.doc_id
"""
