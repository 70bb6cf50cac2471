"""Licence recognition: known sentences by identifier, ordered rules over their sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.columns import ascii_lower

# Licence sentences and the identifiers they are known by
SENTENCES = (
    ("ApacheLicensed", "Licensed under the Apache License, Version 2.0"),
    ("ApacheHeader", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("ApacheComply", "you may not use this file except in compliance with the License"),
    ("ApacheObtain", "You may obtain a copy of the License at"),
    ("ApacheUrl", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheObtainUrl", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheBasis", "Unless required by applicable law or agreed to in writing, software distributed under the "
     'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("MITReleased", "Released under the MIT License"),
    ("MITLicensed", "Licensed under the MIT License"),
    ("MITTitle", "The MIT License"),
    ("MITTitle", "MIT License"),
    ("MITGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software"),
    ("MITWarranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("MITLiability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("GPL3Work", "This work is licensed under the GNU General Public License, version 3"),
    ("GPLFree3Later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version"),
    ("GPLFree2Later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version"),
    ("GPLHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GPLSee", "See the GNU General Public License for more details"),
    ("GPLReceived", "You should have received a copy of the GNU General Public License along with this program"),
    ("CCByNc4", "Licensed under CC BY-NC 4.0"),
    ("CCBy4", "Licensed under CC BY 4.0"),
    ("CCBySa4", "Licensed under CC BY-SA 4.0"),
    ("BSDRedistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("AllRights", "All rights reserved"),
    ("SPDXApache2", "SPDX-License-Identifier: Apache-2.0"),
    ("SPDXMIT", "SPDX-License-Identifier: MIT"),
    ("SPDXGPL3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("SPDXGPL3Later", "SPDX-License-Identifier: GPL-3.0-or-later"),
)

# Licences and the sentence sequences that show them, in the order of trial
RULES = (
    ("Apache-2.0", ("ApacheHeader", "ApacheComply", "ApacheObtain", "ApacheUrl", "ApacheBasis", "ApacheSee")),
    ("Apache-2.0", ("ApacheHeader", "ApacheComply", "ApacheObtainUrl", "ApacheBasis", "ApacheSee")),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT-style", ("MITGrant", "MITNotice")),
    ("GPL-3.0-or-later", ("GPLFree3Later", "GPLHope", "GPLSee", "GPLReceived")),
    ("GPL-3.0-or-later", ("GPLFree3Later",)),
    ("GPL-2.0-or-later", ("GPLFree2Later", "GPLHope", "GPLSee", "GPLReceived")),
    ("GPL-2.0-or-later", ("GPLFree2Later",)),
    ("Apache-2.0", ("ApacheHeader",)),
    ("Apache-2.0", ("ApacheLicensed",)),
    ("Apache-2.0", ("SPDXApache2",)),
    ("MIT", ("MITReleased",)),
    ("MIT", ("MITLicensed",)),
    ("MIT", ("SPDXMIT",)),
    ("GPL-3.0-only", ("GPL3Work",)),
    ("GPL-3.0-only", ("SPDXGPL3",)),
    ("GPL-3.0-or-later", ("SPDXGPL3Later",)),
    ("CC-BY-NC-4.0", ("CCByNc4",)),
    ("CC-BY-SA-4.0", ("CCBySa4",)),
    ("CC-BY-4.0", ("CCBy4",)),
)

# Patterns shared with the SQL; a sentence ends at a stop before white space, at a blank
# line, or where a line ends that is not one word of many
STOP = r"([.!?;:])[ \t\n\r\f]+"
BLANK = r"\n[ \t\r\f]*\n"
CUT = "\x1e"
NOT_PLAIN = r"[^a-z0-9.+/-]+"
EDGES = r"^[ .+/-]+|[ .+/-]+$"


def sentences(text: Column) -> Column:
    """The text's sentences, still with the line ends inside them."""
    marked = F.regexp_replace(F.regexp_replace(text, STOP, f"$1{CUT}"), BLANK, CUT)
    return F.split(marked, CUT)


def normal(sentence: Column) -> Column:
    """Lower case, one space between words, `license` for `licence`; no other marks than . + / - inside."""
    plain = F.regexp_replace(ascii_lower(sentence), NOT_PLAIN, " ")
    return F.regexp_replace(F.regexp_replace(plain, EDGES, ""), "licence", "license")


def scan_licenses(docs: DataFrame, known: Sequence[tuple[str, str]] = SENTENCES,
                  rules: Sequence[tuple[str, Sequence[str]]] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_sentences, sentence_ids, licenses, license.

    Each sentence is normalised and mapped to its identifier; one that is not known as a
    whole is tried line by line. Rules are tried in order; one fits where its identifiers
    follow each other with nothing between, and takes these sentences from later rules.
    `sentence_ids` are the known identifiers in the text's order and `licenses` the
    licences in the order of rules, comma-joined; `license` is the first, or null.

    All of it happens within the row: whole texts, no shuffle. A null or empty text has no
    sentences, '' twice and a null `license`. Repeated rows and null ids give a row each;
    other columns are not read; an empty table gives an empty result.
    """
    of_plain = {s: i for i, s in known}
    # Identifiers by normalised sentence: a literal with an entry for each known sentence
    spark = docs.sparkSession
    plain = spark.range(1).select(
        F.array(*(normal(F.lit(s)).alias("s") for s in of_plain)).alias("s")
    ).first().s if of_plain else []
    entries = dict(zip(plain, of_plain.values()))
    pairs = [F.lit(x) for pair in entries.items() for x in pair]
    ids = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    def identify(sentence: Column) -> Column:
        whole = F.try_element_at(ids, normal(sentence))
        lines = F.transform(F.split(sentence, "\n"), lambda x: F.coalesce(F.try_element_at(ids, normal(x)), F.lit("-")))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    filled = F.filter(sentences(F.coalesce(F.col(text_col), F.lit(""))), lambda s: F.length(F.trim(s)) > 0)
    found = docs.select(
        F.col(id_col).alias(id_col),
        F.transform(filled, identify).alias("_by_sentence"),
    ).select(
        id_col, F.size("_by_sentence").alias("n_sentences"), F.flatten("_by_sentence").alias("_ids"),
    )
    # Each identifier between commas of its own, each run of unknown sentences as one mark
    joined = F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(","))
    sequence = F.regexp_replace(joined, "(,-,)+", ",-,")
    trials = F.array(*(
        F.struct(F.lit(name).alias("license"), F.lit("".join(f",{i}," for i in wanted)).alias("run"))
        for name, wanted in rules
    )) if rules else F.array().cast("array<struct<license:string,run:string>>")
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))

    def tried(state: Column, rule: Column) -> Column:
        return F.when(
            F.contains(state["left"], rule["run"]),
            F.struct(
                F.replace(state["left"], rule["run"], F.lit(",-,")).alias("left"),
                F.concat(state["names"], F.array(rule["license"])).alias("names"),
            ),
        ).otherwise(state)

    names = F.aggregate(trials, start, tried, lambda s: F.array_distinct(s["names"]))
    return found.select(
        id_col, "n_sentences",
        F.array_join(F.filter("_ids", lambda i: i != "-"), ",").alias("sentence_ids"),
        names.alias("_names"),
    ).select(
        id_col, "n_sentences", "sentence_ids",
        F.array_join("_names", ",").alias("licenses"), F.get("_names", F.lit(0)).alias("license"),
    )
