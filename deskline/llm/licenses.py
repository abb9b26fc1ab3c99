"""Licence scans by sentence rules (operator 2), DataFrame functions only.

A text is cut into sentences, known licence sentences are looked up in them (whole, or as whole lines
of one, since a line without end punctuation is glued to the next), and the sequence of their
identifiers is matched against ordered rules: each rule is a run of identifiers, earlier rules take
their runs first, and what a rule has taken no later one sees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import ascii_lower

# Sentences of public licences, normalised (see `sentences`), by identifier. These and
# RULES are also what the SQL of op2_licence_sentences is made from; more stand in PUBLISHED.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-head": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-fitness": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "ccbync-ref": "licensed under cc by nc 4 0",
    "ccby-ref": "licensed under cc by 4 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "rights": "all rights reserved",
}


@dataclass(frozen=True)
class LicenceRule:
    name: str
    run: tuple[str, ...]


#: Longer runs stand before the shorter ones they contain.
RULES = [
    LicenceRule("Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-see")),
    LicenceRule("GPL-3.0-or-later", ("gpl3-head", "gpl-warranty", "gpl-fitness", "gpl-see")),
    LicenceRule("MIT", ("mit-grant", "mit-warranty", "mit-liability")),
    LicenceRule("GPL-3.0-or-later", ("gpl3-head",)),
    LicenceRule("Apache-2.0", ("apache-head",)),
    LicenceRule("MIT", ("mit-grant",)),
    LicenceRule("ISC", ("isc-grant",)),
    LicenceRule("Apache-2.0", ("apache-ref",)),
    LicenceRule("GPL-3.0", ("gpl3-ref",)),
    LicenceRule("MIT", ("mit-ref",)),
    LicenceRule("MIT", ("mit-ref2",)),
    LicenceRule("CC-BY-NC-4.0", ("ccbync-ref",)),
    LicenceRule("CC-BY-4.0", ("ccby-ref",)),
    LicenceRule("All-rights-reserved", ("rights",)),
]

_GRANT, _NOTICE = (SENTENCES["mit-grant"].partition(" the above copyright")[0],
                   "the above copyright" + SENTENCES["mit-grant"].partition(" the above copyright")[2])
_COPY = SENTENCES["apache-copy"].partition(" http ")[0]
_UNLESS = "unless" + SENTENCES["apache-copy"].partition(" unless")[2]
_TERMS = ("you can redistribute it and or modify it under the terms of the gnu {} as published by the free software "
          "foundation either version {} of the license or at your option any later version")

#: SENTENCES, the parts that published layouts set off by an empty line, and further public licences.
PUBLISHED = SENTENCES | {
    "mit-terms": _GRANT,
    "mit-notice": _NOTICE,
    "mit-ref3": "this project is licensed under the mit license",
    "mit-ref4": "distributed under the mit license",
    "apache-obtain": _COPY,
    "apache-url": "http www apache org licenses license 2 0",
    "apache-urls": "https www apache org licenses license 2 0",
    "apache-unless": _UNLESS,
    "apache-ref2": "this project is licensed under the apache license version 2 0",
    "apache-ref3": "licensed under the apache license 2 0",
    "gpl-free": "this program is free software",
    "gpl3-terms": _TERMS.format("general public license", "3"),
    "gpl2-terms": _TERMS.format("general public license", "2"),
    "gpl2-head": "this program is free software " + _TERMS.format("general public license", "2"),
    "agpl3-terms": _TERMS.format("affero general public license", "3"),
    "agpl3-head": "this program is free software " + _TERMS.format("affero general public license", "3"),
    "agpl-see": "see the gnu affero general public license for more details",
    "lgpl-free": "this library is free software",
    "lgpl21-terms": _TERMS.format("lesser general public license", "2 1"),
    "gpl3-ref2": "licensed under the gnu general public license version 3",
    "gpl2-ref": "licensed under the gnu general public license version 2",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-head": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "ccby-ref2": "this work is licensed under cc by 4 0",
    "ccby-name": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa-ref": "licensed under cc by sa 4 0",
    "ccbysa-name": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync-name": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}

_GPL_TAIL = ("gpl-warranty", "gpl-fitness", "gpl-see")
_AGPL_TAIL = ("gpl-warranty", "gpl-fitness", "agpl-see")
#: RULES, and those of the further sentences; longer runs first again.
PUBLISHED_RULES = [
    LicenceRule("Apache-2.0", ("apache-head", "apache-use", "apache-obtain", "apache-url", "apache-unless", "apache-see")),
    LicenceRule("Apache-2.0", ("apache-head", "apache-use", "apache-obtain", "apache-urls", "apache-unless", "apache-see")),
    LicenceRule("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", *_GPL_TAIL)),
    LicenceRule("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", *_GPL_TAIL)),
    LicenceRule("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms", *_AGPL_TAIL)),
    LicenceRule("GPL-2.0-or-later", ("gpl2-head", *_GPL_TAIL)),
    LicenceRule("AGPL-3.0-or-later", ("agpl3-head", *_AGPL_TAIL)),
    LicenceRule("MIT", ("mit-terms", "mit-notice", "mit-warranty", "mit-liability")),
    LicenceRule("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-name")),
    *[r for r in RULES if len(r.run) > 1],
    LicenceRule("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    LicenceRule("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    LicenceRule("GPL-2.0-or-later", ("gpl-free", "gpl2-terms")),
    LicenceRule("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    LicenceRule("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-terms")),
    LicenceRule("MPL-2.0", ("mpl-head", "mpl-copy")),
    LicenceRule("MPL-2.0", ("mpl-head", "mpl-copy2")),
    LicenceRule("MIT", ("mit-terms", "mit-notice")),
    LicenceRule("MIT", ("mit-warranty", "mit-liability")),
    *[r for r in RULES if len(r.run) == 1],
    *[LicenceRule(name, (i,)) for name, i in [
        ("MIT", "mit-terms"), ("MIT", "mit-ref3"), ("MIT", "mit-ref4"), ("Apache-2.0", "apache-ref2"),
        ("Apache-2.0", "apache-ref3"), ("GPL-2.0-or-later", "gpl2-head"), ("AGPL-3.0-or-later", "agpl3-head"),
        ("GPL-3.0-or-later", "gpl3-terms"), ("GPL-2.0-or-later", "gpl2-terms"), ("AGPL-3.0-or-later", "agpl3-terms"),
        ("LGPL-2.1-or-later", "lgpl21-terms"), ("GPL-3.0", "gpl3-ref2"), ("GPL-2.0", "gpl2-ref"), ("MPL-2.0", "mpl-copy"),
        ("MPL-2.0", "mpl-copy2"), ("Unlicense", "unlicense"), ("CC-BY-4.0", "ccby-ref2"), ("CC-BY-4.0", "ccby-name"),
        ("CC-BY-SA-4.0", "ccbysa-ref"), ("CC-BY-SA-4.0", "ccbysa-name"), ("CC-BY-NC-4.0", "ccbync-name")]],
]


def sentences(text: Column, lines: bool = False) -> Column:
    """Array of normalised sentences: a sentence ends at ``.``, ``;``, ``!`` or ``?`` before white space or
    the end, and at an empty line. Normalised: A-Z lower-cased, runs of anything but a-z and 0-9 one
    blank, none at the ends; sentences without a letter or digit are left out. Null gives an empty array.
    With ``lines`` the blank that stands for a line's end is a line feed."""
    marked = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[.;!?](?=\s|$)|\n[ \t\r]*\n", "\u0001")
    if lines:
        plain = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\u0001\r\n]+", " "), " ?[\r\n][ \r\n]*", "\n")
        return F.filter(F.transform(F.split(plain, "\u0001"), lambda s: F.trim(s, F.lit(" \n"))), lambda s: s != "")
    plain = F.regexp_replace(marked, "[^a-z0-9\u0001]+", " ")
    return F.filter(F.transform(F.split(plain, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None,
         rules: list[LicenceRule] | None = None, lines: bool = True) -> DataFrame:
    """One row per document: id, ``n_sentences``, ``found`` (array of sentence number from 0 and identifier),
    ``licences`` (names of the rules that match, in rule order, once for each run) and ``n_left``
    (known sentences that no rule takes).

    With ``lines`` a known sentence is also found as one or more whole lines inside a sentence (wrapped
    sentences stay joined): leftmost first, then the longest, without overlap, so a sentence may give
    several identifiers. Without, only whole sentences are looked up.

    Row by row: nothing is shuffled, and rows that repeat an id are rows of their own. Null and empty
    texts have no sentences. Known sentences and rules are literals of the plan, so their number is
    that of the caller's list. Identifiers may not hold ``<`` or ``>``.
    """
    known = PUBLISHED if known is None else known
    rules = PUBLISHED_RULES if rules is None else rules
    names = F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>")
    texts = F.array(*[F.lit(v) for v in known.values()]) if known else F.array().cast("array<string>")
    own = docs.select(F.col(id_col).alias("_id"), sentences(F.col(text_col), lines).alias("_s"))
    if lines and known:
        longest = sorted(known.values(), key=lambda v: (-len(v), v))
        anyone = "|".join("[ \\n]".join(map(re.escape, v.split())) for v in longest)
        hits = F.transform("_s", lambda s, i: F.transform(
            F.regexp_extract_all(s, F.lit(rf"(?<![^\n])({anyone})(?![^\n])"), F.lit(1)),
            lambda m: F.struct(i.alias("sentence"), F.array_position(texts, F.translate(m, "\n", " ")).cast("int").alias("n"))))
        place = F.flatten(hits)
    else:
        place = F.transform("_s", lambda s, i: F.struct(i.alias("sentence"), F.array_position(texts, s).cast("int").alias("n")))
    found = F.transform(F.filter(place, lambda p: p["n"] > 0), lambda p: F.struct(
        p["sentence"].alias("sentence"), F.element_at(names, p["n"]).alias("identifier")))
    own = own.select("_id", F.size("_s").cast("long").alias("_n"), found.alias("_found"))
    run = F.concat(F.lit(""), F.array_join(F.transform("_found", lambda f: F.concat(F.lit("<"), f["identifier"], F.lit(">"))), ""))
    own = own.withColumn("_run", run)
    listed = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit("".join(f"<{i}>" for i in r.run)).alias("run"))
                       for r in rules if r.run])

    def apply(state: Column, rule: Column) -> Column:
        rest = F.replace(state["rest"], rule["run"], F.lit("|"))
        times = (F.length(rest) - F.length(state["rest"])).cast("int").__neg__() / (F.length(rule["run"]) - 1)
        return F.struct(rest.alias("rest"), F.concat(state["names"], F.array_repeat(rule["name"], times.cast("int"))).alias("names"))

    empty = F.struct(F.col("_run").alias("rest"), F.array().cast("array<string>").alias("names"))
    state = F.aggregate(listed, empty, apply) if rules else empty
    return own.withColumn("_state", state).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_sentences"), F.col("_found").alias("found"),
        F.col("_state.names").alias("licences"),
        F.regexp_count(F.col("_state.rest"), F.lit("<")).cast("long").alias("n_left"))
