"""Operator 5, license scans by sentence rules, native.

Texts are normalised (lower case, runs other than letters and digits become one space) and known sentences are mapped to
identifiers. A sentence ends at a full stop or a blank line, also one of comment signs only; inside it, line ends and
';' or ':' before a space are joints. A known sentence starts and ends at a joint or an end of the sentence and may run
over joints, so wrapped notices are found as well as one-line ones without a full stop. The text's identifier sequence
is then matched against ordered rules, longest licences first; what a rule matches is taken out and the next rule sees
the rest. Licence sentences that no rule used make the text `unmatched`, so that nothing known is lost.

All of it is row by row in projections. Cases: a null or empty text has no sentences; repeated rows and rows sharing an
identifier are scanned each; of sentences that several patterns know, the first pattern wins; a very long text costs time in
proportion; an empty table gives no rows; extra columns, whatever their names, do not take part.

The SQL of `oracle` cuts at every joint. It gives the same where no known sentence runs over one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Known sentences, normalised, as anchored patterns; $1 is a version, its parts joined by a space.
LEAD = "(?:(?:this|the|all|these) (?:[a-z]+ ){0,2}(?:is|are) )?"
SENTENCES = [
    ("mit_ref", f"^{LEAD}(?:released|licensed|distributed|available|provided) under the (?:terms of the )?(?:mit|expat) licen[sc]e$", "MIT-ref"),
    ("mit_grant", "^permission is hereby granted free of charge to any person obtaining a copy of this software .*$", "MIT-grant"),
    ("mit_notice", "^the above copyright notice and this permission notice shall be included in all copies .*$", "MIT-notice"),
    ("as_is", "^(?:the|this) software is provided (?:by the copyright holders and contributors )?as is .*$", "AsIs"),
    ("liability", "^in no event shall (?:the )?(?:authors?|copyright (?:holders?|owners?)) .*$", "Liability"),
    ("apache_ref", f"^{LEAD}(?:released|licensed|distributed) under the (?:terms of the )?apache licen[sc]e version ([0-9](?: [0-9])?)(?: the licen[sc]e)?$", "Apache-$1-ref"),
    ("apache_may", "^you may not use this file except in compliance with the licen[sc]e$", "Apache-may"),
    ("apache_obtain", "^you may obtain a copy of the licen[sc]e at.*$", "Apache-obtain"),
    ("apache_basis", "^unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis .*$", "Apache-basis"),
    ("apache_text", "^apache licen[sc]e version 2 0 january 2004.*$", "Apache-text"),
    ("gpl_ref", f"^{LEAD}(?:released|licensed|distributed) under the (?:terms of the )?gnu general public licen[sc]e version ([0-9](?: [0-9])?)(?: only)?$", "GPL-$1-ref"),
    ("gpl_later", ".*gnu general public licen[sc]e as published by the free software foundation either version ([0-9](?: [0-9])?) .*any later version$", "GPL-$1-later"),
    ("gpl_only", ".*gnu general public licen[sc]e version ([0-9](?: [0-9])?) (?:only )?as published by the free software foundation$", "GPL-$1-ref"),
    ("gpl_text", "^gnu general public licen[sc]e version ([0-9]) [0-9]+ [a-z]+ [0-9]{4}$", "GPL-$1-text"),
    ("lgpl_ref", f"^{LEAD}(?:released|licensed|distributed) under the (?:terms of the )?gnu (?:lesser|library) general public licen[sc]e version ([0-9](?: [0-9])?)$", "LGPL-$1-ref"),
    ("lgpl_later", ".*gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation either version ([0-9](?: [0-9])?) .*any later version$", "LGPL-$1-later"),
    ("agpl_ref", f"^{LEAD}(?:released|licensed|distributed) under the (?:terms of the )?gnu affero general public licen[sc]e version ([0-9](?: [0-9])?)$", "AGPL-$1-ref"),
    ("agpl_later", ".*gnu affero general public licen[sc]e as published by the free software foundation either version ([0-9](?: [0-9])?) .*any later version$", "AGPL-$1-later"),
    ("cc_ref", f"^{LEAD}(?:released|licensed|distributed|available) under (?:a |the )?(?:cc|creative commons) (by(?: (?:nc|nd|sa))*) ([0-9](?: [0-9])?)(?: licen[sc]e)?$", "CC-$1-$2-ref"),
    ("cc0_ref", f"^{LEAD}(?:released|licensed|distributed|available) under (?:the )?(?:cc0|creative commons zero) (?:v|version )?1 0(?: universal)?(?: licen[sc]e)?$", "CC0-ref"),
    ("cc0_waiver", "^to the extent possible under law .*(?:waived|dedicated) all copyright and related (?:and|or) neighboring rights to .*$", "CC0-waiver"),
    ("bsd_use", "^redistribution and use in source and binary forms with or without modification are permitted .*$", "BSD-use"),
    ("bsd_source", "^(?:1 )?redistributions of source code must retain .*$", "BSD-source"),
    ("bsd_binary", "^(?:2 )?redistributions in binary form must reproduce .*$", "BSD-binary"),
    ("bsd_advert", "^(?:3 )?all advertising materials mentioning features or use of this software must display .*$", "BSD-advert"),
    ("bsd_names", "^(?:[34] )?neither the name of .* may be used to endorse or promote .*$", "BSD-names"),
    ("mpl_ref", f"^{LEAD}(?:released|licensed|distributed) under the (?:terms of the )?mozilla public licen[sc]e (?:version )?([0-9] [0-9])$", "MPL-$1-ref"),
    ("mpl_subject", "^this source code form is subject to the terms of the mozilla public licen[sc]e v$", "MPL-subject"),
    ("mpl_obtain", "^if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl ([0-9] [0-9])$", "MPL-$1-obtain"),
    ("mpl_text", "^mozilla public licen[sc]e version ([0-9] [0-9])$", "MPL-$1-text"),
    ("isc_grant", "^permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that .*$", "ISC-grant"),
    ("zero_bsd_grant", "^permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted$", "0BSD-grant"),
    ("zlib_liability", "^in no event will the authors be held liable .*$", "Zlib-liability"),
    ("zlib_grant", "^permission is granted to anyone to use this software for any purpose including commercial applications .*$", "Zlib-grant"),
    ("unlicense", "^this is free and unencumbered software released into the public domain$", "Unlicense-domain"),
    ("epl", "^this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:version |v ?)?([0-9] [0-9]).*$", "EPL-$1"),
    ("spdx", "^spdx licen[sc]e identifier ([a-z0-9 ]+)$", "SPDX-$1-ref"),
]
# Ordered rules over the sequence, each sentence identifier standing in angle brackets.
END_NOTES = "(?:<AsIs>)?(?:<Liability>)?"
APACHE_NOTES = "(?:<Apache-may>)?(?:<Apache-obtain>)?(?:<Apache-basis>)?"
RULES = [
    (f"<BSD-use><BSD-source><BSD-binary><BSD-advert>(?:<BSD-names>)?{END_NOTES}", "BSD-4-Clause"),
    (f"<BSD-use><BSD-source><BSD-binary><BSD-names>{END_NOTES}", "BSD-3-Clause"),
    (f"<BSD-use><BSD-source><BSD-binary>{END_NOTES}", "BSD-2-Clause"),
    (f"<BSD-use><BSD-source>{END_NOTES}", "BSD-1-Clause"),
    (f"<MIT-grant>(?:<MIT-notice>)?{END_NOTES}", "MIT"),
    ("<MIT-ref>", "MIT"),
    (f"<ISC-grant>{END_NOTES}", "ISC"),
    (f"<0BSD-grant>{END_NOTES}", "0BSD"),
    ("(?:<AsIs>)?(?:<Zlib-liability>)?<Zlib-grant>", "Zlib"),
    (f"<Unlicense-domain>{END_NOTES}", "Unlicense"),
    (f"<Apache-text>(?:<Apache-2 0-ref>)?{APACHE_NOTES}", "Apache-2.0"),
    (f"<Apache-2(?: 0)?-ref>{APACHE_NOTES}", "Apache-2.0"),
    ("<Apache-1 1-ref>", "Apache-1.1"),
    ("<MPL-subject><MPL-2 0-obtain>", "MPL-2.0"),
    ("<MPL-2 0-(?:ref|text|obtain)>", "MPL-2.0"),
    ("<EPL-1 0>", "EPL-1.0"),
    ("<EPL-2 0>", "EPL-2.0"),
    ("<GPL-2(?: 0)?-later>", "GPL-2.0-or-later"),
    ("<GPL-3(?: 0)?-later>", "GPL-3.0-or-later"),
    ("<GPL-2(?: 0)?-(?:ref|text)>", "GPL-2.0-only"),
    ("<GPL-3(?: 0)?-(?:ref|text)>", "GPL-3.0-only"),
    ("<LGPL-2 1-later>", "LGPL-2.1-or-later"),
    ("<LGPL-3(?: 0)?-later>", "LGPL-3.0-or-later"),
    ("<LGPL-2 1-ref>", "LGPL-2.1-only"),
    ("<LGPL-3(?: 0)?-ref>", "LGPL-3.0-only"),
    ("<AGPL-3(?: 0)?-later>", "AGPL-3.0-or-later"),
    ("<AGPL-3(?: 0)?-ref>", "AGPL-3.0-only"),
    ("<CC-by-4 0-ref>", "CC-BY-4.0"),
    ("<CC-by sa-4 0-ref>", "CC-BY-SA-4.0"),
    ("<CC-by nc-4 0-ref>", "CC-BY-NC-4.0"),
    ("<CC-by nc sa-4 0-ref>", "CC-BY-NC-SA-4.0"),
    ("<CC0-(?:ref|waiver)>", "CC0-1.0"),
]
# Identifiers that a tag may name, alone or joined by OR and AND. What follows WITH is not told apart.
TAGS = """MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 MPL-2.0 EPL-2.0 BSL-1.0 GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later""".split()
RULES += [(f"<SPDX-{re.sub('[^a-z0-9]+', ' ', tag.lower()).replace(' or later', ' orlater')}-ref>", tag) for tag in TAGS]
END, JOINT = "\x01", "\x02"
SPLIT = r"[.!?;:]+[ \t\r]+|[.!?;:]*\r?\n"
SPEAKS = "licen[sc]e|permission|redistribut|warrant|as is|in no event|neither the name|copy of the|general public|public domain|advertising materials|neighboring rights|cc0|creative commons zero"


def running(pattern: str) -> str:
    """A known sentence's pattern, found anywhere in a marked text; its words may stand on either side of a joint."""
    tail = " .*$" if pattern.endswith(" .*$") else ".*$" if pattern.endswith(".*$") else "$"
    inner = pattern.removeprefix("^").removeprefix(".*").removesuffix(tail)
    # a class with a space in it (that of SPDX) stays inside one piece
    inner = "".join(x if x.startswith("[") else x.replace(" ", f"[ {JOINT}]").replace(".*", f"[^{END}]*?") for x in re.split(r"(\[[^\]]*\])", inner))
    start = f"(?<![^{END}{JOINT}])" if pattern.startswith("^") else "(?<![a-z0-9])"
    rest = f"[^{END}{JOINT}]*"  # to the joint only, so that what stands behind it is seen
    return start + inner + {" .*$": f"(?: {rest}|{JOINT})", ".*$": rest, "$": f"(?![^{END}{JOINT}])"}[tail]


ANY = "|".join(running(p) for _, p, _ in SENTENCES)
SPEAKS_WRAPPED = SPEAKS.replace(" ", "[^a-z0-9]+")


def marked(text: Column) -> Column:
    """Normalised text in which END and JOINT stand between sentences and pieces, without spaces beside them."""
    out = F.translate(F.lower(text), END + JOINT, "  ")
    steps = [(r"[.!?]+(?=[ \t\r\n])", END), (r"\n[^a-z0-9\n]*+(?=\n)", END), (r"[;:]+(?=[ \t\r\n])|\n", JOINT), (f"[^a-z0-9{END}{JOINT}]++", " "),
             (f" ?{JOINT}[ {JOINT}]*+", JOINT), (f"[ {JOINT}]?{END}[ {JOINT}{END}]*+", END)]
    for pattern, mark in steps:
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def identifier(sentence: Column) -> Column:
    """The known sentence's identifier, or null."""
    out = F.lit(None).cast("string")
    for _, pattern, name in reversed(SENTENCES):
        out = F.when(sentence.rlike(pattern), F.regexp_replace(sentence, pattern, name)).otherwise(out)
    return out


def tags(name: Column) -> Column:
    """An identifier as a list: one for each licence that a tag joins by OR and AND."""
    listed = F.split(F.regexp_replace(F.regexp_replace(name, "^SPDX-|-ref$", ""), " or later", " orlater"), " (?:or|and) ")
    own = F.transform(listed, lambda x: F.concat(F.lit("SPDX-"), F.regexp_replace(x, " with .*", ""), F.lit("-ref")))
    return F.when(name.startswith("SPDX-"), own).otherwise(F.array(name))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sequence (their identifiers), licenses (in rule order), unmatched (what is left)."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = F.transform(F.regexp_extract_all(marked(F.col("text")), F.lit(ANY), F.lit(0)), lambda s: F.translate(s, JOINT, " "))
    speaking = F.when(F.lower("text").rlike(SPEAKS_WRAPPED), known).otherwise(F.array().cast("array<string>"))
    df = own.select("doc_id", F.flatten(F.transform(F.filter(F.transform(speaking, identifier), lambda x: x.isNotNull()), tags)).alias("ids"))
    df = df.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ";").alias("sequence"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("rest"), F.array().cast("array<string>").alias("found"))
    for pattern, name in RULES:
        hit = F.col("rest").rlike(pattern)
        df = df.select("doc_id", "n_sentences", "sequence", F.when(hit, F.regexp_replace("rest", pattern, "")).otherwise(F.col("rest")).alias("rest"), F.when(hit, F.array_union("found", F.array(F.lit(name)))).otherwise(F.col("found")).alias("found"))
    return df.select("doc_id", "n_sentences", "sequence", F.array_join("found", ",").alias("licenses"), F.col("rest").alias("unmatched"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    swap = lambda s: s.replace("$", "\\")
    cases = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN regexp_replace(s, {quoted(p)}, {quoted(swap(n))})" for _, p, n in SENTENCES)
    sql = f"""WITH plain AS (SELECT doc_id, [trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) FOR s IN string_split_regex(coalesce(text, ''), {quoted(SPLIT)})] AS sentences FROM documents),
named AS (SELECT doc_id, [x FOR x IN [CASE {cases} END FOR s IN sentences IF regexp_matches(s, {quoted(SPEAKS)})] IF x IS NOT NULL] AS names FROM plain),
listed AS (SELECT doc_id, flatten([CASE WHEN starts_with(x, 'SPDX-') THEN ['SPDX-' || regexp_replace(t, ' with .*', '') || '-ref' FOR t IN string_split_regex(replace(regexp_replace(x, '^SPDX-|-ref$', '', 'g'), ' or later', ' orlater'), ' (?:or|and) ')] ELSE [x] END FOR x IN names]) AS ids FROM named),
r0 AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ';') AS sequence, array_to_string(['<' || x || '>' FOR x IN ids], '') AS rest, CAST([] AS VARCHAR[]) AS found FROM listed)"""
    for k, (pattern, name) in enumerate(RULES):
        sql += f""",
r{k + 1} AS (SELECT doc_id, n_sentences, sequence, regexp_replace(rest, {quoted(pattern)}, '', 'g') AS rest, CASE WHEN regexp_matches(rest, {quoted(pattern)}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM r{k})"""
    return sql + f"\nSELECT doc_id, n_sentences, sequence, array_to_string(found, ',') AS licenses, rest AS unmatched FROM r{len(RULES)}"
