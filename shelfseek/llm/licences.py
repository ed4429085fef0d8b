"""Licence recognition by sentences, with DataFrame functions only.

A text is cut into sentences, every sentence is normalised, and a table of known sentences maps it to all
identifiers it holds, in order of place (with the versions it names, where it names some). The identifiers of a text, in order, are then
matched against licence rules: sequences of identifiers, tried in order, longest first. What a rule has matched
is taken out before the next rule is tried, and nothing matches across it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The SQL looks only into texts that hold one of these. The operator looks into every text: several
#: known sentences hold none of them, and a phrase may be wrapped over two lines.
SIGNAL_WORDS = ["licen", "copyright", "spdx-", "warrant", "permission", "redistribut", "public domain"]

#: Identifier, pattern of the normalised sentence, and whether its first group is a version.
#: The first pattern that is found at a place names it. The SQL takes only the first of the list from a sentence.
SENTENCES = [
    ("spdx", r"^spdx-license-identifier: ([a-z0-9.+-]+)", True),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy", False),
    ("mit-notice", r"the above copyright notice and this permission notice (?:\(.*\) )?shall be included in all copies", False),
    ("isc-grant", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", False),
    ("as-is", r"software is provided (?:as is|by the copyright holders and contributors as is)", False),
    ("no-liability", r"in no event shall .* be liable for any", False),
    ("bsd-redistribution", r"^redistribution and use in source and binary forms", False),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice", False),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice", False),
    ("bsd-endorse", r"may be used to endorse or promote products derived", False),
    ("agpl-free", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license", False),
    ("lgpl-free", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) (?:general )?public license", False),
    ("gpl-free", r"you can redistribute it and/or modify it under the terms of the gnu (?:general )?public license", False),
    ("or-later", r"version ([0-9](?:\.[0-9])?) of the license,? or (?:\(at your option\) )?any later version", True),
    ("this-version", r"version ([0-9](?:\.[0-9])?) of the license\b", True),
    ("gpl-no-warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", False),
    ("gpl-copy", r"you should have received a copy of the gnu (?:general|lesser general|library general|affero general) public license", False),
    ("agpl-ref", r"gnu affero general public license,? (?:version |v)?([0-9](?:\.[0-9])?)", True),
    ("lgpl-ref", r"gnu (?:lesser|library) general public license,? (?:version |v)?([0-9](?:\.[0-9])?)", True),
    ("gpl-ref", r"gnu general public license,? (?:version |v)?([0-9](?:\.[0-9])?)", True),
    ("agpl-unversioned", r"gnu affero general public license", False),
    ("lgpl-unversioned", r"gnu (?:lesser|library) general public license", False),
    ("gpl-unversioned", r"gnu general public license", False),
    ("agpl-short", r"\bagpl ?v([0-9](?:\.[0-9])?)", True),
    ("lgpl-short", r"\blgpl ?v([0-9](?:\.[0-9])?)", True),
    ("gpl-short", r"\bgpl ?v([0-9](?:\.[0-9])?)", True),
    ("apache-compliance", r"you may not use this file except in compliance with the license", False),
    ("apache-copy", r"you may obtain a copy of the license at", False),
    ("apache-basis", r"distributed under the license is distributed on an as is basis", False),
    ("apache-ref", r"apache license,? (?:version |v)?([0-9](?:\.[0-9])?)", True),
    ("mpl-ref", r"mozilla public license,? (?:version |v\. ?|v)?([0-9](?:\.[0-9])?)", True),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file", False),
    ("epl-ref", r"eclipse public license(?: -)?,? (?:version |v\. ?|v ?)?([0-9](?:\.[0-9])?)", True),
    ("bsl-ref", r"boost software license(?: -)?,? (?:version |v\. ?|v ?)?([0-9](?:\.[0-9])?)", True),
    ("cddl-ref", r"common development and distribution license,? (?:\(cddl\),? )?(?:version |v\. ?|v ?)?([0-9](?:\.[0-9])?)", True),
    ("artistic-ref", r"artistic license,? (?:version |v\. ?|v ?)?([0-9](?:\.[0-9])?)", True),
    ("afl-ref", r"academic free license,? (?:version |v\. ?|v ?)?([0-9](?:\.[0-9])?)", True),
    ("eupl-ref", r"european union public licen[cs]e,? (?:\(eupl\),? )?(?:version |v\. ?|v ?)?([0-9](?:\.[0-9])?)", True),
    ("cc0-ref", r"\bcc0[ -](?:version )?([0-9](?:\.[0-9])?)", True),
    ("wtfpl-ref", r"do what the f(?:uck|\*ck) you want to public license", False),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose, including commercial applications", False),
    ("zlib-origin", r"the origin of this software must not be misrepresented", False),
    ("zlib-altered", r"altered source versions must be plainly marked as such", False),
    ("zlib-notice", r"this notice may not be removed or altered from any source distribution", False),
    ("bsl-grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy", False),
    ("zlib-ref", r"\bzlib license", False),
    ("cc-name", r"creative commons attribution((?:-[a-z]+)* [0-9]\.[0-9])", True),
    ("cc-ref", r"\bcc[ -]by((?:-[a-z]+)* [0-9]\.[0-9])", True),
    ("mit-ref", r"\bmit license", False),
    ("bsd-ref", r"\b([23])-clause bsd license", True),
    ("isc-ref", r"\bisc license", False),
    ("unlicense", r"released into the public domain", False),
    ("copyright", r"^copyright (?:\(c\) )?[0-9]{4}", False),
]

_ID = r"\(*[a-z0-9.+-]*[a-z0-9+]\)*"
#: How the operator looks for some of them. An expression of identifiers is taken whole, wherever it
#: stands; what lies between the two ends of a sentence is left to be searched.
WIDER = {
    "spdx": rf"\bspdx-license-identifier: ({_ID}(?: (?:or|and|with) {_ID})*)",
    "mit-notice": r"the above copyright notice and this permission notice (?=(?:\(.*\) )?shall be included in all copies)",
    "no-liability": r"in no event shall (?=.* be liable for any)",
}
#: Further versions behind the first, as in "version 2 or version 3".
_MORE = r"(?:,? (?:(?:or|and/or) (?:version |v)?[0-9](?:\.[0-9])?|and (?:(?:version |v)[0-9](?:\.[0-9])?|[0-9]\.[0-9]))(?![0-9a-z]))*"

#: Licence and its sentences, in the order in which the rules are tried. ``*`` stands for the
#: version of the sentence and is copied into the name; a sentence with ``?`` may be absent.
RULES = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "no-liability"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "as-is"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "as-is", "no-liability"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "as-is"]),
    ("Apache-*", ["apache-ref*", "apache-compliance", "apache-copy", "apache-basis"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("ISC", ["isc-grant", "as-is", "no-liability"]),
    ("ISC", ["isc-grant", "as-is"]),
    *[
        (f"{name}-*{later}", [f"{mark}-free", f"{version}*", "gpl-no-warranty?", f"{mark}-unversioned?", "gpl-copy?"])
        for later, version in (("-or-later", "or-later"), ("-only", "this-version"))
        for name, mark in (("AGPL", "agpl"), ("LGPL", "lgpl"), ("GPL", "gpl"))
    ],
    ("GPL", ["gpl-free", "gpl-no-warranty", "gpl-copy"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("AGPL-*", ["agpl-ref*"]),
    ("LGPL-*", ["lgpl-ref*"]),
    ("GPL-*", ["gpl-ref*"]),
    ("GPL", ["gpl-free"]),
    ("AGPL", ["agpl-free"]),
    ("LGPL", ["lgpl-free"]),
    ("AGPL", ["agpl-unversioned"]),
    ("LGPL", ["lgpl-unversioned"]),
    ("GPL", ["gpl-unversioned"]),
    ("AGPL-*", ["agpl-short*"]),
    ("LGPL-*", ["lgpl-short*"]),
    ("GPL-*", ["gpl-short*"]),
    ("Apache-*", ["apache-ref*"]),
    ("MPL-*", ["mpl-ref*", "mpl-copy"]),
    ("MPL-*", ["mpl-ref*"]),
    ("EPL-*", ["epl-ref*"]),
    ("BSL-*", ["bsl-ref*", "bsl-grant"]),
    ("BSL-*", ["bsl-ref*"]),
    ("BSL", ["bsl-grant"]),
    ("CDDL-*", ["cddl-ref*"]),
    ("Artistic-*", ["artistic-ref*"]),
    ("AFL-*", ["afl-ref*"]),
    ("EUPL-*", ["eupl-ref*"]),
    ("CC0-*", ["cc0-ref*"]),
    ("WTFPL", ["wtfpl-ref"]),
    ("Zlib", ["zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-ref"]),
    ("CC-BY*", ["cc-name*"]),
    ("CC-BY*", ["cc-ref*"]),
    ("MIT", ["mit-ref"]),
    ("BSD-*-Clause", ["bsd-ref*"]),
    ("ISC", ["isc-ref"]),
    ("Unlicense", ["unlicense"]),
    ("*", ["spdx*"]),
]

#: A point before a number that ends no sentence.
NUMBER_MARK = r"\b([Vv]|[Vv]er|[Nn]o)\.\s+([0-9])"
#: Words no sentence ends with, so that the next line goes on whatever it starts with.
GOES_ON = r"(?i)\b(gnu|lesser|library|affero|general|public|mozilla|eclipse|apache|boost|the|of|this|and|or|under)[ \t]*\n[ \t]*([a-z0-9])"

BREAK, GONE = "\x01", "|"


def rule_pattern(ids: list[str]) -> str:
    """The pattern of a rule in a text of ``<identifier version>`` marks; its group is the version."""
    forms = {"*": "<{} ([^>]*)>", "?": "(?:<{} >)?"}
    return "".join(forms[name[-1]].format(name[:-1]) if name[-1] in forms else f"<{name} >" for name in ids)


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order.

    A sentence ends at . ! ? or ; before white space or the end, at an empty line, and where the next line
    starts with a capital or a digit, unless the last word cannot end one. A point between "v", "ver" or "no" and
    a number ends none. Comment signs at the start of a line go first. Normalising lower-cases,
    keeps letters, digits and a few signs, makes one space of the rest, and drops signs at the start.
    """
    bare = F.regexp_replace(text, r"(?m)^[ \t]*(?:/{2,}!?|/\*+|\*+/?|#+|;+|--+|%+|<!--)(?=[ \t]|$)[ \t]*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, NUMBER_MARK, "$1.$2"), GOES_ON, "$1 $2")
    ended = F.regexp_replace(bare, r"[.!?;](\s+|$)", BREAK)
    broken = F.regexp_replace(ended, r"\n\s*(\n|[A-Z0-9])", BREAK + "$1")
    parts = F.split(broken, BREAK)
    plain = F.transform(
        parts,
        lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9.,:;()+/-]+", " "), "^[^a-z0-9]+", "")),
    )
    return F.filter(plain, lambda s: s != "")


def _wide(name: str, pattern: str) -> str:
    return WIDER.get(name, pattern + _MORE if name.endswith("-ref") and "version" in pattern else pattern)


def sentence_marks(sentence: Column) -> Column:
    """``<identifier version>`` of everything known in a normalised sentence, in order of place.

    One pattern finds all places, none of which overlap; at one place the first of ``SENTENCES`` holds. What it
    found is then named, once for every version.
    """
    # every pattern begins with a word, so the other places of a sentence need not be tried
    anything = r"\b(?:" + "|".join(f"(?:{_wide(name, pattern)})" for name, pattern, _ in SENTENCES) + ")"
    places = F.regexp_extract_all(sentence, F.lit(anything), F.lit(0))
    return F.flatten(F.transform(places, _marks_of_place))


def _mark(name: str):
    return lambda version: F.concat(F.lit(f"<{name} "), version, F.lit(">"))


def _marks_of_place(place: Column) -> Column:
    marks = F.array().cast("array<string>")
    for name, pattern, versioned in reversed(SENTENCES):
        wide = _wide(name, pattern)
        versions = F.regexp_extract(place, wide, 1) if versioned else F.lit("")
        if name == "spdx":
            versions = F.split(F.translate(versions, "()", ""), " (?:or|and) ")
        elif wide.endswith(_MORE):
            versions = F.filter(
                F.concat(F.array(versions), F.regexp_extract_all(place, F.lit(r"(?:or|and) (?:version |v)?([0-9](?:\.[0-9])?)"), F.lit(1))),
                lambda v: v != "",
            )
        else:
            versions = F.array(versions)
        own = F.transform(versions, _mark(name))
        marks = F.when(place.rlike("^(?:" + wide.split("(?=")[0] + ")"), own).otherwise(marks)
    return marks


def _named(before: str, after: str):
    return lambda version: F.concat(F.lit(before), F.upper(F.translate(version, " ", "-")), F.lit(after))


def recognise(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, sentence_ids, n_sentences, n_unmatched) for every row of ``docs`` (doc_id, text).

    ``licences`` names what the rules found, in the order of the rules, each name once, joined by ";";
    ``sentence_ids`` the known sentences in order, with versions, joined by a space; n_unmatched counts those
    that no rule took. A null or empty text has none. Repeated rows give repeated results; nothing is
    shuffled, so neither hot sources nor copies matter.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    marks = F.flatten(F.transform(sentences(text), sentence_marks))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), marks.alias("marks"))
    state = rows.select("doc_id", "marks", F.array_join("marks", "").alias("rest"), none.alias("names"))
    for licence, ids in RULES:
        pattern = rule_pattern(ids)
        if "*" in licence:
            versions = F.regexp_extract_all("rest", F.lit(pattern), F.lit(1))
            names = F.transform(versions, _named(*licence.split("*")))
        else:
            names = F.when(F.col("rest").rlike(pattern), F.array(F.lit(licence))).otherwise(none)
        state = state.select(
            "doc_id", "marks", F.regexp_replace("rest", pattern, GONE).alias("rest"), F.concat("names", names).alias("names")
        )
    ids = F.transform("marks", lambda m: F.rtrim(F.translate(m, "<>", "")))
    return state.select(
        "doc_id", F.array_join(F.array_distinct("names"), ";").alias("licences"),
        F.array_join(F.transform(ids, lambda i: F.translate(i, " ", "@")), " ").alias("sentence_ids"),
        F.size("marks").cast("bigint").alias("n_sentences"),
        F.size(F.filter(F.split("rest", "<"), lambda s: s.contains(">"))).cast("bigint").alias("n_unmatched"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def recognise_sql(source: str = "documents") -> str:
    """The same as DuckDB SQL, but only for texts with one of ``SIGNAL_WORDS``, one identifier a sentence, and with
    comment signs left in sentences."""
    signals = " OR ".join(f"contains(lower(text), {_quoted(word)})" for word in SIGNAL_WORDS)
    cases = " ".join(
        f"WHEN regexp_matches(s, {_quoted(pattern)}) THEN '<{name} ' || "
        + (f"regexp_extract(s, {_quoted(pattern)}, 1)" if versioned else "''")
        + " || '>'"
        for name, pattern, versioned in SENTENCES
    )
    steps = []
    for number, (licence, ids) in enumerate(RULES):
        pattern = _quoted(rule_pattern(ids))
        if "*" in licence:
            before, after = map(_quoted, licence.split("*"))
            names = f"list_transform(regexp_extract_all(rest, {pattern}, 1), lambda v: {before} || upper(replace(v, ' ', '-')) || {after})"
        else:
            names = f"CASE WHEN regexp_matches(rest, {pattern}) THEN [{_quoted(licence)}] ELSE []::VARCHAR[] END"
        steps.append(
            f"s{number + 1} AS (SELECT doc_id, marks, regexp_replace(rest, {pattern}, '{GONE}', 'g') AS rest, "
            f"list_concat(names, {names}) AS names FROM s{number})"
        )
    return f"""WITH cut AS (SELECT doc_id, CASE WHEN {signals} THEN string_split(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(text, {_quoted(NUMBER_MARK)}, '\\1.\\2', 'g'), {_quoted(GOES_ON)}, '\\1 \\2', 'g'), '[.!?;](\\s+|$)', chr(1), 'g'), '\\n\\s*(\\n|[A-Z0-9])', chr(1) || '\\1', 'g'), chr(1)) ELSE []::VARCHAR[] END AS parts FROM {source}),
plain AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(regexp_replace(lower(p), '[^a-z0-9.,:;()+/-]+', ' ', 'g'))),
  lambda s: s <> '') AS sentences FROM cut),
marked AS (SELECT doc_id, list_filter(list_transform(sentences, lambda s: CASE {cases} END), lambda m: m IS NOT NULL) AS marks FROM plain),
s0 AS (SELECT doc_id, marks, array_to_string(marks, '') AS rest, []::VARCHAR[] AS names FROM marked),
{(',' + chr(10)).join(steps)}
SELECT doc_id,
  array_to_string(list_filter(names, lambda n, i: list_position(names, n) = i), ';') AS licences,
  array_to_string(list_transform(marks, lambda m: replace(rtrim(translate(m, '<>', '')), ' ', '@')), ' ') AS sentence_ids,
  len(marks)::BIGINT AS n_sentences,
  len(list_filter(string_split(rest, '<'), lambda x: contains(x, '>')))::BIGINT AS n_unmatched
FROM s{len(RULES)}"""
