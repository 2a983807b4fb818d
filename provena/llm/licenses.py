"""Licence scans by sentence rules.

Texts are cut into sentences and each is normalised. Known sentences become identifiers; the sequence of
identifiers of a text, in order, is matched against licence rules. A rule lists the sentences that have to occur in
its order, with anything between them. Everything is column expressions; no row leaves its place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences in normal form (lower case, words joined by one space).
SENTENCES = {
    "mit-title": "the mit license mit",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# Rules: licence, sentences in order, and the rules that a match makes needless.
RULES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "mit-full": ("MIT", ("mit-grant", "mit-notice", "mit-warranty"), ("mit-grant-only", "mit-reference", "mit-statement")),
    "mit-grant-only": ("MIT", ("mit-grant",), ()),
    "mit-reference": ("MIT", ("mit-short",), ()),
    "mit-statement": ("MIT", ("mit-licensed",), ()),
    "apache-full": ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-warranty"), ("apache-reference",)),
    "apache-reference": ("Apache-2.0", ("apache-short",), ()),
    "gpl3-full": ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-copy"), ("gpl3-reference",)),
    "gpl2-full": ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty", "gpl-copy"), ()),
    "gpl3-reference": ("GPL-3.0-only", ("gpl3-short",), ()),
    "bsd-3": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ("bsd-2",)),
    "bsd-2": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), ()),
    "cc-by": ("CC-BY-4.0", ("cc-by-short",), ()),
    "cc-by-sa": ("CC-BY-SA-4.0", ("cc-by-sa-short",), ()),
    "cc-by-nc": ("CC-BY-NC-4.0", ("cc-by-nc-short",), ()),
    "mpl": ("MPL-2.0", ("mpl-notice", "mpl-copy"), ()),
    "isc": ("ISC", ("isc-grant",), ()),
    "unlicense": ("Unlicense", ("unlicense",), ()),
}

# Sentences whose notices hold marks inside, and the words that a part after such a mark begins with. The sentence
# is found whole, cut at all of these places, or at some of them.
CUTS: dict[str, tuple[str, ...]] = {
    "gpl-free": ("you can redistribute", "either version 3"),
    "gpl2-free": ("you can redistribute", "either version 2"),
    "gpl-warranty": ("without even",),
    "mpl-notice": ("2 0",),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A sentence ends at a mark before white space, or at a blank line. Single line ends only wrap it.
BREAK = r"[.!?;:]+[ \t\r\n]+|\r?\n[ \t]*\r?\n"
LINE_BREAK = r"[.!?;:]+[ \t\r\n]+|\r?\n"


def normal(sentence: Column) -> Column:
    """Lower-case letters, digits and letters beyond ASCII, all else one space."""
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _check(sentences: dict[str, str], rules: dict) -> None:
    for name, text in sentences.items():
        if not re.fullmatch(r"[a-z0-9\u0080-￿]+( [a-z0-9\u0080-￿]+)*", text):
            raise ValueError(f"sentence {name} is not in normal form")
    for name, (_, parts, covers) in rules.items():
        if not parts or set(parts) - set(sentences) or set(covers) - set(rules):
            raise ValueError(f"rule {name} names unknown sentences or rules")


def _parts(text: str, starts: tuple[str, ...]) -> list[str]:
    """A sentence cut before each of ``starts``."""
    out = []
    for start in starts:
        head, found, tail = text.partition(f" {start}")
        if not found:
            raise ValueError(f"{start!r} is not inside its sentence")
        out.append(head)
        text = start + tail
    return [*out, text]


def _pieces(sentences: dict[str, str], cuts: dict[str, tuple[str, ...]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Identifiers by text, of whole sentences and of runs of parts, and the part identifiers of each cut sentence.

    Parts have identifiers of their own (``@`` and a number), by their text: sentences may share them.
    """
    ids: dict[str, str] = {}
    wholes = {name: [(part, ids.setdefault(part, f"@{len(ids)}")) for part in _parts(sentences[name], starts)] for name, starts in cuts.items()}
    known = {}
    for parts in wholes.values():
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                known[" ".join(text for text, _ in parts[i:j])] = [id_ for _, id_ in parts[i:j]]
    known |= {text: [name] for name, text in sentences.items()}
    return known, {name: [id_ for _, id_ in parts] for name, parts in wholes.items()}


def scan(documents: DataFrame, sentences: dict[str, str] | None = None, rules: dict | None = None, cuts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Licences of documents(doc_id, text): ``doc_id, sentences`` (identifiers found, in order), ``rules`` (rules that
    match, sorted) and ``licenses`` (their licences, sorted).

    Sentences are read twice, cut at every line end and cut at blank lines only, so that wrapped sentences and short
    lines are both found; what both readings find is put in one order by place. A sentence of ``cuts`` is also found in parts that
    follow each other, with nothing known between them; parts alone are no sentence. Null and empty texts give empty
    lists; each row gives a row, repeated ones too; other columns are ignored.
    """
    if cuts is None:
        cuts = CUTS if sentences is None else {}
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    _check(sentences, rules)
    pieces, wholes = _pieces(sentences, cuts)
    none = F.expr("cast(array() as array<string>)")
    known = F.create_map(*[F.lit(x) for text, ids in pieces.items() for x in (text, "><".join(ids))])
    # Texts without any first three words of a known sentence need no cutting. The words may be wrapped.
    starts = sorted({r"[^a-z0-9]+".join(s.split()[:3]) for s in sentences.values()})
    likely = F.translate("text", UPPER, LOWER).rlike("|".join(starts))

    def known_id(piece: Column) -> Column:
        return F.element_at(known, normal(piece))

    # Blocks of the second reading; the first cuts each of them at its line ends.
    read = F.transform(F.split("text", BREAK), lambda b: F.struct(known_id(b).alias("block"), F.when(b.contains("\n"), F.filter(F.transform(F.split(b, "\r?\n"), known_id), lambda i: i.isNotNull())).alias("lines")))
    # A block begins where its first line does, so its own identifier goes first. Equal to that of a line, it is that
    # line: all others are empty then.
    found = F.flatten(F.transform(read, lambda r: F.array_compact(F.concat(F.when(F.array_contains(r["lines"], r["block"]), none).otherwise(F.array(r["block"])), F.coalesce(r["lines"], none)))))

    def whole(ids: Column) -> Column:
        """Parts that follow each other joined to their sentence; other parts go."""
        text = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">"))
        for name, parts in wholes.items():
            text = F.replace(text, F.lit(f"<{'><'.join(parts)}>"), F.lit(f"<{name}>"))
        text = F.regexp_replace(F.regexp_replace(text, "<@[0-9]+>", ""), "^<|>$", "")
        return F.when(F.exists(ids, lambda i: i.startswith("@")), F.filter(F.split(text, "><"), lambda i: i != "")).otherwise(ids)

    rows = documents.select("doc_id", F.coalesce(F.when(likely, found), none).alias("_found"))
    rows = rows.select("doc_id", whole(F.col("_found")).alias("sentences"))
    text = F.concat(F.lit("<"), F.array_join("sentences", "><"), F.lit(">"))
    hits = [F.when(text.like("%" + "%".join(f"<{p}>" for p in parts) + "%"), F.lit(name)) for name, (_, parts, _) in sorted(rules.items())]
    rows = rows.withColumn("_all", F.array_compact(F.array(*hits)) if hits else none)
    covered = F.flatten(F.transform("_all", lambda r: F.element_at(F.create_map(*[x for name, (_, _, covers) in rules.items() for x in (F.lit(name), F.array(*map(F.lit, covers)) if covers else none)]), r)))
    rows = rows.withColumn("rules", F.array_except("_all", covered))
    name_of = F.create_map(*[F.lit(x) for name, (license_, _, _) in rules.items() for x in (name, license_)])
    return rows.select("doc_id", "sentences", "rules", F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.element_at(name_of, r)))).alias("licenses"))


def oracle(sentences: dict[str, str] | None = None, rules: dict | None = None) -> str:
    """The same scan as DuckDB SQL, with the licences joined by commas."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    table = ", ".join(f"('{text}', '{name}')" for name, text in sentences.items())
    cases = ", ".join(f"('{name}', '{license_}', '%{'%'.join(f'<{p}>' for p in parts)}%')" for name, (license_, parts, _) in rules.items())
    covers = ", ".join(f"('{name}', '{c}')" for name, (_, _, cs) in rules.items() for c in cs)

    def cut(name: str, pattern: str) -> str:
        return rf"""{name}_s AS (
  SELECT doc_id, i, trim(regexp_replace(translate(s[i], '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS s
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
{name} AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM {name}_s JOIN known USING (s) GROUP BY doc_id)"""

    return rf"""
WITH known(s, id) AS (VALUES {table}),
rules(rule, license, pattern) AS (VALUES {cases}),
covers(rule, other) AS (VALUES {covers}),
{cut('a', LINE_BREAK)},
{cut('b', BREAK)},
seq AS (
  SELECT doc_id, CASE WHEN coalesce(len(b.ids), 0) > coalesce(len(a.ids), 0) THEN b.ids ELSE coalesce(a.ids, []) END AS ids
  FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)),
hit AS (SELECT doc_id, rule, license FROM seq JOIN rules ON '<' || array_to_string(ids, '><') || '>' LIKE pattern),
kept AS (SELECT h.* FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o JOIN covers c ON o.rule = c.rule WHERE o.doc_id = h.doc_id AND c.other = h.rule)),
named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM seq LEFT JOIN named USING (doc_id)"""
