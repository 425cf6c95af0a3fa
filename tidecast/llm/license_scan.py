"""License scan by sentence rules: normalised sentences become known sentence identifiers, and the sequence of a text's
identifiers is matched against ordered licence rules. DataFrame functions only, so one pass stays inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised (lower case; anything but letters, digits and dots inside numbers becomes one
#: blank), by identifier. A trailing * accepts any continuation of the sentence.
SENTENCES = {
    "apache-2-grant": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache-2-compliance": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at *"],
    "apache-2-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software *", "permission is hereby granted free of charge to any person obtaining a copy"],
    "mit-name": ["licensed under the mit license", "this software is released under the mit license", "released under the mit license", "mit license", "the mit license mit"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind *"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted *"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice *"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice *"],
    "bsd-endorse": ["neither the name of *"],
    "gpl-grant": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license *", "this program is free software you can redistribute it and or modify it", "licensed under the gnu general public license *"],
    "gpl-2": ["either version 2 of the license or at your option any later version"],
    "gpl-3": ["either version 3 of the license or at your option any later version", "licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty *"],
    "lgpl-grant": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license *"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2.0", "this source code form is subject to the terms of the mozilla public license *"],
    "cc-by-sa-4": ["this work is licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0", "licensed under the creative commons attribution sharealike 4.0 *"],
    "cc-by-4": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "cc-by-nc-4": ["this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"],
    "cc0": ["to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"],
    "agpl-grant": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license *"],
    "lgpl-2.1": ["either version 2.1 of the license or at your option any later version"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies *"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-asis": ["the software is provided as is and the author disclaims all warranties *"],
    "zlib-asis": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions *"],
    "zlib-origin": ["the origin of this software must not be misrepresented *"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 *", "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 *", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0 *"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software *"],
    "bsl-1": ["distributed under the boost software license version 1.0 *"],
    "spdx": ["spdx license identifier *"],
    "reserved": ["all rights reserved"],
    "copyright": ["copyright *", "c copyright *"],
}

#: Ordered rules: licence, identifiers that must stand in this order (others may lie between), confidence. First rules win
#: over later ones of the same family.
RULES = [
    ("Apache-2.0", "Apache", ["apache-2-grant", "apache-2-compliance", "apache-2-asis"], "full"),
    ("Apache-2.0", "Apache", ["apache-2-grant"], "notice"),
    ("MIT", "MIT", ["mit-grant", "mit-notice", "mit-asis"], "full"),
    ("MIT", "MIT", ["mit-name"], "notice"),
    ("MIT", "MIT", ["mit-grant"], "notice"),
    ("BSD-3-Clause", "BSD", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], "full"),
    ("BSD-2-Clause", "BSD", ["bsd-grant", "bsd-source", "bsd-binary"], "full"),
    ("BSD", "BSD", ["bsd-grant"], "notice"),
    ("AGPL-3.0-or-later", "AGPL", ["agpl-grant", "agpl-3"], "full"),
    ("AGPL", "AGPL", ["agpl-grant"], "notice"),
    ("LGPL-3.0-or-later", "LGPL", ["lgpl-grant", "lgpl-3"], "full"),
    ("LGPL-2.1-or-later", "LGPL", ["lgpl-grant", "lgpl-2.1"], "full"),
    ("LGPL-2.0-or-later", "LGPL", ["lgpl-grant", "lgpl-2"], "full"),
    ("LGPL", "LGPL", ["lgpl-grant"], "notice"),
    ("ISC", "ISC", ["isc-grant", "isc-asis"], "full"),
    ("ISC", "ISC", ["isc-grant"], "notice"),
    ("0BSD", "ISC", ["0bsd-grant", "isc-asis"], "full"),
    ("Zlib", "Zlib", ["zlib-asis", "zlib-grant", "zlib-origin"], "full"),
    ("Zlib", "Zlib", ["zlib-grant"], "notice"),
    ("EPL-2.0", "EPL", ["epl-2"], "notice"),
    ("Unlicense", "Unlicense", ["unlicense-free", "unlicense-anyone"], "full"),
    ("Unlicense", "Unlicense", ["unlicense-free"], "notice"),
    ("BSL-1.0", "BSL", ["bsl-1"], "notice"),
    ("CC0-1.0", "CC", ["cc0"], "notice"),
    ("GPL-3.0-or-later", "GPL", ["gpl-grant", "gpl-3"], "full"),
    ("GPL-2.0-or-later", "GPL", ["gpl-grant", "gpl-2"], "full"),
    ("GPL-3.0", "GPL", ["gpl-3"], "notice"),
    ("GPL", "GPL", ["gpl-grant"], "notice"),
    ("MPL-2.0", "MPL", ["mpl-2"], "notice"),
    ("CC-BY-SA-4.0", "CC", ["cc-by-sa-4"], "notice"),
    ("CC-BY-4.0", "CC", ["cc-by-4"], "notice"),
    ("CC-BY-NC-4.0", "CC-NC", ["cc-by-nc-4"], "notice"),
    ("SPDX-tag", "SPDX", ["spdx"], "tag"),
    ("Proprietary", "Proprietary", ["copyright", "reserved"], "notice"),
    ("All-rights-reserved", "Proprietary", ["reserved"], "notice"),
]

#: Known to the scan only, oracle_sql() has its own cuts: the GNU Lesser licence is also granted to programs.
WRAPPED = {"lgpl-grant": ["this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license *"]}

#: Every known sentence holds one of these words, so other texts and sentences go no further.
HINTS = ["license", "licence", "copyright", "redistribution", "permission", "software", "reserved", "neither", "warranty", "spdx"]
HINT = "(?i)" + "|".join(HINTS)
#: The GNU licences share the sentence of their version: (pattern, what it means after their grants).
DERIVED = {"agpl-2", "agpl-3", "lgpl-2", "lgpl-3"}
_VERSIONS = [("(lgpl|agpl)-grant,gpl-([23])", "$1-grant,$1-$2")]
_BLANK = r"[\t\n\x0b\f\r ]"
_ENDS = rf"[\n\r]+|[.!?;:]+({_BLANK}+|\z)"
_LINE = r"(?>\r\n|[\n\r])"
#: No sentence goes over a line without letters and digits, or over a full stop.
_HARD = rf"{_LINE}(?:[^A-Za-z0-9\n\r]*{_LINE})+|[.!?;:]*[.!?][.!?;:]*({_BLANK}+|\z)"
#: A sentence may begin after these, and may go over them.
_SOFT = rf"[\n\r]+|[;:]+({_BLANK}+|\z)|,(?={_BLANK}+(?i:either){_BLANK})"
#: Applied in this order to a lower-cased sentence: only letters, digits and dots between digits stay.
_CLEAN = [(r"[^a-z0-9.]+", " "), (r"\.+([^0-9.]|\z)", r" $1"), (r"([^0-9.]|\A)\.+", r"$1 "), (r" +", " ")]


def normalise_sentence(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, to in _CLEAN:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def _identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if unknown. Exact texts first, then longest beginnings."""
    exact = [(t, k) for k, texts in SENTENCES.items() for t in texts if not t.endswith("*")]
    starts = sorted(((t[:-2], k) for k, texts in SENTENCES.items() for t in texts if t.endswith("*")), key=lambda x: (-len(x[0]), x[0]))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in exact for x in pair]), sentence)
    rest: Column | None = None
    for text, key in starts:
        test = (sentence == F.lit(text)) | sentence.startswith(text + " ")
        rest = F.when(test, key) if rest is None else rest.when(test, key)
    return F.coalesce(known, rest)


def _known() -> list[tuple[str, str, bool]]:
    """(sentence, identifier, whether any continuation is accepted), longest first."""
    every = [(t.removesuffix(" *"), k, t.endswith("*")) for found in (SENTENCES, WRAPPED) for k, texts in found.items() for t in texts]
    return sorted(every, key=lambda x: (-len(x[0]), x[0]))


def _placed_identifier(pieces: Column, piece: Column, i: Column) -> Column:
    """(key, n): identifier of the longest known sentence that begins with piece i, and the pieces it goes over."""
    known = _known()
    most = max(len(t.split(" ")) for t, _, _ in known)
    begun = F.lit("".join(f"|{t} " for t, _, _ in known)).contains(F.concat(F.lit("|"), piece, F.lit(" ")))
    joins = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(pieces) - i)), lambda n: F.concat_ws(" ", F.slice(pieces, i + 1, n)))

    def over(joined: Column) -> Column:
        last, found = F.element_at(joined, -1), None
        for text, key, more in known:
            test = (last == F.lit(text)) | last.startswith(text + " ") if more else F.array_contains(joined, text)
            value = F.struct(F.lit(key).alias("key"), (F.size(F.filter(joined, lambda x: F.length(x) < len(text))) + 1).alias("n"))  # noqa: B023
            found = F.when(test, value) if found is None else found.when(test, value)
        return found

    # A known sentence begins with the first two words of one: other pieces are not compared with any.
    pair = F.concat(F.lit("|"), F.substring_index(piece, " ", 2), F.lit("|"))
    opens = F.lit("|".join(["", *sorted({" ".join(t.split(" ")[:2]) for t, _, _ in known}), ""])).contains(pair) | F.substring_index(piece, " ", 1).isin(*sorted({t for t, _, _ in known if " " not in t}))
    alone = F.struct(F.when(opens, _identifier(piece)).alias("key"), F.lit(1).alias("n"))
    return F.when(begun & (i + 1 < F.size(pieces)), F.coalesce(F.element_at(F.transform(F.array(joins), over), 1), alone)).otherwise(alone)


def _sentence_ids(text: Column) -> Column:
    """Identifiers in order. A sentence may go over line breaks, colons and semicolons, but one inside another is not counted."""
    sentences = F.transform(F.filter(F.split(text, _HARD), lambda s: s.rlike(HINT)), lambda s: F.filter(F.transform(F.split(s, _SOFT), normalise_sentence), lambda p: p != ""))
    placed = F.transform(sentences, lambda ps: F.transform(ps, lambda p, i: _placed_identifier(ps, p, i)))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("keys"))

    def merge(at: Column, x: Column) -> Column:
        add = (at["skip"] == 0) & x["key"].isNotNull()
        return F.struct(F.when(add, x["n"] - 1).otherwise(F.greatest(at["skip"] - 1, F.lit(0))).alias("skip"), F.when(add, F.concat(at["keys"], F.array(x["key"]))).otherwise(at["keys"]).alias("keys"))

    return F.flatten(F.transform(placed, lambda xs: F.when(F.exists(xs, lambda x: x["key"].isNotNull()), F.aggregate(xs, start, merge, lambda at: at["keys"])).otherwise(F.array().cast("array<string>"))))


def _pattern(sequence: list[str]) -> str:
    return "(^|,)" + "(,|,.*,)".join(sequence) + "(,|$)"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_licenses) for every row.

    sentence_ids: identifiers of the known sentences in order, comma-joined; licenses: licence:confidence of the first
    rule of each family that matches, in rule order, comma-joined. Sentences may be wrapped at any blank. Null and empty texts give empty strings and 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.concat_ws(",", _sentence_ids(text))
    for pattern, to in _VERSIONS:
        found = F.regexp_replace(found, pattern, to)
    low = F.lower(text)
    ids = F.when(reduce(lambda a, b: a | b, (low.contains(h) for h in HINTS)), found).otherwise("")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("sentence_ids"))
    hits, families = [], {}
    for licence, family, sequence, kind in RULES:
        pattern = _pattern(sequence)
        own = F.col("sentence_ids").rlike(pattern)
        test = own & ~families[family] if family in families else own
        families[family] = families[family] | own if family in families else own
        hits.append(F.when(test, f"{licence}:{kind}"))
    matched = base.select("doc_id", "sentence_ids", F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*hits))).alias("hits"))
    return matched.select("doc_id", "sentence_ids", F.concat_ws(",", "hits").alias("licenses"), F.size("hits").cast("long").alias("n_licenses"))


def oracle_sql() -> str:
    """The same result in DuckDB SQL, where no known sentence goes over a line break, colon or semicolon."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    clean = "lower(x)"
    for pattern, to in _CLEAN:
        clean = f"regexp_replace({clean}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    exact = [(t, k) for k, texts in SENTENCES.items() for t in texts if not t.endswith("*")]
    starts = sorted(((t[:-2], k) for k, texts in SENTENCES.items() for t in texts if t.endswith("*")), key=lambda x: (-len(x[0]), x[0]))
    cases = [f"WHEN y = {quote(t)} THEN {quote(k)}" for t, k in exact] + [f"WHEN y = {quote(t)} OR starts_with(y, {quote(t + ' ')}) THEN {quote(k)}" for t, k in starts]
    joined = "coalesce(string_agg(k, ',' ORDER BY p), '')"
    for pattern, to in _VERSIONS:
        joined = f"regexp_replace({joined}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    families: dict[str, list[str]] = {}
    hits = []
    for licence, family, sequence, kind in RULES:
        test = f"regexp_matches(sentence_ids, {quote(_pattern(sequence))})"
        hits.append(f"CASE WHEN {' AND NOT '.join([test, *families.get(family, [])])} THEN {quote(f'{licence}:{kind}')} END")
        families.setdefault(family, []).append(test)
    return f"""
WITH sentences AS (
  SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), {quote(_ENDS)})) AS x,
         generate_subscripts(string_split_regex(coalesce(text, ''), {quote(_ENDS)}), 1) AS p FROM documents),
clean AS (SELECT doc_id, p, trim({clean}) AS y FROM sentences WHERE regexp_matches(x, {quote(HINT)})),
known AS (SELECT doc_id, p, CASE {' '.join(cases)} END AS k FROM clean),
ids AS (SELECT d.doc_id, {joined} AS sentence_ids FROM documents d LEFT JOIN known USING (doc_id) GROUP BY d.doc_id),
hits AS (SELECT doc_id, sentence_ids, list_filter([{', '.join(hits)}], lambda z: z IS NOT NULL) AS h FROM ids)
SELECT doc_id, sentence_ids, array_to_string(h, ',') AS licenses, CAST(len(h) AS BIGINT) AS n_licenses FROM hits"""
