"""Licence scans: known sentences become identifiers, and ordered rules match identifier sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "this work is licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheGrant",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "ApacheGrantUse",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "either version 2 of the license or at your option any later version": "GplLater2",
    "either version 3 of the license or at your option any later version": "GplLater3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GplTermsLater2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GplTermsLater3",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "all rights reserved": "AllRights",
}

#: Licences and the identifiers that state them, in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("ApacheGrantUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheGrantUse",)),
    ("Apache-2.0", ("ApacheGrant", "ApacheUse")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitRef",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "GplLater2")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "GplLater3")),
    ("GPL-2.0-or-later", ("GplFree", "GplTermsLater2")),
    ("GPL-3.0-or-later", ("GplFree", "GplTermsLater3")),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("ISC", ("IscGrant",)),
    ("MPL-2.0", ("Mpl2Ref",)),
)

#: A word of this pattern is in every known sentence, so texts without one need no cutting.
TRIGGER = "licens|permission|redistribut|warrant|software|rights|of the license|liable"
_MARK, _SOFT = "\x01", "\x02"
#: Parts between soft breaks that a known sentence may be joined from: a line of it is a part at most.
PARTS = 8


def sentences(text: Column) -> Column:
    """A text's sentences, normalised to lower-case letters and digits with single spaces, each as its parts.

    Sentences end at ``. ! ? ; :`` before white space, and at a blank line before
    a capitalised word.  Where only a line break stands before the capitalised
    word, or a number follows ``v.``, the sentence may go on, so its parts are
    kept apart; other line breaks are spaces.
    """
    marked = F.regexp_replace(text, r"\b([vV])\.\s+(?=\d)", f"$1{_SOFT}")
    marked = F.regexp_replace(marked, r"([.!?;:])\s", f"$1{_MARK}")
    marked = F.regexp_replace(marked, r"\n([^\S\n]*\n\s*[A-Z][a-z])", f"{_MARK}$1")
    marked = F.regexp_replace(marked, r"\n([^\S\n]*[A-Z][a-z])", f"{_SOFT}$1")
    plain = F.regexp_replace(F.lower(marked), f"[^a-z0-9{_MARK}{_SOFT}]+", " ")
    return F.transform(F.split(plain, _MARK), lambda s: F.array_remove(F.transform(F.split(s, _SOFT), lambda x: F.trim(x)), ""))


def _known(parts: Column, table: Column) -> Column:
    """The known sentences among a sentence's parts, alone or joined with those that follow; the longest comes first."""

    def next_one(state: Column, i: Column) -> Column:
        sizes = F.sequence(F.least(F.lit(PARTS), F.size(parts) - i), F.lit(1), F.lit(-1))
        tried = F.transform(sizes, lambda n: F.struct(F.try_element_at(table, F.array_join(F.slice(parts, i + 1, n), " ")).alias("id"), (i + n).alias("end")))
        hit = F.get(F.filter(tried, lambda h: h["id"].isNotNull()), F.lit(0))
        taken = F.transform(F.array(hit), lambda h: F.when(h.isNull(), state).otherwise(F.struct(h["end"].alias("end"), F.concat(state["ids"], F.array(h["id"])).alias("ids"))))
        return F.when(i < state["end"], state).otherwise(F.element_at(taken, 1))

    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("ids"))
    joined = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, next_one, lambda s: s["ids"])
    alone = F.array_compact(F.array(F.try_element_at(table, F.get(parts, F.lit(0)))))
    return F.when(F.size(parts) < 2, alone).otherwise(joined)


def scan(docs: DataFrame, text: str, known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, trigger: str = TRIGGER) -> DataFrame:
    """Add ``sentence_ids``, ``licences`` and ``n_unmatched`` to each row.

    ``sentence_ids`` are a text's known sentences, in order.  Rules are tried in
    turn: where one's identifiers stand in sequence, its licence is found and
    they are used up, so specific rules come before general ones.  ``licences``
    are the distinct ones found, in rule order, joined by commas; ``n_unmatched``
    counts known sentences that no rule used.  Null and empty texts have none.
    Columns of these names are replaced, all others and all rows stay.

    Everything is computed within a row, without a shuffle.
    """
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.flatten(F.transform(sentences(F.col(f"`{text}`")), lambda s: _known(s, table)))
    ids = F.when(F.col(f"`{text}`").rlike(f"(?i)({trigger})"), found).otherwise(F.array().cast("array<string>"))
    out = docs.withColumns({"sentence_ids": ids}).withColumn("__left", F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    hits = []
    for k, (name, sequence) in enumerate(rules):
        pattern = "".join(f"<{i}>" for i in sequence)
        out = out.withColumns({f"__hit{k}": F.when(F.contains("__left", F.lit(pattern)), F.lit(name)), "__left": F.replace("__left", F.lit(pattern), F.lit("."))})
        hits.append(f"__hit{k}")
    left = F.length("__left") - F.length(F.replace("__left", F.lit("<"), F.lit("")))
    out = out.withColumns({"licences": F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ","), "n_unmatched": left.cast("bigint")})
    return out.drop("__left", *hits)


def scan_sql(source: str, key: str, text: str, known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> str:
    """The same scan as SQL: (key, sentences joined by spaces, licences, n_unmatched)."""
    table = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in known.items()) + "}"
    lines = [
        f"WITH s AS (SELECT {key}, regexp_replace(regexp_replace(coalesce({text}, ''), '([.!?;:])\\s', '\\1' || chr(1), 'g'), '\\n(\\s*[A-Z][a-z])', chr(1) || '\\1', 'g') AS t FROM {source})",
        f"p AS (SELECT {key}, list_transform(string_split(regexp_replace(lower(t), '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1)), lambda x: trim(x)) AS parts FROM s)",
        f"i AS (SELECT {key}, list_filter(list_transform(parts, lambda x: {table}[x]), lambda x: x IS NOT NULL) AS ids FROM p)",
        f"r0 AS (SELECT {key}, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest, CAST([] AS VARCHAR[]) AS hits FROM i)",
    ]
    for k, (name, sequence) in enumerate(rules):
        pattern = "".join(f"<{i}>" for i in sequence)
        lines.append(f"r{k + 1} AS (SELECT {key}, ids, replace(rest, '{pattern}', '.') AS rest, CASE WHEN contains(rest, '{pattern}') AND NOT list_contains(hits, '{name}') THEN list_append(hits, '{name}') ELSE hits END AS hits FROM r{k})")
    end = f"SELECT {key}, coalesce(array_to_string(ids, ' '), '') AS sentences, coalesce(array_to_string(hits, ','), '') AS licences, CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unmatched FROM r{len(rules)}"
    return ", ".join(lines) + " " + end
