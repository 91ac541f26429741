"""Licence scans by sentence rules, with DataFrame functions only.

Every sentence of a text is normalised to its ASCII letters and digits and
looked up among the sentences that licences are known by. The identifiers found
are kept in text order; a licence is present where one of its rules, an ordered
run of identifiers, stands in that sequence. Sentences nobody knows may come
between, so wrapped or commented notices still match.

A text is cut three times: with every line end as a border (short notices on a
line of their own), with blank lines only (sentences wrapped over lines), and
with lines that hold no letter or digit and list numbers after a colon as borders
(notices in comments).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Names of licences and the sentences of their published texts and notices. One list is one rule, in order.
RULES: dict[str, list[list[str]]] = {
    "Apache-2.0": [
        ["Licensed under the Apache License, Version 2.0."],
        ["This project is licensed under the Apache License, Version 2.0."],
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
            "See the License for the specific language governing permissions and limitations under the License.",
        ],
    ],
    "MIT": [
        ["Released under the MIT License."],
        ["Licensed under the MIT License."],
        ["This project is licensed under the MIT License."],
        [
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ],
    ],
    "GPL-3.0": [
        ["This work is licensed under the GNU General Public License, version 3."],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ],
    "GPL-2.0": [
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "See the GNU General Public License for more details.",
        ],
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ],
    "LGPL-3.0": [
        ["This work is licensed under the GNU Lesser General Public License, version 3."],
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
            "See the GNU Lesser General Public License for more details.",
        ],
    ],
    "BSD-3-Clause": [
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ],
    ],
    "BSD-2-Clause": [
        [
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        ],
    ],
    "ISC": [
        ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    ],
    "MPL-2.0": [
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    ],
    "CC-BY-4.0": [
        ["Licensed under CC BY 4.0."],
        ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    ],
    "CC-BY-SA-4.0": [
        ["Licensed under CC BY-SA 4.0."],
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    ],
    "CC-BY-NC-4.0": [
        ["Licensed under CC BY-NC 4.0."],
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    ],
    "CC0-1.0": [
        ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    ],
    "Unlicense": [
        ["This is free and unencumbered software released into the public domain."],
    ],
    "LGPL-2.1": [
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "See the GNU Lesser General Public License for more details.",
        ],
    ],
    "AGPL-3.0": [
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU Affero General Public License for more details.",
        ],
    ],
    "BSL-1.0": [
        ["Distributed under the Boost Software License, Version 1.0."],
    ],
    "Zlib": [
        [
            "This software is provided 'as-is', without any express or implied warranty.",
            "In no event will the authors be held liable for any damages arising from the use of this software.",
        ],
    ],
    "CC-BY-ND-4.0": [
        ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    ],
    "CC-BY-NC-SA-4.0": [
        ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    ],
    "CC-BY-NC-ND-4.0": [
        ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    ],
}

SPACE = r"[\x20\x09-\x0D]"
MARK = "\n"
COMMENT_BORDER = r"\r?\n[^\p{L}\p{N}\r\n]*\r?\n|(?<=:)[\x20\x09]*\r?\n[^\p{L}\p{N}\r\n]*[0-9]{1,2}[.)](?=[\x20\x09])"


def plain(sentence: str) -> str:
    """ASCII letters and digits in lower case, single blanks between."""
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip().lower()


def sentence_book(rules: dict[str, list[list[str]]]) -> dict[str, str]:
    """Known sentence -> identifier, numbered in the order of the rules.

    A sentence with full stops inside (v. 2.0) is known by its parts.
    """
    book: dict[str, str] = {}
    for sentence in (s for runs in rules.values() for run in runs for s in run):
        for part in _parts(sentence):
            book.setdefault(part, f"s{len(book) + 1}")
    return book


def _parts(sentence: str) -> list[str]:
    return [p for p in map(plain, re.split(f"(?<=[.!?]){SPACE}+", sentence)) if p]


def rule_keys(rules: dict[str, list[list[str]]]) -> list[tuple[str, str]]:
    """(licence, ``,s4,s5,``) for every rule."""
    book = sentence_book(rules)
    return [(name, "," + ",".join(book[p] for s in run for p in _parts(s)) + ",") for name, runs in rules.items() for run in runs]


def _identifiers(text: Column, border: str, book: dict[str, str]) -> Column:
    cut = F.regexp_replace(F.regexp_replace(text, border, f".{MARK}{MARK}"), f"([.!?]){SPACE}+", f"$1{MARK}{MARK}")
    known = F.create_map(*[F.lit(x) for pair in book.items() for x in pair])
    norm = lambda s: F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))
    found = F.transform(F.split(cut, f"{MARK}{MARK}"), lambda s: F.try_element_at(known, norm(s)))
    return F.filter(found, lambda s: s.isNotNull())


def scan_licenses(docs: DataFrame, rules: dict[str, list[list[str]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, licenses, sentence_ids, wrapped_sentence_ids`` for every row.

    ``licenses`` are the names found, sorted; the identifiers are those of the
    first two ways to cut the text, in text order with repeats. Null and empty texts
    give empty arrays. Repeated rows and null ids are kept, other columns
    ignored, an empty table gives an empty result. The rules are a fixed input
    and travel as literals; nothing is shuffled.
    """
    book = sentence_book(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col),
        _identifiers(text, "[\r\n]+", book).alias("sentence_ids"),
        _identifiers(text, r"\r?\n[\x20\x09]*\r?\n", book).alias("wrapped_sentence_ids"),
        _identifiers(text, COMMENT_BORDER, book).alias("_commented"),
    )
    lines, wrapped, commented = (F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")) for c in ("sentence_ids", "wrapped_sentence_ids", "_commented"))
    hits = [F.when(lines.contains(key) | wrapped.contains(key) | commented.contains(key), F.lit(name)) for name, key in rule_keys(rules)]
    names = F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return found.select(id_col, names.alias("licenses"), "sentence_ids", "wrapped_sentence_ids")


def licenses_sql(rules: dict[str, list[list[str]]] = RULES) -> str:
    """The same scan in DuckDB SQL."""
    book = sentence_book(rules)
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in book.items()) + "}"
    ids = lambda border: (
        f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '{border}', '.' || chr(10) || chr(10), 'g'), '([.!?]){SPACE}+', '\\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10)), "
        f"lambda s: known[trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g')))]), lambda s: s IS NOT NULL)"
    )
    hits = ", ".join(f"CASE WHEN contains(a, '{key}') OR contains(b, '{key}') THEN '{name}' END" for name, key in rule_keys(rules))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {known} AS known FROM documents),
f AS (SELECT doc_id, {ids('[' + chr(92) + 'r' + chr(92) + 'n]+')} AS sentence_ids, {ids(chr(92) + 'r?' + chr(92) + 'n[' + chr(92) + 'x20' + chr(92) + 'x09]*' + chr(92) + 'r?' + chr(92) + 'n')} AS wrapped_sentence_ids FROM d),
j AS (SELECT *, ',' || coalesce(array_to_string(sentence_ids, ','), '') || ',' AS a, ',' || coalesce(array_to_string(wrapped_sentence_ids, ','), '') || ',' AS b FROM f)
SELECT doc_id, list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))) AS licenses, sentence_ids, wrapped_sentence_ids FROM j"""
