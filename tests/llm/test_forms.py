"""Mixing, encoding, licences, vectors, archives and fingerprints: brute force, round trips, odd inputs."""

import gzip
import hashlib
import io
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respondex.llm import queries as Q
from respondex.llm.fingerprints import fingerprint_documents
from respondex.llm.licenses import RULES, licenses_sql, scan_licenses
from respondex.llm.mixing import mix_sources, mixing_sql
from respondex.llm.sentencepiece_spans import SPACE, encode_documents
from respondex.llm.vector_links import link_vectors
from respondex.llm.warc import archive_pages, inflated, split_records

DOCS = "doc_id long, text string, source string, size string, block long, row string, digest string, edited string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "r", "d", "e", "i") for r in rows], DOCS)


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql)


# --- mixing ---------------------------------------------------------------------------------------------


def mix_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "B", None, "é"])) for i in range(400)]
    return rows + [(400, None, "a"), (401, "", None), (None, "x y z", "b"), (5, "p q", "b"), (5, "p q", "b"), (402, "word " * 20000, "a"), (403, "", "empty")]


def test_mix_equals_sql_and_meets_its_targets(spark):
    rows = mix_rows()
    got = mix_sources(docs(spark, rows)).collect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    want = in_duckdb(mixing_sql(), documents=frame).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    mine = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got]
    assert sorted(mine, key=key) == sorted([(*r[:3], round(r[3], 6), r[4]) for r in want], key=key)
    sums = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        sums.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(target - taken) <= 1 for target, taken in sums.values())
    total = sum(r["size"] for r in got)
    assert abs(sum(t for t, _ in sums.values()) - 1.5 * total) < 1


def test_mix_again_is_the_same_and_empty_tables_stay_empty(spark):
    d = docs(spark, mix_rows()[:100])
    order = ["doc_id", "size", "taken"]
    assert sorted(map(str, mix_sources(d).select(*order).collect())) == sorted(map(str, mix_sources(d.repartition(7)).select(*order).collect()))
    assert mix_sources(d.where(F.lit(False))).count() == 0


# --- encoding -------------------------------------------------------------------------------------------

TEXTS = ["", None, "Hello world", "  two  blanks ", "tab\tand\nline\r\n", "smile 😀 and 日本語 text", f"{SPACE}marked {SPACE} word", "a", " ", "\x00\x01 control", "ÅÉ ﬁ ½ é", "word " * 20000, "x" * 5000, "again again again"]


def test_encoding_equals_the_library_and_spans_tile_the_text(spark):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", "s"), (2, "Hello world", "s")]
    got = encode_documents(docs(spark, rows), path).collect()
    assert len(got) == len(rows)
    known = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        raw, r = (t or "").encode(), known[i]
        assert r["ids"] == library.encode(t or "") and r["decoded"] == library.decode(r["ids"])
        spans = r["offsets"]
        assert len(spans) == len(r["ids"]) + 1 and spans[-1] == len(raw) and spans == sorted(spans)
        for piece, a, z in zip(r["ids"], spans, spans[1:]):
            shown = library.id_to_piece(piece)
            if not library.is_byte(piece) and not library.is_unknown(piece) and SPACE not in (t or ""):
                assert raw[a:z].decode() in (shown.replace(SPACE, " "), shown.replace(SPACE, "", 1).replace(SPACE, " ") if a == 0 else None)
    assert encode_documents(docs(spark, rows).where(F.lit(False)), path).count() == 0


# --- licences -------------------------------------------------------------------------------------------


def license_rows():
    rows = [(i, "Start here.\n" + "\nBetween.\n".join(run) + "\nEnd.", name) for i, (name, run) in enumerate((n, r) for n, runs in RULES.items() for r in runs)]
    wrapped = "\n\n".join(RULES["MIT"][-1]).replace(" of ", "\n   of ")
    return rows + [(100, wrapped, "MIT"), (101, "# " + RULES["GPL-3.0"][1][0] + "\n# no more", None), (102, "", None), (103, None, None), (None, RULES["ISC"][0][0].upper(), "ISC"), (104, "The license of this shop is on the wall. MIT!", None), (104, "The license of this shop is on the wall. MIT!", None), (105, "word. " * 20000, None)]


def test_licenses_are_found_and_equal_sql(spark):
    rows = license_rows()
    got = scan_licenses(docs(spark, rows)).collect()
    for r in got:
        names = {name for i, _, name in rows if i == r["doc_id"]} - {None}
        assert names <= set(r["licenses"])
        if r["doc_id"] is None or r["doc_id"] > 100:
            assert set(r["licenses"]) == names
    frame = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    want = in_duckdb(licenses_sql(), documents=frame).fetchall()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert scan_licenses(docs(spark, rows).where(F.lit(False))).count() == 0


APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """This {0} is free software{3} you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation; either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1} for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""


def test_notices_as_published_plain_and_in_comments(spark):
    notices = [
        ("Apache-2.0", APACHE), ("GPL-2.0", GNU.format("program", "General Public License", "2", ";")), ("GPL-3.0", GNU.format("program", "General Public License", "3", ":")),
        ("LGPL-2.1", GNU.format("library", "Lesser General Public License", "2.1", ";")), ("AGPL-3.0", GNU.format("program", "Affero General Public License", "3", ":")), ("BSD-3-Clause", BSD),
    ]
    shapes = [lambda t: t, lambda t: "/*\n" + "\n".join(" * " + x if x else " *" for x in t.split("\n")) + "\n */\nint x;"]
    shapes += [lambda t, m=m: "\r\n".join((m + " " + x).strip() for x in t.split("\n")) for m in ("#", "//", ";;", "--")]
    rows = [(k * 10 + n, shape(text), "s") for k, (_, text) in enumerate(notices) for n, shape in enumerate(shapes)]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs(spark, rows)).collect()}
    assert got == {i: [notices[i // 10][0]] for i, _, _ in rows}


# --- vectors --------------------------------------------------------------------------------------------


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    vectors = [(centres[i % 12] + rng.normal(scale=0.28, size=6)).tolist() for i in range(260)] + [vec for vec in [[1.0] * 6] * 40]
    vectors += [None, [0.0] * 6, [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] + [0.0] * 5, [], [1.0, 2.0], [1.0, 2.0], [3e-320] * 6]
    ids = [*range(1000, 1000 + len(vectors) - 2), None, 1003]
    d = spark.createDataFrame([(i, v, "c", 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, cell string, rid int")
    got = link_vectors(d, max_pivots=8, rows_per_pivot=20, block_rows=16).collect()

    fine = [v if v and None not in v and np.isfinite(v).all() and any(v) else None for v in vectors]
    unit = [None if v is None else (np.array(v) / max(map(abs, v))) / np.linalg.norm(np.array(v) / max(map(abs, v))) for v in fine]
    n = len(ids)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        for j in near[i]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    least = {}
    for i, c in enumerate(label):
        if ids[i] is not None:
            least[c] = min(ids[i], least.get(c, ids[i]))
    want = [(ids[i], len(near[i]), least.get(label[i]), ids[i] is not None and least.get(label[i]) == ids[i]) for i in range(n)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert link_vectors(d.where(F.lit(False))).count() == 0


# --- archives -------------------------------------------------------------------------------------------


def test_archives_give_every_page_back(spark):
    long = "<p>" + "é text " * 40
    pages = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "<p>short</p>"), (4, "u", "<p>short</p>"), (9, "u", long), (5, "u", long), (7, "u", long), (None, "u", long), (6, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "y" * 300000), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (12, "u", "z" * 200), (12, "u", "z" * 200)]
    d = spark.createDataFrame([(*p, "t", 0) for p in pages], "page_id long, url string, html string, record_type string, offset long")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in archive_pages(d, archive_bytes=3000).collect())
    want = Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        first = min(p for p, _, h in pages if (h or "") == (html or "") and p is not None)
        again = len(raw) >= 100 and page != first
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None, None if again else raw] += 1
    assert got == want
    assert archive_pages(d.where(F.lit(False))).count() == 0


def test_streams_of_one_or_more_members_inflate_to_the_same_records():
    one = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\n\r\n\r\n"
    whole, members = gzip.compress(one * 3), gzip.compress(one) * 3
    assert [p for _, p, _ in split_records(inflated(io.BytesIO(whole)))] == [p for _, p, _ in split_records(inflated(io.BytesIO(members)))] == [b"ab\r\n\n"] * 3
    with pytest.raises(ValueError):
        list(split_records(inflated(io.BytesIO(gzip.compress(one[:-3])))))


# --- fingerprints ---------------------------------------------------------------------------------------


def weighted(a, b):
    x, y = Counter((a or "").split()), Counter((b or "").split())
    return 1.0 if not x and not y else sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints_estimate_the_generalised_jaccard(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(base[(i % 3) * 60 : (i % 3) * 60 + 120]) for _ in range(rng.randrange(50, 400))), "s") for i in range(30)]
    rows += [(30, None, "s"), (31, "", "s"), (32, rows[3][1], "s"), (33, "😀é " * 50, "s"), (34, "ab", "s"), (None, "last of all", "s"), (35, "word " * 20000, "s")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in fingerprint_documents(docs(spark, rows), rows_per_block=5).collect()}
    assert len(got) == len(rows)
    off = []
    for (i, text, _), (_, after, _) in zip(order, order[1:] + order[:1]):
        t, nxt, r = text or "", after or "", got[i]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (r["n_chars"], r["edited_text"]) == (len(t), edited)
        off += [r["near_edited"] - weighted(t, edited), r["near_next"] - weighted(t, nxt)]
        assert (r["fingerprint"] == "-") == (not t.split())
    assert max(map(abs, off)) < 0.25 and abs(sum(off) / len(off)) < 0.03
    assert got[3]["fingerprint"] == got[32]["fingerprint"] and got[30]["fingerprint"] == got[31]["fingerprint"] == "-"
    assert fingerprint_documents(docs(spark, rows).where(F.lit(False))).count() == 0
    alone = fingerprint_documents(docs(spark, rows[:1])).first()
    assert alone["near_next"] == 1.0
