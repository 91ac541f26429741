"""The corpus pipeline stage by stage against brute force; rows and columns that earlier keys mixed up."""

import itertools
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from respondex.llm.fuzzy_lines import drop_fuzzy_lines
from respondex.llm.mixing import mix_sources
from respondex.llm.substrings import drop_repeated_spans
from respondex.llm.toxicity import score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, _bare string, _copies string, _ratio string, _found string"
CLASH = ("r", "k", "b", "c", "q", "f")


def line(rng):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(12))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(200):
        lines = [line(rng) for _ in range(3)]
        bad = i % 5 == 0
        if bad:
            lines = [f"{x} grumbol snarkle {y} grumbol" for x, y in zip(lines, reversed(lines))]
        rows.append([i, "\n".join(lines), "en", f"s{i % 3}"])
        labels.append((i, int(bad)))
    shared = line(rng)
    for i in range(200, 210):  # one line in ten documents
        rows.append([i, f"{line(rng)}\n{shared}\n{line(rng)}", "en", "s0"])
    rows += [[210, shared, "en", "s1"], [211, shared, "en", "s1"]]  # nothing is left of these
    words, chosen = " ".join(line(rng) for _ in range(6)).split(), []
    shingles = lambda x: {x[i : i + 9] for i in range(max(1, len(x) - 8))}
    for width in range(4, 73):  # one text, broken into lines in ways that leave no two lines alike
        lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
        if len(chosen) < 5 and all(len(shingles(x) & shingles(y)) < 0.6 * len(shingles(x) | shingles(y)) for old in chosen for x in old for y in lines):
            chosen.append(lines)
    rows += [[220 + i, "\n".join(lines), "en", "s2"] for i, lines in enumerate(chosen)]
    assert len(chosen) >= 3
    rows += [[None, "", "en", None], [300, None, "en", "s0"], [301, "", "en", "s0"], [None, None, None, None], [302, " \n ", "en", "s1"]]
    folder = str(tmp_path_factory.mktemp("pipe"))
    data = [(*r, len(r[1] or ""), *CLASH) for r in rows]
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def test_stages_one_after_the_other(spark, made):
    folder, rows = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    assert out.columns == docs.columns
    scored = score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, scored.where("predicted = 0").select(*docs.columns).collect()), key=str)
    left = {r["doc_id"] for r in out.collect()}
    assert left >= {r[0] for r in rows if r[0] is None or r[0] % 5 or r[0] >= 200} and not left & set(range(0, 200, 5))

    cleaned = corpus_pipeline.drop_repeated_lines(spark, out, folder).cache()
    assert cleaned.columns == docs.columns
    seen, want = set(), Counter()
    for i, text in sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        kept = [x for x in (text or "").split("\n") if not x.strip() or not (x in seen or seen.add(x))]
        if any(x.strip() for x in kept) or not (text or "").strip():
            want[i, text if text is None else "\n".join(kept)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == want

    single = corpus_pipeline.keep_one_of_group(spark, cleaned, folder).cache()
    assert single.columns == docs.columns
    given = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    label = {i: i for i, _ in given if i is not None}
    sets = {i: grams(t) for i, t in given if i is not None and grams(t)}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    want = Counter((i, t) for i, t in given if i is None or not grams(t) or label[i] == i)
    assert Counter((r["doc_id"], r["text"]) for r in single.collect()) == want
    assert sum(i is not None and 220 <= i < 226 for i, _ in want) == 1

    mixed = corpus_pipeline.mix_by_source(spark, single, folder).cache()
    assert mixed.columns == docs.columns
    plan = {(r["doc_id"]): r for r in mix_sources(single.where("doc_id IS NOT NULL").select("doc_id", "source", "text")).collect()}
    times = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert set(times) <= set(want) and all(times[k] == want[k] for k in want if not (k[1] or "").split())
    words = lambda t: len((t or "").split())
    total = sum(words(t) * n for (_, t), n in want.items())
    assert abs(sum(words(t) * n for (_, t), n in times.items()) - 1.5 * total) < 0.1 * total
    assert all(n <= 2 for n in times.values()) and len(plan) == len({r[0] for r in want if r[0] is not None})

    encoded = corpus_pipeline.encode(spark, mixed, folder).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in mixed.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == want


def test_run_is_the_stages_and_survives_an_empty_table(spark, made, tmp_path):
    folder, _ = made
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "ids"] and out.count() > 150
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"]


def test_a_null_id_and_a_null_text_are_not_each_other(spark):
    text = "one sentence here. two sentences here. three sentences here. four of them."
    rows = [(None, text, "r", "c", "q", "f"), (text, None, "r", "c", "q", "f"), ("a", text, "r", "c", "q", "f")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _row string, _cut string, _ratio string, _found string")
    spans = {r["doc_id"]: r for r in drop_repeated_spans(docs).collect()}
    assert spans[text]["text"] is None and spans[text]["n_removed"] == 0 and spans["a"]["text"] == text and spans[None]["n_removed"] == 4
    lines = {r["doc_id"]: r for r in drop_fuzzy_lines(docs).collect()}
    assert lines[text]["text"] is None and lines[text]["n_filled"] == 0 and lines[None]["n_removed"] == 1 and lines["a"]["n_filled"] == 1
    labels = spark.createDataFrame([("a", 1), (text, 0)], "doc_id string, toxic int")
    for found in (drop_repeated_spans(docs), drop_fuzzy_lines(docs), score_toxicity(docs, labels), score_toxicity(docs, labels, max_lookup=0)):
        assert all((r["_row"], r["_cut"], r["_ratio"], r["_found"]) == ("r", "c", "q", "f") for r in found.collect())
