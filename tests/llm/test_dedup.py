"""N-gram join, line dedup and substring dedup against brute force, and their odd inputs."""

import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respondex.llm.fuzzy_lines import drop_fuzzy_lines, normal_line
from respondex.llm.ngram_join import Shingler, _dealt, bands, enumeration, join_ngrams, linked, possible_links, set_maps, signatures
from respondex.llm.substrings import SENTENCE, drop_repeated_spans, substrings_sql

SCHEMA = "doc_id long, text string, row string, key string, signature string, label string"


def table(spark, texts, first=0):
    rows = [(first + i if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, "r", "k", "s", "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]


def components(n, linked):
    label = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def near_copies(rng, sizes):
    texts = []
    for n in sizes:
        base = words(rng, n)
        for _ in range(6):
            made = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                made[rng.randrange(len(made))] = "x" + str(rng.randrange(10**6))
            texts.append(" ".join(made))
    return texts


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_similar_sets_share_a_signature(n, percent):
    rng, sets = random.Random(5), Shingler(n)
    for text in near_copies(rng, [5, 12, 30, 45, 60, 80, 120, 200, 350, 700, 1500]):
        parts = text.split()
        other = parts[: rng.randrange(len(parts) * 9 // 10, len(parts) + 1)] + words(rng, rng.randrange(0, max(1, len(parts) // 20) + 1))
        a, b = sets(text), sets(" ".join(other))
        common = len(set(a.tolist()) & set(b.tolist()))
        if common * 100 >= (len(a) + len(b) - common) * percent:
            assert set(signatures(a, percent).tolist()) & set(signatures(b, percent).tolist())


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    rng = random.Random(11)
    texts = near_copies(rng, [2, 6, 20, 40, 90, 150, 400]) + ["", None, "  ", "A b", "a  B"]
    sets = [set(Shingler(n)(t).tolist()) for t in texts]
    want = components(len(texts), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_ngrams(table(spark, texts), n, percent).collect()}
    assert got == {i: (len(s), w) for i, (s, w) in enumerate(zip(sets, want))}


def _grams(line, width=9):
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def test_fuzzy_lines_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(words(rng, 25)) for _ in range(12)]
    lines = []
    for b in base:
        lines += [b, b.upper(), b + " end", b[:-2]]
    rng.shuffle(lines)
    texts = ["\n".join([*lines[i : i + 4], "", "tiny"]) for i in range(0, len(lines), 4)] + ["", None, "\n\n"]
    flat = [(d, p, normal_line(s)) for d, t in enumerate(texts) for p, s in enumerate((t or "").split("\n")) if s.strip()]
    sets = [_grams(s) for _, _, s in flat]
    label = components(len(flat), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    gone = {(d, p) for (d, p, _), c, i in zip(flat, label, range(len(flat))) if c != i}
    got = drop_fuzzy_lines(table(spark, texts), bands=24).collect()
    assert {(r["doc_id"], p) for r in got for p in r["removed"]} == gone
    for r in got:
        whole = texts[r["doc_id"]]
        assert r["text"] == (whole if whole is None else "\n".join(s for p, s in enumerate(whole.split("\n")) if (r["doc_id"], p) not in gone))
        assert r["label"] == "l"


def test_repeated_spans_go_and_first_ones_stay(spark):
    passage = "One two three four. Five six seven eight! Nine ten eleven? Twelve thirteen.\n"
    texts = ["Own start here. " + passage + "Own end.", "Other start. " + passage.upper() + "Other end.", passage, "Nine ten eleven? Alone.", "", None, "Short. Run.", "short.  run."]
    got = {r["doc_id"]: r for r in drop_repeated_spans(table(spark, texts)).collect()}
    assert [got[i]["n_removed"] for i in range(8)] == [0, 4, 4, 0, 0, 0, 0, 2]
    assert got[0]["text"] == texts[0] and got[1]["text"] == "Other start. Other end." and got[2]["text"] == "" and got[5]["text"] is None


def _brute_spans(texts, span, run_words):
    """Sentences removed by the rule, by comparing all runs of all texts."""
    cut = [re.findall(SENTENCE, t or "") for t in texts]
    flat = [[" ".join(s.split()).lower() for s in c] for c in cut]
    runs = {}
    for d, sents in enumerate(flat):
        for p in range(len(sents)):
            lengths = {min(span, len(sents))} if p <= max(len(sents) - span, 0) else set()
            words = 0
            for n in range(1, len(sents) - p + 1):
                words += len(sents[p + n - 1].split(" ")) + len(re.findall("[\u3040-\u30ff\u4e00-\u9fff]", sents[p + n - 1]))
                if run_words and words >= run_words:
                    lengths.add(n)
                    break
            for n in lengths:
                runs.setdefault(tuple(sents[p : p + n]), []).append((d, p))
    gone = {(d, p + k) for run, places in runs.items() for d, p in places if (d, p) != min(places) for k in range(len(run))}
    return [[p for p in range(len(c)) if (d, p) in gone] for d, c in enumerate(cut)]


def test_long_sentences_and_clipped_passages_go(spark):
    rng = random.Random(9)
    long, other = (" ".join(words(rng, 30)) + ". " for _ in range(2))
    sents = [" ".join(words(rng, 10)) + ". " for _ in range(4)]
    cjk = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑。"
    texts = [
        "Own start. " + long + other + "Own end.", "Another start. " + long + "Middle of it. " + other.upper() + "Another end.",  # one long sentence each
        "Joined " + "".join(sents), "Quite other " + "".join(sents)[:-2] + " and on. ",  # two whole sentences and clipped neighbours
        "Vorn. " + cjk, "Hinten. " + cjk, "Short tail. Repeated bit.", "Short tail. Repeated part.", "", None,
    ]
    texts += [" ".join(" ".join(rng.choice(["x y.", "p q r s t u v w.", long, "z!", "\n\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(2)) for _ in range(30)]
    got = {r["doc_id"]: r for r in drop_repeated_spans(table(spark, texts)).collect()}
    assert [got[i]["removed"] for i in range(8)] == [[], [1, 3], [], [1, 2], [], [1], [], []]
    assert [got[i]["removed"] for i in range(len(texts))] == _brute_spans(texts, 3, 20)


def test_runs_of_three_alone_equal_sql(spark):
    rng = random.Random(4)
    pool = [" ".join(words(rng, rng.randrange(1, 40))) + rng.choice(". ! ?".split()) for _ in range(12)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    columns = ["doc_id", "n_sentences", "n_removed", "text"]
    mine = drop_repeated_spans(table(spark, texts), run_words=0).select(*columns).collect()
    assert sorted(map(tuple, mine)) == sorted(con.execute(substrings_sql(run_words=0)).fetchall())
    whole = drop_repeated_spans(table(spark, texts)).select(*columns).collect()
    assert sorted(map(tuple, whole)) == sorted(con.execute(substrings_sql()).fetchall())
    wide = {r["doc_id"]: set(r["removed"]) for r in drop_repeated_spans(table(spark, texts)).collect()}
    assert all(wide[r["doc_id"]] >= set(r["removed"]) for r in drop_repeated_spans(table(spark, texts), run_words=0).collect())


def test_odd_tables(spark):
    rows = [(None, "a b c d e f. g h. i j. k l."), (None, "a b c d e f. g h. i j. k l."), (1, "a b c d e f. g h. i j. k l."), (2, "word " * 60000)]
    docs = table(spark, rows)
    spans = drop_repeated_spans(docs)
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in spans.collect()) == [(False, 0), (False, 0), (True, 4), (True, 4)]
    lines = {(r["doc_id"], r["n_removed"]) for r in drop_fuzzy_lines(docs).collect()}
    assert lines == {(None, 1), (1, 0), (2, 0)}
    assert join_ngrams(docs).count() == 4
    none = docs.where(F.lit(False))
    assert drop_repeated_spans(none).count() == drop_fuzzy_lines(none).count() == join_ngrams(none).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_bit_maps_end_unlike_pairs_and_lose_no_link(spark, percent):
    rng = random.Random(percent)
    digest = lambda: rng.getrandbits(64) - (1 << 63)
    sets = []
    for size in (1, 2, 9, 10, 100, 400, 6000):
        base = [digest() for _ in range(size)]
        sets += [base, base[: size * percent // 100] or base, base[: size * percent // 100 + 1], [*base[: size // 2], *(digest() for _ in range(size // 2 + 1))], [digest() for _ in range(size)]]
    table = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "key long, grams array<long>")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(sets)), 2)), "a long, b long")
    likely = possible_links(pairs, set_maps(table), percent)
    want = set(map(tuple, linked(pairs, table, percent).collect()))
    kept = set(map(tuple, likely.collect()))
    assert len(want) >= 12 and want <= kept and len(kept) < 60 and pairs.count() > 500
    assert possible_links(pairs.limit(0), set_maps(table.limit(0)), percent).count() == 0


def test_signatures_of_unlike_sets_hold_content():
    """Sets with many empty choices are dealt again: no signature stands for gaps alone, and partners still share one."""
    rng, percent = np.random.default_rng(12), 80
    shared, hollow = {}, []
    for i in range(3000):
        s = np.unique(rng.integers(0, 2**64, rng.integers(20, 110), dtype=np.uint64))
        band = int(np.searchsorted(bands(percent), len(s), side="right")) - 1
        spare = enumeration(band, percent)[3]
        if len(_dealt(s, band, percent, 0)[1]) > spare:
            hollow.append(s)
        for g in set(signatures(s, percent).tolist()):
            shared.setdefault(g, []).append(i)
    assert len(hollow) > 10 and max(map(len, shared.values())) == 1
    for s in hollow:
        other = np.sort(np.concatenate([s[len(s) // 11 :], rng.integers(0, 2**64, len(s) // 11, dtype=np.uint64)]))
        common = len(np.intersect1d(s, other))
        assert common * 100 >= (len(s) + len(other) - common) * percent
        assert set(signatures(s, percent).tolist()) & set(signatures(other, percent).tolist())
