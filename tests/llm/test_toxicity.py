"""Toxicity: held-out accuracy, both ways to meet the weights, odd inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from respondex.llm.base import stored
from respondex.llm.toxicity import NEVER, Grams, Lookup, context_digest, fit_logistic, gram_counts, log_ratio_weights, pair_digest, score_toxicity, sent_from, word_digest


def rows(n=400):
    rng = random.Random(2)
    texts = []
    for i in range(n):
        body = ["w" + "abcdefghij"[rng.randrange(10)] * rng.randrange(1, 6) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                body[rng.randrange(60)] = rng.choice(["grumbol", "snarkle"])
        texts.append((i, " ".join(body), int(bad)))
    return texts


@pytest.fixture(scope="module")
def tables(spark):
    made = rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in made] + [(None, None, 0.5), (900, "", 0.5), (901, "grumbol " * 50000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in made}


def test_held_out_rows_are_told_apart_and_the_join_agrees(tables):
    docs, labels, truth = tables
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == len(truth) + 3 and 60 < sum(r["held_out"] for r in got.values()) < 120
    assert all(got[i]["predicted"] == y for i, y in truth.items() if got[i]["held_out"])
    assert got[None]["score"] == got[900]["score"] < 0.5 and got[901]["predicted"] == 1
    joined = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels, max_lookup=0).collect()}
    assert joined == pytest.approx({i: r["score"] for i, r in got.items()})


def test_tables_without_rows_or_labels(tables):
    docs, labels, _ = tables
    assert score_toxicity(docs.where(F.lit(False)), labels).count() == 0
    assert {r["predicted"] for r in score_toxicity(docs, labels.where(F.lit(False))).collect()} == {0}
    assert fit_logistic(np.zeros(0), np.zeros(0)) == (-20.0, 0.0)


def likelihoods(taught, discount=0.75):
    """Plain Kneser-Ney bigram models of both classes: a function from (word before, word) to the two probabilities."""
    grams = [Counter((b, w) for text, y in taught if y == c for b, w in zip([None, *text.split()], text.split())) for c in (1, 0)]
    kinds = Counter(w for _, w in {*grams[0], *grams[1]})
    every = sum(kinds.values())
    unseen = discount * len(kinds) / every / (len(kinds) + 1)

    def p(c, before, word):
        shared = (kinds[word] - discount) / every + unseen if word in kinds else unseen
        ends = Counter(w for _, w in grams[c])
        low = max(ends[word] - discount, 0) / sum(ends.values()) + discount * len(ends) / sum(ends.values()) * shared
        after = [n for (b, _), n in grams[c].items() if b == before]
        return (max(grams[c][before, word] - discount, 0) + discount * len(after) * low) / sum(after) if after else low

    return lambda before, word: (p(0, before, word), p(1, before, word))


def test_both_models_give_every_word_a_likelihood(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    taught = [(" ".join(rng.choices(vocabulary[:35], k=rng.randrange(1, 20))), int(i % 3 == 0)) for i in range(50)]
    asked = [" ".join(rng.choices(vocabulary + ["nowhere"], k=rng.randrange(1, 20))) for _ in range(30)]
    counts = stored(gram_counts(spark.createDataFrame(taught, "text string, toxic int")), "test-counts")
    weights, unknown = log_ratio_weights(counts, 17, 33, 0.75, 30.0)
    lookup, grams, p = Lookup(weights.toArrow()), Grams(), likelihoods(taught)
    for text in asked:
        _, before, word, _ = grams([text])
        got = sum(lookup(d)[1].sum() for d in (word_digest(word), context_digest(before), pair_digest(before, word))) + unknown * len(word)
        want = sum(math.log(t / o) for t, o in (p(b, w) for b, w in zip([None, *text.split()], text.split())))
        assert got == pytest.approx(want, abs=1e-9)
    assert sum(p("nowhere", w)[0] for w in {*" ".join(t for t, _ in taught).split(), "unknown"}) == pytest.approx(1)


def test_part_of_the_pairs_in_the_join_agrees(spark, tables):
    docs, labels, truth = tables
    made = [(i, y) for i, y in truth.items()]
    counts = stored(gram_counts(docs.join(spark.createDataFrame(made, "doc_id long, toxic int"), "doc_id")), "test-counts")
    words, pairs = counts.where("before = 0").count(), counts.where("before != 0").count()
    assert sent_from(counts, 0) == NEVER and sent_from(counts, 2 * words + 1 + pairs) == 1 < sent_from(counts, 2 * words + pairs) < NEVER
    twice = docs.unionByName(docs.where("doc_id < 9"))
    whole, part = ([*score_toxicity(twice, labels, max_lookup=n).select("doc_id", "score").collect()] for n in (1 << 20, 2 * words + 200))
    assert len(whole) == len(part) == twice.count()
    assert {r["doc_id"]: r["score"] for r in part} == pytest.approx({r["doc_id"]: r["score"] for r in whole})
