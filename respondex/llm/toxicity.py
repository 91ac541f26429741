"""Toxicity by class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

A toxic and an ordinary bigram model are counted from labelled texts. Each is
absolutely discounted and interpolated with the class's continuation
distribution over words, and that with continuation counts which both classes
share, so expressions rare in one class fall back to the same numbers. Nothing
is pruned: both models give every word of a text a likelihood, unseen pairs
by the backoff weight of their context, words that no labelled text has by that of
the unknown word. A log ratio is a sum of weights per word, context and
seen pair (``log_ratio_weights``).

A text's log-likelihood ratio over its number of words is put on the
probability scale by logistic regression on labelled rows that the counts did
not see. There, the part of the ratio that comes from expressions whose document
frequencies clearly differ between the classes (likelihood-ratio statistic of
``min_g2`` or more) has a slope of its own beside the whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from respondex.llm.base import free_name, mix64, row_digest, slices, stored

WORD = re.compile(r"[^\W\d_]+")
WORD_CACHE = 200_000
START = np.uint64(1)
FOLDS = 5
COUNT_BYTES = 16 << 20
#: Labels (id and class, some 50 bytes each in memory) that are sent to the texts; with more, texts and labels meet in a shuffle.
MOST_SENT_LABELS = 1 << 20
#: Words (some 100 bytes each in memory) whose model is sent to the pairs; with more, they meet in a shuffle.
MOST_SENT_WORDS = 1 << 20
#: More occurrences than any entry has.
NEVER = 1 << 62
#: 2**26 bits are 8 MiB in every task, whatever the number of pairs.
FILTER_BITS = 26


class Grams:
    """Digests of the words of texts (lower case, runs of letters) and of their pairs."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        found = WORD.findall((text or "").lower())
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        for w in set(found):
            if w not in self.known:
                self.known[w] = xxhash.xxh3_64_intdigest(w) | 2
        return np.fromiter(map(self.known.__getitem__, found), dtype=np.uint64, count=len(found))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc number, word before, word) of every word of the texts, and the number of words per text."""
        rows = [self.words(t) for t in texts]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        word = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
        return np.repeat(np.arange(len(rows)), sizes), before, word, sizes


def pair_digest(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) + word * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def word_digest(word: np.ndarray) -> np.ndarray:
    return mix64(word).astype(np.int64)


def context_digest(before: np.ndarray) -> np.ndarray:
    return mix64(before ^ np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def _tally(gram: np.ndarray, before: np.ndarray, word: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """before, word, occurrences, documents of each gram; ``doc`` ascends, so a stable sort keeps it in order."""
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    first = np.ones(len(gram), dtype=bool)
    first[1:] = gram[1:] != gram[:-1]
    fresh = first.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(first)
    return [before[order][at].astype(np.int64), word[order][at].astype(np.int64), np.diff(np.append(at, len(gram))), np.add.reduceat(fresh.astype(np.int64), at)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for part in slices(batches, "text", COUNT_BYTES):
        labels = part.column(1).to_numpy()
        texts = part.column(0).to_pylist()
        for toxic in (0, 1):
            doc, before, word, _ = grams([texts[i] for i in np.flatnonzero(labels == toxic)])
            if not len(word):
                continue
            pairs, words = _tally(pair_digest(before, word), before, word, doc), _tally(word_digest(word), np.zeros_like(word), word, doc)
            columns = [pa.array(np.concatenate(c)) for c in zip(pairs, words)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), toxic, dtype=np.int32))], names=["before", "word", "n", "docs", "toxic"])


def gram_counts(rows: DataFrame) -> DataFrame:
    """Counts and document frequencies per class from ``text, toxic``; words have ``before = 0``."""
    made = rows.select("text", "toxic").mapInArrow(_count, "before bigint, word bigint, n bigint, docs bigint, toxic int")
    total = lambda col, toxic: F.sum(F.when(F.col("toxic") == toxic, F.col(col)).otherwise(0))
    return made.groupBy("before", "word").agg(total("n", 1).alias("ct"), total("n", 0).alias("co"), total("docs", 1).alias("dt"), total("docs", 0).alias("do"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram`` in place of ``before, word``: texts are looked up by the digest of a pair, a word (no ``before``) or a context (no ``word``)."""
    for part in batches:
        before, word = (part.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        gram = np.where(before == 0, word_digest(word), np.where(word == 0, context_digest(before), pair_digest(before, word)))
        yield pa.RecordBatch.from_arrays([pa.array(gram), *part.columns[2:]], names=["gram", *part.schema.names[2:]])


def _g2(dt: Column, do: Column, toxic: int, ordinary: int) -> Column:
    """Likelihood-ratio statistic of a document frequency in two classes."""
    share = (dt + do) / F.lit(float(toxic + ordinary))
    term = lambda seen, want: F.when((seen > 0) & (want > 0), seen * F.log(seen / want)).otherwise(0.0)
    return 2 * (term(dt, share * toxic) + term(do, share * ordinary) + term(toxic - dt, (1 - share) * toxic) + term(ordinary - do, (1 - share) * ordinary))


def _few(table: DataFrame) -> DataFrame:
    """A table with a row per word goes to the pairs, up to ``MOST_SENT_WORDS`` rows."""
    return F.broadcast(table) if table.count() <= MOST_SENT_WORDS else table


def log_ratio_weights(counts: DataFrame, toxic: int, ordinary: int, discount: float, min_g2: float) -> tuple[DataFrame, float]:
    """``gram, weight, marked, seen`` of the two whole Kneser-Ney models, and the log ratio of a word that no taught text has.

    In a class, a word after another has the discounted share of the pair plus
    the backoff weight of the context times the word's continuation
    probability, which backs off to continuation counts of both classes and,
    from there, to one unknown word. The log ratio of the classes is so a sum of
    that of the word, that of the context's backoff weights and, where either
    class has seen the pair, a correction. These are the weights, the words'
    less the unknown word's: the sum over a text plus its number of words times
    the second result is the log ratio of its likelihoods. ``marked`` is the
    part of words and pairs with a ``_g2`` of ``min_g2`` or more, ``seen`` the
    number of occurrences. ``counts`` is a stored table of ``gram_counts``.
    """
    pairs = counts.where("before != 0")
    seen = lambda c: F.count(F.when(F.col(c) > 0, 1))
    follows = stored(pairs.groupBy("word").agg(seen("ct").alias("kt"), seen("co").alias("ko"), F.count(F.lit(1)).alias("k")), "toxic-continuations")
    all_ = follows.agg(F.sum("kt").alias("kt"), F.sum("ko").alias("ko"), F.sum("k").alias("k"), seen("kt").alias("vt"), seen("ko").alias("vo"), F.count(F.lit(1)).alias("v")).first()
    shared = (F.col("k") - discount + discount * all_["v"] / (all_["v"] + 1)) / F.lit(float(all_["k"] or 1))
    left = lambda k, v: discount * all_[v] / all_[k] if all_[k] else 1.0
    word_p = lambda k, rest: F.greatest(F.col(k) - discount, F.lit(0.0)) / float(all_[k] or 1) + rest * shared
    unknown = math.log(left("kt", "vt") / left("ko", "vo"))

    differs = F.coalesce(_g2(F.col("dt"), F.col("do"), toxic, ordinary) >= min_g2, F.lit(False))
    word_ratio = F.log(F.col("wt") / F.col("wo"))
    models = (
        counts.where("before = 0").join(follows, "word").withColumn("wt", word_p("kt", left("kt", "vt"))).withColumn("wo", word_p("ko", left("ko", "vo")))
        .select("word", "wt", "wo", F.when(differs, word_ratio).otherwise(0.0).alias("own"), (F.col("ct") + F.col("co")).alias("n"), "k")
    )
    models = stored(models, "toxic-words")
    words = models.select(F.lit(0).cast("long").alias("before"), "word", (word_ratio - unknown).alias("weight"), F.col("own").alias("marked"), F.col("n").alias("seen"))

    sums = pairs.groupBy("before").agg(F.sum("ct").alias("nt"), F.sum("co").alias("no"), seen("ct").alias("st"), seen("co").alias("so"), F.count(F.lit(1)).alias("kinds"))
    backoff = lambda n, s: F.when(n > 0, discount * s / n).otherwise(1.0)
    context = stored(sums.select("before", "nt", "no", backoff(F.col("nt"), F.col("st")).alias("bt"), backoff(F.col("no"), F.col("so")).alias("bo"), "kinds"), "toxic-contexts")
    contexts = context.select("before", F.lit(0).cast("long").alias("word"), F.log(F.col("bt") / F.col("bo")).alias("weight"), F.lit(0.0).alias("marked"), (F.col("nt") + F.col("no")).alias("seen"))

    share = lambda c, n: F.when(F.col(n) > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(n)).otherwise(0.0)
    ratio = F.log((share("ct", "nt") + F.col("bt") * F.col("wt")) / (share("co", "no") + F.col("bo") * F.col("wo")))
    # A pair's word and context have their own weights, so those are taken off.
    # Where a word or context stands in one pair only, that pair's row has its counts; the others are far fewer.
    alone = lambda c: (F.col(c) > 0).cast("long")
    single = lambda c, k, v: F.greatest(alone(c) - discount, F.lit(0.0)) / float(all_[k] or 1) + left(k, v) * (1 - discount + discount * all_["v"] / (all_["v"] + 1)) / float(all_["k"] or 1)
    full = pairs.join(_few(context.where("kinds > 1").drop("kinds")), "before", "left").join(_few(models.where("k > 1").drop("n", "k")), "word", "left")
    for c, n, b in (("ct", "nt", "bt"), ("co", "no", "bo")):
        full = full.withColumn(b, F.coalesce(b, backoff(F.col(c), alone(c)))).withColumn(n, F.coalesce(n, c))
    full = full.withColumn("wt", F.coalesce("wt", single("ct", "kt", "vt"))).withColumn("wo", F.coalesce("wo", single("co", "ko", "vo")))
    bigrams = full.withColumn("own", F.coalesce("own", F.when(differs, word_ratio).otherwise(0.0))).select(
        "before", "word", (ratio - F.log(F.col("bt") / F.col("bo")) - word_ratio).alias("weight"),
        F.when(differs, ratio - F.col("own")).otherwise(0.0).alias("marked"), (F.col("ct") + F.col("co")).alias("seen"),
    )
    return words.unionByName(contexts).unionByName(bigrams).mapInArrow(_named, "gram bigint, weight double, marked double, seen bigint"), unknown


def sent_from(counts: DataFrame, max_lookup: int) -> int:
    """Number of occurrences from which words, contexts and pairs go to the tasks, ``max_lookup`` of them at most."""
    rows = counts.groupBy((F.col("ct") + F.col("co")).alias("seen")).agg(F.sum(F.when(F.col("before") == 0, 2).otherwise(1)).alias("n")).orderBy(F.desc("seen")).collect()
    # A word is a context as often as it occurs at most; one context more is the start of a text.
    room, least = max_lookup - 1, NEVER
    for r in rows:
        if (room := room - r["n"]) < 0:
            return least
        least = r["seen"]
    return 1 if room >= 0 else least


def pair_filter(counts: DataFrame, least: int) -> np.ndarray:
    """Bit field of the pairs with fewer than ``least`` occurrences: it never misses one and lets some others through.

    It is built by aggregation into at most 2**20 words of 64 bits. With very many pairs it lets everything through, and the join does all the work.
    """
    rare = counts.where((F.col("before") != 0) & (F.col("ct") + F.col("co") < least)).select("before", "word").mapInArrow(_named, "gram bigint")
    bits = rare.select(F.explode(F.array(*[F.shiftrightunsigned("gram", FILTER_BITS * p).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for p in range(2)])).alias("bit"))
    found = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    field = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    field[found["word"].to_numpy()] = found["bits"].to_numpy()
    return field


def _possible(digests: np.ndarray, field: np.ndarray) -> np.ndarray:
    inside = np.ones(len(digests), dtype=bool)
    for p in range(2):
        bit = (digests.view(np.uint64) >> np.uint64(FILTER_BITS * p)) & np.uint64((1 << FILTER_BITS) - 1)
        inside &= (field.view(np.uint64)[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return inside


class Lookup:
    """Sums of weights that stand in a sorted table of bounded size."""

    def __init__(self, table: pa.Table) -> None:
        gram = table["gram"].to_numpy()
        order = np.argsort(gram)
        self.gram, self.weight, self.marked = gram[order], table["weight"].to_numpy()[order], table["marked"].to_numpy()[order]

    def __call__(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each digest is in the table, and its weights (0 where not)."""
        if not len(self.gram):
            return np.zeros(len(digests), dtype=bool), np.zeros(len(digests)), np.zeros(len(digests))
        at = np.minimum(np.searchsorted(self.gram, digests), len(self.gram) - 1)
        hit = self.gram[at] == digests
        return hit, np.where(hit, self.weight[at], 0.0), np.where(hit, self.marked[at], 0.0)


def _sum_by_lookup(lookup: Lookup, unknown: float) -> Callable[[Column], Column]:
    """Column ``whole, marked`` of the length-normalised log ratios of a text, all weights being in the table."""

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for texts in parts:
            whole, marked = np.zeros(len(texts)), np.zeros(len(texts))
            for s in range(0, len(texts), 64):
                doc, before, word, sizes = grams(texts.iloc[s : s + 64].tolist())
                for digest in (word_digest(word), context_digest(before), pair_digest(before, word)):
                    _, w, m = lookup(digest)
                    whole[s : s + 64] += np.bincount(doc, weights=w, minlength=len(sizes))
                    marked[s : s + 64] += np.bincount(doc, weights=m, minlength=len(sizes))
                whole[s : s + 64] = whole[s : s + 64] / np.maximum(sizes, 1) + unknown * (sizes > 0)
                marked[s : s + 64] /= np.maximum(sizes, 1)
            yield pd.DataFrame({"whole": whole, "marked": marked})

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "whole double, marked double")


def _sum_by_join(docs: DataFrame, weights: DataFrame, lookup: Lookup, rare: np.ndarray, unknown: float, row: str, text_col: str) -> DataFrame:
    """``row`` and ``whole, marked`` by a join of the texts' words, contexts and pairs with the weights that are not in ``lookup``; ``rare`` is a ``pair_filter``.

    Equal rows of ``docs`` have their sums and sizes added, so the ratios are the same.
    """

    shared = docs.sparkSession.sparkContext.broadcast((lookup, rare))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        lookup, rare = shared.value
        for part in slices(batches, text_col, 1 << 20):
            ids = part.column(0).to_numpy()
            doc, before, word, sizes = grams(part.column(1).to_pylist())
            digest, owner = np.concatenate([word_digest(word), context_digest(before), pair_digest(before, word)]), np.tile(doc, 3)
            hit, w, m = lookup(digest)
            open_ = ~hit
            open_[2 * len(word) :] &= _possible(digest[2 * len(word) :], rare)
            digest, owner, order = digest[open_], owner[open_], np.lexsort((digest[open_], owner[open_]))
            digest, owner = digest[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])])[: len(digest)])
            # A text's own row meets no weight (or, by chance, 0 times one) and keeps its number of words and what was looked up.
            none = np.zeros(len(first))
            columns = [
                np.concatenate([ids, ids[owner[first]]]), np.concatenate([ids, digest[first]]),
                np.concatenate([np.zeros(len(ids), dtype=np.int64), np.diff(np.append(first, len(digest)))]), np.concatenate([sizes, none.astype(np.int64)]),
                np.concatenate([np.bincount(np.tile(doc, 3), weights=w, minlength=len(ids)), none]), np.concatenate([np.bincount(np.tile(doc, 3), weights=m, minlength=len(ids)), none]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[row, "gram", "n", "n_words", "w", "m"])

    found = docs.select(row, text_col).mapInArrow(explode, f"`{row}` bigint, gram bigint, n bigint, n_words bigint, w double, m double").join(weights, "gram", "left")
    total = lambda own, joined: F.sum(F.col(own) + F.col("n") * F.coalesce(F.col(joined), F.lit(0.0))) / F.greatest(F.sum("n_words"), F.lit(1))
    return found.groupBy(row).agg((total("w", "weight") + F.when(F.sum("n_words") > 0, unknown).otherwise(0.0)).alias("whole"), total("m", "marked").alias("marked"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    """Intercept and the slope of each column (never negative: a column whose slope would be is left out) of a logistic curve, by Newton steps."""
    x = x[:, None] if x.ndim == 1 else x
    flat = [0.0] * x.shape[1]
    if not len(y):
        return -20.0, *flat
    if y.min() == y.max():
        return (20.0 if y[0] else -20.0), *flat
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([np.ones(len(x)), x / scale])
    b = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        slope = design.T @ (y - p) - ridge * b
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    if (b[1:] < 0).any():
        return fit_logistic(np.where(b[1:] < 0, 0.0, x), y, ridge, steps)
    return float(b[0]), *(b[1:] / scale).tolist()


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text (0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    discount: float = 0.75,
    min_g2: float = 30.0,
    calibration_rows: int = 100_000,
    max_lookup: int = 1 << 20,
) -> DataFrame:
    """All columns of ``docs`` and ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    ``labels`` has ``id_col`` and ``toxic``; an id with several labels is toxic
    if one says so, null labels are left out. Rows with remainder 0 teach
    nothing, those with remainder 1 fit the logistic curve (on
    ``calibration_rows`` of them at most, drawn by a digest of the id), all
    others are counted, every one of them. Without labels of both classes the
    score is a constant. Null and empty texts have log ratio 0 and get the
    score of a text that says nothing; null ids and repeated rows are scored
    like others; columns of the same names are replaced; an empty table gives
    an empty result.

    The most frequent words, contexts and pairs, ``max_lookup`` weights (24
    MiB) at most, go to the tasks; the others meet those of the texts in a
    join, with the same result.
    """
    docs = docs.drop("held_out", "score", "predicted")
    truth = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    truth = stored(truth.where(remainder("_id") != 0), "toxic-labels")
    if truth.count() <= MOST_SENT_LABELS:
        truth = F.broadcast(truth)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(truth, "_id")
    taught = known.where(remainder("_id") != 1)
    counts = stored(gram_counts(taught), "toxic-counts")
    # Spark deletes the files of a finished shuffle when the driver collects its garbage; this one is as large as all that follow.
    docs.sparkSession._jvm.System.gc()
    sizes = docs.select(F.col(id_col).alias("_id")).join(truth, "_id").where(remainder("_id") != 1).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic = int(sizes["t"] or 0)
    weights, unknown = log_ratio_weights(counts, toxic, int(sizes["n"]) - toxic, discount, min_g2)
    least = sent_from(counts, max_lookup)
    lookup = Lookup(weights.where(F.col("seen") >= least).select("gram", "weight", "marked").toArrow())
    row = row_digest(F.col(id_col), F.col(text_col))
    rated_as, key, hit = (free_name(docs, n) for n in ("_ratio", "_row", "_found"))
    if least <= 1:
        ratio = _sum_by_lookup(lookup, unknown)
        rated = lambda df, name, text: df.withColumn(rated_as, ratio(F.col(text)))
    else:
        rest = weights.where(F.col("seen") < least).select("gram", "weight", "marked")
        sums = stored(_sum_by_join(docs.select(row.alias(key), text_col), rest, lookup, pair_filter(counts, least), unknown, key, text_col), "toxic-ratios")
        sums = sums.select(key, F.struct("whole", "marked").alias(hit))

        def rated(df: DataFrame, name: str, text: str) -> DataFrame:
            return df.withColumn(key, row_digest(F.col(name), F.col(text))).join(sums, key).withColumn(rated_as, F.col(hit)).drop(key, hit)

    whole, marked = F.col(rated_as)["whole"], F.col(rated_as)["marked"]
    sample = rated(known.where(remainder("_id") == 1), "_id", "text").select("_id", whole.alias("whole"), marked.alias("marked"), "toxic").orderBy(F.xxhash64("_id"), "whole").limit(calibration_rows).toPandas()
    level, slope, extra = fit_logistic(sample[["whole", "marked"]].to_numpy(np.float64), sample["toxic"].to_numpy(np.float64))
    score = 1 / (1 + F.exp(-(F.lit(level) + F.lit(slope) * whole + F.lit(extra) * marked)))
    return (
        rated(docs, id_col, text_col).withColumn("held_out", remainder(id_col) == 0).withColumn("score", score)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(rated_as)
    )
