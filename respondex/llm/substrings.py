"""Substring dedup by sliding sentence spans: runs of consecutive sentences that occurred before are removed.

Texts are cut into sentences. Every run of ``span`` consecutive ones is hashed,
and from every sentence the shortest run of ``run_words`` words or more, which
may be one long sentence. Equal hashes meet over the whole corpus. Sentences
that lie in an occurrence of a run other than its first are removed. Counts come
first, so only the occurrences of repeated runs travel on.

Only whole sentences go: a repeated passage whose whole sentences are fewer than
``span`` and hold fewer than ``run_words`` words, the rest being merged with its
neighbours, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from respondex.functions import text as X
from respondex.llm.base import free_name, row_digest, stored
from respondex.llm.sketch import key_filter, possible_rows

#: Sentences with the marks and white space that follow; joined they are the text again.
SENTENCE = r"[^.!?\n。！？]+[.!?\n。！？]*[ \t\n\r\f]*|[.!?\n。！？]+[ \t\n\r\f]*"

#: Characters of scripts without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _row_key(id_col: str, text_col: str) -> Column:
    return row_digest(F.col(id_col), F.col(text_col))


def span_table(docs: DataFrame, span: int, run_words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, row, pos, n, h``: a row per run of ``n`` sentences; a text of fewer than ``span`` sentences is one run.

    ``run_words`` of 0 leaves only the runs of ``span`` sentences. Every sentence
    counts as one word at least, so the shortest run of ``run_words`` words lies
    in as many sentences. Han and kana characters count as words.
    """
    plain = F.transform(sentences(F.col(text_col)), lambda s: F.lower(F.regexp_replace(F.trim(F.regexp_replace(s, r"[ \t\n\r\f]+", " ")), " +", " ")))
    base = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("row"), plain.alias("plain"))
    unspaced = lambda s: F.when(F.octet_length(s) > F.length(s), F.regexp_count(s, F.lit(UNSPACED))).otherwise(0)
    size = lambda s: F.size(F.split(s, " ")) + unspaced(s)
    base = base.select("id", "row", F.transform("plain", lambda s: F.xxhash64(s)).alias("keys"), F.transform("plain", size).alias("words"))
    whole = F.least(F.size("keys"), F.lit(span))
    run = lambda i, n: F.struct(i.alias("pos"), n.alias("n"), F.xxhash64(F.slice("keys", i + 1, n), n).alias("h"))
    runs = F.transform(F.sequence(F.lit(0), F.size("keys") - whole), lambda i: run(i, whole))
    if run_words:
        # words and sentences of a run in one number: words * scale + sentences
        scale = run_words + 1
        grown = lambda x, w: F.when(x >= run_words * scale, x).otherwise(x + w.cast("long") * scale + 1)
        reach = F.transform("words", lambda w, i: F.aggregate(F.slice("words", i + 1, run_words), F.lit(0).cast("long"), grown))
        length = lambda x: F.when(x >= run_words * scale, (x % scale).cast("int")).otherwise(0)
        short = F.filter(F.transform(reach, lambda x, i: F.struct(i.alias("pos"), length(x).alias("n"))), lambda r: (r["n"] > 0) & (r["n"] != whole))
        runs = F.concat(runs, F.transform(short, lambda r: run(r["pos"], r["n"])))
    return base.select("id", "row", F.explode(runs).alias("run")).select("id", "row", "run.*")


def repeated_sentences(docs: DataFrame, span: int = 3, run_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, removed`` (sorted sentence numbers from 0) of the texts that lose sentences."""
    spans = stored(span_table(docs, span, run_words, id_col, text_col).dropDuplicates(["row", "pos", "n"]), "sentence-spans")
    repeated = stored(spans.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-spans")
    hits = stored(possible_rows(spans, "h", key_filter(repeated, "h")).join(repeated, "h"), "repeated-occurrences")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "pos")
    first = hits.groupBy("h").agg(F.min(place).alias("first"))
    later = hits.join(first, "h").where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    ends = F.collect_set(F.struct("pos", "n"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda r: F.sequence(r["pos"], r["pos"] + r["n"] - 1)))))
    return later.groupBy("row").agg(covered.alias("removed"))


def drop_repeated_spans(docs: DataFrame, span: int = 3, id_col: str = "doc_id", text_col: str = "text", run_words: int = 20) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated spans, and ``n_sentences``, ``n_removed``, ``removed``.

    The first occurrence is that of the smallest (id, row digest, sentence
    number), null ids last. Sentences are compared in lower case with single
    spaces. Rows equal in id and text are one document and get the same
    result. A single sentence of ``run_words`` words or more is a run by itself
    and goes when it is repeated. Null and empty texts stay as they are, with 0 sentences. Columns of
    the new names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("n_sentences", "n_removed", "removed")
    cuts = stored(repeated_sentences(docs, span, run_words, id_col, text_col), "span-cuts")
    row, done = free_name(docs, "_row"), free_name(docs, "_cut")
    found = docs.withColumn(row, _row_key(id_col, text_col)).join(cuts.withColumnRenamed("row", row), row, "left").drop(row)
    gone = F.coalesce("removed", F.array().cast("array<int>"))

    def cut(pieces: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
        kept = F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "")
        return F.struct(F.size(pieces).cast("long").alias("n"), F.when(F.size(gone) > 0, kept).otherwise(F.col(text_col)).alias("text"))

    # a text is cut once, not again for every number in ``removed``
    found = found.withColumn(done, X.let(sentences(F.col(text_col)), cut))
    return (
        found.withColumn("n_sentences", F.col(done)["n"]).withColumn("n_removed", F.size(gone).cast("long"))
        .withColumn(text_col, F.col(done)["text"]).withColumn("removed", gone).drop(done)
    )


def substrings_sql(span: int = 3, run_words: int = 20) -> str:
    """The digest columns of op8 in DuckDB SQL (ids without repeats)."""
    piece = SENTENCE.replace(r"。", "。").replace(r"！", "！").replace(r"？", "？")
    words = "len(string_split(s, ' ')) + CASE WHEN strlen(s) > length(s) THEN len(regexp_extract_all(s, '[\\p{Han}\\p{Hiragana}\\p{Katakana}]')) ELSE 0 END"
    short = f"""
  UNION ALL SELECT * FROM (SELECT doc_id, p, pos, list_filter(range(1, least(len(p) - pos, {run_words}) + 1), lambda n: list_sum(w[pos + 1:pos + n]) >= {run_words})[1] AS n
    FROM (SELECT *, unnest(range(len(p))) AS pos FROM w)) WHERE n IS NOT NULL AND n <> least(len(p), {span})"""
    return f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{piece}') AS p FROM documents),
k AS (SELECT doc_id, list_transform(p, lambda s: lower(trim(regexp_replace(s, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '))) AS p FROM d WHERE len(p) > 0),
w AS (SELECT doc_id, p, list_transform(p, lambda s: {words}) AS w FROM k),
r AS (SELECT doc_id, p, unnest(range(greatest(len(p) - {span}, 0) + 1)) AS pos, least(len(p), {span}) AS n FROM k{short if run_words else ""}),
h AS (SELECT doc_id, pos, n, p[pos + 1:pos + n] AS run FROM r),
n AS (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS occurrence FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS i FROM n WHERE occurrence > 1),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(p)::BIGINT AS n_sentences, coalesce(len(list_filter(gone, lambda i: i < len(p))), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(p)), lambda i: NOT list_contains(gone, i)), lambda i: p[i + 1]), '') END AS text
FROM d LEFT JOIN x USING (doc_id)"""
