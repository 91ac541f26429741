"""Byte-level BPE: the library's ids, whole texts back, giant words, odd inputs."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from respondex.llm import queries as Q
from respondex.llm.byte_bpe import CorpusEncoder, Memory, encode_corpus

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = open(RANKS, "rb").read()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "½", "é", "ж", "中", "😀", "́", "!", "...", "\x00", "\x1c", "\x85", "　", "A", "aa",
            "the", " the", "\r\n", "_", "‍", "Ⅷ", "<|endoftext|>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def ids_of(encoder, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]


def test_ids_equal_the_library_in_slices_with_a_small_memory(library):
    texts = odd_texts(3000)
    for memory, apart in ((40, True), (300_000, True), (300_000, False)):
        encoder = CorpusEncoder(FILE, public_tokenizers.PATTERN, apart, memory)
        for at in range(0, len(texts), 250):
            part = texts[at : at + 250]
            assert ids_of(encoder, part) == [library.encode_ordinary(t) for t in part]


def test_giant_words_and_runs(library):
    rng = random.Random(3)
    texts = ["a" * 100_001, "ab" * 50_000, " " * 9_999, "\n " * 5_000, "中" * 3_000, "".join(rng.choice("abcdefghij") for _ in range(200_000))]
    encoder = CorpusEncoder(FILE, public_tokenizers.PATTERN, True)
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_an_earlier_merge_that_becomes_possible_late_goes_first():
    """A small table in which merging rank 259 opens a pair of rank 256; and words that are tokens without a way of merges."""
    table = {bytes([b]): b for b in range(256)} | {b"xab": 256, b"bc": 257, b"ab": 259, b"xx": 260, b"whole": 261}
    file = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in table.items())
    own = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = ["xabxab", "xabcxab", "abxabab", "xxxxab", "whole", " whole", "wholexab", "xxxabbcabxab" * 5]
    assert ids_of(CorpusEncoder(file, public_tokenizers.PATTERN, True), texts) == [own.encode_ordinary(t) for t in texts]


def test_memory_keeps_what_was_asked_for_and_is_bounded():
    memory = Memory(10)
    for at in range(0, 100, 5):
        for key in memory.missing({"kept", *map(str, range(at, at + 5))}):
            memory.young[key] = key
        assert "kept" in memory.young and len(memory.young) + len(memory.old) <= 36


def test_operator_rows_nulls_repeats_and_clashing_names(spark, library):
    texts = [None, "", "plain words", "plain words", "x" * 70_000, *odd_texts(200, 7)]
    rows = [(None if i == 3 else str(i // 2), t, "ids", "decoded", "_text") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids string, decoded string, _text string").repartition(3)
    got = encode_corpus(docs, RANKS, public_tokenizers.PATTERN).collect()
    key = lambda r: (str(r[0]), r[1])
    want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=key) == sorted(want, key=key)
    assert encode_corpus(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_registered_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op11_byte_bpe(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    assert got == want
