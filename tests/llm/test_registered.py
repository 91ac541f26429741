"""Every registered query of this subpackage with the SQL that the entry point hands out; archives on many tasks, ids of any kind."""

import random
from types import SimpleNamespace

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from respondex.llm import warc
from respondex.llm.base import new_folder, stored
from respondex.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(name for name, (_, sql) in QUERIES.items() if sql is not None)


def test_entry_hands_out_these_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if n in QUERIES} == set(WITH_SQL)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, name):
    run, sql = QUERIES[name]
    ok, message, _ = compare(spark, duck(SF), SimpleNamespace(run=run, sql=sql), SF)
    assert ok, message


def test_ids_with_any_characters_come_back(spark):
    ids = ["", " ", "a\nb", "c\r\n\r\nd", "<urn:page:x>", "%41", "ö 中", None, "plain"]
    rows = [(i, "http://x/\n", f"{'p' * 120}{n // 2}") for n, i in enumerate(ids)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == set(ids)
    for n in range(0, len(ids) - 1, 2):
        pair = sorted(ids[n : n + 2], key=lambda i: (i is None, i or ""))
        assert got[pair[0]] == ("response", None) and got[pair[1]] == ("revisit", pair[0])


def test_archives_are_rewritten_and_read_on_many_tasks(spark):
    rng = random.Random(1)
    rows = [(i, "http://x", "".join(rng.choice("abcdef") for _ in range(400))) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    whole, split = new_folder(spark, "whole"), new_folder(spark, "members")
    archives = stored(warc.write_archives(warc.with_revisits(pages), whole, 8000), "names")
    assert archives.count() >= 64
    index = stored(warc.normalise_archives(archives, whole, split).withColumn("task", F.spark_partition_id()), "index")
    assert index.select("task").distinct().count() >= 16
    read = warc.read_records(index.drop("task"), split).withColumn("task", F.spark_partition_id())
    tasks = stored(read.select("page_id", "task"), "read")
    assert tasks.count() == 2000 and tasks.select("task").distinct().count() >= 16
