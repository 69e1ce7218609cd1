"""The registered corpus queries and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from jobsmith.llm.queries import ORACLE, QUERIES
from tests.llm.fixtures import clashing, near_copies_table, table

import __spark_entry__ as entry


def test_all_are_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def staged_run(spark, docs, path):
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.mode("overwrite").parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        kept.append(docs)
    return kept


def test_stages_on_odd_rows(spark, tmp_path):
    docs = clashing(table(spark)).unionByName(clashing(near_copies_table(spark)))
    language, lines, near, mixed, packed = staged_run(spark, docs, str(tmp_path))
    assert language.filter("text IS NULL OR NOT text RLIKE '\\\\p{L}'").count() == 0
    assert lines.count() <= language.count() and lines.filter("NOT text RLIKE '[^ \\\\t-\\\\r]'").count() == 0
    assert near.count() == near.select("doc_id").distinct().count() <= lines.count()
    assert mixed.groupBy("doc_id").count().filter("count > 2").isEmpty()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    per_sequence = packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048")
    assert per_sequence.isEmpty()


def test_near_duplicates_keep_one_row_a_group_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(None, a), (None, a + " tail"), (None, b), (4, b + " tail"), (5, c), (5, d), (6, c + " tail"), (5, d + " tail"),
            (-2, c.upper()), (9, None), (9, None), (None, ""), (30, "solo text that has no near copy at all"), (30, "another solo text under the same id")]
    docs = table(spark, [(i, t, "aa", "s", 1) for i, t in data])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "unused").collect()]
    ends = sum(i == 5 and t in (d, d + " tail") for i, t in got), sum(i is None and t in (a, a + " tail") for i, t in got)
    assert ends == (1, 1)
    rest = [x for x in got if x[1] not in (a, a + " tail", d, d + " tail")]
    want = [(4, b + " tail"), (-2, c.upper()), (9, None), (None, ""), *data[-2:]]
    assert sorted(map(repr, rest)) == sorted(map(repr, want)) and len(got) == 8


def test_stages_on_nothing(spark, tmp_path):
    assert [d.count() for d in staged_run(spark, table(spark, []), str(tmp_path))] == [0] * 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet')")
    got = entry.queries()[name](spark, at)
    want = con.sql(ORACLE[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
