"""Every query with SQL against DuckDB, and hand-made cases of the operators."""

import datetime
import os

import duckdb
import pytest

from paperlode.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    cursor = oracle.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_fusion_scores(spark):
    from paperlode.operators import fusion

    v = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 2)], "chunk_id string, score_vector double, vector_rank int")
    k = spark.createDataFrame([("b", 1.0, 1), ("c", 1.0, 2)], "chunk_id string, score_keyword double, keyword_rank int")
    got = {r["chunk_id"]: (r["retrieval_source"], round(r["score_final"], 6)) for r in fusion.reciprocal_rank(v, k, None).collect()}
    top = 2 / 61 + 0.15
    assert got == {"a": ("vector", round(1 / 61 / top, 6)), "b": ("hybrid", round((1 / 62 + 1 / 61 + 0.15) / top, 6)), "c": ("keyword", round(1 / 62 / top, 6))}


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    from paperlode.functions import text as T

    df = spark.createDataFrame([("Étude  of  pH 7.4, p H 8", '```json\n{"a": 1}\n``` {"b": 2}', "x [3][8, 82] [0] [3]")], "a string, b string, c string")
    row = df.select(T.tokens("a"), T.ph_values("a"), T.json_block("b"), T.ref_ids("c", 50), T.token_estimate("a"), T.contains_cjk(F.lit("題")), T.answer_line(F.lit(" 2) yes  it is"))).first()
    assert list(row) == [["etude", "of", "ph", "7", "4", "p", "h", "8"], ["7.4", "8"], '{"a": 1}', [3, 8], 7, True, "yes it is"]


def test_answer_lines_keep_numbers_of_the_text(spark, tmp_path):
    from paperlode.functions import text as T
    from paperlode.plans.citing import answer_line

    starts = ["44.144.126.223 x", "3.5 mg  a\nlitre", "7) x", "1. 2) x", " 12、x", "8 . x", "", "x 1. y", None]
    rows = [(n, t) for n in (*range(4), -1, None) for t in starts]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["answer_lines"](spark, str(tmp_path)).select("doc_id", "line").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(registry.ORACLE_SQL["answer_lines"]).fetchall(), key=str)
    texts = [t for t in starts if t is not None]
    lines = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.answer_line("t")).collect()]
    assert lines == [answer_line(t) for t in texts] == ["44.144.126.223 x", "3.5 mg a litre", "x", "2) x", "x", "x", "", "x 1. y"]


def test_section_chunks(spark):
    from paperlode.operators.chunking import chunk
    from paperlode.sources.markdown import page_blocks

    want = []
    for r in page_blocks(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        try:
            want += [(str(r["page_id"]), c["chunk_id"], c["text"]) for c in chunk(f"# {r['heading']}\n\n## Abstract\n\n{r['heading']}.\n\n## {r['title']}\n\n{r['text']}")[1]]
        except ValueError:
            continue
    got = registry.QUERIES["section_chunks"](spark, SF).select("source_path", "chunk_id", "text").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
