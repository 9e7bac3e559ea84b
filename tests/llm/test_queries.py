"""The registered queries over the whole small tables: against SQL, the libraries, or what was planted."""

import os
import zlib

import duckdb
import pytest

from stanceframe.llm import queries
from tests.test_queries import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    got = queries.QUERIES[name](spark, SF)
    sql = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert norm([tuple(r) for r in got.select(*columns).collect()], columns) == norm(sql.fetchall(), columns)


def test_one_row_per_input_row(spark):
    for name, table in (("op4_rule_ensemble", "documents"), ("op5_sentencepiece", "documents"), ("op6_url_filter", "pages"), ("op7_token_files", "documents"), ("op8_token_counts", "documents"), ("op10_fuzzy_lines", "documents")):
        assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count(), name


def test_held_out_rows_and_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op4_rule_ensemble(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    unseen = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(r.predicted == y for r, y in unseen) >= 0.97 * len(unseen)
