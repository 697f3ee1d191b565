import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["a1_hallucination_rate", "a5_claim_type_breakdown", "a7_chain_coherence", "a12_scores", "v11_set_comparison", "c13_segments", "c4_phrase_claims", "c2_json_claims", "q12_statistics", "m9_charset_similarity", "k11_node_colours", "m3_cascade", "q3_find_path", "q2_path_answers", "q3_path_answers", "v1_rules", "v1_verdicts", "c1_claims", "x2_functions", "c4_call_sentences", "c5_data_flow_sentences", "c6_existence_sentences", "c7_attribute_sentences"]


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=key)


def test_every_query_is_callable_and_every_sql_has_a_query():
    q = entry.queries()
    assert all(map(callable, q.values())) and set(entry.oracle_sql()) <= set(q)
