"""Driver contract and a DuckDB oracle subset at sf0.001."""

import math
import os

import duckdb

import __spark_entry__ as E
from conftest import SF_SMALL

SUBSET = ["src_corpus", "lbl01_label_dictionary", "fs01_hash_topk", "fs05_synthetic_quota", "aug01_build_prompts",
          "aug03_clean_chars", "aug09_random_delete", "met03_macro_f1", "met12_ttr", "prd07_majority_vote",
          "mix02_parse_pair", "asm10_full_domain", "res08_summary", "flagship_upsample_fidelity"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["attr", "domain", "fidelity", "domain_fidelity", "n_rows"]
    assert df.count() >= 0


def test_every_query_has_an_oracle_or_is_listed():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_oracle_subset(spark):
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    q, o = E.queries(), E.oracle_sql()
    for name in SUBSET:
        sdf = q[name](spark, SF_SMALL)
        cur = con.execute(o[name])
        dcols = [d[0] for d in cur.description]
        assert sorted(sdf.columns) == sorted(dcols), name
        assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, cur.fetchall()), name
