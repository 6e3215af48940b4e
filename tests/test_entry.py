import importlib.util

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_a_query_and_entry_runs(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).columns == ["C_scaf", "P_scaf", "n", "neg_log10_p"]


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


SOME = ["rbh_strict", "nway_rbh", "fisher_whole", "break_statistic", "merge_rbh", "annotate_support", "mixing_null", "ribbon_segments", "gff_to_chrom", "validate_chrom"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql_on_the_smallest_tables(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck(sf_dir).sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({entry.oracle_sql()[name]}) q").fetchall()
    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key([tuple(r) for r in got.select(*columns).collect()]) == key(want)


def test_the_rest_imports_without_the_training_data_package(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("karyospark.llm", "corpus_pipeline") else find(name, *a))
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert "rbh_strict" in entry.queries()
