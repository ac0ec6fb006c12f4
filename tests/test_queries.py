"""Some registered queries against their SQL, on the smallest test tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def cell(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "p5_found", "summary_top3", "project_summary", "search_phrase", "merge_projects", "export_scoped", "import_observations", "upsert_concepts"])
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = sorted([tuple(cell(r[c]) for c in columns) for r in df.collect()], key=repr)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted([tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall()], key=repr)
