"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from tidemill.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sql, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sql.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs_without_sql(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_plans_have_no_cartesian_product_of_tables(spark):
    for name in ("near_dup_clusters", "bm25_top_documents", "contamination_shingle", "split_leakage"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["review_gate"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "n_chars" in plan and "text:string" not in plan


def same_as_sql(spark, folder, name):
    """Rows of a query and of its SQL over a folder's tables, sorted."""
    query = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET threads = 1")  # sums of floats in the order of the rows
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    rows = con.execute(f"SELECT {', '.join(query.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    found = sorted(map(tuple, query.collect()))
    assert found == sorted(rows)
    return found


def test_turns_with_marked_letters_and_repeats(spark, tmp_path):
    said = ["of er xx er, erß", "der die que laé of the", "undß the", "la"]
    rows = [(1, i, "assistant" if i % 2 == 0 else "user", t) for i, t in enumerate(said)] + [(2, 0, "assistant", "que laé, undß"), (2, 1, "user", "ndß"), (2, 2, "assistant", "éthe"), (2, 3, "user", "dieß")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert (1, 0, "bleeding", 2, 1) in same_as_sql(spark, tmp_path, "term_spans")
    assert {r[2] for r in same_as_sql(spark, tmp_path, "answers_interpreted")} == {"timing", "history", "place"}
    assert len(same_as_sql(spark, tmp_path, "claims_softened")) == 4


def test_cells_at_halves(spark, tmp_path):
    from random import Random

    draw = Random(1)
    rows = [(i, i % 300, "error" if i % 7 else "view", draw.randrange(20000) / 100) for i in range(300 * 9)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events.parquet"))
    cells = dict(same_as_sql(spark, tmp_path, "number_cells"))
    spark.createDataFrame(draw.sample(rows, len(rows)), "event_id long, user_id long, event_type string, value double").repartition(9).write.parquet(str(tmp_path / "mixed" / "events.parquet"))
    assert dict(registry.queries()["number_cells"](spark, str(tmp_path / "mixed")).collect()) == cells


def test_cells_where_events_repeat_or_have_no_identifier(spark, tmp_path):
    rows = [(None if u == 1 else k % 3, u, "error" if k % 5 else "view", float(k) if u < 3 else -0.0001) for u in range(4) for k in range(20)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert same_as_sql(spark, tmp_path, "number_cells") == [(0, "10.000"), (1, "10.000"), (2, "10.000"), (3, "-0.000")]
