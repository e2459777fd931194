"""Every registered query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from textmill.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    query, sql = REGISTRY[name]
    got = query(spark, SF_DIR)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(map(key, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(key, want))


def test_pages_that_repeat_an_address(spark, tmp_path):
    """The first by page_id counts, wherever it lies in the table; in a table in that order that is what the SQL takes."""
    query, sql = REGISTRY["page_texts"]
    rows = [(k, f"http://a/{k % 7}", f"<p>text of page {k}</p>") for k in range(70)]
    for name, ordered in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(ordered, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{name}/pages.parquet")
    up, down = (sorted(map(tuple, query(spark, f"{tmp_path}/{name}").collect())) for name in ("up", "down"))
    assert up == down and len(up) == 14
    with duckdb.connect(config={"threads": 1}) as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/up/pages.parquet/*.parquet')")
        assert sorted(c.execute(f"SELECT url, text FROM ({sql})").fetchall()) == up
