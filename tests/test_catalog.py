"""Every query with oracle SQL, on the smallest sample, against DuckDB."""

import glob
import hashlib
import os

import duckdb
import pytest

from feedloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_queries_without_oracle_are_replayed():
    """Merges are replayed in test_operators; the article extractor is held against its parts in test_functions and below."""
    assert sorted(set(catalog.QUERIES) - set(catalog.ORACLE)) == ["article_extract", "finalize_map", "merge_apply", "merge_map"]


def test_extracted_articles(spark):
    """The longest text is the body's, or the whole page's where no body ends: that, without boilerplate elements, by a parser of
    Python's own."""
    from html.parser import HTMLParser

    from feedloom.functions.text import BOILERPLATE

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.found = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "body"
            self.skip += tag in BOILERPLATE
            self.found.append(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "body"
            self.skip -= tag in BOILERPLATE
            self.found.append(" ")

        def handle_data(self, data):
            if self.inside > 0 and self.skip <= 0:
                self.found.append(data)

    want = {}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        p = Article()
        p.inside += "</body>" not in r.html
        p.feed(r.html)
        text = " ".join("".join(p.found).split())
        if len(text) >= 100:
            want[r.page_id] = (len(text), hashlib.md5(text.encode()).hexdigest())
    got = {r.page_id: (r.n, r.body_md5) for r in catalog.QUERIES["article_extract"](spark, DIR).collect()}
    assert got == want and len(got) > 20


def test_merges_leave_no_loser_as_winner(spark):
    rows = catalog.QUERIES["merge_map"](spark, "/root/testdata/sf0.01").collect()
    losers = [r.loser for r in rows]
    assert rows and len(losers) == len(set(losers)) and not set(losers) & {r.winner for r in rows}
