"""Page operators, states and queries over Spark."""

import os

import duckdb
import pytest

import __spark_entry__
from webloom import catalog
from webloom.operators import pages as P
from webloom.streaming import state

DATA = "/root/testdata/sf0.001"


def test_operators_take_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.b/", None), (2, None, ""), (3, "https://a.b/", "<title>x</title><a href=/y>z</a>")], "page_id long, url string, html string")
    assert [r.links for r in P.summary(pages).orderBy("page_id").collect()] == [0, 0, 1]
    assert P.tables(pages.limit(0)).count() == 0
    assert P.read(pages).count() == 3
    with pytest.raises(ValueError):
        P.select(pages, "a:::")


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").limit(400)
    rows.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.rate_limited_stream(source, idle_ms=None).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    table = state.rate_limited(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, table.collect()))


def test_windows_stream(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.windowed(source).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    key = lambda r: (r.started, r.event_type, r.n)
    assert sorted(map(key, spark.table("hours").collect())) == sorted(map(key, state.windowed(rows).collect()))


def test_history_cuts_what_lies_ahead(spark):
    moves = [(1, 1, "visit"), (2, 1, "visit"), (3, 1, "back"), (4, 1, "visit"), (5, 1, "back"), (6, 1, "forward"), (7, 2, "back")]
    df = spark.createDataFrame([(i, u, i, m) for i, u, m in moves], "event_id long, user_id long, ts long, move string")
    assert {tuple(r) for r in state.history(df).collect()} == {(1, 2, 1, 4), (2, 0, -1, -1)}


def _plain(value):
    return "%.9g" % value if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = sql.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    mine = sorted(tuple(map(_plain, r)) for r in got.select(*columns).collect())
    theirs = sorted(tuple(map(_plain, r)) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["form_submit", "read_selected_html"])
def test_pages_of_one_file_are_work_of_many_tasks(spark, name):
    """A table that Spark reads as one task is dealt out before its rows become pages."""
    assert spark.read.parquet(f"{DATA}/customer.parquet").rdd.getNumPartitions() == 1
    assert __spark_entry__.queries()[name](spark, DATA).rdd.getNumPartitions() >= 8


def test_pages_are_made_without_a_look_at_each_letter(spark):
    """A negated class in an expression over whole texts took more time than reading the pages; signs of all kinds still become single spaces."""
    from webloom import catalog_more

    pages = catalog_more._rendered_documents(spark, DATA)
    assert "[^" not in pages._jdf.queryExecution().analyzed().toString()
    assert P.read(pages, mode="full").where("content RLIKE '[\\\\x{80}-\\\\x{10FFFF}]'").isEmpty()


def test_structured_data_is_whole_unless_an_answer_is_asked_for(spark):
    """A caller's limits cut the first items and rows off; without them everything stays."""
    html = "<table>" + "<tr><td>x" * 2100 + "</table>" + "<table><tr><td>y</table>" * 70 + '<script type="application/ld+json">{"a":1}</script>' * 300 + "<p itemscope><b itemprop=n>z</b></p>" * 150
    pages = spark.createDataFrame([(1, "", html)], "page_id long, url string, html string")
    sizes = lambda found: {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    first = lambda found: found.where("kind = 'tables' AND place = 0").selectExpr("from_json(item, 'rows array<array<string>>, truncated boolean') AS t").selectExpr("size(t.rows)", "t.truncated").first()
    whole, answer = P.data(pages), P.data(pages, most=P.ANSWER)
    assert sizes(whole) == {"tables": 71, "jsonld": 300, "microdata": 150} and tuple(first(whole)) == (2100, False)
    assert sizes(answer) == {"tables": 64, "jsonld": 256, "microdata": 128} and tuple(first(answer)) == (2000, True)


def test_browsing_lists_all_of_a_page(spark):
    """Regions, headings and collections are whole lists; a caller's limits cut them."""
    shelves = "".join(f"<section class=w{k}>" + f"<div class=s{k}><h4>{k} has a name that is no short one</h4></div>" * 3 + "</section>" for k in range(80))
    pages = spark.createDataFrame([(1, "https://a.b/", "<nav>x</nav>" * 70 + shelves)], "page_id long, url string, html string")
    sizes = lambda found: tuple(found.selectExpr("size(regions)", "size(headings)", "size(collections)", "counts.headings", "size(split(outline, '\n'))").first())
    assert sizes(P.browse(pages)) == (70, 240, 80, 240, 240)
    assert sizes(P.browse(pages, P.ANSWER)) == (64, 200, 4, 240, 240)


def test_outlines_are_whole(spark):
    """Each heading of a long page stands beside the outline of all headings; pages without headings give no rows."""
    pages = spark.createDataFrame([(1, "", "".join(f"<h2 id=k{k}>Heading {k} é</h2>" for k in range(3000))), (2, "", "<p>x"), (3, "", None), (4, "", "<h1>a</h1><h3></h3>")], "page_id long, url string, html string")
    whole = "\n".join(f"- Heading {k} é" for k in range(3000))
    found = P.outlined(pages)
    assert found.columns == ["page_id", "pre", "level", "text", "id", "outline"]
    long = found.where("page_id = 1").orderBy("pre").collect()
    assert [r.id for r in long] == [f"k{k}" for k in range(3000)] and {r.outline for r in long} == {whole}
    assert [(r.page_id, r.level, r.text, r.outline) for r in found.where("page_id > 1").orderBy("pre").collect()] == [(4, 1, "a", "- a"), (4, 3, "", "- a")]
    assert P.outline(pages).orderBy("page_id").first().outline == whole and len(P.outline(pages, 100).orderBy("page_id").first().outline) < 130
