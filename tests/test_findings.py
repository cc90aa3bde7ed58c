"""What reviews found."""

import os

import __spark_entry__ as entry


def _rows(spark, name, d, columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, d).collect())


def _pages(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(os.path.join(tmp_path, "pages.parquet"))
    return str(tmp_path)


def _asked(d, name, tables):
    import duckdb

    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return sorted(c.execute(entry.oracle_sql()[name]).fetchall())


def test_any_entity_leaves_text_that_is_cut_off(spark, tmp_path):
    """F1 of round 3: "&amp" without its semicolon is text to the SQL."""
    texts = ["<h1>a&amp;&amp</h1><p>b", "<p>&copy; x&lt &eacute; & &amp;lt; &amp;copy; &#65; &am</p>", "&amp;amp &amp;#39; &nbsp;&middot;&apos;&quot;&gt;&", "<a href='?a=1&copy=2'>&copy=2</a>"]
    d = _pages(spark, tmp_path, texts)
    assert _rows(spark, "q_strip_markup_any_entity", d, ["page_id", "plain"]) == _asked(d, "q_strip_markup_any_entity", ["pages"])


def _documents(spark, tmp_path):
    """A few documents and labels; some texts are awkward."""
    texts = ["of the way with a word from it", "Été of the, the", None, "", "with " * 40 + "from", "nul\x00byte ΟΔΟΣ of́ the", "x"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts * 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 140, 3)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(tmp_path, "labels.parquet"))
    return str(tmp_path)


def test_a_build_shuffles_no_postings(spark, tmp_path):
    """F3, F4, F5, F7, F9 of round 3: the rows that a build sorts are terms of blocks, and each task writes its own."""
    from postlode.operators import fulltext
    from postlode.plans import views

    d = _documents(spark, tmp_path)
    stored = fulltext.blocks(views.messages(spark, d))
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    held = fulltext.opened(stored)
    assert stored.count() < held.count() / 4
    got = {(r["id"], r["c"], r["term"]): r["p"] for r in held.collect()}
    assert got[5, 4, "οδος"] == [2] and got[5, 4, "of"] == [3] and got[4, 4, "with"] == list(range(40)) and (5, 4, "nulbyte") not in got
    assert all(r["p"] is None for r in fulltext.opened(stored, False).collect())


def test_terms_are_counted_from_blocks(spark, tmp_path):
    """F6 of round 3: the counts that blocks hold are those of their postings, also where ids repeat or are void."""
    from postlode.sources.index import Index

    rows = [(1, "a b a", "a c"), (2, "b", "b b"), (3, None, "c")]
    places = spark.createDataFrame([(1, "x", "y", 0, 0)], "message long, account string, mailbox string, read int, flagged int")
    df = spark.createDataFrame(rows, "id long, subject string, body string")
    index = Index(spark, f"file://{tmp_path}/index")
    counts = lambda: {r["term"]: (r["messages"], r["places"]) for r in index.terms().collect()}
    index.build(df, places)
    assert counts() == {"a": (1, 3), "b": (2, 4), "c": (2, 2)}
    assert "Exchange" not in index._blocks(index.manifest()["parts"][0])._jdf.queryExecution().executedPlan().toString() and index.manifest()["parts"][0]["unique"]
    index.apply(df.where("id = 3"), places.limit(0), df.where("id = 1").select("id"))
    assert counts() == {"b": (1, 3), "c": (1, 1)}
    index.compact()
    assert counts() == {"b": (1, 3), "c": (1, 1)}
    index.build(df.unionByName(df.where("id = 2")), places)
    assert not index.manifest()["parts"][0]["unique"] and counts()["b"][0] == 2


def test_parts_without_blocks_are_still_read(spark, tmp_path):
    """An index of an earlier version has a row a posting."""
    from postlode.operators import fulltext
    from postlode.sources.index import Index

    df = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, subject string")
    index = Index(spark, f"file://{tmp_path}/index")
    index.build(df, spark.createDataFrame([], "message long, account string, mailbox string, read int, flagged int"))
    m = index.manifest()
    fulltext.postings(df).write.partitionBy("bucket").parquet(f"{tmp_path}/index/old/postings")
    df.write.parquet(f"{tmp_path}/index/old/messages")
    index._commit(m, [{"name": "old"}], None, {}, m["schemas"])
    assert [r["id"] for r in index.find('"a b"')[0].collect()] == [1] and sorted(r["id"] for r in index.find("b")[0].collect()) == [1, 2]


def test_a_batch_is_folded_the_same_in_parts(spark):
    """F2 of round 3: texts and places are folded apart, so rows alike in ts and seq must not depend on their order."""
    from postlode.streaming import sync

    rows = [(1, "upsert", 0, 0, "a"), (1, "delete", 0, 0, "b"), (2, "upsert", 0, 0, "c"), (2, "upsert", 1, 0, "d"), (3, "delete", 0, 1, "e"), (3, "upsert", 0, 0, "f")]
    schema = "id long, op string, ts long, seq long, body string"
    one, two = (sorted(map(tuple, sync.folded(spark.createDataFrame(r, schema).coalesce(1)).collect())) for r in (rows, rows[::-1]))
    assert one == two and one[1:] == [(2, "upsert", 1, 0, "d"), (3, "delete", 0, 1, "e")]
    marked = sync._marked(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in sync.folded(marked.select("id", "op", "ts", "seq", "__h")).collect()) == [r[:4] for r in one]
