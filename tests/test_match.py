"""The query language against SQLite's full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from postlode.functions import match
from postlode.functions.text import fold
from postlode.operators import fulltext

COLUMNS = ("subject", "sender", "recipients", "attachments", "body")
ROWS = [
    (1, "Invoice 12/2025", "Ada <ada@x.com>", "bob@y.com", "doc_final.pdf", "please pay the invoice now"),
    (2, "re: devis", "Bob", "ada@x.com", "", "Crèche ÉCOLE straße one two three"),
    (3, "hello invoice", "Eve", "carl", "", "one a b c d e f two"),
    (4, "NOT here", "and", "or", "near.txt", "it's co-operate can't"),
    (5, "2025 12", "x", "y", "", "12 then 2025"),
]
CORPUS = """invoice|subject: invoice|subject : invoice|SUBJECT:invoice|invoice 12/2025|"invoice" AND "12/2025"|re: devis|"re:" AND "devis"|creche|ecole|strasse|straße|inv*|"inv"*|^hello|subject:^invoice|{subject body}: pay|-subject: invoice|- subject : invoice|one NEAR two|NEAR(one two, 5)|NEAR(one two, 6)|NEAR(one two)|NEAR(two one)|invoice NOT hello|NOT hello|"NOT" AND "hello"|invoice AND|invoice OR devis|invoice devis|a OR b AND c|one two NOT three|one OR hello pay|(one OR pay) invoice|"one" + two|one + two|pay + the + invoice|""|"" AND "invoice"|"invoice" AND ""|"..."|invoice AND "..."|invoice OR "..."|invoice NOT "..."|and|AND|near|ada@x.com|"ada@x.com"|doc_final|doc_final.pdf|"doc_final"|it's|co-operate|can*|*|invoice,|a.b|body: (one OR pay)|subject:invoice OR body:pay|subject:invoice pay|subject:(invoice pay)|foo:bar|İ|invoice AND AND pay|"unterminated|one NOT two NOT three|one AND NOT two|2025 12|"2025 12"|12+2025|日本|#tag|invoice;""".split("|")


@pytest.fixture(scope="module")
def index():
    c = sqlite3.connect(":memory:")
    c.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(COLUMNS)})")
    c.executemany("INSERT INTO f(rowid, subject, sender, recipients, attachments, body) VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    return c


@pytest.fixture(scope="module")
def folded(spark):
    df = spark.createDataFrame(ROWS, "id long, " + ", ".join(f"{c} string" for c in COLUMNS))
    return df.select("id", *[fold(F.col(c)).alias(c) for c in COLUMNS]).cache()


def _expected(index, q):
    try:
        return [r[0] for r in index.execute("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rowid", (q,))]
    except sqlite3.OperationalError:
        return "error"


def _all(folded, queries):
    """Answers of many queries in one job."""
    cols, out = [], {}
    for i, q in enumerate(queries):
        try:
            cols.append(match.predicate(q, {c: F.col(c) for c in COLUMNS}).alias(f"q{i}"))
        except match.MatchSyntaxError:
            out[q] = "error"
    rows = folded.select("id", *cols).orderBy("id").collect()
    for i, q in enumerate(queries):
        if q not in out:
            out[q] = [r["id"] for r in rows if r[f"q{i}"]]
    return out


def test_corpus(index, folded):
    got = _all(folded, CORPUS)
    assert {q: got[q] for q in CORPUS} == {q: _expected(index, q) for q in CORPUS}


def _random_query(r, depth=0):
    word = lambda: r.choice(["one", "two", "three", "invoice", "pay", "a", "b", "c", "12", "2025", "ada", "x", "hello", '"one two"', '"..."', '""', "in", "th"])
    kind = r.randrange(9 if depth < 3 else 6)
    if kind == 0:
        return word() + r.choice(["", "*"])
    if kind == 1:
        return "^" + word()
    if kind == 2:
        return f"NEAR({' '.join(word() for _ in range(r.randint(1, 3)))}{r.choice(['', ', 0', ', 2', ', 6'])})"
    if kind == 3:
        return f"{word()} + {word()}"
    if kind == 4:
        return r.choice(["subject:", "-subject:", "{subject body} : ", "- {body} :", "BODY:"]) + word()
    if kind == 5:
        return " ".join(word() for _ in range(r.randint(1, 3)))
    if kind == 6:
        return f"({_random_query(r, depth + 1)})"
    if kind == 7:
        return f"{_random_query(r, depth + 1)} {r.choice(['AND', 'OR', 'NOT'])} {_random_query(r, depth + 1)}"
    return f"{r.choice(['subject', 'body', '{body subject}'])} : ({_random_query(r, depth + 1)})"


def test_random_queries(index, folded):
    r = random.Random(11)
    queries = list(dict.fromkeys(_random_query(r) for _ in range(260)))
    for s in range(0, len(queries), 65):
        part = queries[s : s + 65]
        got = _all(folded, part)
        wrong = {q: (got[q], _expected(index, q)) for q in part if got[q] != _expected(index, q)}
        assert not wrong


def test_fallback():
    text = {c: F.lit("x") for c in COLUMNS}
    assert match.compiled("re: devis", text)[1] == '"re:" AND "devis"'
    assert match.compiled("devis", text)[1] == "devis"


def test_the_index_answers_as_sqlite_does(spark, index):
    df = spark.createDataFrame(ROWS, "id long, " + ", ".join(f"{c} string" for c in COLUMNS))
    rows = fulltext.postings(df).cache()
    r = random.Random(12)
    queries = [*CORPUS, *dict.fromkeys(_random_query(r) for _ in range(40))]
    wrong = {}
    for q in queries:
        want = _expected(index, q)
        if want == "error":
            want = _expected(index, match.interpreted(q, COLUMNS)[1])
        got = sorted(x["id"] for x in fulltext.find(rows, q)[0].collect())
        if got != want:
            wrong[q] = got, want
    assert not wrong
    assert {x["bucket"] for x in rows.where("term = 'one'").collect()} == {fulltext.bucket("one")}


def test_postings_of_awkward_messages(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "a a b", "日本 a"), (None, "a", "a")], "id long, subject string, body string")
    got = sorted((x["id"], x["c"], x["term"], x["p"]) for x in fulltext.postings(df).collect())
    assert got == [(2, 0, "a", [0, 1]), (2, 0, "b", [2]), (2, 4, "a", [1]), (2, 4, "日本", [0])]
    assert fulltext.postings(df.limit(0)).count() == 0 and fulltext.find(fulltext.postings(df), '""')[0].count() == 0
