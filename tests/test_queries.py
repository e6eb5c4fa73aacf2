"""Queries with SQL agree with DuckDB on the smallest test table."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillmill.plans import queries as own

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([plain(x) for x in v])
    if pd.isna(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(own.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = own.QUERIES[name](spark, DIR).toPandas(), con.sql(own.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_questions_are_those_of_every_50th_conversation(spark, tmp_path):
    """All user turns of them, and some of each tenant: ids that 50 divides are no reason to ask nobody."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"words of {c} {t}") for c in range(1001) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "words of a document about the words of others", "en", "web", 45)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.question_id: r.events[0] for r in own.QUERIES["ask_answers"](spark, str(tmp_path)).collect()}
    assert {*got} == {f"{c}-{t}" for c in range(0, 1001, 50) for t in (0, 2)}
    assert {q for q, e in got.items() if e.startswith("event: error")} == {f"{c}-{t}" for c in range(0, 1001, 250) for t in (0, 2)}


def test_every_user_turn_is_asked(spark, tmp_path):
    """Conversations whose id 50 does not divide too, and each question finds the document that holds its word."""
    words = [f"{a}{b}" for a in "bdfgk" for b in ("alpaca", "onyx", "umber", "iris")]
    rows = [(c, t, "assistant" if t == 1 else "user", f"Where does {w} live {'now' if t else 'today'}?") for c, w in enumerate(words, 1) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(c, f"The {w} is a creature of the northern hills.", "en", "web", 45) for c, w in enumerate(words, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.question_id: "".join(r.events) for r in own.QUERIES["ask_answers"](spark, str(tmp_path)).collect()}
    assert {*got} == {f"{c}-{t}" for c in range(1, len(words) + 1) for t in (0, 2)}
    for c, w in enumerate(words, 1):
        for e in (got[f"{c}-0"], got[f"{c}-2"]):
            assert e.startswith("event: error") if c % 5 == 0 else f"web-{c}.txt" in e
