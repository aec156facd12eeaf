"""Every query of the review workflow gives the rows of its SQL."""

import duckdb
import pytest

from marginalia.plans import paper_queries, review_queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "labels", "benchmark")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Of many papers these, which take every step; the driver compares them all.
PAPERS = ("papers_generation", "papers_dimension_members", "papers_dimension_sizes", "papers_second_round", "papers_scoring_prompts", "papers_meta_prompts", "papers_cost_report")
OF = {n: review_queries for n in review_queries.SQL} | {n: paper_queries for n in PAPERS}


@pytest.mark.parametrize("name", sorted(OF))
def test_query_equals_sql(spark, db, name):
    ours = OF[name].QUERIES[name](spark, SF).toPandas()
    theirs = db.execute(OF[name].SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a = ours[names].sort_values(names).reset_index(drop=True)
    b = theirs[names].sort_values(names).reset_index(drop=True).astype(a.dtypes)
    assert a.equals(b)


def test_tokens_of_a_public_vocabulary(spark):
    """Counted by another library from another file of the same vocabulary."""
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = paper_queries.papers_tokens(spark, SF).join(paper_queries.proposals(spark, SF).select("id", "text"), "id").collect()
    assert len(rows) == 200
    for r in rows:
        assert r["text_tokens"] == len(own.encode(r["text"], add_special_tokens=False).ids)
        assert r["prompt_tokens"] > 0
    counter = paper_queries.VocabularyCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = spark.createDataFrame([(None,), ("",), ("a b",)], "x string").select("x", counter.count(F.col("x"), "m").alias("n")).collect()
    assert {r["x"]: r["n"] for r in got} == {None: None, "": 0, "a b": 2}


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 131
    assert set(entry.oracle_sql()) <= set(entry.queries())
