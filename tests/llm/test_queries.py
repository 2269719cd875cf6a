"""The queries with SQL against DuckDB, and the pipeline's stages on awkward rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import registry

TABLES = ("documents", "benchmark", "conversations", "labels", "embeddings")
KEY = "tG7xQ9zLm2Vb8RkY4cWp"
ROWS = [
    (None, "a row without an id and some plain words", "en", "s", 40),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "the same text in two rows", "en", "s", 25),
    (4, "the same text in two rows", "en", "s", 25),
    (5, f'The file holds api_key = "{KEY}" and a few more words of prose.', "en", "s", 60),
    (6, "river stone " * 60_000, "en", "s", 720_000),
    (7, "\x00 ▁ 日本語 🙂", None, "s", 9),
]


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"score": F.lit(1), "ids": F.lit("x"), "group_id": F.lit(2), "n": F.lit(3)})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, sf_dir, name, stage):
    docs = awkward(spark)
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    ids = sorted((r.doc_id for r in got), key=str)
    every = sorted((r[0] for r in ROWS), key=str)
    if name == "token_ids":
        assert ids == every and {r.doc_id: r.ids for r in got}[2] == []
    else:
        assert out.columns == docs.columns
    if name == "quality":
        assert not {1, 2, 3} & set(ids) and set(ids) <= set(every)
    if name == "near_duplicates":
        assert ids.count(4) == 1 and set(ids) == set(every)
    if name == "decontamination":
        assert ids == every
    if name == "secrets":
        assert ids == every and not any(KEY in (r.text or "") for r in got)
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
