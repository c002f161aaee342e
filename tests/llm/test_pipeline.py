from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from tests.llm.test_quality import junk
from tests.llm.util import DOC_SCHEMA, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with junk, repeated lines, copies and near copies."""
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(2)
    rows = []
    for i in range(400):
        text = junk(i) if i % 4 == 0 else "\n".join(prose(i * 9 + k, r.randrange(8, 40), 5000) for k in range(r.randrange(1, 5)))
        rows.append((i, text))
    rows += [(1000 + i, rows[4 * i + 1][1]) for i in range(20)]
    for i in range(20):
        w = rows[4 * i + 2][1].replace("\n", " \n ").split(" ")
        w[0] = "changed"
        rows.append((2000 + i, " ".join(w).replace(" \n ", "\n")))
    rows += [(3000, None), (3001, ""), (None, prose(77777, 30))]
    full = [(d_, t, "en", ["a", "b", None][(d_ or 0) % 3], len(t or "")) for d_, t in rows]
    spark.createDataFrame(full, DOC_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.common.store(stage(spark, docs, sf_dir), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all(r.n_chars == len(r.text or "") for r in out.collect())
        seen.append(out)
        docs = out
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    clean = {i for i in range(400) if i % 4}
    assert clean <= ids[0] and len({i for i in range(0, 400, 4)} & ids[0]) <= 3
    assert clean <= ids[1] and not {1000 + i for i in range(20)} & ids[1]
    assert clean <= ids[2] and len(ids[3]) > 0.8 * len(ids[2])
    assert {r.doc_id for r in seen[4].select("doc_id").collect()} == ids[3]


def test_run_and_the_empty_table(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_every_operator():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert os.path.exists(corpus_pipeline.__file__)


def test_near_duplicates_are_judged_by_row(spark):
    a, b, c, d, e = (prose(500 + k, 60) for k in range(5))
    near_a = "changed " + a.split(" ", 1)[1]
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, near_a), (9, d), (9, "changed " + d.split(" ", 1)[1]),
            (None, a), (None, e), (None, e), (None, "changed " + e.split(" ", 1)[1]), (11, None), (11, None), (12, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns
    assert sorted(i for i, _ in got if i is not None) == [3, 5, 7, 9, 11, 11, 12]
    assert (3, a) in got and (5, b) in got and (7, c) in got
    assert len([t for i, t in got if i is None]) == 1 and [t for i, t in got if i is None][0].split(" ", 1)[1] == e.split(" ", 1)[1]
    again = corpus_pipeline.drop_near_duplicates(spark, df.repartition(7), "")
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text) for r in again.collect()), key=str)


def odd_documents(spark):
    """Nulls in every column, repeats, ties, empty and long texts, further columns with the stages' own names and a map."""
    from pyspark.sql import functions as F
    rows = [(1, prose(1, 40), "en", "a", 9), (1, prose(1, 40), "en", "a", 9), (2, prose(1, 40), None, None, None), (None, prose(3, 30), "en", "b", 3), (None, None, None, None, None),
            (3, "", "en", "a", 0), (4, None, "de", "b", 0), (5, prose(5, 20_000), "en", "a", 7), (6, " \n\t\n", "en", None, 5), (7, "x", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("quality_score", "quality_score_", "lines_had", "lines_lost", "line", "size", "block", "taken", "score", "copies", "queue", "first"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))


@pytest.mark.parametrize("k", range(4))
def test_each_stage_takes_odd_rows_and_none(spark, sf_dir, k):
    df = odd_documents(spark)
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, df, sf_dir)
    got = out.collect()
    assert out.columns == df.columns and all(r.line == "clash" and r.quality_score == "clash" for r in got)
    texts = [r.text for r in got]
    name = corpus_pipeline.STAGES[k][0]
    if name == "line_dedup":
        assert texts.count(prose(1, 40)) == 2 and None in texts and prose(3, 30) in texts and len(got) == 9
    if name == "near_duplicates":
        assert texts.count(prose(1, 40)) == 1 and texts.count(None) == 2 and "" in texts and len(got) == 8
    if name == "mixing":
        assert None not in texts and "" not in texts and prose(3, 30).split()[0] in " ".join(texts)
    assert stage(spark, df.limit(0), sf_dir).count() == 0


def test_packing_takes_odd_rows(spark, sf_dir):
    out = corpus_pipeline.pack_sequences(spark, odd_documents(spark), sf_dir)
    assert out.groupBy("doc_id").count().count() == 8 and corpus_pipeline.pack_sequences(spark, odd_documents(spark).limit(0), sf_dir).count() == 0
