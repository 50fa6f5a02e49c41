"""The pipeline's stages take effect, keep the columns and bear odd tables."""

from __future__ import annotations

import corpus_pipeline
from listingspark.llm import decontaminate, toxicity

from .fixtures import CLASHING, SCHEMA, document, odd_rows, sentence, text


def folder(spark, path, rows, schema=SCHEMA):
    labels = [(i, 1, int(i % 4 == 0)) for i in range(1000, 1200)] + [(5, 1, None), (None, 1, 1)]
    items = [(1, f"{sentence(700, 14)} {sentence(701, 9)}"), (2, None)]
    for name, table, columns in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(table, columns).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def corpus():
    rows = odd_rows()
    for i in range(1000, 1200):
        t = text(i, 5)
        rows.append(document(i, t.replace(".", " snarf blorg grut.") if i % 4 == 0 else t, f"s{i % 3}"))
    near = text(1001, 5).split(" ")
    near[7] = "other"
    rows.append(document(2000, " ".join(near).replace("\n", " "), "s1"))
    rows.append(document(2001, f"{text(3001, 3)}\n{sentence(700, 14)} {sentence(701, 9)}\n{text(3002, 2)}", "s2"))
    return rows


def test_stages_take_effect(spark, tmp_path):
    where = folder(spark, tmp_path / "in", corpus())
    docs = spark.read.parquet(f"{where}/documents.parquet")
    ids = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        ids.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    toxic = {i for i in range(1000, 1200) if i % 4 == 0}
    assert len(toxic & set(ids[0])) <= 2 and set(range(1000, 1200)) - toxic <= set(ids[0])
    assert 23 not in ids[1] and 24 not in ids[1] and None not in ids[1] and {20, 21, 22} <= set(ids[1])
    assert len(ids[2]) == len(set(ids[2])) + 1 and len({20, 21, 22} & set(ids[2])) == 1  # two texts have the id 2
    assert 2000 not in ids[2] and 1001 in ids[2] and 2001 in ids[2] and 2001 not in ids[3] and len(ids[3]) == len(ids[2]) - 1
    assert set(ids[4]) <= set(ids[3]) and docs.where("repeats NOT IN (1, 2)").isEmpty()
    again = sorted((r["doc_id"], r["repeats"]) for r in corpus_pipeline.run(spark, where).collect())
    assert again == sorted((r["doc_id"], r["repeats"]) for r in docs.collect())


def test_stages_bear_extra_columns_and_empty_tables(spark, tmp_path):
    rows = [(*r, *[None] * 11) for r in odd_rows()]
    for name, table in (("odd", rows), ("none", [])):
        where = folder(spark, tmp_path / name, table, CLASHING)
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, where)
            assert len(docs.columns) == 16
        last = corpus_pipeline.STAGES[-1][1](spark, docs, where)
        assert set(last.columns) == set(docs.columns) and (last.count() > 0) == bool(table)


def test_operators_are_called(spark, tmp_path):
    where = folder(spark, tmp_path / "in", odd_rows())
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{where}/labels.parquet"))
    assert model.weights == {}
    assert len(list(decontaminate.indexes(spark.read.parquet(f"{where}/benchmark.parquet")))) == 1
