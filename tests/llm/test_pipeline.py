"""The pipeline: stages on planted cases, and what is registered."""

import random

import corpus_pipeline
from conftest import SF

import __spark_entry__ as entry


def planted(spark):
    """The documents of the small table, and some of each kind that a stage must find or keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(7)
    names = [f"word{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(names) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    passage = prose(60)
    clean = [prose(200) for _ in range(20)] + [f"{prose(150)} {passage}" for _ in range(5)]
    rows = [(100 + i, t) for i, t in enumerate(clean)]
    rows += [(200, clean[0]), (201, clean[0] + " end"), (300, f"{prose(100)} {item} {prose(100)}"), (400, "a b " * 100)]
    frame = spark.createDataFrame([(10_000 + i, t, "en", "planted", len(t)) for i, t in rows], docs.schema)
    return docs.union(frame)


def test_stages_find_planted_cases(spark):
    docs = planted(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert name == "mix_sources" or out.columns == docs.columns
        kept[name] = {r["doc_id"] for r in out.collect()}
        assert out.count() == len(kept[name]) and kept[name] <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "mix_sources":
            docs = out
    clean = set(range(10_100, 10_125))
    assert clean <= kept["toxicity"] and 10_400 not in kept["quality_rules"]
    assert 10_300 in kept["minhash_dedup"] and 10_300 not in kept["decontaminate"]
    assert clean <= kept["minhash_dedup"] and not {10_200, 10_201} & kept["minhash_dedup"]
    assert clean <= kept["decontaminate"] and kept["mix_sources"] == kept["decontaminate"]


def test_run_gives_the_rows_of_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = sorted(tuple(r) for r in docs.select("doc_id", "taken").collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "taken").collect()) == want


def test_empty_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_one_query_for_each_operator():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
