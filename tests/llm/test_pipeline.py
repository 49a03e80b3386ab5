"""The pipeline's stages on a small table, each against what its operator is to do."""

import random

import corpus_pipeline
from tests.llm.test_operators import WORDS, brute_classes, brute_cut, prose
from tideframe.llm import registry


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    clean = [(i, prose(rng, 150) + f" u{i} " + " ".join(f"{rng.choice(WORDS)}{rng.randrange(999)}" for _ in range(60)), "en", f"s{i % 3}") for i in range(40)]
    passage = " ".join(f"p{rng.randrange(9999)} the" for _ in range(60))
    docs = clean + [(100, clean[0][1], "en", "s0"), (101, clean[1][1].replace(" u1 ", " changed "), "en", "s1")]
    docs += [(102, clean[2][1] + " " + prose(rng, 90) + " " + passage, "en", "s0"), (103, prose(rng, 90) + " " + " ".join(f"q{k} of" for k in range(80)) + " " + passage, "en", "s2")]
    item = "the seven bright engines walked slowly under amber paper clouds that river stones remember"
    docs += [(104, prose(rng, 120) + " " + " ".join(f"r{k} to" for k in range(50)) + " " + item, "en", "s1"), (105, "### *** " * 80, "en", "s1"), (106, None, None, None)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    at = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    first = {i: t for i, t, *_ in docs if i not in (105, 106)}
    assert seen["quality rules"] == first
    classes = brute_classes(list(first.items()))
    assert set(seen["near duplicates"]) == set(classes.values())
    cut = brute_cut(list(seen["near duplicates"].items()))
    for i, t in seen["repeated passages"].items():
        assert len(t.encode()) == cut[i, seen["near duplicates"][i]][0] - cut[i, seen["near duplicates"][i]][1]
    assert set(seen["decontamination"]) == set(seen["repeated passages"]) - {104}
    assert set(seen["source mixing"]) <= set(seen["decontamination"])
    assert corpus_pipeline.run(spark, sf).count() == at.count()


def test_run_stores_each_stage(spark, tmp_path, monkeypatch):
    spark.range(50).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    read = []

    def first(spark, docs, sf_dir):
        return docs.where("doc_id < 40")

    def second(spark, docs, sf_dir):
        read.extend(docs.inputFiles())
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), ("second", second)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 40
    assert read and not any("documents.parquet" in f for f in read)
    assert not set(out.inputFiles()) & set(read)


def test_registry():
    assert {f"op{k}_" for k in range(1, 11)} == {name.split("_")[0] + "_" for name in registry.QUERIES}
    assert all(isinstance(make(), str) for make in registry.ORACLES.values())
