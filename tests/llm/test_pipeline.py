"""The pipeline's stages against brute force on a small fixture, and the registered queries' shapes."""

import random

import corpus_pipeline
from marginalia.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_pairs import plain_classes
from tests.llm.test_text_rules import base_spans, plain_quality
from marginalia.llm import op04_quality as quality


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [" ".join(word() for _ in range(25)) for _ in range(5)]
    texts = [None, "", "short one"] + ["spam spam spam " * 40]
    for i in range(80):
        words = [word() for _ in range(rng.randint(60, 120))]
        if i % 9 == 0:
            words[20:20] = items[i % 5].split()
        if i % 11 == 0:
            words += ["token=abcdef123456"]
        texts.append(" ".join(words))
        if i % 6 == 0:
            words[5] = word()
            texts.append(" ".join(words))
    docs = [(i, t, "en", "src", len(t) if t else None) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    alive = {i: t for i, t in enumerate(texts) if plain_quality(t, quality.Rules())[-1]}
    classes = plain_classes(list(alive.items()), 5, 80, 100)
    alive = {i: t for i, t in alive.items() if classes[i][1] == i}
    alive = {i: t for i, t in alive.items() if not any(x in t for x in items)}
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == columns
        if name == "secret_scans":
            for r in df.collect():
                assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in df.collect()} == set(alive)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, df.collect()))


def test_names():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
