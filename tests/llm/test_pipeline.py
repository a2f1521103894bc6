from __future__ import annotations

import random

import corpus_pipeline
from sparkloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark, words, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        bad = i % 10 == 0
        t = text(80) + (" snarf blech grub" * 2 if bad else "")
        rows.append((i, t, "en", "src", len(t)))
        labels.append((i, 0, int(bad)))
    item = text(40)
    rows += [(300, rows[3][1], "en", "src", 1), (301, rows[3][1] + " more", "en", "src", 1), (302, f"{text(20)} {item.upper()} {text(20)}", "en", "src", 1), (303, text(50) + " password=abc12345def", "en", "src", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i in range(200) if i % 10}
    assert kept[0] == clean | {300, 301, 302, 303}
    assert kept[1] == clean | {302, 303}
    assert kept[2] == kept[3] == clean | {303}
    assert docs.where("doc_id = 303 and text like '%[ASSIGN]' and n_chars = length(text)").count() == 1
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_all_eleven_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries()) <= names


def test_pipeline_on_the_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_hard_rows_and_clashing_columns(spark, words, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, and columns named like those inside: every stage defines them."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(n))
    long, twice = text(30_000), text(60)
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " end"), (6, twice), (6, twice), (6, text(60)), (None, twice), (None, None), (7, text(50))]
    extra = "own string, root long, node long, fp string, score double"
    spark.createDataFrame([(i, t, "en", "src", len(t or ""), "o", 1, 2, "f", 0.9) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(40)), (None, twice), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted((repr(r.doc_id), len(r.text or "")) for r in docs.select("doc_id", "text").collect()))
    assert kept[0] == sorted((repr(i), len(t or "")) for i, t in rows)  # nothing is toxic
    assert kept[1] == kept[2] == kept[3] == sorted((repr(i), len(t or "")) for i, t in [rows[0], rows[3], rows[5], *rows[7:]])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({repr(r.doc_id) for r in packed}) == sorted({i for i, _ in kept[3]})
    assert sum(r.length for r in packed if r.doc_id == 4) > 30_000
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0)
        df.write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
