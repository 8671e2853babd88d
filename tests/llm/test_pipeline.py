import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from inkstone.llm import quality, toxicity
from inkstone.llm.common import shared_dir


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(1)
    good, bad = [f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60)], ["x###", "y$$$", "z%%%", "***"]
    rows, labels = [], []
    for i in range(200):
        words = list(rng.choice(bad if i % 4 == 0 else good, 80))
        if i % 5 == 1:
            words[:6] = ["scum"] * 6
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 4 > 0), int(i % 5 == 1)))
    rows += [(900, rows[2][1], "en", "s", 0), (2, rows[2][1], "en", "s", 0), (None, rows[3][1], "en", "s", 0), (901, " ".join(rng.choice(good, 80)) + " +1 (619) 555-0053", "en", "s", 0), (902, None, None, None, None), (903, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
    clean = {i for i in range(200) if i % 4 and i % 5 != 1}
    assert len({r.doc_id for r in seen["quality"]} & set(range(0, 200, 4))) <= 2
    toxic = set(range(1, 200, 5))
    assert len({r.doc_id for r in seen["toxicity"]} & toxic) <= 4 and len(clean - {r.doc_id for r in seen["toxicity"]}) <= 2
    ids = [r.doc_id for r in seen["near_dedup"]]
    assert ids.count(2) == 1 and 900 not in ids and None not in ids
    texts = {r.doc_id: r for r in seen["pii"]}
    assert "[PHONE]" in texts[901].text and texts[901].n_chars == len(texts[901].text)
    assert {r.doc_id for r in seen["packing"]} == set(texts)
    tables = lambda: set(Path(shared_dir(spark).removeprefix("file://")).rglob("_SUCCESS"))
    before = tables()
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(tables() - before) == 1  # the pieces that the result reads
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in final) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in seen["packing"])


def test_stages_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    good, bad = [f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60)], ["x###", "y$$$", "z%%%"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, 60))) for i in range(120)] + [(500, " ".join(rng.choice(good, 400_000)) + " +1 (619) 555-0053"), (501, None), (502, "")]
    labels = [(i, int(i % 4 > 0), int(i % 5 == 1)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["key", "id", "row", "label", "h", "picked", "slots", "score", "piece", "fp", "held_out", "component_id", "quality", "toxic"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", *(f"'{n}' AS {n}" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in out} == {r.doc_id for r in stage(spark, plain, str(tmp_path)).collect()}
        long = [r for r in out if r.doc_id == 500]
        if name == "packing":
            assert sum(r.length for r in long) > 400_000 and {r.length for r in long if r.piece} == {2048}
        else:
            assert len(long) == 1 and all(r[n] == n for r in out for n in names)
            assert (len(long[0].text) == len(rows[120][1])) == (name != "pii")


def test_without_labels_and_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.THRESHOLD == 0.3 and toxicity.THRESHOLD == 0.5


def test_the_rest_stands_alone(tmp_path):
    top = Path(corpus_pipeline.__file__).parent
    for p in top.rglob("*.py"):
        inside = p.relative_to(top)
        if inside.parts[:2] in (("inkstone", "llm"), ("tests", "llm")) or inside.name == "corpus_pipeline.py" or ".git" in inside.parts:
            continue
        (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / inside).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
