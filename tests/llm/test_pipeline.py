"""The pipeline's stages one after the other, and what may be taken away."""

import os
import random
import re
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import registry
from tests.llm.conftest import tables

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": [f"the{c}" for c in "abcdefghijklmnop"] + ["and", "house", "with"], "de": [f"sch{c}" for c in "abcdefghijklmnop"] + ["und", "haus", "nicht"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    leak = text("en", 30)
    rows = []
    for i in range(200):
        lang = rng.choice(["en", "de"])
        body = text(lang, 60)
        rows.append((i, body + ("\nHome About Contact" if i % 4 == 0 else ""), lang, "s" + str(i % 2), len(body)))
    near = rows[1][1].split()
    near[30] = "changed"
    rows += [(200, rows[0][1], "en", "s1", 1), (201, " ".join(near), "en", "s1", 1), (202, text("en", 10) + " " + leak.upper() + ". " + text("en", 20), "en", "s0", 1), (203, "12345 !!", "en", "s0", 1), (204, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = tables(tmp_path, spark, documents=docs, benchmark=spark.createDataFrame([(1, leak)], "item_id bigint, text string"))
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    every = {r[0] for r in rows}
    assert kept[0] == every - {203, 204} and kept[1] == kept[0]
    lines = spark.read.parquet(str(tmp_path / "out1"))
    assert lines.filter(F.col("text").contains("Home About") & (F.col("doc_id") < 200)).count() == 0 and lines.filter("n_chars <> length(text) and doc_id % 4 = 0 and doc_id < 200").count() == 0
    assert kept[2] == kept[1] - {200, 201} and kept[3] == kept[2] - {202} and kept[4] == kept[3]
    final = sorted(map(str, now.collect()))
    assert final == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_languages_that_were_not_learned_go(spark):
    rng = random.Random(8)
    words = {"en": "the house with would think and river they were walking".split(), "de": "der haus und schön nicht gehen fluß werden über".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, "s", 1) for i in range(120) for lang in [rng.choice(["en", "de"])]]
    rows += [(500, " ".join("".join(rng.choice("бвгджзклмнпрст") for _ in range(6)) for _ in range(60)), None, "s", 1), (501, "the house", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.language_id(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {500}


def test_one_query_per_operator():
    names = [n for n in registry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_the_rest_works_without(tmp_path):
    """Without the subpackage, its tests and the pipeline, the entry point imports and lists the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) < set(q); import sys; assert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "pulsegrid")):
        if os.path.basename(folder) == "llm" or "__pycache__" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                assert "pulsegrid.llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name
