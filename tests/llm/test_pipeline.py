"""The stages, one after another, on a small table with planted cases."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    line = "This footer stands below a good many of the documents."
    near = text(500).split()
    near[60] = "changed"
    item = text(900, 30)
    rows = [(k, f"{text(k)}\n{line}") for k in range(8)]
    rows += [(500, text(500)), (501, " ".join(near)), (502, text(500)), (502, text(500)), (600, "too short"), (601, None), (602, "a b c " * 60), (700, text(700) + " " + item), (None, text(800))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs, after = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        after.append(docs)
        assert k == 4 or docs.columns == COLUMNS
    ids = [sorted((r.doc_id for r in d.collect()), key=lambda x: (x is not None, x)) for d in after]
    assert ids[0] == [None, *range(8), 500, 501, 502, 502, 700]
    assert ids[1] == ids[0]
    lines = {r.doc_id: r.text.count("\n") for r in after[1].collect()}
    assert [lines[k] for k in range(8)] == [0] * 7 + [1]
    assert all(r.n_chars == len(r.text) for r in after[1].collect())
    assert ids[2] == [None, *range(8), 500, 700]
    assert ids[3] == [None, *range(8), 500]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in after[3].collect())
    assert sum(r.length for r in after[4].collect()) == expected


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Names that the operators use themselves stay what they were, and change nothing."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    names = ["row", "m", "kept", "base_failed", "hit", "own", "own_id", "n_dropped", "n_lines", "kept_text", "words", "to", "node", "component", "kept_id", "rows", "signature", "far"]
    more = plain.select("*", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns
        rows = out.collect()
        assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        expected = stage(spark, plain, sf_dir).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, ((r.doc_id, r.text) for r in expected)))
    assert corpus_pipeline.pack(spark, more, sf_dir).count() == corpus_pipeline.pack(spark, plain, sf_dir).count()


def test_run_and_registry(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() == 10
    assert QUERIES["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
