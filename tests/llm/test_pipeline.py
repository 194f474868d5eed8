"""The corpus pipeline against its stages' plain versions."""

import random

import pytest

import corpus_pipeline
from bytelore.llm import decontamination, near_copies, pieces, secrets
from tests.llm.test_operators import plain_secrets, plain_tiles, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("corpus")), random.Random(3)
    item = prose(30, 900)
    texts = [prose(r.randint(50, 90), 700 + k) for k in range(40)]
    texts += [t + " tail" for t in texts[:6]] + texts[:4] + [item + " " + prose(20, 901), None, "", "12 34", prose(50, 902) + " token = abcdef99"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run_equals_the_plain_stages(spark, folder):
    path, rows = folder
    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    once = []
    for r in kept:
        if not any(near_copies.alignable(near_copies.words(o[1]), near_copies.words(r[1])) for o in once):
            once.append(r)
    item = prose(30, 900).split()
    clean = [(r[0], secrets.redacted(r[1], plain_secrets(r[1]))) for r in once if plain_tiles(item, r[1].split(), decontamination.TILE) < 0.8 * len(item)]
    own = pieces.codec(pieces.model_path())
    want = {(i, tuple(own.encode(t)), t) for i, t in clean}
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, path).collect()} == want
    assert len(want) == 41


def test_nothing_is_left_but_the_result(spark, folder):
    import os
    import re

    from bytelore.sources.stored import shared_dir

    base = os.path.dirname(re.sub("^file:/*", "/", shared_dir(spark)))
    before = set(os.listdir(base))
    out = corpus_pipeline.run(spark, folder[0])
    left = set(os.listdir(base)) - before
    assert out.count() == 41 and len(left) == 1 and out._stored_path.endswith(left.pop())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
    n = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secrets(spark, docs, folder[0]).collect()}
    assert all(t is None or c == len(t) for t, c in n.values())


def test_columns_of_other_names_and_clashes(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").drop("n_chars").withColumns({c: F.lit(42.0) for c in ("score", "lang_pred", "own_h", "own_id", "times", "h")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder[0])
        assert got.columns == docs.columns
        assert got.where("score <> 42 OR lang_pred <> 42 OR h <> 42").count() == 0 and got.count() > 0
