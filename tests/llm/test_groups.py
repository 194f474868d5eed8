"""Large groups: how much is compared in them."""

import os
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bytelore.llm import common, near_copies, recurrent
from bytelore.sources.stored import stored


def test_a_group_of_near_copies_takes_a_pair_or_two_for_each_text(spark, monkeypatch):
    draw, n = random.Random(5), 120
    base = [f"w{draw.randrange(5000)}" for _ in range(100)]
    texts = [" ".join(w if draw.random() > 0.06 else f"v{draw.randrange(10**6)}" for w in base) for _ in range(n)]
    compared, verdicts = [], near_copies.verdicts

    def counted(pairs, own_texts):
        compared.append(pairs.count())
        return verdicts(pairs, own_texts)

    monkeypatch.setattr(near_copies, "verdicts", counted)
    df = spark.createDataFrame([*enumerate(texts), (n, "something else altogether")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_copies.near_classes(df).collect()}
    assert got == {k: 0 for k in range(n)} | {n: n}
    assert sum(compared) <= 3 * n


def test_every_training_document_counts_in_a_large_corpus(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "LEAST_TOKENS", 1)
    draw = random.Random(7)
    df = spark.createDataFrame([(k, " ".join(f"w{draw.randrange(9)}" for _ in range(40))) for k in range(12)], "doc_id long, text string")
    own = [r.doc_id for r in df.where(recurrent.training("doc_id")).limit(3).collect()]
    vocabulary = recurrent.counted(df)[1]
    whole = recurrent.fitted(df, vocabulary)
    for k in own:
        assert not np.array_equal(recurrent.fitted(df.where(f"doc_id <> {k}"), vocabulary), whole)


def test_texts_that_share_a_rarer_passage_of_half_their_words_are_no_pairs(spark):
    passage, own = [f"p{j}" for j in range(55)], [[f"s{k}x{j}" for j in range(45)] for k in range(12)]
    texts = [" ".join(passage + o) for o in own]
    others = [" ".join(o + [f"u{k}x{m}x{j}" for j in range(300)]) for k, o in enumerate(own) for m in range(15)]  # the passage's words are the rarer ones
    link = " ".join(passage + own[0][:40] + ["new"] * 5)
    long = [" ".join(passage * 50 + o * times) for o, times in ((own[0], 20), (own[0], 18), (own[1], 40))]  # more than WHOLE words
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate([*texts, *others, link, *long])], "tid long, root long, text string")
    n = len(texts) + len(others)
    assert sorted((r.pivot, r.tid) for r in near_copies.crowded_pairs(df).collect() if r.tid != n + 3) == [(0, n), (n + 1, n + 2)]


def test_shuffle_files_behind_a_stored_table_are_deleted(spark):
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for top in folders for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before = files()
    table = stored(spark.range(1000).repartition(4, "id"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def crowd():
    draw = random.Random(31)
    base = [[f"w{draw.randrange(400)}" for _ in range(60)] for _ in range(40)]
    near = [[w if draw.random() > 0.05 else f"v{draw.randrange(400)}" for w in b] for b in base[:20]]
    return [" ".join(x) for x in base + near]


def test_crowded_texts_are_dealt_out_in_turns_of_bounded_size(spark, monkeypatch):
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(crowd())], "tid long, root long, text string")
    monkeypatch.setattr(near_copies, "PART", 50)
    whole, dealt, turns = sorted(map(tuple, near_copies.crowded_pairs(df).collect())), near_copies._dealt, []
    assert {(40 + k, k) for k in range(20)} <= set(whole)

    def seen(*given):
        rows = dealt(*given)
        turns.append(rows.agg(F.sum(F.octet_length("rare") + F.octet_length("first") + F.octet_length("cells"))).first()[0])
        return rows

    monkeypatch.setattr(near_copies, "_dealt", seen)
    monkeypatch.setattr(near_copies, "AT_ONCE", 30_000)
    assert sorted(map(tuple, near_copies.crowded_pairs(df).collect())) == whole
    assert len(turns) > 3 and max(turns) < 45_000 and sum(turns) > 100_000


def test_joins_that_shuffle_move_few_texts_that_nobody_needs(spark, monkeypatch):
    source = spark.range(5000).selectExpr("id AS source_id", "unhex(md5(CAST(id AS string))) AS source_h")
    wanted = source.where("source_id % 10 = 0").selectExpr("source_h AS h")
    kept = {r.source_id for r in near_copies.passed(source, "source_h", wanted).collect()}
    assert {k for k in range(5000) if k % 10 == 0} <= kept and len(kept) < 520
    df = spark.createDataFrame(list(enumerate(crowd())), "doc_id long, text string")
    usual, sizes = sorted(map(tuple, near_copies.near_classes(df).collect())), []
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    passed = near_copies.passed
    monkeypatch.setattr(near_copies, "passed", lambda *given: (sizes.append(1), passed(*given))[1])
    assert sorted(map(tuple, near_copies.near_classes(df).collect())) == usual and sizes
    assert len({r[1] for r in usual}) == 40


def test_documents_of_a_large_corpus_train_as_often_as_those_of_a_small_one(spark, monkeypatch):
    draw = random.Random(8)
    df = spark.createDataFrame([(k, f"t{k} " + " ".join(f"w{draw.randrange(9)}" for _ in range(20))) for k in range(30)], "doc_id long, text string")
    own, vocabulary = {r.text.encode() for r in df.where(recurrent.training("doc_id")).collect()}, recurrent.counted(df)[1]
    read, run = Counter(), type(df).mapInArrow

    def spied(frame, *given):
        if frame.columns == ["text"]:
            read.update(bytes(r.text) for r in frame.collect())
        return run(frame, *given)

    monkeypatch.setattr(type(df), "mapInArrow", spied)
    for least in (recurrent.LEAST_TOKENS, 1):
        monkeypatch.setattr(recurrent, "LEAST_TOKENS", least)
        read.clear()
        recurrent.fitted(df, vocabulary)
        assert read == dict.fromkeys(own, recurrent.ROUNDS)
