"""Operator 11: exact parts against a plain version, the model word by word, gradients, and likelihood of held-out documents."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bytelore.llm import recurrent as module
from bytelore.llm.recurrent import END, Network, Reader, Trainer, Vocabulary, counted, fitted, op11_recurrent, scored, scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [w.encode() for w in WORD.findall((text or "").translate(LOWER))] + [END]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_counts(rows):
    return Counter(t for doc_id, text in rows if not held_out(doc_id) for t in tokens(text))


def plain_score(net, vocabulary, counts, text):
    """Word by word, with the whole distribution written out."""
    p, h = net.parts, module.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    state, last, total = np.zeros(h), net.begin, 0.0
    number = {w: k for k, w in enumerate(vocabulary.words[: vocabulary.n])}
    for t in tokens(text):
        given, back = p["embed"][last] @ p["input"] + p["bias"], state @ p["state"]
        z, r = sigmoid(given[:h] + back[:h]), sigmoid(given[h : 2 * h] + back[h : 2 * h])
        new = np.tanh(given[2 * h :] + r * back[2 * h :])
        state = (1 - z) * new + z * state
        classes = np.exp(state @ p["by_class"] + p["class_bias"])
        last = number.get(t, net.rare)
        k = net.class_of[last]
        total += math.log10(classes[k] / classes.sum())
        if last == net.rare:
            total += math.log10((counts[t] + 1) / vocabulary.rest)
        else:
            a, b = net.bounds[k], net.bounds[k + 1]
            own = np.exp(state @ p["by_word"][a:b].T + p["word_bias"][a:b])
            total += math.log10(own[last - a] / own.sum())
    return total


def check(spark, rows, weights=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = plain_counts(rows)
    _, vocabulary, _ = counted(df)
    if weights is None:
        weights = vocabulary.network().weights
        weights += np.random.default_rng(1).normal(0, 0.3, len(weights)).astype(np.float32)
    net = vocabulary.network(weights)
    assert (vocabulary.total, vocabulary.distinct) == (sum(counts.values()), len(counts))
    got = sorted(scored(df, weights=weights).collect(), key=lambda r: (r.id is None, r.id or 0, r.n_tokens, r.base_score))
    size = sum(counts.values()), len(counts)
    want = []
    for doc_id, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (size[0] + size[1] + 1)) for t in own)
        want.append((doc_id, held_out(doc_id), len(own), sum(counts[t] > 0 for t in own), size[0], base, plain_score(net, vocabulary, counts, text)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want, strict=True):
        assert r.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(w[6], rel=2e-5, abs=1e-4)


def some_rows(n=60):
    rng = np.random.default_rng(3)
    names = [f"Wort{k}" for k in range(300)] + ["été", "ÉTÉ", "x y", "a\u0085b"]
    rows = [(int(k), " ".join(rng.choice(names, rng.integers(0, 90))) + rng.choice(["", "\n", "\t \x0b"])) for k in range(n)]
    return [*rows, (None, None), (None, "Wort1 neu"), (5, None), (6, ""), (7, "  \n"), rows[0], rows[0]]


def test_scores_equal_the_plain_version(spark):
    check(spark, some_rows())


def test_words_that_tasks_do_not_hold_are_joined(spark, monkeypatch):
    monkeypatch.setattr(module, "HELD_WORDS", 40)
    monkeypatch.setattr(module, "WORDS", 12)
    monkeypatch.setattr(module, "PIECE", 64)
    check(spark, some_rows())


def test_the_end_counts_where_many_words_are_more_frequent(spark, monkeypatch):
    monkeypatch.setattr(module, "HELD_WORDS", 3)
    check(spark, [(k, "a b c d a b c d a b c d e") for k in range(8)])
    monkeypatch.setattr(module, "HELD_WORDS", 4)
    check(spark, [(k, "a b c d a b c d a b c d e") for k in range(8)])


def test_no_training_documents_and_no_rows(spark):
    out = next(k for k in range(99) if held_out(k))
    got = scored(spark.createDataFrame([(out, "some words")], "doc_id long, text string")).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got] == [(3, 0, 0, 0.0, 0.0)]
    assert scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_columns_may_have_any_name(spark):
    rows = [(k, "a b a c", "x", 1, 2) for k in range(9)]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string, n string, id int, row int")).collect()
    assert len(got) == 9 and len({(r.n_tokens, round(r.score, 6)) for r in got}) == 1


def test_words_of_long_texts(monkeypatch):
    text = "One two  three\t\x0bvier " * 50 + "last" + " " * 40 + "end"
    for piece in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(module, "PIECE", piece)
        assert [w for some in module.words(text.encode()) for w in some] == tokens(text)[:-1]


def test_a_very_long_text_is_scored_whole(spark):
    rows = [(k, "one two three four " * 20) for k in range(20)] + [(100, "one two three four " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in scored(df, weights=counted(df)[1].network().weights).collect()}
    assert got[100].n_tokens == 240_001 and got[100].score < 2000 * got[3].score < 0


def small_net(seed=0):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 50, 40))[::-1].astype(float)
    net = Network(counts, 30)
    net.weights += rng.normal(0, 0.4, len(net.weights)).astype(np.float32)
    return net, rng


def test_probabilities_of_all_words_sum_to_one():
    net, rng = small_net()
    states = np.repeat(rng.normal(0, 1, (1, module.HIDDEN)).astype(np.float32), net.n + 1, 0)
    assert np.exp(net.log_probs(states, np.arange(net.n + 1))[0]).sum() == pytest.approx(1, rel=1e-5)
    words = Vocabulary([(b"a", 5), (b"b", 3)], 20, 9)
    assert words.rest == 20 - 8 + 9 - 2 + 1


def test_gradients_equal_differences():
    net, rng = small_net(4)
    docs = [rng.integers(0, net.n + 1, n).astype(np.int32) for n in (9, 3, 5, 1, 14)]
    trainer, lanes = Trainer(net, 0.1), module._Lanes(docs, net.begin, 3)
    steps, size = next(lanes.windows())
    state = np.zeros((size, module.HIDDEN), np.float32)
    g, _, _ = trainer.gradient(lanes, steps, state)
    n = sum(map(len, steps))
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 40, replace=False):
        old = net.weights[k]
        around = []
        for d in (0.02, -0.02):
            net.weights[k] = old + d
            around.append(-trainer.gradient(lanes, steps, state)[1] / n)
        net.weights[k] = old
        assert (around[0] - around[1]) / 0.04 == pytest.approx(float(g[k]), rel=0.05, abs=5e-4)


def test_lanes_do_not_change_scores(monkeypatch):
    net, rng = small_net(5)
    docs = [rng.integers(0, net.n + 1, n).astype(np.int32) for n in rng.integers(1, 150, 30)]
    one = scores(net, docs, net.table())
    monkeypatch.setattr(module, "SCORING_LANES", 4)
    assert scores(net, docs, net.table()) == pytest.approx(one, rel=1e-5)
    assert scores(net, docs[:1], net.table()) == pytest.approx(one[:1], rel=1e-5)


def test_training_learns_order():
    cycle = [b"a", b"b", b"c", b"d"]
    vocabulary = Vocabulary([(w, 100) for w in cycle] + [(END, 10)], 410, 5)
    reader, net = Reader(vocabulary), vocabulary.network()
    docs = [reader.narrowed(reader.numbers(b"a b c d " * 10)[0]) for _ in range(40)]
    before = scores(net, docs[:1], net.table())[0]
    trainer = Trainer(net, 0.02)
    for _ in range(30):
        trainer.train(docs)
    assert scores(net, docs[:1], net.table())[0] > 0.3 * before


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_documents_are_likelier_than_by_counts(spark, sf):
    got = op11_recurrent(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == 1000 and got[0].doc_id is not None
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert np.isfinite(fitted(df, counted(df)[1])).all()


def test_training_takes_each_exponential_once(monkeypatch):
    net, rng = small_net(6)
    targets, sizes, taken, exp = rng.integers(0, net.n + 1, 200), np.diff(net.bounds), [], np.exp
    states = rng.normal(0, 1, (200, module.HIDDEN)).astype(np.float32)
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: taken.append(x.size) or exp(x, *a, **b))
    net.log_probs(states, targets, net.views(np.zeros_like(net.weights)))
    inside = [int(sizes[k]) for k in net.class_of[targets] if k < net.classes and sizes[k] > 1]
    assert sum(taken) == 200 * (net.classes + 1) + sum(inside)


def test_training_reads_the_words_of_the_network_alone():
    vocabulary = Vocabulary([(b"w%d" % k, 5000 - k) for k in range(module.WORDS + 50)] + [(END, 10)], 10**8, 10**4)
    reader, text = Reader(vocabulary), b"W3 w2049 never w0 w2047\tw2048 " * 3
    assert reader.network_numbers(text).tolist() == reader.narrowed(reader.numbers(text)[0]).tolist()
    assert len(reader.network_numbers(b"")) == 1 and len(reader.own) == module.WORDS


def odd_texts():
    rng = np.random.default_rng(8)
    names = ["Wort", "été", "ÉTÉ", "a\u0085b", "c\x1cd", "x Y", "AZ@[", " "]
    texts = ["".join(str(rng.choice(names)) + str(rng.choice([" ", "\n", "\t \x0b", "\x0c\r "])) for _ in range(rng.integers(0, 40))).encode() for _ in range(50)]
    return [b"", b" \n", b" a  B ", b"x" * 200 + b" y", b"\xff\xfe Ab \x80", *texts, b"", b"one"]


@pytest.mark.parametrize("piece", [1 << 20, 60, 1])
def test_many_texts_are_read_as_one_by_one(monkeypatch, piece):
    monkeypatch.setattr(module, "PIECE", piece)
    monkeypatch.setattr(module, "WORDS", 5)
    texts, counts = odd_texts(), Counter()
    for text in texts:
        counts.update([w for some in module.words(text) for w in some] + [END])
    reader = Reader(Vocabulary(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12], sum(counts.values()), len(counts)))
    batch, got = pa.record_batch([pa.array(texts, pa.binary())], names=["text"]), Counter()
    for some in module._count([batch.slice(0, 9), batch.slice(9)]):
        for word, n in zip(*(c.to_pylist() for c in some.columns), strict=True):
            got[word] += n
    assert got == counts
    for column in (batch.column(0), batch.slice(3, 20).column(0), batch.slice(0, 2).column(0)):
        docs, others, times = reader.all_numbers(column)
        for text, own, words, n, narrow in zip(column.to_pylist(), docs, others.to_pylist(), times.to_pylist(), reader.all_network_numbers(column), strict=True):
            want, rest = reader.numbers(text)
            assert own.tolist() == want.tolist() and dict(zip(words, n, strict=True)) == rest and len(words) == len(rest)
            assert narrow.tolist() == reader.network_numbers(text).tolist()


def test_words_of_texts_that_are_not_long_are_never_python_objects(monkeypatch):
    def refused(text):
        raise AssertionError("read word by word")

    monkeypatch.setattr(module, "words", refused)
    reader, column = Reader(Vocabulary([(b"a", 3), (END, 2)], 9, 4)), pa.array([b"a b A", b"c"], pa.binary())
    assert sum(len(some) for some in module._count([pa.record_batch([column], names=["text"])])) == 4
    assert [n.tolist() for n in reader.all_numbers(column)[0]] == [[0, -1, 0, 1], [-1, 1]]
    assert [n.tolist() for n in reader.all_network_numbers(column)] == [[0, 2, 0, 1], [2, 1]]


def test_chunks_have_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(module, "CHUNK_TOKENS", 50)
    texts = [b"x" * n for n in np.random.default_rng(2).integers(0, 120, 90)] + [b"y" * 5000]
    batch = pa.record_batch([pa.array(range(91)), pa.array(texts, pa.binary())], names=["id", "text"])
    chunks = list(module._chunks([batch.slice(0, 40), batch.slice(40, 0), batch.slice(40)]))
    assert [k for c in chunks for k in c.column("id").to_pylist()] == list(range(91))
    loads = [[len(t) // 6 + 1 for t in c.column("text").to_pylist()] for c in chunks]
    assert all(sum(x) >= 50 > sum(x[:-1]) for x in loads[:-1]) and list(module._chunks([])) == []


@pytest.mark.filterwarnings("error")
def test_values_too_large_for_exponentials():
    net, rng = small_net(7)
    states, targets = rng.normal(0, 1, (30, module.HIDDEN)).astype(np.float32), rng.integers(0, net.n + 1, 30)
    net.parts["class_bias"][:] += np.linspace(-300, 300, net.classes + 1, dtype=np.float32)
    logs, back = net.log_probs(states, targets, net.views(np.zeros_like(net.weights)))
    z = states @ net.parts["by_class"] + net.parts["class_bias"]
    classes = net.class_of[targets]
    of_class = (z - np.logaddexp.reduce(z, axis=1)[:, None])[np.arange(30), classes]
    assert np.isfinite(logs).all() and np.isfinite(back).all()
    assert logs[classes == net.classes] == pytest.approx(of_class[classes == net.classes], abs=1e-3) and (logs <= of_class + 1e-3).all()
    net.weights[:] *= 1000
    docs = [rng.integers(0, net.n + 1, 20).astype(np.int32) for _ in range(3)]
    assert np.isfinite(scores(net, docs, net.table())).all()
