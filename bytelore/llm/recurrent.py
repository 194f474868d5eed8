"""Operator 11: log-likelihood of texts under a gated recurrent language model, and under smoothed counts of words.

Words are runs of other than ASCII white space, A-Z lower-cased; a text is its words and one end. Counts of all words of all
training documents (crc32 of the id as text, mod 7, other than 2) are a table that Spark sums; it gives N, V and the base score,
the sum of log10((c + 1) / (N + V + 1)).

The model. A gated recurrent unit of HIDDEN values reads the words before; its output is factored by class: a softmax over
CLASSES classes of the WORDS most frequent words (split by the square roots of their counts) and one class of all other words;
then a softmax over the words of the class, or, in the last class, smoothed counts, which reach words never seen. The
probabilities of all possible words sum to 1. Weights start at those of counts alone and are trained in numpy by
back-propagation through windows of WINDOW words (Adam). State is carried from window to window, in training and in scoring,
so a text of any length is scored whole.

Training reads all training documents ROUNDS times, in all tasks, however many there are. In each round of averaging every
replica trains on its part, from the mean of the round before; means are weighted by words and made in Spark. Up to
LEAST_TOKENS words a reading is one round; with more, the documents are dealt out by a hash of the row to ROUNDS rounds, which
follow each other. Counts, N, V and the words of the classes come from all training documents, too.

Tasks hold the counts of the end and of words above a count that at most HELD_WORDS words exceed; what else a text has goes, with its number
of occurrences, into a join with the table of counts. Texts are split and looked up by Arrow, a chunk of them at once; those of
more than PIECE bytes are read in pieces, word by word.

Cases: null text is empty (its end is scored); a null id reads as empty text; repeated rows are scored each, with equal results;
no training documents: both scores are 0; an empty table has no rows; ties between words are broken by their bytes; other
columns are ignored. The last digits of sums may change with the order in which Spark adds them.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bytelore.llm.common import held, mapped, spark_schema, stored, table, text_column

WORDS, CLASSES, HIDDEN = 2048, 32, 16
WINDOW = 32
#: Documents side by side: in training, where each window of all lanes is one step, and in scoring.
LANES, SCORING_LANES = 64, 256
#: Words up to which each round trains on all documents; with more, a reading of all is ROUNDS rounds. Lanes of replicas with more words.
LEAST_TOKENS, MORE_LANES = 2_000_000, 256
#: Readings of all documents, and rounds of each if there are many.
ROUNDS, RATE, CLIP = 2, 0.01, 1.0
#: Words of a replica and round, up to so many replicas; beyond, a replica reads more.
REPLICA_TOKENS, REPLICAS = 3_000_000, 512
HELD_WORDS = 1 << 17
COUNTED_WORDS = 300_000
PIECE = 1 << 20
CHUNK_TOKENS = 1 << 21
BLOCK = 4096
#: Rows of a softmax over classes at once, which stay near a core. Logarithms whose exponentials add up in four bytes without a shift.
SOFTMAX_ROWS, SAFE = 2048, 60

END = b""  # a key that no word has
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a text, in order."""
    if len(text) <= PIECE:
        yield text.translate(_LOWER).split()
        return
    carried, view = b"", memoryview(text)
    for at in range(0, len(text), PIECE):
        piece = carried + bytes(view[at : at + PIECE]).translate(_LOWER)
        found = piece.split()
        carried = found.pop() if found and not piece[-1:].isspace() else b""
        yield found
    yield [carried] if carried else []


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (as bytes), in order, and the places where those of each text begin, with the end; as `words`, by Arrow."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat, bounds = found.values.view(pa.binary()), found.offsets.to_numpy()
    filled = pc.greater(pc.binary_length(flat), 0)  # white space around a text leaves empty ones
    if not pc.all(filled, min_count=0).as_py():
        bounds = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))[bounds]
        flat = flat.filter(filled)
    return flat, bounds


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts that Arrow splits; rows of these, and of the long ones, which are read in pieces."""
    long = pc.greater(pc.binary_length(texts), PIECE).to_numpy(zero_copy_only=False)
    return (texts.filter(pa.array(~long)) if long.any() else texts), np.flatnonzero(~long), np.flatnonzero(long)


def training(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 != 2


_COUNT = {"word": "binary", "n": "bigint"}


def _count(batches) -> Iterator[pa.RecordBatch]:
    def handed(found, times) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_arrays([pa.array(found, pa.binary()), pa.array(times, pa.int64())], names=list(_COUNT)).to_batches(max_chunksize=20_000)

    for chunk in _chunks(batches):
        short, _, long = parted(chunk.column("text"))
        counts = pc.value_counts(split(short)[0])
        yield from handed(counts.field(0), counts.field(1))
        yield from handed([END], [chunk.num_rows])
        for row in long:
            found: Counter = Counter()
            for some in words(chunk.column("text")[row].as_py()):
                found.update(some)
                if len(found) > COUNTED_WORDS:
                    yield from handed(found.keys(), found.values())
                    found.clear()
            yield from handed(found.keys(), found.values())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, as is `_tanh`; what overflows comes out as 0, as it should."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """By one exponential, in half the time of numpy's own."""
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1
    return x


def _with_ones(rows: np.ndarray) -> np.ndarray:
    """One more column of 1, so that biases are one more row of the weights."""
    out = np.ones((len(rows), rows.shape[1] + 1), rows.dtype)
    out[:, :-1] = rows
    return out


def _softmax(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of the probabilities of column `at` of each row; the sums of the exponentials, which are left in z; places of these columns."""
    places = np.arange(0, z.size, z.shape[1]) + at
    if not -SAFE < z.min() <= z.max() < SAFE:
        z -= z.max(1)[:, None]
    out = z.reshape(-1).take(places)
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    out -= np.log(sums)
    return out, sums, places


def _softmax_back(z: np.ndarray, sums: np.ndarray, places: np.ndarray, given: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weights and of what was given, after `_softmax`; the short rows are divided by the sums, not the long ones."""
    z.reshape(-1)[places] -= sums
    return (given / sums[:, None]).T @ z, (z @ weights) / sums[:, None]


class Network:
    """Weights in one vector. Words are numbers from 0 by falling count; `rare` is every other word, and `begin` what is before a text."""

    def __init__(self, counts: np.ndarray, rest: int, weights: np.ndarray | None = None, seed: int = 11):
        """counts: of the network's words, falling; rest: words and occurrences outside, at least 1."""
        self.n, k, h = len(counts), len(counts), HIDDEN
        self.rare, self.begin = k, k + 1
        share = np.cumsum(np.sqrt(counts)) / max(1.0, float(np.sqrt(counts).sum()))
        of_word = np.minimum((share * CLASSES - 1e-9).astype(np.int64), CLASSES - 1).clip(0)
        _, of_word = np.unique(of_word, return_inverse=True)
        self.classes = int(of_word.max()) + 1 if k else 0
        self.class_of = np.append(of_word, self.classes)
        self.bounds = np.searchsorted(of_word, np.arange(self.classes + 1))
        self.shapes = {"embed": (k + 2, h), "input": (h, 3 * h), "bias": (3 * h,), "state": (h, 3 * h), "by_class": (h, self.classes + 1), "class_bias": (self.classes + 1,), "by_word": (k, h), "word_bias": (k,)}
        self.weights = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), np.float32)
        self.parts = self.views(self.weights)
        if weights is not None:
            self.weights[:] = weights
            return
        rng = np.random.default_rng(seed)
        for name in ("embed", "input", "state"):
            self.parts[name][:] = rng.normal(0, h**-0.5, self.shapes[name])
        mass = np.append(np.bincount(of_word, counts, self.classes), rest)
        self.parts["class_bias"][:] = np.log(mass) - np.log(mass.sum())
        self.parts["word_bias"][:] = np.log(counts) - np.log(mass[of_word])

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """By name; `inputs` and `classes` have the bias, which is behind these weights, as their last row."""
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = vector[at : at + size].reshape(shape)
            if name in ("input", "by_class"):
                out["inputs" if name == "input" else "classes"] = vector[at : at + size + shape[1]].reshape(-1, shape[1])
            at += size
        return out

    def gates(self, name: str) -> np.ndarray:
        """Weights `input` or `state` as a block for each gate."""
        return np.ascontiguousarray(self.parts[name].reshape(HIDDEN, 3, HIDDEN).swapaxes(0, 1))

    def table(self) -> np.ndarray:
        """What each word adds to the gates: a table of each."""
        return self.parts["embed"] @ self.gates("input") + self.parts["bias"].reshape(3, 1, HIDDEN)

    @staticmethod
    def step(given: np.ndarray, state: np.ndarray, weights: np.ndarray):
        """One word of all lanes. Each gate is a whole block of memory, a row for each lane; weights: `gates("state")`."""
        back = state @ weights
        gates, raw = back[:2], back[2]
        gates += given[:2]
        _sigmoid(gates)
        z, r = gates
        new = r * raw
        new += given[2]
        _tanh(new)
        after = state - new
        after *= z
        after += new
        return after, z, r, new, raw

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """Natural logarithms of the targets' probabilities; with `grads`, also adds the loss's gradients and returns those of states."""
        p = self.parts
        classes = self.class_of.take(targets)
        order = np.argsort(classes.astype(np.int16), kind="stable")
        classes, targets, own = classes.take(order), targets.take(order), _with_ones(states.take(order, 0))
        found, back = np.empty(len(order), states.dtype), None if grads is None else np.empty_like(states)
        for at in range(0, len(order), SOFTMAX_ROWS):
            some = slice(at, at + SOFTMAX_ROWS)
            z = own[some] @ p["classes"]
            found[some], sums, places = _softmax(z, classes[some])
            if grads is not None:
                to_weights, back[some] = _softmax_back(z, sums, places, own[some], p["by_class"].T)
                grads["classes"] += to_weights
        words = np.concatenate([p["by_word"], p["word_bias"][:, None]], axis=1).T
        cuts = np.searchsorted(classes, np.arange(self.classes + 1))  # the last class has no words of its own
        for k in range(self.classes):
            a, b = self.bounds[k], self.bounds[k + 1]
            some = slice(cuts[k], cuts[k + 1])
            if b - a < 2 or cuts[k] == cuts[k + 1]:
                continue
            z = own[some] @ words[:, a:b]
            logs, sums, places = _softmax(z, targets[some] - a)
            found[some] += logs
            if grads is not None:
                to_weights, to_states = _softmax_back(z, sums, places, own[some], p["by_word"][a:b])
                grads["by_word"][a:b] += to_weights[:-1].T
                grads["word_bias"][a:b] += to_weights[-1]
                back[some] += to_states
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        return found.take(where), None if grads is None else back.take(where, 0)


class _Lanes:
    """Documents (arrays of words' numbers, each with its end) one after the other in lanes of about equal length."""

    def __init__(self, docs: list[np.ndarray], begin: int, lanes: int):
        lanes = min(lanes, len(docs))
        loads = [(0, k) for k in range(lanes)]
        dealt: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            load, k = heapq.heappop(loads)
            dealt[k].append(d)
            heapq.heappush(loads, (load + len(docs[d]), k))
        dealt.sort(key=lambda own: -sum(len(docs[d]) for d in own))
        self.lengths = np.array([sum(len(docs[d]) for d in own) for own in dealt])
        self.offsets = np.append(0, np.cumsum(self.lengths))[:-1]
        order = [d for own in dealt for d in own]
        self.targets = np.concatenate([docs[d] for d in order]) if order else np.zeros(0, np.int32)
        self.of = np.repeat(order, [len(docs[d]) for d in order])
        starts = np.append(0, np.cumsum([len(docs[d]) for d in order]))[:-1].astype(np.int64)
        self.given = np.append(begin, self.targets[:-1]) if order else self.targets
        self.given[starts] = begin
        self.first = np.zeros(len(self.targets), bool)
        self.first[starts] = True

    def windows(self) -> Iterator[tuple[list[np.ndarray], int]]:
        """Places of the words at each step of a window, by lane; lanes that have ended are the last ones, and missing."""
        for at in range(0, int(self.lengths[0]) if len(self.lengths) else 0, WINDOW):
            steps = [self.offsets[: np.searchsorted(-self.lengths, -t, "left")] + t for t in range(at, min(at + WINDOW, int(self.lengths[0])))]
            yield steps, len(steps[0])

    def kept(self, steps: list[np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """0 for each word of a window that begins a document, else 1; where the steps begin and end; whether a step has such words."""
        cuts = np.append(0, np.cumsum([len(x) for x in steps]))
        first = self.first.take(places)
        return (~first).astype(np.float32)[:, None], cuts, np.logical_or.reduceat(first, cuts[:-1]).tolist()


def scores(net: Network, docs: list[np.ndarray], given: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document; `given` is `net.table()`."""
    lanes = _Lanes(docs, net.begin, SCORING_LANES)
    out = np.zeros(len(docs))
    state, weights = np.zeros((len(lanes.lengths), HIDDEN), np.float32), net.gates("state")
    for steps, _ in lanes.windows():
        places = np.concatenate(steps)
        all_given = given.take(lanes.given.take(places), 1)
        keep, cuts, begins = lanes.kept(steps, places)
        states = np.empty((len(places), HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(steps)):
                here = slice(cuts[t], cuts[t + 1])
                state = state[: len(steps[t])]
                if begins[t]:
                    state = state * keep[here]
                states[here] = state = net.step(all_given[:, here], state, weights)[0]
        found, _ = net.log_probs(states, lanes.targets.take(places))
        out += np.bincount(lanes.of.take(places), found.astype(np.float64), len(docs))
    return out


class Trainer:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.first, self.second = np.zeros_like(net.weights), np.zeros_like(net.weights)

    def gradient(self, lanes: _Lanes, steps: list[np.ndarray], state: np.ndarray):
        """(gradient of the mean loss of a window, sum of logarithms, state after it)."""
        net, h = self.net, HIDDEN
        vector = np.zeros_like(net.weights)
        grads, saved, parts = net.views(vector), [], net.parts
        places = np.concatenate(steps)
        numbers, n = lanes.given.take(places), len(places)
        all_given, weights = net.table().take(numbers, 1), net.gates("state")
        keep, cuts, begins = lanes.kept(steps, places)
        befores, afters = np.empty((n, h), np.float32), np.empty((n, h), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(steps)):
                here = slice(cuts[t], cuts[t + 1])
                state = state[: len(steps[t])]
                if begins[t]:
                    state = state * keep[here]
                befores[here] = state
                saved.append(net.step(all_given[:, here], state, weights))
                afters[here] = state = saved[-1][0]
        found, back = net.log_probs(afters, lanes.targets.take(places), grads)
        gates, to_new = np.empty((3, n, h), np.float32), np.empty((n, h), np.float32)  # of z, r and the new state times r; of the new state
        later, weights = None, np.ascontiguousarray(weights.swapaxes(1, 2))
        for t in range(len(steps) - 1, -1, -1):
            here, (after, z, r, new, raw) = slice(cuts[t], cuts[t + 1]), saved[t]
            d = back[here]
            if later is not None:
                d[: len(later)] += later
            to_z, to_r, to_back, to_here = *gates[:, here], to_new[here]
            rest = 1 - z
            np.subtract(after, new, out=to_z)
            to_z *= rest
            to_z *= d
            np.multiply(new, new, out=to_here)
            np.subtract(1, to_here, out=to_here)
            to_here *= rest
            to_here *= d
            np.multiply(to_here, r, out=to_back)
            np.subtract(1, r, out=to_r)
            to_r *= raw
            to_r *= to_back
            turned = gates[:, here] @ weights
            later = np.multiply(d, z, out=rest)
            for one in turned:
                later += one
            if begins[t]:
                later *= keep[here]
        grads["state"] += (befores.T @ gates).swapaxes(0, 1).reshape(h, 3 * h)
        gates[2] = to_new
        grads["inputs"] += (_with_ones(parts["embed"].take(numbers, 0)).T @ gates).swapaxes(0, 1).reshape(h + 1, 3 * h)
        to_words = gates @ np.ascontiguousarray(net.gates("input").swapaxes(1, 2))
        to_words[0] += to_words[1]
        to_words[0] += to_words[2]
        order = np.argsort(numbers.astype(np.int16), kind="stable")  # fewer than 32,768
        there, at = np.unique(numbers.take(order), return_index=True)
        grads["embed"][there] += np.add.reduceat(to_words[0].take(order, 0), at)
        vector /= n
        return vector, float(found.sum(dtype=np.float64)), state

    def train(self, docs: list[np.ndarray]) -> float:
        lanes = _Lanes(docs, self.net.begin, LANES if sum(map(len, docs)) < MORE_LANES * BLOCK else MORE_LANES)
        state, total, some = np.zeros((len(lanes.lengths), HIDDEN), np.float32), 0.0, np.empty_like(self.net.weights)
        for steps, _ in lanes.windows():
            g, found, state = self.gradient(lanes, steps, state)
            total += found
            size = float(np.sqrt(g @ g))
            if size > CLIP:
                g *= CLIP / size
            self.steps += 1
            self.first *= 0.9
            self.first += np.multiply(g, 0.1, out=some)
            self.second *= 0.99
            g *= g
            g *= 0.01
            self.second += g
            np.multiply(self.second, 1 / (1 - 0.99**self.steps), out=g)
            np.sqrt(g, out=g)
            g += 1e-6
            np.divide(self.first, g, out=some)
            some *= self.rate / (1 - 0.9**self.steps)
            self.net.weights -= some
        return total


class Vocabulary:
    """Words that tasks hold, by falling count, and what the counts of all words sum to."""

    def __init__(self, held_words: list[tuple[bytes, int]], total: int, distinct: int):
        self.words = [w for w, _ in held_words]
        self.counts = np.array([n for _, n in held_words], np.int64)
        self.total, self.distinct = total, distinct
        self.n = min(WORDS, len(self.words))
        self.rest = total - int(self.counts[: self.n].sum()) + distinct - self.n + 1  # of the last class, with one for the unseen

    def network(self, weights: np.ndarray | None = None) -> Network:
        return Network(self.counts[: self.n].astype(np.float64), self.rest, weights)


class Reader:
    """Texts as numbers of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.number = {w: k for k, w in enumerate(vocabulary.words)}
        self.rare = vocabulary.n
        self.own = dict(zip(vocabulary.words[: self.rare], range(self.rare), strict=True))
        self.known = pa.array(vocabulary.words, pa.binary())

    def numbers(self, text: bytes) -> tuple[np.ndarray, Counter]:
        """Numbers of all words and the end (-1: not held), and the words that are not held."""
        get, out, others = self.number.get, [], Counter()
        for some in words(text):
            found = np.fromiter(map(get, some, repeat(-1)), np.int32, len(some))
            out.append(found)
            others.update(some[k] for k in np.flatnonzero(found < 0))
        out.append(np.array([get(END, -1)], np.int32))
        return np.concatenate(out), others

    def network_numbers(self, text: bytes) -> np.ndarray:
        """`narrowed` numbers of all words and the end, by the network's words alone."""
        get, rare = self.own.get, self.rare
        return np.concatenate([*(np.fromiter(map(get, some, repeat(rare)), np.int32, len(some)) for some in words(text)), np.array([get(END, rare)], np.int32)])

    def narrowed(self, numbers: np.ndarray) -> np.ndarray:
        return np.where((numbers < 0) | (numbers > self.rare), np.int32(self.rare), numbers)

    def _all(self, texts: pa.Array, known: pa.Array, other: int, end: int) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
        """Numbers by `known` of each text that Arrow splits (long ones: empty), with its end; its words and their numbers; rows of long texts."""
        short, rows, long = parted(texts)
        flat, bounds = split(short)
        found = pc.index_in(flat, value_set=known).fill_null(other).to_numpy()
        with_ends, cuts = np.insert(found, bounds[1:], end), bounds + np.arange(len(bounds))
        docs = [with_ends[:0]] * len(texts)
        for k, row in enumerate(rows):
            docs[row] = with_ends[cuts[k] : cuts[k + 1]]
        others = np.flatnonzero(found < 0)
        return docs, flat.take(pa.array(others)), rows[np.searchsorted(bounds, others, "right") - 1], long

    def all_network_numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """`network_numbers` of many texts."""
        docs, _, _, long = self._all(texts, self.known[: self.rare], self.rare, self.own.get(END, self.rare))
        for row in long:
            docs[row] = self.network_numbers(texts[row].as_py())
        return docs

    def all_numbers(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.ListArray, pa.ListArray]:
        """`numbers` of many texts: numbers of each; words of each that are not held, and how often they occur."""
        docs, others, rows, long = self._all(texts, self.known, -1, self.number.get(END, -1))
        times = np.ones(len(rows), np.int64)
        for row in long:
            docs[row], more = self.numbers(texts[row].as_py())
            others = pa.concat_arrays([others, pa.array(more.keys(), pa.binary())])
            rows, times = np.append(rows, np.full(len(more), row)), np.append(times, np.fromiter(more.values(), np.int64, len(more)))
        coded = others.dictionary_encode()
        keys, which = np.unique(rows * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)
        of_row, codes = np.divmod(keys, max(1, len(coded.dictionary)))
        bounds = pa.array(np.searchsorted(of_row, np.arange(len(texts) + 1)), pa.int32())
        sums = np.bincount(which, times, len(keys)).astype(np.int64)
        return docs, pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(codes))), pa.ListArray.from_arrays(bounds, pa.array(sums, pa.int64()))


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    """Rows together until their texts have about `CHUNK_TOKENS` words."""

    def joined() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    some, load = [], 0
    for batch in batches:
        sizes = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) // 6 + 1))
        at = 0
        while at < batch.num_rows:
            end = min(int(np.searchsorted(sizes, sizes[at] + CHUNK_TOKENS - load)), batch.num_rows)
            some.append(batch.slice(at, end - at))
            load += int(sizes[end] - sizes[at])
            at = end
            if load >= CHUNK_TOKENS:
                yield from joined()
                some, load = [], 0
    if some:
        yield from joined()


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary, int]:
    """(word, n) of all training documents; the vocabulary; the count above which all words are held."""
    texts = docs.where(training(id_col)).select(text_column(text_col).cast("binary").alias("text"))
    counts = stored(mapped(texts, _count, spark_schema(*_COUNT.items())).groupBy("word").agg(F.sum("n").alias("n")))
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))  # a row for each different count
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = sizes.withColumn("above", F.sum("words").over(above)).where(F.col("above") > HELD_WORDS).agg(F.max("n")).first()[0] or 0
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = counts.where((F.col("n") > limit) | (F.col("word") == F.lit(END))).collect()  # HELD_WORDS at most, and the end, which every text has
    return counts, Vocabulary(sorted(((bytes(r.word), r.n) for r in most), key=lambda x: (-x[1], x[0])), total, distinct), limit


_PART = {"block": "int", "tokens": "bigint", "piece": "binary"}


def fitted(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights, trained in all tasks by rounds of averaging."""
    spark, net = docs.sparkSession, vocabulary.network()
    if not vocabulary.total:
        return net.weights
    text = text_column(text_col)
    place = F.xxhash64(F.col(id_col).cast("string"), text)
    whole = docs.where(training(id_col)).select(place.alias("place"), text.cast("binary").alias("text"))
    turns = ROUNDS if vocabulary.total > LEAST_TOKENS else 1  # rounds of one reading
    rounds = ROUNDS * turns
    replicas = int(min(REPLICAS, max(1, vocabulary.total // (turns * REPLICA_TOKENS))))
    kind = spark_schema(*_PART.items())
    words_sent = spark.sparkContext.broadcast(vocabulary)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(net.weights)

        def trained(batches, start=start, rate=RATE * (1 - k / rounds)) -> Iterator[pa.RecordBatch]:
            own = words_sent.value
            reader, trainer, tokens = Reader(own), Trainer(own.network(start.value), rate), 0
            for chunk in _chunks(batches):
                docs = reader.all_network_numbers(chunk.column("text"))
                trainer.train(docs)
                tokens += sum(map(len, docs))
            if tokens:
                flat = trainer.net.weights
                blocks = range(-(-len(flat) // BLOCK))
                columns = [pa.array(blocks, pa.int32()), pa.array([tokens] * len(blocks), pa.int64()), pa.array([flat[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=list(_PART))

        dealt = whole.where(F.pmod("place", F.lit(turns)) == k % turns).repartition(replicas, "place").sortWithinPartitions("place").select("text")
        parts = dealt.mapInArrow(trained, kind)
        blocks = sorted((r.block, bytes(r.piece)) for r in mapped(parts.repartition("block").sortWithinPartitions("block"), _mean, kind).collect())
        if blocks:
            net.weights[:] = np.frombuffer(b"".join(piece for _, piece in blocks), np.float32)
        start.unpersist()
    words_sent.unpersist()
    return net.weights


def _mean(batches) -> Iterator[pa.RecordBatch]:
    """The mean of each block, weighted by words: a row of each replica at most."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for block, tokens, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen, total = sums.get(block, (0, 0.0))
            sums[block] = seen + tokens, total + np.frombuffer(piece, np.float32).astype(np.float64) * tokens
    columns = [pa.array(sums.keys(), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([(s / n).astype(np.float32).tobytes() for n, s in sums.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=list(_PART))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the model is trained unless weights are given."""
    spark = docs.sparkSession
    counts, vocabulary, limit = counted(docs, id_col, text_col)
    if weights is None:
        weights = fitted(docs, vocabulary, id_col, text_col)
    model, key = spark.sparkContext.broadcast((vocabulary, weights)), uuid.uuid4().hex
    own_id = docs.schema[id_col].dataType
    schema = spark_schema(("row", "bigint"), ("id", own_id.simpleString()), ("held_out", "boolean"), ("n_tokens", "bigint"), ("held", "bigint"), ("rare", "bigint"), ("base", "double"), ("score", "double"), ("others", "array<binary>"), ("times", "array<bigint>"))

    def scoring(batches) -> Iterator[pa.RecordBatch]:
        reader, net, given, logs = held(("recurrent", key), lambda: _ready(*model.value))
        number, none = TaskContext.get().partitionId() << 33, len(logs) - 1  # the last logarithm is 0, of words that are not held
        for chunk in _chunks(batches):
            docs, others, times = reader.all_numbers(chunk.column("text"))
            found = scores(net, [reader.narrowed(n) for n in docs], given) / np.log(10)
            lengths, flat = np.array([len(n) for n in docs]), np.concatenate(docs)
            starts = np.append(0, np.cumsum(lengths)[:-1])
            total = lambda x, starts=starts: np.add.reduceat(x, starts)
            in_rest, own_logs = (flat < 0) | (flat >= reader.rare), logs.take(np.where(flat < 0, none, flat))
            columns = [
                np.arange(number, number + len(docs)), chunk.column("id"), chunk.column("held_out"), lengths, total((flat >= 0).astype(np.int64)), total(in_rest.astype(np.int64)),
                total(own_logs), found + total(np.where(in_rest, own_logs, 0.0)), others, times,
            ]
            number += len(docs)
            rows = pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)
            for at in range(0, len(docs), 500):
                yield rows.slice(at, 500)

    types = to_arrow_schema(schema)
    read = docs.select(F.col(id_col).alias("id"), (~training(id_col)).alias("held_out"), text_column(text_col).cast("binary").alias("text"))
    rows = stored(mapped(read, scoring, schema))
    others = rows.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
    seldom = counts.where((F.col("n") <= limit) & (F.col("word") != F.lit(END))).select("word", "n")
    sums = others.join(seldom, "word").groupBy("row").agg(F.sum("times").alias("seldom"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_logs, rare_logs = float(np.log10(vocabulary.total + vocabulary.distinct + 1)), float(np.log10(vocabulary.rest))
    return rows.drop("others", "times").join(sums, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("held") + zero("seldom")).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - F.col("n_tokens") * all_logs).alias("base_score"), (F.col("score") + zero("logs") - F.col("rare") * rare_logs).alias("score"),
    )


def _ready(vocabulary: Vocabulary, weights: np.ndarray):
    net = vocabulary.network(weights)
    return Reader(vocabulary), net, net.table(), np.append(np.log10(vocabulary.counts + 1.0), 0.0)


def op11_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document; see the module."""
    return scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
