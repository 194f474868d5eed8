"""Language identification by a byte convolutional network (operator 10).

Method. Lower-cased UTF-8 bytes, with ASCII characters other than letters read as blanks, are cut into windows of WINDOW
bytes, all of a text, the last one padded with zeros. Filters of widths 2, 3 and 4 slide over the bytes; the largest
activation of each filter in a window, rectified, feeds a softmax over the languages. A text's probabilities are the mean
over its windows, weighted by their bytes. The network is trained in numpy (Adam, equal shares of each language in a
batch) on a sample of at most TRAIN_ROWS labelled rows, chosen by a hash of the id, and WINDOWS_EACH windows of each.
For prediction, the filters are folded into one table by byte pairs, and windows are taken in batches.

Only rows with crc32(id as text) mod 4 other than 2 and a language are learnt from; language, source and id are no inputs.

Cases: a text that is null or has no letter gets `und` with score 0, as does every text if there is no labelled row;
repeated rows and equal texts are judged alike; of a very long text all windows are judged, some at a time; of many rows under
one id in the sample, no more than TRAIN_ROWS are learnt from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelore.llm.common import mapped, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
REACH = max(WIDTHS) - 1
#: The most labelled rows that the network is fitted on, and the most windows of each; both only bound the training.
TRAIN_ROWS = 2000
WINDOWS_EACH = 4
STEPS, BATCH, RATE = 500, 64, 0.02
BATCH_BYTES = 1 << 17

_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class ByteNetwork:
    """Filters as one table per offset: weights[k] has a row of filters for each byte at offset k."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 7) -> ByteNetwork:
        """windows: rows of WINDOW + REACH bytes."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        params = [*self.filters, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            rows = np.concatenate([rng.choice(r, -(-BATCH // len(by_label))) for r in by_label])
            x, y = windows[rows], labels[rows]
            pooled, at = [], []
            for f in self.filters:
                act = sum(f[k][x[:, k : k + WINDOW]] for k in range(len(f)))
                at.append(act.argmax(1))
                pooled.append(np.take_along_axis(act, at[-1][:, None, :], 1)[:, 0])
            top = np.concatenate(pooled, 1) + self.bias
            hidden = np.maximum(top, 0)
            z = hidden @ self.out + self.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ self.out.T) * (top > 0)
            grads = []
            for j, f in enumerate(self.filters):
                g = np.zeros_like(f)
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(f)):
                    np.add.at(g[k], (x[np.arange(len(x))[:, None], at[j] + k], np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
        return self

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """(table by byte pair: width 2, first two of width 3, first and last two of width 4; table by byte: last of width 3)."""
        a, b, c = self.filters
        pair = lambda f, k: (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(a, 0), pair(b, 0), pair(c, 0), pair(c, 2)], 1), b[2].copy()


class Predictor:
    def __init__(self, network: ByteNetwork):
        self.network = network
        self.pairs, self.singles = network.folded()

    def windows(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probabilities of the windows of zero-padded bytes, of which each sees REACH bytes more but for a text's last ones."""
        net, n = self.network, len(flat) - REACH
        k = FILTERS
        codes = flat[:-1].astype(np.int32) << 8 | flat[1:]
        act = self.pairs[codes]
        use = np.empty((n, 3 * k), np.float32)
        use[:, : 2 * k] = act[:n, : 2 * k]
        use[:, k : 2 * k] += self.singles[flat[2 : n + 2]]
        np.add(act[:n, 2 * k : 3 * k], act[2 : n + 2, 3 * k :], out=use[:, 2 * k :])
        use = use.reshape(n // WINDOW, WINDOW, 3 * k)
        use[last, -REACH:] = -np.inf  # what starts there would reach into the next text
        top = use.max(1)
        z = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores."""
        languages, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo, size = [], 0
        for i, text in enumerate(texts):
            if has_letter(text):
                todo.append((i, _bytes(text)))
                size += len(todo[-1][1])
                if size >= BATCH_BYTES:
                    self._batch(todo, languages, scores)
                    todo, size = [], 0
        if todo:
            self._batch(todo, languages, scores)
        return languages, scores

    def _batch(self, todo: list[tuple[int, bytes]], languages: list[str], scores: list[float]) -> None:
        padded = [d + bytes(-(len(d) + REACH) % WINDOW + REACH) for _, d in todo]
        flat = np.frombuffer(b"".join(padded) + bytes(REACH), np.uint8)
        counts = np.array([len(x) // WINDOW for x in padded])
        ends = np.cumsum(counts) - 1
        parts, step = [], 512
        for at in range(0, ends[-1] + 1, step):  # a very long text takes no more memory than a batch
            here = ends[(ends >= at) & (ends < at + step)] - at
            parts.append(self.windows(flat[at * WINDOW : (at + step) * WINDOW + REACH], here))
        p = np.concatenate(parts)
        owner = np.repeat(np.arange(len(todo)), counts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        inside = np.arange(len(owner)) - begin[owner]
        size = np.array([len(d) for _, d in todo])
        weight = np.clip(size[owner] - inside * WINDOW, 0, WINDOW).astype(np.float64)
        total = np.zeros((len(todo), p.shape[1]))
        np.add.at(total, owner, p * weight[:, None])
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for row, (i, _) in enumerate(todo):
            languages[i], scores[i] = self.network.languages[best[row]], float(min(1.0, total[row, best[row]]))


def learnable(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def sample_windows(text: str) -> list[bytes]:
    """WINDOWS_EACH windows of a text at most, spread over all of it."""
    data = _bytes(text)
    data += bytes(-(len(data) + REACH) % WINDOW + REACH)
    n = len(data) // WINDOW
    data += bytes(REACH)
    return [data[k * WINDOW : (k + 1) * WINDOW + REACH] for k in sorted({round(j * (n - 1) / max(1, WINDOWS_EACH - 1)) for j in range(WINDOWS_EACH)})]


def training_windows(rows: list[tuple[list[bytes], str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows as rows of bytes, the number of each one's language, and the languages."""
    languages = sorted({lang for _, lang in rows})
    both = [(np.frombuffer(w, np.uint8), languages.index(lang)) for windows, lang in rows for w in windows]
    return np.array([w for w, _ in both]), np.array([k for _, k in both]), languages


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork | None:
    """The network fitted on a bounded sample of the labelled rows; None if there are none.

    The sample is chosen by ids alone; then its rows' windows are cut in the tasks, and TRAIN_ROWS of them go to the driver.
    """
    known = df.where(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = [r[0] for r in known.select(id_col).orderBy(order, id_col).limit(TRAIN_ROWS).collect()]
    if not ids:
        return None
    chosen = known.where(F.col(id_col).isin(ids)).select(order.alias("a"), F.col(id_col).cast("long").alias("b"), F.xxhash64(text_col).alias("c"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            windows = pa.array([sample_windows(t) if has_letter(t) else [] for t in texts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], windows, batch.column(4)], names=["a", "b", "c", "windows", "lang"])

    cut = mapped(chosen, run, "a long, b long, c long, windows array<binary>, lang string").orderBy("a", "b", "c", "lang").limit(TRAIN_ROWS)
    rows = [([bytes(w) for w in r.windows], r.lang) for r in cut.collect() if r.windows]
    if not rows:
        return None
    windows, labels, languages = training_windows(rows)
    return ByteNetwork(languages).fit(windows, labels)


@lru_cache(maxsize=2)
def _predictor(packed: bytes) -> Predictor:
    return Predictor(pickle.loads(packed))


def with_language(df: DataFrame, network: ByteNetwork | None, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The same rows with two columns added, which take the place of columns of these names."""
    kept = [c for c in df.columns if c not in (lang_pred, score)]
    df = df.select(*kept)
    if network is None:
        return df.withColumns({lang_pred: F.lit("und"), score: F.lit(0.0)})
    packed, at = pickle.dumps(network), kept.index(text_col)

    def run(batches):
        own = _predictor(packed)
        for batch in batches:
            languages, scores = own.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_pred, score])

    return mapped(df, run, T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def least_score(df: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lost: float = 1e-4) -> float:
    """The score, in hundredths, under which lies at most a share of `lost` of the labelled rows with letters that were held out."""
    if network is None:
        return 0.0
    held = df.where(~learnable(id_col) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"))
    scored = with_language(held, network).where("lang_pred <> 'und'")
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()  # 101 at most
    below, allowed = 0, lost * sum(r.n for r in bins)
    for r in bins:
        below += r.n
        if below > allowed:
            return r.bin / 100
    return 0.0


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
