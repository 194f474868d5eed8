"""Exact encoding and decoding with a merge-type SentencePiece vocabulary (operator 9).

Method. A text is cut where no piece can cross (before a run of the space symbol that follows another symbol, around
characters that only occur as pieces of their own, around characters outside the vocabulary). Each chunk is encoded by
backtracking: an Aho-Corasick pass lists the pieces that start at each position, longest first; a piece is taken if it is
compatible with the piece before it, that is, if merging the two pieces' characters again by the vocabulary's scores gives
just these two pieces; a bitfield holds the positions from which the rest of the chunk can't be encoded, so none is tried
twice. A sequence whose neighbours are all compatible is the only one that merging can give, so the result is exact.
Characters outside the vocabulary become byte pieces.

Cases: null text is read as empty, which encodes to begin and end ids only; rows are independent, so repeats, ties and
empty tables need nothing special; a very long text is encoded chunk by chunk; columns other than the two named are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.common import arrow_batch, held, mapped, table, text_column

SPACE = "▁"
#: Chunks and pairs kept per worker, twice at most.
KEPT_CHUNKS = 200_000
KEPT_PAIRS = 200_000
LONGEST_KEPT = 80

codecs.register_error("bytelore_each_byte", lambda e: ("�", e.start + 1))


class _Kept(dict):
    """A bounded memory of a function's results: what was used since the last turn, and, in `_old`, what was before it."""

    def __init__(self, made, most: int):
        super().__init__()
        self._made, self._most, self._old = made, most, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._made(key)
            if isinstance(key, str) and len(key) > LONGEST_KEPT:
                return value
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder for the vocabulary in a SentencePiece model file of merge (BPE) type."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)  # read for its vocabulary only
        n = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [self.unknown] * 256
        self.surface: list[bytes] = [b""] * n
        self.plain = [False] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
                self.plain[i] = True
        self.characters = {p for p in self.ids if len(p) == 1}
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "\n" if "\n" not in inside else None
        self.cut_at_space = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        # only pieces that merging gives back whole can occur in a result
        stable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self._stable, self._count = stable, n
        self._longest_piece = max(map(len, stable), default=1)
        self._length = [0] * n
        self._text = [""] * n
        self._shorter = [-1] * n  # the longest stable piece that is a proper prefix
        automaton = ahocorasick.Automaton()
        for piece, i in stable.items():
            automaton.add_word(piece, i)
            self._length[i], self._text[i] = len(piece), piece
            self._shorter[i] = next((stable[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in stable), -1)
        automaton.make_automaton()
        self._automaton = automaton
        self._compatible = _Kept(self._check_pair, KEPT_PAIRS)
        self._packed = _Kept(self._pack, KEPT_CHUNKS // 4)
        self._spaced = _Kept(lambda word: self._pack(SPACE + word), KEPT_CHUNKS)

    def _check_pair(self, pair: int) -> bool:
        first, second = self._text[pair // self._count], self._text[pair % self._count]
        return self.merge(first + second) == [first, second]

    def merge(self, text: str) -> list[str]:
        """The definition: join the adjacent pair whose piece scores highest (the leftmost of equals) until none is a piece."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        compatible, count = self._compatible, self._count
        longest = [i for _, i in self._automaton.iter_long(text)]
        before = -1
        for i in longest:
            if before >= 0 and not compatible[before * count + i]:
                break
            before = i
        else:
            return longest  # the longest pieces fit at once; else some of them have to be taken back
        n, length, shorter = len(text), self._length, self._shorter
        dead = bytearray(n // 8 + 1)
        taken: list[int] = []
        at, piece = 0, longest[0]
        while True:
            end = at + length[piece]
            if not dead[end >> 3] >> (end & 7) & 1 and (not taken or compatible[taken[-1] * count + piece]):
                taken.append(piece)
                at = end
                if at == n:
                    return taken
                piece = self._longest(text, at)
                continue
            piece = shorter[piece]
            while piece < 0:
                if not taken:
                    raise ValueError("no sequence of pieces covers the text")
                dead[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= length[last]
                piece = shorter[last]

    def _longest(self, text: str, at: int) -> int:
        part = text[at : at + self._longest_piece]
        part = part[: self._automaton.longest_prefix(part)]  # a prefix of some piece, at least as long as any piece here
        while part not in self._stable:
            part = part[:-1]
        return self._stable[part]

    def _pack(self, chunk: str) -> bytes:
        ids: list[int] = []
        known = self.characters
        if known.issuperset(chunk):
            return struct.pack(f"<{len(found := self.backtrack(chunk))}I", *found)
        start = 0
        for i, c in enumerate(chunk):
            if c not in known:
                ids += self.backtrack(chunk[start:i]) if i > start else []
                ids += [self.byte_ids[b] for b in c.encode()]
                start = i + 1
        if start < len(chunk):
            ids += self.backtrack(chunk[start:])
        return np.array(ids, "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = " " + (text.replace(SPACE, " ") if SPACE in text else text)
        lines = text.split(self.alone) if self.alone else [text]
        newline = self._packed[self.alone] if self.alone else b""
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append(newline)
            if not line:
                continue
            if not self.cut_at_space:
                out.append(self._packed[line.replace(" ", SPACE)])
            elif "  " not in line and line[-1] != " ":
                first, *words = line.split(" ")
                if first:
                    out.append(self._packed[first])
                out += map(self._spaced.__getitem__, words)
            else:
                out += map(self._packed.__getitem__, _cut(line.replace(" ", SPACE)))
        return b"".join(out)

    def encode(self, text: str, begin: bool = True, end: bool = True) -> list[int]:
        ids = np.frombuffer(self.packed(text), "<u4").tolist()
        return [self.begin] * begin + ids + [self.end] * end

    def decode(self, ids: list[int]) -> str:
        """Text of ids; a byte that is not part of a valid character becomes U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if raw[:1] == b" ":
            first = next((i for i in ids if self.surface[i]), None)
            if first is not None and self.plain[first]:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "bytelore_each_byte")


def _cut(line: str) -> list[str]:
    """Runs of the space symbol with what follows them up to the next one."""
    out, start, n = [], 0, len(line)
    while start < n:
        i = start
        while i < n and line[i] == SPACE:
            i += 1
        j = line.find(SPACE, i)
        j = n if j < 0 else j
        out.append(line[start:j])
        start = j
    return out


def codec(model_file: str) -> PieceCodec:
    """One codec for each worker process."""
    return held(("pieces", model_file), lambda: PieceCodec(model_file))


def piece_ids(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids (begin and end included) and the text decoded from them: (id, ids array<int>, decoded string)."""

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield arrow_batch({id_col: (batch.column(0), pa.int64()), "ids": (ids, pa.list_(pa.int32())), "decoded": ([own.decode(x) for x in ids], pa.string())})

    return mapped(df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")), run, f"{id_col} long, ids array<int>, decoded string")


def piece_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `piece_ids`, but only the number of ids and digests leave the worker: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        own = codec(model_file)
        begin, end = (np.array([x], "<u4").tobytes() for x in (own.begin, own.end))
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                packed = begin + own.packed(text) + end
                count.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(own.decode(np.frombuffer(packed, "<u4").tolist()).encode()).hexdigest())
            yield arrow_batch({id_col: (batch.column(0), pa.int64()), "n_tokens": (count, pa.int64()), "ids_sha256": (of_ids, pa.string()), "decoded_sha256": (of_text, pa.string())})

    return mapped(df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")), run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    """The installed vocabulary file; never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), model_path())
