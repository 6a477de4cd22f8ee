"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a one-pass Viterbi.

The automaton holds every ordinary piece. Walking a word once, it gives at each end position all
pieces that end there (its output links); each relaxes the best score of that position from the
best score at its start. The segmentation with the largest sum of piece scores is read back from
the end. A letter that is no piece costs the lowest score less ``UNKNOWN_BELOW`` and becomes its
UTF-8 byte pieces (or the unknown id when the vocabulary has no byte pieces).

A vocabulary without pieces that continue past a space mark lets the text be cut before each
mark: every word is solved alone and kept by a bounded cache. Otherwise the whole text is one
word. At equal scores the longest last piece wins.

Normalisation is that of the model (its own normaliser), with the space mark U+2581.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each; very long words are solved by the same pass without being kept; extra columns are
ignored by ``encode``. The decoded text equals the normalised text, marks turned into spaces and
the added first space dropped; letters outside the vocabulary survive through byte pieces.
"""

from __future__ import annotations

import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightperf.llm.common import per_process, small_batches

MARK = "▁"
_MARK = MARK.encode()
UNKNOWN_BELOW = 10.0
CACHE_WORDS = 200_000
CACHE_LETTERS = 48


class _Held(dict):
    """key of a word -> its ids, solved when first asked for; only short words are kept."""

    def __init__(self, model: "PieceModel"):
        super().__init__()
        self.model = model

    def __missing__(self, key: bytes) -> bytes:
        word = key[1:].decode() if key[:1] == b" " else MARK + key.decode()
        ids = np.array(self.model.best(word)[0], dtype="<i4").tobytes()
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(key) <= CACHE_LETTERS:
            self[key] = ids
        return ids


class PieceModel:
    """Pieces, scores and normaliser of a SentencePiece model file (its bytes)."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = sp.normalize
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.unknown = sp.unk_id()
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.auto = ahocorasick.Automaton()
        low = 0.0
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or not p:
                continue
            self.auto.add_word(p, (len(p), i, sp.get_score(i)))
            low = min(low, sp.get_score(i))
        self.auto.make_automaton()
        self.letters = {p for p in self.pieces if len(p) == 1 and self.auto.exists(p)}
        self.unknown_score = low - UNKNOWN_BELOW
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.auto.keys())
        byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.table = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.held = _Held(self)
        self.worth = np.array([sp.get_score(i) for i in range(len(sp))])
        self.worth[self.unknown] = self.unknown_score
        for b, i in self.byte_id.items():
            self.worth[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown_score

    # --- encode

    def best(self, word: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of a normalised word."""
        n = len(word)
        score = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        odd = [] if self.letters.issuperset(word) else [i for i, c in enumerate(word) if c not in self.letters]
        at = 0
        for end, (length, piece, s) in self.auto.iter(word):
            while at < len(odd) and odd[at] <= end:
                self._step_over(score, back, odd[at])
                at += 1
            start = end + 1 - length
            new = score[start] + s
            if new > score[end + 1]:
                score[end + 1] = new
                back[end + 1] = (start, piece)
        for i in odd[at:]:
            self._step_over(score, back, i)
        ids: list[int] = []
        while n:
            start, piece = back[n]
            if piece < 0 or piece == self.unknown:
                raw = word[start:n].encode()
                ids.extend([self.byte_id[b] for b in reversed(raw)] if self.byte_id else [self.unknown])
            else:
                ids.append(piece)
            n = start
        return ids[::-1], float(score[-1])

    def _step_over(self, score, back, i):
        new = score[i] + self.unknown_score
        if new > score[i + 1]:
            score[i + 1] = new
            back[i + 1] = (i, self.unknown)

    def words(self, text: str) -> list[bytes]:
        """The normalised text cut before each run of marks that follows a letter, as keys: the bytes
        of a word with one mark, or a space and the whole word (a space is never left in a text)."""
        t = self.normalize(text)
        if not self.by_word or not t:
            return [b" " + t.encode()] if t else []
        parts = t.encode().split(_MARK)
        if all(parts[1:]):                              # single marks only
            return parts[1:] if not parts[0] else [b" " + parts[0], *parts[1:]]
        out, marks = ([b" " + parts[0]] if parts[0] else []), 0
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(p if marks == 1 else b" " + _MARK * marks + p)
                marks = 0
        if marks:
            out.append(b" " + _MARK * marks)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32 bytes."""
        return b"".join(map(self.held.__getitem__, self.words(text)))

    def score(self, ids: np.ndarray) -> float:
        """The score of encoded ids: a letter outside the vocabulary counts at its first byte."""
        return float(self.worth[ids].sum())

    # --- decode

    def decode(self, ids) -> str:
        """Text of ids: byte pieces joined to letters, marks to spaces, the added first space dropped."""
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _model(spec):
    return per_process(f"pieces_{zlib.crc32(spec.value)}", lambda: PieceModel(spec.value))


def _broadcast(docs: DataFrame, model_file: str):
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())   # a vocabulary file: of fixed size


def _encoded(model: PieceModel, batch, keys: tuple[str, ...]):
    """A batch of (keys..., text) -> keys, ids, n_ids, score."""
    ids = [model.encode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
    scores = [model.score(np.frombuffer(x, "<i4")) for x in ids]
    lens = np.array([len(x) // 4 for x in ids], dtype=np.int32)
    cut = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    flat = np.frombuffer(b"".join(ids), "<i4")
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), pa.array(lens),
         pa.array(scores, pa.float64())], names=[*keys, "ids", "n_ids", "score"])


def _decoded(model: PieceModel, batch, at: int):
    """A batch with ids in column ``at`` -> the same with the texts of the ids at its end."""
    texts = []
    for x in batch.column(at):
        texts.append(model.decode(x.values.to_numpy().tolist()) if x.is_valid else "")
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def _picked(docs: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, T.StructType]:
    """The rows that are encoded and the schema of what they become."""
    picked = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    return picked, picked.select(*keys).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "integer").add("score", "double")


def encode(docs: DataFrame, model_file: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., text) -> keys, ids array<int>, n_ids, score of the segmentation."""
    spec = _broadcast(docs, model_file)
    picked, schema = _picked(docs, keys)

    def run(batches):
        model = _model(spec)
        for b in small_batches(batches):
            yield _encoded(model, b, keys)

    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Rows with an ``ids`` column, each with its ``decoded`` text added (an old one is replaced)."""
    spec = _broadcast(encoded, model_file)
    rows = encoded.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    at = rows.columns.index("ids")

    def run(batches):
        model = _model(spec)
        for b in small_batches(batches):
            yield _decoded(model, b, at)

    return rows.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model_file: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` followed by ``decode``: keys, ids, n_ids, score, decoded. Both take a batch in turn in one
    Python worker: in two steps each task would hold two workers, each with a model and a cache of its own."""
    spec = _broadcast(docs, model_file)
    picked, schema = _picked(docs, keys)
    at = len(keys)

    def run(batches):
        model = _model(spec)
        for b in small_batches(batches):
            yield _decoded(model, _encoded(model, b, keys), at)

    return picked.mapInArrow(run, schema.add("decoded", "string"))
