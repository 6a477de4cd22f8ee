"""Token ids in patched frame-of-reference files.

Documents are dealt by ranges of doc_id and sorted, encoded in the tasks, and packed into
segments of about ``SEGMENT_IDS`` ids. A document is never cut, so a segment ends at the first
document that fills it. Segments are rows of a Parquet table (the files Spark can write to and
read from any store); the ``data`` column of a row is one segment in the format below. A small
index table holds the first position of every segment, and the header of a segment holds the
documents and the start of every block, so one document can be read without the rest.

Segment: 8 header numbers (uint32: magic, version, documents, ids, block length, blocks, packed
words, exceptions), then little-endian arrays:

    doc_len   uint32[documents]   ids of each document
    minimum   uint32[blocks]      smallest id of each block (the frame of reference)
    width     uint8[blocks]       bits of a packed value
    start     uint32[blocks + 1]  index: first packed word of each block
    ex_start  uint32[blocks + 1]  index: first exception of each block
    packed    uint32[words]       id - minimum, ``width`` bits each; exceptions hold their low bits
    ex_at     uint16[exceptions]  place in the block
    ex_high   uint32[exceptions]  the bits above ``width``

The width of a block fits its ``percentile`` smallest values; larger values are exceptions.

Defined cases: a null text counts as empty (the end id alone); rows are ordered by doc_id (nulls
first), then by text bytes, so repeated rows follow each other; an empty table gives no segment;
extra columns are ignored; ids need 32 bits at most.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightperf.llm.common import per_process, small_batches, text_bytes

MAGIC, VERSION = 0x50464F52, 1
BLOCK = 1024
PERCENTILE = 90
SEGMENT_IDS = 1 << 19
CACHE_WORDS = 900_000     # words a worker keeps the ids of; full, it starts anew
CACHE_LETTERS = 40        # longer words are not kept


# --- the format --------------------------------------------------------------------

def _bits(v: np.ndarray) -> np.ndarray:
    """Bits needed by each uint32 value."""
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, block length) uint32 values of ``width`` bits -> (blocks, words) uint32."""
    n, length = values.shape
    groups = values.reshape(n, length // 32, 32)
    out = np.zeros((n, length // 32, width), dtype=np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, :, word] |= groups[:, :, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= groups[:, :, i] >> np.uint32(32 - shift)
    return out.reshape(n, -1)


def _unpack(words: np.ndarray, width: int, length: int) -> np.ndarray:
    n = len(words)
    groups = words.reshape(n, length // 32, width)
    out = np.zeros((n, length // 32, 32), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        v = groups[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            v = v | (groups[:, :, word + 1] << np.uint32(32 - shift))
        out[:, :, i] = v & mask
    return out.reshape(n, length)


def pack_segment(ids: np.ndarray, doc_len: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """uint32 ids of whole documents -> one segment."""
    n_blocks = -(-len(ids) // block)
    full = np.empty(n_blocks * block, dtype=np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[-1] if len(ids) else 0       # the last block is padded with its last id
    full = full.reshape(n_blocks, block)
    low = full.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    need = _bits(rest)
    rank = max(0, -(-block * percentile // 100) - 1)
    width = np.partition(need, int(rank), axis=1)[:, int(rank)] if n_blocks else np.zeros(0, np.uint8)
    at = need > width[:, None]
    ex_block, ex_at = np.nonzero(at)
    ex_high = (rest[at].astype(np.uint64) >> width[ex_block].astype(np.uint64)).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * block // 32)]).astype(np.uint32)
    ex_start = np.concatenate([[0], np.cumsum(at.sum(axis=1))]).astype(np.uint32)
    packed = np.zeros(int(start[-1]), dtype=np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if not w:
            continue
        words = _pack(rest[own] & np.uint32((1 << int(w)) - 1), int(w))
        packed[start[own][:, None].astype(np.int64) + np.arange(words.shape[1])] = words
    head = np.array([MAGIC, VERSION, len(doc_len), len(ids), block, n_blocks, len(packed), len(ex_at)], dtype="<u4")
    return b"".join(x.tobytes() for x in (
        head, doc_len.astype("<u4"), low.astype("<u4"), width.astype("u1"), start.astype("<u4"),
        ex_start.astype("<u4"), packed.astype("<u4"), ex_at.astype("<u2"), ex_high.astype("<u4")))


@dataclass
class Segment:
    doc_len: np.ndarray
    n_ids: int
    block: int
    low: np.ndarray
    width: np.ndarray
    start: np.ndarray
    ex_start: np.ndarray
    packed: np.ndarray
    ex_at: np.ndarray
    ex_high: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> "Segment":
        head = np.frombuffer(data, "<u4", 8)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a token segment of this version")
        n_docs, n_ids, block, n_blocks, n_words, n_ex = map(int, head[2:])
        at, arrays = 32, []
        for kind, n in (("<u4", n_docs), ("<u4", n_blocks), ("u1", n_blocks), ("<u4", n_blocks + 1),
                        ("<u4", n_blocks + 1), ("<u4", n_words), ("<u2", n_ex), ("<u4", n_ex)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        return cls(arrays[0], n_ids, block, *arrays[1:])

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``first`` up to ``end``; only the blocks that hold them are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if first >= end:
            return np.zeros(0, np.uint32)
        b0, b1 = first // self.block, (end - 1) // self.block + 1
        width = self.width[b0:b1]
        out = np.zeros((b1 - b0, self.block), dtype=np.uint32)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            if w:
                n = int(w) * self.block // 32
                words = self.packed[self.start[b0 + own][:, None].astype(np.int64) + np.arange(n)]
                out[own] = _unpack(words, int(w), self.block)
        e0, e1 = int(self.ex_start[b0]), int(self.ex_start[b1])
        ex_block = np.repeat(np.arange(b1 - b0), np.diff(self.ex_start[b0:b1 + 1].astype(np.int64)))
        out[ex_block, self.ex_at[e0:e1]] |= self.ex_high[e0:e1] << width[ex_block].astype(np.uint32)
        out += self.low[b0:b1, None]
        return out.reshape(-1)[first - b0 * self.block:end - b0 * self.block]


# --- encoding ----------------------------------------------------------------------

# Small letters of Latin-1 (UTF-8): already lower-cased and composed, and one piece together.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
# Byte-level models write a byte as a letter: printable Latin-1 as it is, the others from U+0100 on.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_UNPRINTED)}


class WordIds(dict):
    """word (bytes) -> its ids as little-endian uint32 bytes, filled through the tokenizer.

    White space separates words for this tokenizer (it is dropped, no merge crosses it), so the
    ids of a text are those of its words in turn. It lower-cases, and letters and punctuation are
    separate pieces to it, so "The," meets "the" and ","; ``splits_at_space`` checks the vocabulary
    file. A word of small Latin-1 letters is one piece: it goes to the tokenizer's model as its bytes.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.pieces = tokenizer.encode, tokenizer.model.tokenize

    def ids(self, text: bytes) -> bytes:
        # special tokens are found before lower-casing
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: bytes) -> bytes:
        if word[-1:] in b".," and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        elif _PLAIN.fullmatch(word):
            ids = np.array([t.id for t in self.pieces(word.decode("latin-1").translate(_BYTE_LEVEL))], dtype="<u4").tobytes()
        else:
            ids = np.array(self.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(word) <= CACHE_LETTERS:
            self[word] = ids
        return ids


# Fixed value: the split pattern of the public word-level vocabulary.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(tokenizer_json: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space between pieces, parts letters from
    punctuation and does nothing across words."""
    spec = json.loads(tokenizer_json)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = steps[0]
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") \
        and not steps[1].get("use_regex")
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True \
        and (split.get("pattern") or {}).get("Regex") == _SPLIT
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    known = [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"]
    added = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or " " in a["content"])
                for a in spec.get("added_tokens", []))
    return bool(drops and byte_level and known and added and not spec.get("post_processor"))


def encoder(tokenizer_json: str):
    """text bytes -> ids as little-endian uint32 bytes (no special tokens added)."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one task, one thread
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(tokenizer_json)
    if splits_at_space(tokenizer_json):
        return WordIds(tokenizer).ids
    return lambda text: np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids,
                                 dtype="<u4").tobytes()


# --- write and read ----------------------------------------------------------------

def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, block: int = BLOCK,
                      percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write ``path``/segments and ``path``/index."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())   # a vocabulary file: of fixed size
    held = f"word_ids_{zlib.crc32(spec.value.encode())}"
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches):
        encode = per_process(held, lambda: encoder(spec.value))
        ids, lens, doc_ids, n, no = [], [], [], 0, 0
        for b in small_batches(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if n >= segment_ids:
                    yield _segment(doc_ids, ids, lens, no, block, percentile)
                    ids, lens, doc_ids, n, no = [], [], [], 0, no + 1
                one = encode(text.as_py()) + end
                ids.append(one)
                lens.append(len(one) // 4)
                doc_ids.append(doc_id)
                n += lens[-1]
        if lens:
            yield _segment(doc_ids, ids, lens, no, block, percentile)

    rows = docs.select("doc_id", text_bytes().alias("bytes"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "bytes")
     .mapInArrow(segments, "part int, segment int, first_id long, n_docs int, n_ids long, doc_ids array<long>, data binary")
     .write.parquet(f"{path}/segments"))
    _write_index(spark, path)


def _segment(doc_ids, ids, lens, no, block, percentile):
    from pyspark import TaskContext
    data = pack_segment(np.frombuffer(b"".join(ids), "<u4"), np.array(lens, dtype=np.uint32), block, percentile)
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([no], pa.int32()),
         pa.array([doc_ids[0]], pa.int64()), pa.array([len(lens)], pa.int32()),
         pa.array([int(np.sum(lens, dtype=np.int64))], pa.int64()),
         pa.array([doc_ids], pa.list_(pa.int64())), pa.array([data], pa.binary())],
        names=["part", "segment", "first_id", "n_docs", "n_ids", "doc_ids", "data"])


def _write_index(spark: SparkSession, path: str) -> None:
    """The first position of every segment: a running sum over the parts (one row a part), then
    one inside each part. Range parts follow each other in their number."""
    seg = spark.read.parquet(f"{path}/segments").select("part", "segment", "first_id", "n_docs", "n_ids")
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    (seg.join(before, "part").select("part", "segment", "first_id", "n_docs", "n_ids",
                                     (F.col("before") + inside).alias("start"))
     .write.parquet(f"{path}/index"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document in the files."""
    def docs(batches):
        for b in batches:
            for row in b.to_pylist():
                seg = Segment.parse(row["data"])
                ids = seg.ids()
                off = np.concatenate([[0], np.cumsum(seg.doc_len, dtype=np.int64)])
                for at in range(0, len(seg.doc_len), 512):
                    to = min(at + 512, len(seg.doc_len))
                    cut = pa.array((off[at:to + 1] - off[at]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][at:to], pa.int64()), pa.array(row["start"] + off[at:to]),
                         pa.ListArray.from_arrays(cut, pa.array(ids[off[at]:off[to]].view(np.int32)))],
                        names=["doc_id", "start", "ids"])

    return _with_start(spark, path).mapInArrow(docs, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' own bytes."""
    def docs(batches):
        for b in batches:
            for row in b.to_pylist():
                seg = Segment.parse(row["data"])
                raw = memoryview(seg.ids().astype("<u4").tobytes())
                off = np.concatenate([[0], np.cumsum(seg.doc_len, dtype=np.int64)])
                ends = (off * 4).tolist()
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + off[:-1]),
                     pa.array(seg.doc_len.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_start(spark, path).mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    seg = spark.read.parquet(f"{path}/segments").select("part", "segment", "doc_ids", "data")
    index = spark.read.parquet(f"{path}/index").select("part", "segment", "start")
    return seg.join(index, ["part", "segment"]).select("doc_ids", "start", "data")
