"""SimHash near-duplicates found through a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most ``k`` bits
differ in at most ``k`` bytes, so they share at least ``8 - k`` positional bytes: the guaranteed
minimum. A posting list holds the distinct fingerprints that agree on one choice of ``8 - k``
positions (a single byte would be far too common a key). Within a list the shared positional
bytes of each pair are tallied, pairs that reach the minimum are kept, and the bit distance is
verified. A pair is reported from one list only: that of its first ``8 - k`` shared positions.

A list longer than ``LIST_MAX`` is not paired up. Its fingerprints are handled exactly by
midpoints: two fingerprints within ``k`` bits have a common neighbour ``z`` within ``ceil(k/2)``
bits of one and ``floor(k/2)`` of the other, so linking everything near ``z`` to one fingerprint
near ``z`` keeps every connection, with rows linear in the list.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like
any other; equal fingerprints are one node, however many rows hold it; a null doc_id never names
a component unless all ids of the component are null; repeated rows each get a result row; extra
columns are ignored by ``components`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import fresh, rows_digest, small_batches, text_bytes, written

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
LIST_MAX = 1024


# --- fingerprints ------------------------------------------------------------------

def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit value whose bits are set in over half of ``hashes`` (uint64)."""
    n = len(hashes)
    if not n:
        return 0
    rows = np.zeros(-(-n // 255) * 255, dtype="<u8")
    rows[:n] = hashes
    rows = rows.reshape(-1, 255)
    counts = np.empty((8, 8), dtype=np.int64)          # [bit within the byte, byte]
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        # each byte of the sum counts up to 255 rows, so no byte carries into the next
        sums = ((rows >> np.uint64(bit)) & lanes).sum(axis=1, dtype="<u8")
        counts[bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    over = counts * 2 > n
    return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if over[bit, byte])


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: majority bits of the XXH64 of its word shingles."""
    words = text.lower().split()                      # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        hashes = np.fromiter((digest(joined[a + 1:b], SEED) for a, b in zip(ends, ends[width:])),
                             dtype=np.uint64, count=len(words) - width + 1)
    return majority_bits(hashes)


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def with_fingerprint(keyed: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(key columns..., bytes) -> (key columns..., fp): the last column holds the text's bytes."""
    keys = keyed.columns[:-1]
    schema = keyed.select(*keys).schema.add("fp", "long", False)

    def run(batches):
        for b in small_batches(batches):
            fps = _signed([fingerprint(x.as_py(), width) for x in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*keys, "fp"])

    return keyed.mapInArrow(run, schema)


# --- inverted index ----------------------------------------------------------------

def _choices(max_bits: int) -> list[tuple[int, ...]]:
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: beyond that no positional byte need agree")
    return list(combinations(range(8), 8 - max_bits))


def postings(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(fp) -> (list_id, key, fp): one posting for each choice of positions."""
    choices = _choices(max_bits)

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            parts = fp.view(np.uint64)
            for k, chosen in enumerate(choices):
                mask = np.uint64(sum(0xFF << (8 * p) for p in chosen))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), k, dtype=np.int16)), pa.array((parts & mask).view(np.int64)),
                     pa.array(fp)], names=["list_id", "key", "fp"])

    return nodes.select("fp").mapInArrow(run, "list_id short, key long, fp long")


def list_pairs(fps: np.ndarray, chosen: tuple[int, ...], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of one posting list (distinct fingerprints, uint64), each from its own list."""
    by_byte = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    a, b = np.triu_indices(len(fps), 1)
    shared = by_byte[a] == by_byte[b]
    enough = shared.sum(axis=1) >= 8 - max_bits       # the tally against the guaranteed minimum
    # the list of the first shared positions reports the pair: all shared positions up to the
    # last chosen one are chosen
    own = shared[:, :chosen[-1] + 1].sum(axis=1) == len(chosen) if chosen else np.ones(len(a), bool)
    a, b = a[enough & own], b[enough & own]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
    return fps[a[near]], fps[b[near]]


def _runs(batches, n_keys: int, longest: int):
    """Of rows sorted by their first ``n_keys`` columns: (key, values, over) for each run of two or
    more rows; a run over ``longest`` comes in pieces (over is True), each started by the run's first row."""
    key, held, over, first = None, [], False, None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        values = np.column_stack([b.column(i).to_numpy(zero_copy_only=False)
                                  for i in range(n_keys, b.num_columns)])
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        singles = np.diff(starts) == 1
        last = len(starts) - 2
        for i in range(last + 1):
            # a run of one row inside the batch needs no further look
            if 0 < i < last and singles[i]:
                if key is not None and len(held) and (over or sum(map(len, held)) > 1):
                    yield key, np.concatenate(held), over, first
                key, held = None, []
                continue
            s, e = starts[i], starts[i + 1]
            if e == s:
                continue
            k = tuple(int(c[s]) for c in cols)
            if k != key:
                if key is not None and len(held) and (over or sum(map(len, held)) > 1):
                    yield key, np.concatenate(held), over, first
                key, held, over, first = k, [], False, values[s]
            held.append(values[s:e])
            if sum(map(len, held)) > longest:
                yield key, np.concatenate(held), True, first
                held, over = [], True
    if key is not None and len(held) and (over or sum(map(len, held)) > 1):
        yield key, np.concatenate(held), over, first


def _batch(a, b, name_a="a", name_b="b"):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=np.int64)),
                                       pa.array(np.asarray(b, dtype=np.int64))], names=[name_a, name_b])


def candidate_links(nodes: DataFrame, max_bits: int, list_max: int = LIST_MAX) -> DataFrame:
    """(a, b, verified): linked pairs of distinct fingerprints; a = b with verified false marks a
    member of a list that is too long to pair up."""
    choices = _choices(max_bits)

    def run(batches):
        for key, values, over, _ in _runs(batches, 2, list_max):
            fps = values[:, 0].astype(np.int64)
            if over:
                out = (fps, fps, np.zeros(len(fps), dtype=bool))
            else:
                x, y = list_pairs(fps.view(np.uint64), choices[key[0]], max_bits)
                out = (x.view(np.int64), y.view(np.int64), np.ones(len(x), dtype=bool))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["a", "b", "verified"])

    return (postings(nodes, max_bits).repartition("list_id", "key")
            .sortWithinPartitions("list_id", "key", "fp").mapInArrow(run, "a long, b long, verified boolean"))


def midpoint_links(dense: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of ``dense`` (fp) within ``max_bits`` bits."""
    near, far = max_bits // 2, max_bits - max_bits // 2

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for n_bits in range(far + 1):
                for bits in combinations(range(64), n_bits):
                    z = fp ^ np.uint64(sum(1 << i for i in bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(z.view(np.int64)), pa.array(np.full(len(fp), int(n_bits > near), np.int64)),
                         pa.array(fp.view(np.int64))], names=["z", "outer", "fp"])

    def star(batches):
        # sorted by (z, outer, fp): the first row is the smallest fingerprint of the inner ball, if any
        for _, values, _, first in _runs(batches, 1, 1 << 16):
            if first[0]:
                continue
            fps = values[:, 1].astype(np.int64)
            fps = fps[fps != first[1]]
            if len(fps):
                yield _batch(np.full(len(fps), first[1]), fps)

    return (dense.mapInArrow(spread, "z long, outer long, fp long").repartition("z")
            .sortWithinPartitions("z", "outer", "fp").mapInArrow(star, "a long, b long").distinct())


def links(nodes: DataFrame, max_bits: int = MAX_BITS, list_max: int = LIST_MAX) -> DataFrame:
    """(a, b) over distinct fingerprints ``nodes`` (fp): enough links to connect all within ``max_bits``."""
    found = written(candidate_links(nodes, max_bits, list_max), "simhash-links")
    dense = found.where("NOT verified").select(F.col("a").alias("fp")).distinct()
    return found.where("verified").select("a", "b").unionByName(midpoint_links(dense, max_bits))


# --- connected components ----------------------------------------------------------

def stars(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): alternating large and small star contraction.

    Every round is a written table; the count and the checksum of the links tell convergence.
    """
    def directed(e):
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()

    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    cur = written(directed(edges), "simhash-star")
    seen = mark(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = written(small.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct(), "simhash-star")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fp_components(rows: DataFrame, max_bits: int, list_max: int = LIST_MAX) -> DataFrame:
    """(doc_id, fp) rows -> (fp, component_id)."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "simhash-nodes")
    roots = stars(links(nodes, max_bits, list_max))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "low_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def components(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
               list_max: int = LIST_MAX) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    rows = written(with_fingerprint(docs.select("doc_id", text_bytes().alias("bytes")), width), "simhash-rows")
    return rows.join(fp_components(rows, max_bits, list_max), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null ids last; of several rows
    with that id, the one with the smallest row digest)."""
    digest, name = fresh(docs, "row_digest"), fresh(docs, "row_id")
    keyed = docs.withColumn(digest, rows_digest(docs)).withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = written(with_fingerprint(keyed.select(
        "doc_id", F.col(digest).alias("digest"), text_bytes().alias("bytes")), width), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id"),
                                           F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
                                           .alias("first_row")), "simhash-nodes")
    roots = stars(links(nodes, max_bits))
    kept = (nodes.join(roots, nodes.fp == roots.node, "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first_row").alias("r"))
            .select(F.coalesce(F.col("r.doc_id").cast("string"), F.lit("")).alias(name), F.col("r.digest").alias(digest)))
    kept = written(kept, "simhash-kept")
    # texts move once: the rows lie by the joined columns, which are those that tell repeated rows
    out = keyed.join(kept, [name, digest], "left_semi")
    return out.dropDuplicates([name, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
