"""Hard-negative mining over vector blocks in Hilbert order.

The candidates are written once as Parquet, one row a block of up to ``BLOCK_ROWS`` vectors that
lie together on a Hilbert curve, with the block's least and greatest value of every dimension (its
zone map). For an anchor ``a`` the scores of a block lie in

    [a+ . lo - a- . hi,  a+ . hi - a- . lo]          (a+ and a-: its positive and negative parts)

so an anchor reads a block only if that interval can hold a row it looks for:

1. each anchor is scored against the block it lies in; its ``positives``-th best score there is a
   lower bound for its positives;
2. its positives: blocks that hold its label and can reach that bound (the bound rises on the way);
3. its windows, one a positive: blocks that hold another label and can reach into a window above
   the best rows found so far.

Blocks are filed in at most ``BANDS`` folders by curve position. A first look at the zone maps alone
(the vectors' column isn't read) says which folders any anchor needs; only those are then read.

Anchors are the stated query set. They are taken in groups of up to ``ANCHORS``, which bounds
what is broadcast; groups follow the curve, so that a group needs few blocks. Every row is compared
as often as the bounds demand, whatever the size: nothing is capped or sampled.

Defined cases: rows with a null label, vector or ``vec_id``, or with a null or non-finite component
take no part. Rows are told apart by ``vec_id``: an anchor's own id is no positive of it. A repeated
row is a candidate (or an anchor) as often as it occurs. Vectors of different lengths are not
compared. Scores are exact; those beyond 63 bits count as 2^63 - 1 or its negative. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightperf.llm.common import share, taken, written

BLOCK_ROWS = 1024       # vectors a block
PART_ROWS = 8192        # vectors a range partition, while that makes at most MAX_PARTS
MAX_PARTS = 20_000
BANDS = 256             # folders of blocks along the curve
ANCHORS = 16_384        # anchors a group (about 8 MB at 64 dimensions)
CURVE_BITS = 4          # bits a dimension in the curve position
EXACT = 2.0 ** 53       # integers that a double holds
TOP = 2 ** 63 - 1       # greatest score; its negative is the least

BLOCKS = ("band int, block long, dim int, n int, labels array<long>, lo array<double>, hi array<double>, "
          "kind string, row_ids binary, row_labels binary, vectors binary")
FOUND = "anchor_row long, slot int, row_id long, score long"


def curve_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Positions on the Hilbert curve, as big-endian bytes, of rows of cell numbers
    (0 to ``2**bits - 1``): Skilling's transform, all rows at once."""
    x = cells.astype(np.uint32).copy()
    rows, n = x.shape
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            inverted = (x[:, i] & q) != 0
            moved = np.where(inverted, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, moved)
            x[:, i] ^= moved
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(rows, np.uint32)
    q = top
    while q > 1:
        turn ^= np.where((x[:, n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn[:, None]
    planes = [((x >> b) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral rows, as int64."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        whole = [[int(v) for v in row] for row in b]
        out = [[sum(int(x) * y for x, y in zip(row, other)) for other in whole] for row in a]
        return np.array([[max(-TOP, min(TOP, s)) for s in row] for row in out], np.int64)
    return (a @ b.T).astype(np.int64)


def _matrix(column, dim: int):
    """The rows of a float list column as float64."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _spread():
    """Per dimension: count, sum and sum of squares of a task's vectors."""
    def run(batches):
        import pyarrow as pa
        sums = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim == 0:
                    continue
                x = _matrix(b.column("vec").filter(pa.array(dims == dim)), int(dim))
                s = sums.setdefault(int(dim), np.zeros((3, int(dim))))
                s += [np.full(int(dim), len(x)), x.sum(0), (x * x).sum(0)]
        for dim, s in sums.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()),
                "n": pa.array(s[0]), "s": pa.array(s[1]), "s2": pa.array(s[2])})
    return run


def _keyed(spread):
    """(row_id, label, dim, vec) with each row's curve position."""
    def run(batches):
        import pyarrow as pa
        scale = taken(spread)
        for b in batches:
            dims = b.column("dim").to_numpy()
            keys = np.empty(b.num_rows, object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim == 0:
                    for i in at:
                        keys[i] = b""
                    continue
                mean, width = scale[int(dim)]
                x = _matrix(b.column("vec").take(pa.array(at)), int(dim))
                cells = np.clip(np.nan_to_num((x - mean) / width), -2, 1.999)     # two deviations either side
                for i, k in zip(at, curve_keys(((cells + 2) * (1 << CURVE_BITS) / 4).astype(np.uint32))):
                    keys[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row_id", "label", "dim", "vec")), pa.array(keys, pa.binary())],
                names=["row_id", "label", "dim", "vec", "place"])
    return run


def _cut(parts: int):
    """Blocks of rows that arrive in (dim, place, row_id) order."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        band = min(BANDS - 1, part * BANDS // parts)
        made = 0
        held, held_dim, held_rows = [], None, 0

        def block():
            nonlocal made
            ids = np.concatenate([h[0] for h in held])
            labels = np.concatenate([h[1] for h in held])
            q = np.concatenate([h[2] for h in held])
            order = np.argsort(ids, kind="stable")      # so that ties come by id
            ids, labels, q = ids[order], labels[order], q[order]
            most = np.abs(q).max() if q.size else 0
            kind = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<f8"
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([band], pa.int32()), pa.array([(part << 32) + made], pa.int64()),
                pa.array([held_dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
                pa.array([q.min(0).tolist()], pa.list_(pa.float64())), pa.array([q.max(0).tolist()], pa.list_(pa.float64())),
                pa.array([kind]), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                pa.array([labels.astype("<i8").tobytes()], pa.binary()), pa.array([q.astype(kind).tobytes()], pa.binary()),
            ], names=["band", "block", "dim", "n", "labels", "lo", "hi", "kind", "row_ids", "row_labels", "vectors"])

        for b in batches:
            dims = b.column("dim").to_numpy()
            ids, labels = b.column("row_id").to_numpy(), b.column("label").to_numpy()
            at = 0
            while at < b.num_rows:
                dim = int(dims[at])
                if held and (dim != held_dim or held_rows == BLOCK_ROWS):
                    yield block()
                    held, held_rows = [], 0
                held_dim = dim
                end = at + int(np.searchsorted(dims[at:], dim, "right"))
                end = min(end, at + BLOCK_ROWS - held_rows)
                vec = b.column("vec").slice(at, end - at)
                q = np.floor(256.0 * _matrix(vec, dim)) if dim else np.zeros((end - at, 0))
                held.append((ids[at:end], labels[at:end], q))
                held_rows += end - at
                at = end
        if held:
            yield block()
    return run


def write_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (row_id, label long, vec array<float or double>, all sound) as written blocks."""
    spark = rows.sparkSession
    rows = rows.withColumn("dim", F.size("vec"))
    sums = rows.select("dim", "vec").mapInArrow(_spread(), "dim int, at int, n double, s double, s2 double")
    sums = sums.groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")]).orderBy("dim", "at").toArrow()
    scale, total = {}, 0
    dims, n, s, s2 = (sums.column(c).to_numpy() for c in ("dim", "n", "s", "s2"))
    for dim in np.unique(dims):
        of = dims == dim
        mean = s[of] / n[of]
        with np.errstate(over="ignore", invalid="ignore"):
            width = np.sqrt(np.maximum(s2[of] / n[of] - mean * mean, 0.0))
        scale[int(dim)] = (mean, np.where(np.isfinite(width) & (width > 0), width, 1.0))
        total += int(n[of][0])
    parts = max(1, min(MAX_PARTS, -(-total // PART_ROWS)))
    placed = rows.mapInArrow(_keyed(share(spark, scale)), f"row_id long, label long, dim int, {_vec(rows)}, place binary")
    dealt = placed.repartitionByRange(parts, "dim", "place", "row_id").sortWithinPartitions("dim", "place", "row_id")
    return written(dealt.mapInArrow(_cut(parts), BLOCKS), "vector-blocks", ["band"])


def _vec(rows: DataFrame) -> str:
    return f"vec {rows.schema['vec'].dataType.simpleString()}"


class Block:
    """One block row of an Arrow batch."""

    def __init__(self, batch, at: int):
        self.dim = batch.column("dim")[at].as_py()
        self.ids = np.frombuffer(batch.column("row_ids")[at].as_py(), "<i8")
        self.row_labels = np.frombuffer(batch.column("row_labels")[at].as_py(), "<i8")
        kind = batch.column("kind")[at].as_py()
        self.vectors = np.frombuffer(batch.column("vectors")[at].as_py(), kind).astype(np.float64).reshape(len(self.ids), self.dim)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Least and greatest score that each anchor can have in a box (``None`` where doubles are inexact)."""
    reach = max(np.abs(lo).max(), np.abs(hi).max()) if lo.size else 0.0
    if anchors.size and np.abs(anchors).max() * reach * anchors.shape[1] >= EXACT:
        return np.full(len(anchors), -np.inf), np.full(len(anchors), np.inf)
    up, down = np.maximum(anchors, 0), np.maximum(-anchors, 0)
    return up @ lo - down @ hi, up @ hi - down @ lo


class Best:
    """The first ``k`` rows (score descending, id ascending) of every (anchor, slot)."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.floor = np.full((anchors, slots), -TOP)         # score of the k-th best so far
        self.parts, self.rows = [], 0
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((group, ids, scores))
        self.rows += len(group)
        if self.rows > 4 * self.floor.size * self.k + 100_000:
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        group, ids, scores = (np.concatenate(c) for c in zip(self.kept, *self.parts))
        order = np.lexsort((ids, -scores, group))
        group, ids, scores = group[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        full = place == self.k - 1
        self.floor.ravel()[group[full]] = scores[full]
        keep = place < self.k
        self.kept = group[keep], ids[keep], scores[keep]
        self.parts, self.rows = [], 0


def _anchors(step: int, positives: int):
    """Anchors with a lower bound for their positives, from the block that they lie in."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for at in range(b.num_rows):
                block = Block(b, at)
                mine = np.flatnonzero(block.ids % step == 0)
                if not len(mine):
                    continue
                scores = products(block.vectors[mine], block.vectors)
                floor = []
                for i, row in zip(mine, scores):
                    own = np.sort(row[(block.row_labels == block.row_labels[i]) & (block.ids != block.ids[i])])
                    floor.append(int(own[-positives]) if len(own) >= positives else -TOP)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column("block")[at].as_py()] * len(mine), pa.int64()),
                    pa.array(mine, pa.int32()), pa.array(block.ids[mine]), pa.array(block.row_labels[mine]),
                    pa.array([block.dim] * len(mine), pa.int32()),
                    pa.array([block.vectors[i].astype("<f8").tobytes() for i in mine], pa.binary()),
                    pa.array(floor, pa.int64())],
                    names=["block", "at", "anchor_id", "label", "dim", "vector", "floor"])
    return run


class Group:
    """One group of anchors of one length, with what they look for: slots of scores [low, high]
    of their own label (``same``) or of another, the first ``k`` of each."""

    def __init__(self, dim, row, ids, labels, vectors, low, high, same, k):
        self.dim, self.row, self.ids, self.labels, self.vectors = dim, row, ids, labels, vectors
        self.low, self.high, self.same, self.k = low, high, same, k

    def needed(self, lo, hi, labels, floor=None) -> np.ndarray:
        """Which anchors must read a block with this zone map."""
        least, most = bounds(self.vectors, lo, hi)
        low = self.low if floor is None else np.maximum(self.low, floor)
        reach = ((most[:, None] >= low) & (least[:, None] <= self.high) & (self.low <= self.high)).any(1)
        if self.same:
            return reach & np.isin(self.labels, labels)
        return reach & ((len(labels) > 1) | (self.labels != labels[0]))

    def read(self, block: Block, lo, hi, labels, best: Best) -> None:
        sel = np.flatnonzero(self.needed(lo, hi, labels, best.floor))
        if not len(sel):
            return
        scores = products(self.vectors[sel], block.vectors)
        order = np.argsort(-scores, axis=1, kind="stable")       # rows of a block lie by id
        groups, ids, found = [], [], []
        for i, a in enumerate(sel):
            if self.same:
                take = order[i][(block.row_labels[order[i]] == self.labels[a]) & (block.ids[order[i]] != self.ids[a])]
            else:
                take = order[i][block.row_labels[order[i]] != self.labels[a]]
            down = scores[i][take]
            for slot in range(self.low.shape[1]):
                low, high = max(self.low[a, slot], best.floor[a, slot]), self.high[a, slot]
                if not low <= high:
                    continue
                start = np.searchsorted(-down, -high, "left")
                end = min(start + self.k, np.searchsorted(-down, -low, "right"))
                if end > start:
                    groups.append(np.full(end - start, a * self.low.shape[1] + slot))
                    ids.append(block.ids[take[start:end]])
                    found.append(down[start:end])
        if groups:
            best.add(np.concatenate(groups), np.concatenate(ids), np.concatenate(found))


def _zones_of(batch, at: int):
    return (np.array(batch.column("lo")[at].as_py(), float), np.array(batch.column("hi")[at].as_py(), float),
            np.array(batch.column("labels")[at].as_py(), np.int64))


def _bands(shared):
    """Bands with a block that some anchor must read, from the zone maps alone."""
    def run(batches):
        import pyarrow as pa
        groups = {g.dim: g for g in taken(shared)}
        bands = set()
        for b in batches:
            for at in range(b.num_rows):
                g, band = groups.get(b.column("dim")[at].as_py()), b.column("band")[at].as_py()
                if g is not None and band not in bands and g.needed(*_zones_of(b, at)).any():
                    bands.add(band)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bands), pa.int32())], names=["band"])
    return run


def _search(shared):
    """Each task's first rows of every (anchor, slot)."""
    def run(batches):
        import pyarrow as pa
        groups = {g.dim: (g, Best(len(g.ids), g.low.shape[1], g.k)) for g in taken(shared)}
        for b in batches:
            for at in range(b.num_rows):
                if b.column("dim")[at].as_py() in groups:
                    g, best = groups[b.column("dim")[at].as_py()]
                    g.read(Block(b, at), *_zones_of(b, at), best)
        for g, best in groups.values():
            best.settle()
            group, ids, scores = best.kept
            yield pa.RecordBatch.from_arrays([
                pa.array(g.row[group // best.slots], pa.int64()), pa.array(group % best.slots, pa.int32()),
                pa.array(ids), pa.array(scores)], names=["anchor_row", "slot", "row_id", "score"])
    return run


def _first(blocks: DataFrame, groups: list[Group], k: int) -> DataFrame:
    """The first ``k`` rows of every (anchor, slot) over the blocks that the anchors need."""
    spark = blocks.sparkSession
    shared = share(spark, groups)
    zones = blocks.select("band", "dim", "lo", "hi", "labels")
    bands = zones.mapInArrow(_bands(shared), "band int").distinct().toArrow().column("band").to_pylist()  # at most BANDS
    found = blocks.where(F.col("band").isin(bands)).mapInArrow(_search(shared), FOUND)
    w = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _grouped(rows, low, high, same, k) -> list[Group]:
    """Anchors (an Arrow table) with their slots, by length of vector."""
    dims = rows.column("dim").to_numpy()
    vectors = rows.column("vector").to_pylist()
    out = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        out.append(Group(int(dim), rows.column("anchor_row").to_numpy()[at], rows.column("anchor_id").to_numpy()[at],
                         rows.column("label").to_numpy()[at],
                         np.array([np.frombuffer(vectors[i], "<f8") for i in at]).reshape(len(at), int(dim)),
                         low[at], high[at], same, k))
    return out


def mine(table: DataFrame, step: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         vector: str = "embedding", label: Column | None = None, vec_id: str = "vec_id") -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``step``: for each of an anchor's first
    ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is
    between ``least`` and ``most`` percent of the positive's. Components count as ``floor(256 x)``."""
    spark = table.sparkSession
    sound = (f"`{vec_id}` IS NOT NULL AND `{vector}` IS NOT NULL AND "
             f"forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = (table.where(sound)
            .select(F.col(f"`{vec_id}`").cast("long").alias("row_id"),
                    (F.col("label") if label is None else label).cast("long").alias("label"), F.col(f"`{vector}`").alias("vec"))
            .where("label IS NOT NULL"))
    blocks = write_blocks(rows)
    anchors = written(blocks.mapInArrow(_anchors(step, positives),
                                        "block long, at int, anchor_id long, label long, dim int, vector binary, floor long"),
                      "anchors")
    groups = -(-anchors.count() // ANCHORS)
    cuts = []
    if groups > 1:      # groups of equal size along the curve
        shares = [i / groups for i in range(1, groups)]
        cuts = sorted(set(anchors.agg(F.percentile_approx("block", shares, 10 * groups).alias("cuts")).first()["cuts"]))
    out = None
    for i in range(len(cuts) + 1 if groups else 0):
        of = anchors
        if i:
            of = of.where(F.col("block") >= cuts[i - 1])
        if i < len(cuts):
            of = of.where(F.col("block") < cuts[i])
        group = of.orderBy("block", "at").toArrow()          # at most about ANCHORS rows
        group = group.append_column("anchor_row", [np.arange(group.num_rows, dtype=np.int64)])
        floor = group.column("floor").to_numpy()
        asked = _grouped(group, floor[:, None], np.full((len(floor), 1), TOP), True, positives)
        best = _first(blocks, asked, positives).select(
            F.col("anchor_row"), F.col("row_id"), F.col("score"), F.col("place")).toArrow()
        pos_score = np.full((group.num_rows, positives), -1, np.int64)
        pos_id = np.zeros((group.num_rows, positives), np.int64)
        where = best.column("anchor_row").to_numpy(), best.column("place").to_numpy() - 1
        pos_score[where], pos_id[where] = best.column("score").to_numpy(), best.column("row_id").to_numpy()
        known = np.zeros((group.num_rows, positives), bool)
        known[where] = True
        # least * p <= 100 * s <= most * p, as whole scores; nothing fits where p is negative or unknown
        low = np.array([-(-least * int(p) // 100) if k else 1 for p, k in zip(pos_score.flat, known.flat)])
        high = np.array([min(TOP, most * int(p) // 100) if k else 0 for p, k in zip(pos_score.flat, known.flat)])
        low, high = low.reshape(-1, positives), high.reshape(-1, positives)
        found = _first(blocks, _grouped(group, low, high, False, negatives), negatives)
        names = spark.createDataFrame(
            [(int(r), int(s), int(group.column("anchor_id")[int(r)].as_py()), int(pos_id[r, s]), int(pos_score[r, s]))
             for r, s in zip(*np.nonzero(known))],
            "anchor_row long, slot int, anchor_id long, positive_id long, positive_score long")
        part = found.join(names, ["anchor_row", "slot"]).select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        part = written(part, "hard-negatives") if groups > 1 else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")
    return out


def moved_label() -> Column:
    """The label of the registered query: ids divisible by 7 have the next one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def sql() -> str:
    """The same in SQL, every anchor against every row."""
    return """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id AS row_id, r.label AS row_label,
    CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
p AS (
  SELECT * FROM s WHERE anchor_label = row_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
w AS (
  SELECT p.anchor_id, p.row_id AS positive_id, s.row_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.row_id ORDER BY s.score DESC, s.row_id) AS INT) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.anchor_label <> s.row_label
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10"""
