"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Words are lower-cased (A-Z) and parted at white space; a text ends with an end token. The model
predicts one of ``CLASSES`` classes from the classes of the two tokens before: the end token, the
most frequent words, and hashed classes that the rarer words share by their last two bytes. The
context vector is the sum of the two class vectors, each scaled by a vector of its place, and a
class scores its dot product with the target vector plus a bias. Training is noise-contrastive
(noise from the class frequencies, shared by a minibatch), in numpy, inside the tasks: every task
trains on all its documents, and the parameters are averaged by Spark, weighted by tokens.

Scoring is normalised: for each distinct context a batched matrix product gives the log of the
sum over all classes. A rare word's probability is that of its class times its share in it: seen
words by their counts, one unseen event with the share of words seen once. So the probabilities
of all classes' words and unseen events sum to 1.

Counts cover all training documents. The most frequent words, ``COUNTED`` at most, go to the tasks
(a bounded table); the rest meet their counts in a join on the word.

Defined cases: null texts count as empty (the end token alone); with no training document every
word is unseen and scores come from the smoothed empty model; repeated rows are scored each; a
null doc_id is in the fold of the empty text; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import fold_column, share, small_batches, taken, text_bytes, written

FREQUENT = 447                # classes of one word; class 0 is the end token
HASHED = 64                   # classes that rarer words share
CLASSES = 1 + FREQUENT + HASHED
WIDTH = 16
NOISE = 20
MINIBATCH = 8192
RATE = 0.03
ROUNDS = 1
COUNTED = 50_000
FOLDS = 10
FLUSH_WORDS = 400_000
LEARN_TOKENS = 400_000        # tokens a task gathers before it goes through them in minibatches
END = b""                     # no word is empty, so the end token is


def hashed_class(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word[-2:]) % HASHED


# --- counts ------------------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(bytes) -> (token binary, c): counts of all words and of the end token."""
    def run(batches):
        held = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                              names=["token", "c"])
        for b in small_batches(batches):
            for x in b.column(0):
                held.update(x.as_py().lower().split())
            held[END] += b.num_rows
            if len(held) > FLUSH_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What the tasks know of the counts: totals, the most frequent words, the hashed classes."""

    def __init__(self, total: int, distinct: int, frequent: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]],
                 ends: int | None = None):
        """``frequent``: words by falling count; ``tails``: hash -> (tokens, words seen once) of all words;
        ``ends``: count of the end token (default: from ``frequent``)."""
        self.total, self.distinct = total, distinct
        self.floor = total + 0.1 * (distinct + 1)
        words = [w for w, _ in frequent if w != END]
        own = words[:FREQUENT]
        self.index = {w: i for i, w in enumerate(words)}
        count = dict(frequent)
        ends = count.get(END, 0) if ends is None else ends
        self.count = np.array([count[w] for w in words], dtype=np.float64)
        self.klass = np.array([1 + i if i < FREQUENT else hashed_class(w) for i, w in enumerate(words)], dtype=np.int32)
        mass, once = np.zeros(CLASSES), np.zeros(CLASSES)
        for h, (tokens, singles) in tails.items():
            mass[1 + FREQUENT + h], once[1 + FREQUENT + h] = tokens, singles
        for w in own:
            k = hashed_class(w)
            mass[k] -= count[w]
            once[k] -= count[w] == 1
        for i, w in enumerate(own):
            mass[1 + i] = count[w]
        mass[0] = ends
        self.mass = mass
        unseen = (once + 0.5) / (mass + 1.0)
        self.unseen = np.log10(unseen)
        self.seen = np.log10(1 - unseen) - np.log10(np.maximum(mass, 1.0))   # plus log10 of the count
        share = np.where(np.arange(CLASSES)[self.klass] <= FREQUENT, 0.0, self.seen[self.klass] + np.log10(self.count)) \
            if len(words) else np.zeros(0)
        self.share = share                                                    # log10 P(word | class)
        self.base = np.log10((self.count + 0.1) / self.floor) if len(words) else np.zeros(0)
        self.base_end = math.log10((ends + 0.1) / self.floor) if self.floor else 0.0
        self.noise = (mass + 1.0) / (mass + 1.0).sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """``counts`` (token, c), written; the driver sees COUNTED words at most and a few hundred sums.

    How many words are how frequent (in steps of a sixteenth of an octave) tells from which count
    on they are no more than COUNTED, so no task sends the driver more than its share of those."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                        F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))).alias("ends")).first()
    step = F.floor(F.log2("c") * 16)
    floor, words = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        words += r["n"]
        if words > COUNTED:
            break
        floor = r["step"]
    top = [] if floor is None else sorted(counts.where(step >= floor).collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    tails = (counts.where(F.col("token") != F.lit(END))
             .groupBy((F.crc32(F.expr("substring(token, -2, 2)")) % HASHED).alias("h"))
             .agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect())
    return Vocabulary(totals["n"] or 0, totals["v"], [(bytes(r["token"]), r["c"]) for r in top],
                      {r["h"]: (r["n"], r["once"]) for r in tails}, totals["ends"] or 0)   # END may be too rare for ``top``


# --- the model ---------------------------------------------------------------------

class LogBilinear:
    """context (CLASSES, WIDTH), place (2, WIDTH), target (CLASSES, WIDTH) and bias (CLASSES)."""

    def __init__(self, noise: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.3, (CLASSES, WIDTH)).astype(np.float32)
        self.target = rng.normal(0, 0.05, (CLASSES, WIDTH)).astype(np.float32)
        self.place = np.array([[1.0] * WIDTH, [0.6] * WIDTH], dtype=np.float32)
        self.bias = np.log(noise).astype(np.float32)
        self.noise = noise

    def names(self):
        return ("context", "target", "place", "bias")

    def vectors(self, h1, h2) -> np.ndarray:
        return self.context[h1] * self.place[0] + self.context[h2] * self.place[1]

    def learner(self):
        return {k: np.full_like(getattr(self, k), 1e-2) for k in self.names()}

    def learn(self, h1, h2, w, held: dict, rng) -> None:
        """One step of noise-contrastive estimation on a minibatch of (context, word)."""
        n = len(w)
        r = self.vectors(h1, h2)
        drawn = rng.choice(CLASSES, NOISE, p=self.noise)
        log_kq = np.log(NOISE * self.noise).astype(np.float32)
        tw = self.target[w]
        # P(word came from the data) for the words and for the noise
        miss = 1 / (1 + np.exp(np.einsum("ij,ij->i", r, tw) + self.bias[w] - log_kq[w]))
        tn = self.target[drawn]
        hit = 1 / (1 + np.exp(-(r @ tn.T + self.bias[drawn] - log_kq[drawn])))
        d_r = miss[:, None] * tw - hit @ tn
        grad = {"bias": np.bincount(w, miss, CLASSES) - np.bincount(drawn, hit.sum(axis=0), CLASSES),
                "target": _rows(w, miss[:, None] * r) - _rows(drawn, hit.T @ r),
                "context": _rows(h1, d_r * self.place[0]) + _rows(h2, d_r * self.place[1]),
                "place": np.stack([(d_r * self.context[h1]).sum(axis=0), (d_r * self.context[h2]).sum(axis=0)])}
        for k, g in grad.items():
            g = (g / n ** 0.5).astype(np.float32)
            held[k] += g * g
            setattr(self, k, getattr(self, k) + np.float32(RATE) * g / np.sqrt(held[k]))

    def log_sums(self, h1, h2) -> np.ndarray:
        """log of the sum over all classes of exp(score) for each context, in blocks."""
        out = np.empty(len(h1), dtype=np.float32)
        for at in range(0, len(h1), 4096):
            s = self.vectors(h1[at:at + 4096], h2[at:at + 4096]) @ self.target.T
            s += self.bias
            top = s.max(axis=1)
            s -= top[:, None]
            np.exp(s, out=s)
            out[at:at + 4096] = np.log(s.sum(axis=1)) + top
        return out


def _rows(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` rows by class."""
    at = (ids[:, None].astype(np.int64) * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(at, values.ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH)


def classes_of(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(place in the frequent words or -1, class) of every word."""
    place = np.fromiter((vocab.index.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    known = place >= 0
    klass = np.empty(len(words), dtype=np.int32)
    klass[known] = vocab.klass[place[known]]
    for i in np.flatnonzero(~known).tolist():
        klass[i] = hashed_class(words[i])
    return place, klass


def _contexts(klass: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, before that, token) of texts' classes; before a text stands the end token."""
    h1 = np.concatenate([np.concatenate([[0], k]) for k in klass]).astype(np.int32)
    h2 = np.concatenate([np.concatenate([[0, 0], k[:-1]]) if len(k) else [0] for k in klass]).astype(np.int32)
    w = np.concatenate([np.concatenate([k, [0]]) for k in klass]).astype(np.int32)
    return h1, h2, w


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Average of the models that the tasks train on all of ``texts`` (bytes), round after round."""
    model = LogBilinear(vocab.noise)
    for r in range(rounds):
        shared = share(texts.sparkSession, (model, vocab))           # CLASSES vectors and COUNTED words: of fixed size

        def run(batches, shared=shared, r=r):
            import copy
            base, vocab = taken(shared)
            model = copy.deepcopy(base)
            held, rng = model.learner(), np.random.default_rng(100 + r)
            seen, gathered, n = 0, [], 0

            def learn():
                h1, h2, w = _contexts(gathered)
                order = rng.permutation(len(w))
                for at in range(0, len(w), MINIBATCH):
                    part = order[at:at + MINIBATCH]
                    model.learn(h1[part], h2[part], w[part], held, rng)
                return len(w)

            for b in small_batches(batches):
                for x in b.column(0):
                    gathered.append(classes_of(x.as_py().lower().split(), vocab)[1])
                    n += len(gathered[-1]) + 1
                    if n >= LEARN_TOKENS:
                        seen += learn()
                        gathered, n = [], 0
            if gathered:
                seen += learn()
            if seen:
                flat = np.concatenate([getattr(model, k).ravel() for k in model.names()]).astype(np.float64)
                at = np.arange(0, len(flat), WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at // WIDTH, pa.int32()), pa.array(np.full(len(at), float(seen))),
                     pa.array([flat[i:i + WIDTH] for i in at], pa.list_(pa.float64()))], names=["part", "weight", "v"])

        sums = (texts.mapInArrow(run, "part int, weight double, v array<double>")
                .select("part", "weight", F.posexplode("v").alias("i", "x"))
                .groupBy("part", "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
                .orderBy("part", "i").collect())        # one number a parameter
        if sums:
            flat = np.array([s["x"] for s in sums], dtype=np.float32)
            for k in model.names():
                shape = getattr(model, k).shape
                size = int(np.prod(shape))
                setattr(model, k, flat[:size].reshape(shape))
                flat = flat[size:]
    return model


# --- scores ------------------------------------------------------------------------

_PARTIAL = ("row long, doc_id long, n_tokens long, n_known long, base_score double, score double, "
            "tokens array<binary>, times array<int>, classes array<int>")


def _partial_scores(rows: DataFrame, model: LogBilinear, vocab: Vocabulary) -> DataFrame:
    """Each row's sums over the frequent words and all classes, and its rarer words with their number."""
    shared = share(rows.sparkSession, (model, vocab))

    def run(batches):
        model, vocab = taken(shared)
        sums = np.full(CLASSES * CLASSES, np.nan, dtype=np.float32)   # by context, as they are needed
        for b in small_batches(batches):
            out = []
            texts = [x.as_py().lower().split() for x in b.column(2)]
            found = [classes_of(t, vocab) for t in texts]
            h1, h2, w = _contexts([k for _, k in found])
            code = h1.astype(np.int64) * CLASSES + h2
            new = np.unique(code[np.isnan(sums[code])])
            sums[new] = model.log_sums((new // CLASSES).astype(np.int32), (new % CLASSES).astype(np.int32))
            logp = np.empty(len(w))
            for at in range(0, len(w), 1 << 17):
                s = slice(at, at + (1 << 17))
                logp[s] = np.einsum("ij,ij->i", model.vectors(h1[s], h2[s]), model.target[w[s]]) + model.bias[w[s]]
            logp = (logp - sums[code]) / math.log(10)
            cut = np.cumsum([0, *(len(t) + 1 for t in texts)])
            for row, doc_id, words, (place, _), s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts,
                                                            found, cut, cut[1:]):
                known = place[place >= 0]
                rare = Counter(words[i] for i in np.flatnonzero(place < 0).tolist())
                out.append((row, doc_id, e - s, len(known) + (vocab.mass[0] > 0),
                            float(vocab.base[known].sum()) + vocab.base_end,
                            float(logp[s:e].sum()) + float(vocab.share[known].sum()),
                            list(rare), list(rare.values()), [hashed_class(x) for x in rare]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
                     pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=[x.split()[0] for x in _PARTIAL.split(", ")])

    return rows.mapInArrow(run, _PARTIAL)


def scores(docs: DataFrame, learn_from=None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``learn_from``: a condition on doc_id that says which rows the model learns from (default: all)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes"))
    texts = (rows.where(learn_from) if learn_from is not None else rows).select("bytes")
    counts = written(word_counts(texts), "lm-counts")
    vocab = vocabulary(counts)
    model = train(texts, vocab, rounds)
    partial = written(_partial_scores(rows.select(F.monotonically_increasing_id().alias("row"), "*"), model, vocab),
                      "lm-partial")
    # the rarer words meet their counts
    rare = partial.select("row", F.explode(F.arrays_zip("tokens", "times", "classes")).alias("x")).select(
        "row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times"), F.col("x.classes").alias("class"))
    seen, unseen = (F.array(*[F.lit(float(v)) for v in table[1 + FREQUENT:]]) for table in (vocab.seen, vocab.unseen))
    at = F.col("class") - F.lit(FREQUENT)
    c = F.col("c").cast("double")
    sums = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce(c, F.lit(0.0)) + 0.1) / F.lit(vocab.floor))).alias("more_base"),
        F.sum(F.col("times") * F.when(F.col("c").isNotNull(), F.element_at(seen, at) + F.log10(c))
              .otherwise(F.element_at(unseen, at))).alias("more_score"))
    return partial.drop("tokens", "times", "classes").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def learning_fold():
    """The rows the contract lets the model learn from."""
    return fold_column("doc_id", FOLDS) != 0
