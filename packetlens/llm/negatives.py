"""Hard-negative mining by segment summary filtering.

A vector ``x`` is cut into segments of ``w`` components. With the mean ``m`` and the
deviation ``d`` (root of the summed squared distances from the mean) of each
segment, the inner product with ``y`` lies within

    sum of  w * m(x) * m(y)  -/+  d(x) * d(y)   over the segments,

so a pair whose bounds lie outside what is asked for needs no closer look. The
summaries are stored beside the vectors for segments of 64, 16 and 4 components.
A block of rows meets a block of anchors at the coarsest level; what remains is
refined at the next ones, and only the rest is scored exactly, in integers.

Two searches run over all rows, a block of anchors at a time:

1. positives: the ``positives`` best rows of the anchor's label. A pair is dropped
   once its upper bound falls below the worst score held for the anchor;
2. negatives: for each positive, the ``negatives`` best rows of other labels between
   ``low`` and ``high`` hundredths of the positive's score. A pair is dropped if
   its bounds miss every range, or can't beat what is held.

Each task hands on its best few of every range, and one window ranks them. A first
pass over one row in ``seed_share`` gives floors to start from, so that each task
hands on little more than what can still win; floors change no result, as every row
is judged by the second pass.

Bounds: a block of anchors (``BLOCK_BYTES`` of vectors, dealt by a hash of the id)
goes to every task, and its positives through the driver: at most ``positives`` rows
an anchor. Rows are read in blocks; nothing else is gathered. Each block's
result is written to the shared folder before the next begins.

Defined results: rows without an id, a label or a vector, or with a null or
non-finite component, take no part, nor do vectors with a component of 65,536 or
more in magnitude (their scores may not fit a long; at 16,384 components or less
the others' do); shorter vectors count as filled up with zeros; an id that repeats
counts once, with its least (label, vector); anchors without a positive, and
positives without a row in their range, have no row; ties go to the smaller id; an
empty table gives an empty result; other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packetlens.llm.common import materialise

WIDTHS = (64, 16, 4)  # components of a segment, level by level
BLOCK_BYTES = 4 << 20  # vectors of a block of anchors
CELLS = 1 << 22  # (row, anchor) pairs met at once
SPARSE = 0.05  # share of pairs below which the rest is looked at one by one
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Vectors:
    """Rows of one (filled-up) length with their summaries, level by level."""
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    means: list[np.ndarray]
    devs: list[np.ndarray]

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.v[at], [x[at] for x in self.means], [x[at] for x in self.devs])

    @property
    def length(self) -> int:
        return self.v.shape[1]


def summaries(v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    means, devs = [], []
    for w in WIDTHS:
        cut = v.reshape(len(v), v.shape[1] // w, w).astype(np.float64)
        mean = cut.mean(axis=2)
        means.append(mean)
        devs.append(np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2)))
    return means, devs


def _by_length(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length among the packed vectors."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(vectors[i] for i in at), "<i4").reshape(len(at), size // 4)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 x) as 32-bit integers, filled up with zeros to whole coarse segments."""
    for batch in batches:
        lists = batch.column(2)
        starts = lists.offsets.to_numpy()
        values = np.floor(lists.values.to_numpy(zero_copy_only=False) * 256.0).astype("<i4")
        out = []
        for a, b in zip(starts[:-1], starts[1:]):
            x = values[a:b].tobytes()
            out.append(x + bytes(-len(x) % (4 * WIDTHS[0]) if x else 4 * WIDTHS[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed rows with ``means`` and ``devs``: all levels, one after the other."""
    for batch in batches:
        vectors = batch.column(2).to_pylist()
        means, devs = [b""] * len(vectors), [b""] * len(vectors)
        for at, v in _by_length(vectors):
            m, d = (np.concatenate(x, axis=1).astype("<f8") for x in summaries(v))
            for k, i in enumerate(at):
                means[i], devs[i] = m[k].tobytes(), d[k].tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(means, pa.binary()), pa.array(devs, pa.binary())],
                                         names=["vec_id", "label", "v", "means", "devs"])


def unpack(ids: list, labels: list, vectors: list[bytes], means: list[bytes], devs: list[bytes]) -> list[Vectors]:
    ids, labels, out = np.array(ids, np.int64), np.array(labels, np.int64), []
    for at, v in _by_length(vectors):
        cuts = np.cumsum([v.shape[1] // w for w in WIDTHS])[:-1]
        m, d = (np.split(np.frombuffer(b"".join(x[i] for i in at), "<f8").reshape(len(at), -1), cuts, axis=1) for x in (means, devs))
        out.append(Vectors(ids[at], labels[at], v, m, d))
    return out


def vector_table(vectors: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """``vec_id, label, v, means, devs`` of the rows that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 65536))
    src = (vectors.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("v"))
           .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))))
    packed = src.mapInArrow(_packed, "vec_id long, label long, v binary")
    once = packed.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    return once.mapInArrow(_summarised, "vec_id long, label long, v binary, means binary, devs binary")


def remaining(rows: Vectors, anchors: Vectors, lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, score) of the pairs among ``alive`` whose score may lie in
    ``lo .. hi`` of the anchor: bounds level by level, then the exact score."""
    length = min(rows.length, anchors.length)
    # bounds are computed in doubles: room for their rounding
    norms = [np.sqrt((x.v[:, :length].astype(np.float64) ** 2).sum(axis=1)) for x in (rows, anchors)]
    r = a = None
    for level, w in enumerate(WIDTHS):
        n = length // w
        mr, ma, dr, da = rows.means[level][:, :n], anchors.means[level][:, :n], rows.devs[level][:, :n], anchors.devs[level][:, :n]
        if r is None:
            near, reach = w * (mr @ ma.T), dr @ da.T + (1e-9 * np.outer(*norms) + 0.5)
            alive = alive & (near + reach >= lo) & (near - reach <= hi)
            if np.count_nonzero(alive) < SPARSE * alive.size:
                r, a = np.nonzero(alive)
        else:
            near = w * np.einsum("ij,ij->i", mr[r], ma[a])
            reach = np.einsum("ij,ij->i", dr[r], da[a]) + (1e-9 * norms[0][r] * norms[1][a] + 0.5)
            keep = (near + reach >= lo[a]) & (near - reach <= hi[a])
            r, a = r[keep], a[keep]
    vr, va = rows.v[:, :length], anchors.v[:, :length]
    if r is not None:
        return r, a, np.einsum("ij,ij->i", vr[r].astype(np.int64), va[a].astype(np.int64))
    r, a = np.nonzero(alive)
    largest = [int(np.abs(x).max(initial=0)) for x in (vr, va)]
    kind = np.float64 if length * largest[0] * largest[1] < 2 ** 53 else np.int64  # exact either way
    return r, a, (vr.astype(kind) @ va.T.astype(kind)).astype(np.int64)[r, a]


def best_of(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of every key, by falling score, then by id."""
    order = np.lexsort((ids, -score, key))
    key, score, ids = key[order], score[order], ids[order]
    place = np.arange(len(key)) - np.searchsorted(key, key)
    keep = place < k
    return key[keep], score[keep], ids[keep]


@dataclass
class Asked:
    """A block of anchors and what is asked of each: ranges of scores, by anchor."""
    anchors: list[Vectors]
    same_label: bool
    k: int
    first: np.ndarray  # first range of each anchor (over all of ``anchors``), and the end
    lo: np.ndarray
    hi: np.ndarray
    floor: np.ndarray  # of each range: a score that its k-th best reaches
    held: tuple[np.ndarray, ...] = field(default_factory=lambda: tuple(np.empty(0, np.int64) for _ in range(3)))
    new: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    n_new: int = 0

    def meet(self, rows: Vectors) -> None:
        at = 0
        for anchors in self.anchors:
            here = slice(at, at + len(anchors.ids))
            counts = np.diff(self.first)[here]
            least, most = np.full(len(counts), _MOST), np.full(len(counts), _LEAST)
            if (some := np.flatnonzero(counts)).size:
                starts = self.first[here][some]
                ends = slice(self.first[here][0], self.first[at + len(anchors.ids)])
                least[some] = np.minimum.reduceat(np.maximum(self.lo, self.floor)[ends], starts - ends.start)
                most[some] = np.maximum.reduceat(self.hi[ends], starts - ends.start)
            if self.same_label:
                for label in np.intersect1d(rows.labels, anchors.labels):
                    a = np.flatnonzero((anchors.labels == label) & (counts > 0))
                    self.meet_some(rows.take(rows.labels == label), anchors.take(a), a + at, least[a], most[a])
            else:
                a = np.flatnonzero(counts > 0)
                self.meet_some(rows, anchors.take(a), a + at, least[a], most[a])
            at = here.stop
        if self.n_new > max(100_000, len(self.held[0])):
            self.settle()

    def meet_some(self, rows: Vectors, anchors: Vectors, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        if not len(rows.ids) or not len(place):
            return
        alive = rows.ids[:, None] != anchors.ids if self.same_label else rows.labels[:, None] != anchors.labels
        r, a, score = remaining(rows, anchors, least, most, alive)
        # one line for each range of the anchor
        a = place[a]
        n = self.first[a + 1] - self.first[a]
        line = np.repeat(np.arange(len(a)), n)
        key = self.first[a][line] + np.arange(len(line)) - (np.cumsum(n) - n)[line]
        score = score[line]
        keep = (score >= np.maximum(self.lo, self.floor)[key]) & (score <= self.hi[key])
        self.new.append((key[keep], score[keep], rows.ids[r[line][keep]]))
        self.n_new += int(keep.sum())

    def settle(self) -> None:
        self.held = best_of(*(np.concatenate(x) for x in zip(self.held, *self.new)), self.k)
        self.new, self.n_new = [], 0
        key, score, _ = self.held
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True) if len(key) else [])
        full = last[last - np.searchsorted(key, key[last]) == self.k - 1]
        self.floor[key[full]] = np.maximum(self.floor[key[full]], score[full])


def _search(rows: DataFrame, asked: Asked) -> DataFrame:
    """``key, score, id``: each task's best of every range."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        mine = Asked(x.anchors, x.same_label, x.k, x.first, x.lo, x.hi, x.floor.copy())
        step = max(1, CELLS // max(1, sum(len(v.ids) for v in x.anchors)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                for part in unpack(*(c.to_pylist() for c in batch.slice(at, step).columns)):
                    mine.meet(part)
        mine.settle()
        for out in pa.table(list(map(pa.array, mine.held)), names=["key", "score", "id"]).to_batches(64_000):
            yield out

    return rows.mapInArrow(run, "key long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _first_k(rows: DataFrame, asked: Asked, seed_share: int) -> DataFrame:
    """The first ``k`` rows of every range, with ``rank``."""
    seeds = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(seed_share)) == 0)
    floors = _ranked(_search(seeds, asked), asked.k).where(F.col("rank") == asked.k).select("key", "score")
    for key, score in floors.collect():  # at most one a range of this block
        asked.floor[key] = score
    return _ranked(_search(rows, asked), asked.k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: Column | str = "label",
                   vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   seed_share: int = 64) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    ``is_anchor`` is a predicate on the column ``vec_id`` (the key)."""
    spark = vectors.sparkSession
    rows = materialise(vector_table(vectors, key, F.col(label) if isinstance(label, str) else label, vector), "vectors")
    n_bytes = rows.where(is_anchor).agg(F.sum(F.length("v"))).first()[0] or 0
    n_blocks = -(-n_bytes // BLOCK_BYTES)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(n_blocks):
        mine = rows.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block)).collect()
        if not mine:
            continue
        anchors = unpack(*map(list, zip(*mine)))
        ids = np.concatenate([x.ids for x in anchors])
        n = len(ids)
        asked = Asked(anchors, True, positives, np.arange(n + 1), np.full(n, _LEAST), np.full(n, _MOST), np.full(n, _LEAST))
        found = sorted(_first_k(rows, asked, seed_share).select("key", "rank", "id", "score").collect())
        if not found:
            continue
        of, _, positive, score = (np.array(x, np.int64) for x in zip(*found))
        first = np.searchsorted(of, np.arange(n + 1))
        ranges = Asked(anchors, False, negatives, first, -(-low * score // 100), high * score // 100, np.full(len(of), _LEAST))
        named = spark.createDataFrame(list(zip(range(len(of)), ids[of].tolist(), positive.tolist(), score.tolist())),
                                      "key long, anchor_id long, positive_id long, positive_score long")
        best = _first_k(rows, ranges, seed_share).join(F.broadcast(named), "key")  # a block's positives
        out = out.unionByName(materialise(best.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "hard-negatives"))
    return out
