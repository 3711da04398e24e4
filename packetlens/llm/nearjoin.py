"""N-gram Jaccard join by chosen paths.

Sets are the distinct five-word shingles of a text (one shingle of all its
words if it has fewer). Steps:

1. Every text becomes a digest of its shingle set, and ``T`` MinHash tokens: two
   sets agree on a token with probability equal to their Jaccard similarity.
   Texts with equal sets form a class at once; the rest works on one
   representative per class.
2. Chosen paths: in each of ``RUNS`` runs a set follows ``BRANCH`` sampled
   positions; sets with the same token at the position share the bucket. A
   bucket above ``LEAF`` sets is split again on positions sampled for it, until
   it is small or its sets are alike; then all of it is compared. Two sets that
   agree on a share s of their tokens part at some depth of one run with
   probability q (root of q = (1 - s + s q) ** 2). ``missed`` averages q ** RUNS
   over s and adds the pairs that step 3 doesn't let through; ``RUNS`` runs reach
   a recall of 0.9999 at similarity 0.8 with both counted.
   Buckets split inside one task; those above ``bucket_rows`` sets are split by
   Spark first, and if their sets are too alike to split, dealt out as pairs of
   blocks.
3. A bucket returns a spanning forest of the sets whose tokens agree on
   ``LOOSE`` or more: at most one edge per set, whatever the bucket's size.
   Connected components of these edges hold all candidate pairs.
4. Exact check: the shingle sets of a component are compared all with all, in
   pairs of blocks of at most ``block_rows`` sets. A block pair returns each
   set's number of links at ``threshold`` and a spanning forest of them; every
   pair belongs to one block pair, so links are counted once and never emitted.
5. Connected components of the exact links are the near-duplicate classes.

Shingles and words are compared by 64-bit hashes, set digests have 128 bits.

Defined results: null text and text without words have no shingles and link to
nothing; repeated rows are documents like any other (equal sets link); null ids
are allowed; an empty table gives an empty result; texts are read whole; other
columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import materialise, packed, small, unpacked, words

SHINGLE = 5
T = 128
BRANCH = 2
LEAF = 200
DEPTH = 6
LOOSE = 0.62
BUCKET_ROWS = 4096
BLOCK_ROWS = 1024


def missed(runs: int, similarity: float = 0.8, loose: float = LOOSE) -> float:
    """Probability that a pair at ``similarity`` meets in no run or isn't let through."""
    def parted(s: float) -> float:
        q = 0.0
        for _ in range(200):
            q = (1 - s + s * q) ** BRANCH
        return q ** runs

    return sum(math.comb(T, x) * similarity ** x * (1 - similarity) ** (T - x) * (parted(x / T) if x >= loose * T else 1.0)
               for x in range(T + 1))


def runs_for(recall: float, similarity: float = 0.8) -> int:
    """Runs until a pair at ``similarity`` is found with probability ``recall``."""
    for runs in range(1, 65):
        if missed(runs, similarity) <= 1 - recall:
            return runs
    raise ValueError(f"LOOSE drops too many pairs at {similarity} for a recall of {recall}")


def _mix(x):
    """Finaliser of SplitMix64 (a published bijection of 64-bit integers)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text's word hashes."""
    w = _mix(word_hashes.view(np.uint64))
    if len(w) == 0:
        return w
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k:len(w) - n + 1 + k])
    return np.unique(h)


_SEEDS = _mix(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FLIPS = _mix(_SEEDS)


def min_values(s: np.ndarray) -> np.ndarray:
    """64-bit tokens of a set, one per hash function (the sketch keeps 16 bits of each)."""
    least = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            np.minimum(least, ((s[at:at + 2048, None] ^ _FLIPS) * _SEEDS).min(axis=0), out=least)
    return _mix(least)


def positions(node) -> np.ndarray:
    """The ``BRANCH`` positions sampled for a node (same for all its sets)."""
    h = _mix(np.uint64(node))
    first = int(h % np.uint64(T))
    step = 1 + int((h >> np.uint64(32)) % np.uint64((T - 1) // BRANCH))
    return np.array([(first + k * step) % T for k in range(BRANCH)])


def child_nodes(node, at: int, tokens: np.ndarray) -> np.ndarray:
    """The bucket that each token of position ``at`` leads to from ``node``."""
    salt = _mix(np.uint64(node) ^ _mix(np.uint64(at + 1)))
    return _mix(salt ^ (tokens.astype(np.uint64) + np.uint64(1)))


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).sum(axis=1) >= LOOSE * T


def spanning(tokens: np.ndarray) -> list[tuple[int, int]]:
    """(member, first of its component) for the graph of sets whose tokens agree."""
    left = np.arange(len(tokens))
    edges = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            rest = tokens[left]
            for f in frontier:
                open_ = np.flatnonzero(~hit)
                if not len(open_):
                    break
                hit[open_[alike(tokens[f], rest[open_])]] = True
            frontier, left = left[hit], left[~hit]
            edges += [(int(x), int(root)) for x in frontier]
    return edges


def split_bucket(node, tokens: np.ndarray) -> list[tuple[int, int]]:
    """Recursive splitting of one bucket; edges between its members' numbers."""
    edges: list[tuple[int, int]] = []
    todo = [(np.uint64(node), np.arange(len(tokens)), 1)]
    while todo:
        key, own, depth = todo.pop()
        t = tokens[own]
        if len(own) <= LEAF or depth >= DEPTH or alike(t[0], t).mean() >= 0.5:
            edges += [(int(own[a]), int(own[b])) for a, b in spanning(t)]
            continue
        for at in positions(key):
            nodes, inverse, count = np.unique(child_nodes(key, at, t[:, at]), return_inverse=True, return_counts=True)
            order = np.argsort(inverse, kind="stable")
            ends = np.cumsum(count)
            todo += [(n, own[order[e - c:e]], depth + 1) for n, c, e in zip(nodes, count, ends) if c > 1]
    return edges


def exact_links(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each set, and a spanning forest of the linked pairs.
    With two values in ``side`` only pairs across the sides are compared."""
    size = np.array([len(s) for s in sets])
    values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = count[number] > 1
    number, owner = number[shared], owner[shared]
    _, number = np.unique(number, return_inverse=True)
    a, b = (np.flatnonzero(side == x) for x in (side.min(), side.max()))
    across = side.min() != side.max()
    if not across:
        b = a
    both = np.zeros((len(a), len(b)), np.float32)
    place = np.empty(len(sets), np.int64)
    place[b] = np.arange(len(b))
    place[a] = np.arange(len(a))
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(number, (at, at + 4096))
        col, own = number[lo:hi] - at, owner[lo:hi]
        width = int(col.max()) + 1
        left = np.zeros((len(a), width), np.float32)
        if across:
            right = np.zeros((len(b), width), np.float32)
            mine = side[own] == side.min()
            left[place[own[mine]], col[mine]] = 1
            right[place[own[~mine]], col[~mine]] = 1
        else:
            left[place[own], col] = 1
            right = left
        both += left @ right.T
    linked = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-6
    links = np.zeros(len(sets), np.int64)
    if across:
        links[a] = linked @ weight[b]
        links[b] = linked.T @ weight[a]
    else:
        np.fill_diagonal(linked, False)
        links[a] = linked @ weight[a]
    if across:
        whole = np.zeros((len(sets), len(sets)), bool)
        whole[np.ix_(a, b)] = linked
        linked = whole | whole.T
    return links, _forest(linked)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    left = np.arange(len(linked))
    edges = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            hit = linked[np.ix_(frontier, left)].any(axis=0)
            frontier, left = left[hit], left[~hit]
            edges += [(int(x), int(root)) for x in frontier]
    return edges


def _groups(batches, keys: int):
    """Rows grouped by their first ``keys`` columns (input is sorted by them)."""
    held, now = [], None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != now:
                if held:
                    yield now, held
                held, now = [], row[:keys]
            held.append(row)
    if held:
        yield now, held


def set_table(docs: DataFrame, runs: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, rk`` (row key)``, n, digest, tokens, paths`` per row; digest is null without words."""
    src = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("rk"),
                      F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    seeds = _mix(np.arange(runs, dtype=np.uint64) + np.uint64(77))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = b.slice(at, 1024)
                w = rows.column(2)
                flat = w.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))])
                sizes, digests, tokens, paths = [], [], [], []
                for lo, hi in zip(ends[:-1], ends[1:]):
                    s = shingles(flat[lo:hi])
                    sizes.append(len(s))
                    if len(s) == 0:
                        digests.append(None), tokens.append(None), paths.append([])
                        continue
                    t = min_values(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    tokens.append((t >> np.uint64(48)).astype("<u2").tobytes())
                    paths.append([int(child_nodes(r, at_, t[at_:at_ + 1])[0].astype(np.int64)) for r in seeds for at_ in positions(r)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(tokens, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                    names=["doc_id", "rk", "n", "digest", "tokens", "paths"])

    kind = docs.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, rk long, n long, digest binary, tokens binary, paths array<bigint>")


def in_blocks(rows: DataFrame, member: str, block_rows: int) -> DataFrame:
    """Deal groups of ``size`` rows out as pairs of blocks: the columns plus
    ``i, j, side``. A group of up to ``block_rows`` is the one pair (0, 0)."""
    n = F.ceil(F.col("size") / block_rows).cast("int")
    out = rows.withColumn("blocks", n).withColumn("side", F.pmod(F.xxhash64(F.lit(5), member), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (out.select("*", other.alias("other"))
            .select("*", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).drop("other", "blocks", "size"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes that two sets at least have met in, with the node's size."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(materialise(sizes, "node-sizes"), "node")


def split_hot(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Split nodes above ``bucket_rows`` on further positions with Spark, until
    they are small, alike or ``DEPTH`` levels deep. ``rows``: node, size, digest, tokens."""
    done = [rows.where(F.col("size") <= bucket_rows)]
    for _ in range(DEPTH):
        hot = rows.where(F.col("size") > bucket_rows)
        if hot.isEmpty():
            break
        pivots = small(materialise(hot.groupBy("node").agg(F.min_by("tokens", "digest").alias("pivot")), "hot-pivots"), 10_000)

        def probe(batches):
            for b in batches:
                near, kids = [], []
                for node, tokens, pivot in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    t, p = np.frombuffer(tokens, "<u2"), np.frombuffer(pivot, "<u2")
                    near.append(bool((t == p).sum() >= LOOSE * T))
                    key = np.int64(node).view(np.uint64)
                    kids.append([int(child_nodes(key, at, t[at:at + 1])[0].astype(np.int64)) for at in positions(key)])
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near, pa.bool_()), pa.array(kids, pa.list_(pa.int64()))],
                                                 names=["node", "size", "digest", "tokens", "near", "kids"])

        probed = materialise(hot.join(pivots, "node").select("node", "size", "digest", "tokens", "pivot")
                             .mapInArrow(probe, "node long, size long, digest binary, tokens binary, near boolean, kids array<bigint>"), "hot-split")
        dense = small(materialise(probed.groupBy("node").agg(F.avg(F.col("near").cast("int")).alias("share"))
                                  .where("share >= 0.5").select("node"), "hot-dense"), 10_000)
        done.append(probed.select("node", "size", "digest", "tokens").join(dense, "node"))
        kids = probed.join(dense, "node", "left_anti").select(F.explode("kids").alias("node"), "digest", "tokens")
        rows = materialise(_sized(kids).select("node", "size", "digest", "tokens"), "node-rows")
        done.append(rows.where(F.col("size") <= bucket_rows))
    else:
        done.append(rows.where(F.col("size") > bucket_rows))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def candidate_edges(sets: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``a, b`` (digests) whose components hold all candidate pairs.
    ``sets``: materialised rows of ``digest, tokens, paths``."""
    steps = _sized(sets.select("digest", F.explode(F.array_distinct("paths")).alias("node")))
    rows = steps.join(sets.select("digest", "tokens"), "digest").select("node", "size", "digest", "tokens")
    dealt = in_blocks(split_hot(materialise(rows, "node-rows"), bucket_rows), "digest", bucket_rows).select("node", "i", "j", "digest", "tokens")

    def run(batches):
        for (node, _, _), own in _groups(batches, 3):
            if len(own) < 2:
                continue
            tokens = np.frombuffer(b"".join(r[4] for r in own), "<u2").reshape(len(own), T)
            edges = split_bucket(np.int64(node).view(np.uint64), tokens)
            if edges:
                yield pa.RecordBatch.from_pydict({"a": pa.array([own[x][3] for x, _ in edges], pa.binary()),
                                                  "b": pa.array([own[y][3] for _, y in edges], pa.binary())})

    return (dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "digest")
            .mapInArrow(run, "a binary, b binary").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: alternating large-star
    and small-star steps (published by Kiveris et al., 2014); the root is the
    least node. A star's centre may have any number of neighbours: minima
    combine on the map side, and its rows are split by AQE's skew join."""
    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # edges to smaller neighbours only: (a, b) with a > b
        down = large.distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        edges = materialise(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                            .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def exact_check(docs: DataFrame, sets: DataFrame, groups: DataFrame, key: str, text: str, threshold: float,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Compare the sets of each candidate group: rows ``a, links`` (weighted
    number of links) and ``a, b`` (a spanning forest), materialised."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    groups = groups.join(sizes, "root").select(F.col("node").alias("digest"), "root", "size")
    active = small(materialise(sets.join(groups, "digest").select("doc_id", "rk", "digest", "mult", "root", "size"), "active-sets"))
    src = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("k"), F.col(text).alias("body"))
    src = src.join(active, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("rk")))
    src = src.select("digest", "mult", "root", "size", F.transform(words(F.col("body")), lambda w: F.xxhash64(w)).alias("w"))

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = b.slice(at, 512)
                w = rows.column(4)
                flat = w.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))])
                sets_ = [shingles(flat[lo:hi]).tobytes() for lo, hi in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(sets_, pa.binary())],
                                                 names=["digest", "mult", "root", "size", "set"])

    read_sets = src.mapInArrow(read, "digest binary, mult long, root binary, size long, set binary")
    dealt = in_blocks(read_sets, "digest", block_rows).select("root", "i", "j", "digest", "side", "mult", "set")

    def compare(batches):
        for _, own in _groups(batches, 3):
            one = {r[3]: r for r in own}  # repeated rows read the same set twice
            rows = list(one.values())
            digests = [r[3] for r in rows]
            side = np.array([r[4] for r in rows])
            if rows[0][1] != rows[0][2] and side.min() == side.max():
                continue  # a pair of blocks of which one is empty
            links, forest = exact_links([np.frombuffer(r[6], np.uint64) for r in rows], side, np.array([r[5] for r in rows]), threshold)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[x] for x in some] + [digests[x] for x, _ in forest], pa.binary()),
                     pa.array([None] * len(some) + [digests[y] for _, y in forest], pa.binary()),
                     pa.array([int(links[x]) for x in some] + [0] * len(forest), pa.int64())], names=["a", "b", "links"])

    checked = (dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "digest")
               .mapInArrow(compare, "a binary, b binary, links long"))
    return materialise(checked, "exact-links")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.9999,
                 bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, rk, class_id`` (least id of the class),
    ``class_rk``, ``n_links`` (other documents at the threshold or above) and
    ``n_shingles``."""
    table = materialise(set_table(docs, runs_for(recall, threshold), key, text), "shingle-sets")
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")
    sets = materialise(
        table.where("digest is not null").groupBy("digest")
        .agg(F.min(named).alias("r"), F.count(F.lit(1)).alias("mult"), F.first("tokens").alias("tokens"), F.first("paths").alias("paths"))
        .select("digest", "r.no_id", "r.doc_id", "r.rk", "mult", "tokens", "paths"), "distinct-sets")
    groups = materialise(components(candidate_edges(sets, bucket_rows)), "candidate-groups")
    checked = exact_check(docs, sets, groups, key, text, threshold, block_rows)
    links = checked.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    roots = components(checked.where("b is not null").select("a", "b")).select(F.col("node").alias("digest"), "root")
    known = sets.select("digest", "no_id", "doc_id", "rk", "mult").join(roots, "digest").join(links, "digest", "left")
    known = materialise(known, "linked-sets")
    heads = known.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "rk")).alias("h"))
    known = known.join(heads, "root").select("digest", "h", "links")
    per_set = (sets.select("digest", "no_id", "doc_id", "rk", "mult").join(known, "digest", "left")
               .select("digest", F.coalesce("h", F.struct("no_id", "doc_id", "rk")).alias("h"),
                       (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    out = table.select("doc_id", "rk", "n", "digest").join(per_set, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("doc_id", "rk", F.when(alone, F.col("doc_id")).otherwise(F.col("h.doc_id")).alias("class_id"),
                      F.when(alone, F.col("rk")).otherwise(F.col("h.rk")).alias("class_rk"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those whose class another one stands for (the one
    with the least id stays; of repeated rows one, unless they have no words)."""
    found = near_classes(docs, key, text, **options)
    stays = (F.col("rk") == F.col("class_rk")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    out = materialise(found.groupBy("doc_id", "rk").agg(F.max(stays).alias("stays"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
                      .where(~F.col("stays") | ((F.col("rows") > 1) & (F.col("n") > 0))), "near-dropped")
    side = small(out.select(F.col("doc_id").alias("d"), F.col("rk").alias("k"), "stays"))
    row = packed(docs).withColumn("rk", F.xxhash64(F.col("row")[key], F.col("row")[text]))
    joined = row.join(side, F.col("row")[key].eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k")), "left")
    kept = joined.where("stays is null").select("row").unionByName(
        joined.where("stays").withColumn("id", F.col("row")[key]).dropDuplicates(["id", "rk"]).select("row"))
    return unpacked(kept, docs.columns)
