"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word 5-gram hashes; equal sets are one class from the start, so copies never meet each other.
Each set gets a MinHash sketch of ``SKETCH`` coordinates.  A run splits all sets recursively: a node (a path) samples
coordinates, on average 1/threshold of them, and each set moves to the child of its own value at each sampled
coordinate.  Buckets of up to ``SMALL`` sets are compared by brute force over their sketches; larger ones split again.
A bucket that is still large after ``DEPTH`` splits holds many sets that are alike, so a few of its sets, drawn at random,
become pivots: what looks alike to a pivot is joined to it and leaves the bucket, and the rest splits again.  That costs one
comparison with each pivot for a set, however large the bucket is.  (What is large even after ``MAX_DEPTH`` splits is compared in
tiles.)  A bucket never emits its pairs, only a star (least set and member) for each group that looks alike.

Runs come in rounds with fresh random choices, of coordinates and pivots.  The share of one round's sets (those with an
alike one) that another round found too estimates a round's recall; two rounds are made at once, and further ones
until the estimate for all together reaches ``RECALL``.  If it does not within ``MAX_ROUNDS``, a warning says so.

Verification is exact: the sets of a connected family are brought together once, every pair within it is compared by its
true Jaccard similarity, links are counted per set, and again only stars of linked sets leave a task.  A family of up to
``TILE`` sets and ``TILE_BYTES`` is one task.  Of a larger one only the differences from one of its sets move: with
D = A xor P for a member P, |A and B| = |P| - |P - A| - |P - B| + |DA and DB|.  These are dealt to blocks of at most
``WIDE_TILE`` sets and ``TILE_BYTES``, and each pair of blocks is a task.  Connected links give the classes.

Defined results: words are runs of other than ASCII white space; a text of one to four words has one shingle of all its
words; null and wordless texts have no shingles, no links, and each is a class of its own; ``class_id`` is the smallest
doc_id in the class (null ids last) and ``rep`` the key of one row of it (of that id, the smallest key), so ties in ids do no
harm; n_links counts the other documents (rows) of similarity ``threshold`` or more, copies included; repeated rows are
copies of each other; texts are taken whole, and a set as large as its text is held by one task at a time; sets are told
apart by 128 bits; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import KEY_ARROW, KEY_TYPE, join_checked, materialize, mix64, read_table, row_key, windows, word_hashes

WORDS = 5
THRESHOLD = 0.8
SKETCH = 128
RUNS = 6
MAX_ROUNDS = 16
RECALL = 0.9999
DEPTH = 3
MAX_DEPTH = 10
SMALL = 200
PIVOTS = 8
#: Buckets' pivots (a few kB each) that may be broadcast.
PIVOT_ROWS = 5_000
TILE = 512
#: A family above ``TILE`` is dealt to this many blocks of ``LEAST_BLOCK`` sets or more, until blocks would hold more than ``WIDE_TILE``.
WIDE_BLOCKS = 8
LEAST_BLOCK = 256
WIDE_TILE = 2048
TILE_BYTES = 32 << 20
#: Sketches that agree in fewer coordinates than the threshold less this many standard deviations aren't alike.
SIGMAS = 4.0

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)

PRINTS = f"row {KEY_TYPE}, doc_id long, set long, check long, size long, sketch binary"


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's word 5-grams."""
    return np.unique(windows(word_hashes(raw), WORDS))


def sketch(s: np.ndarray) -> np.ndarray:
    """MinHash of a set, in pieces so that long texts need no large table."""
    low = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), 4096):
        part = _A[:, None] * x[None, at : at + 4096] + _B[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=1), out=low)
    return low


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set; 0 for the empty one."""
    if not len(s):
        return 0, 0
    sums = np.array([np.add.reduce(mix64(s + np.uint64(1))), np.add.reduce(mix64(s ^ np.uint64(0xC2B2AE3D27D4EB4F)))])
    one, two = mix64(sums ^ np.uint64(len(s))).astype(np.int64).tolist()
    return one or 1, two


def fingerprints(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("row", KEY_ARROW)] + [(c, pa.int64()) for c in ("doc_id", "set", "check", "size")] + [("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingles(t.as_py()) for t in b.column(2))
            rows = [(*set_hashes(s), len(s), sketch(s).tobytes() if len(s) else b"") for s in sets]
            columns = [pa.array([r[i] for r in rows], schema.types[i + 2]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], schema=schema)

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        row_key(F.col("doc_id"), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text")
    ).mapInArrow(run, PRINTS)


# ------------------------------------------------------------------------------------------------ chosen paths

_PATHS = pa.schema([("path", pa.int64()), ("set", pa.int64())])


def _children(path: np.ndarray, level: int) -> np.ndarray:
    """For nodes (by path): which coordinates each samples; about 1/threshold of them on average."""
    seed = mix64(path.astype(np.uint64) + np.uint64(level))
    draws = mix64(seed[:, None] ^ (np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
    limit = np.uint64(int((1 << 64) / (THRESHOLD * SKETCH)))
    return draws < limit


def _move(path: np.ndarray, sets: np.ndarray, sketches: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Child paths of (path, set) rows."""
    nodes, which = np.unique(path, return_inverse=True)
    row, coordinate = np.nonzero(_children(nodes, level)[which])
    value = sketches[row, coordinate].astype(np.uint64)
    child = mix64(path[row].astype(np.uint64) ^ mix64(value * np.uint64(SKETCH) + coordinate.astype(np.uint64)) + np.uint64(level)).astype(np.int64)
    return child & ~1 | path[row] & 1, sets[row]  # the last bit tells the round


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SKETCH)


def start_runs(prints: DataFrame, runs: range) -> DataFrame:
    """(path, set) after the first split of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sets, sketches = b.column(0).to_numpy(), _sketches(b.column(1))
            seeds = mix64(np.array([r + 1 for r in runs], dtype=np.uint64)).astype(np.int64) & ~1 | np.array([r // RUNS % 2 for r in runs])
            parts = [_move(np.full(len(sets), seed), sets, sketches, 0) for seed in seeds]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], schema=_PATHS)

    return prints.select("set", "sketch").mapInArrow(run, "path long, set long")


def split_again(rows: DataFrame, level: int) -> DataFrame:
    """(path, set) one level down, of rows (path, set, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                path, sets = _move(b.column(0).to_numpy(), b.column(1).to_numpy(), _sketches(b.column(2)), level)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(sets)], schema=_PATHS)

    return rows.select("path", "set", "sketch").mapInArrow(run, "path long, set long")


_LEAST_ALIKE = max(1, math.floor(SKETCH * THRESHOLD - SIGMAS * math.sqrt(SKETCH * THRESHOLD * (1 - THRESHOLD))))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two sketch matrices agree in enough coordinates."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2) >= _LEAST_ALIKE
    same = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(SKETCH):
        same += a[:, k, None] == b[None, :, k]
    return same >= _LEAST_ALIKE


def stars(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, member) of every connected group of a (rows ``a``) x (columns ``b``) adjacency, without the least itself.

    Labels fall to the least neighbour until none moves.
    """
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, a, b = near[np.ix_(rows, columns)], a[rows], b[columns]
    if not len(rows):
        return a[rows], a[rows]
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    label, member = np.concatenate([la, lb]), np.concatenate([a, b])
    member, first = np.unique(member, return_index=True)
    label = label[first]
    other = label != member
    return label[other], member[other]


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, kind) for p in parts])


def by_group(rows: DataFrame, keys: list[str], columns: list[str], run, schema: str, arrow: pa.Schema) -> DataFrame:
    """Apply ``run`` (a table of one group -> tuple of arrays) to each group, streaming over sorted partitions.

    As groupBy().applyInArrow(), without its cost for each group: most groups here are a few rows.
    """
    n = len(keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts: list[pa.RecordBatch], out: list) -> None:
            out.append(run(pa.Table.from_batches(parts).select(columns)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(n)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            out: list = []
            for i in range(len(cuts) - 1):
                part, now = batch.slice(cuts[i], cuts[i + 1] - cuts[i]), tuple(key[cuts[i]])
                if held and now != last:
                    flush(held, out)
                    held = []
                held.append(part)
                last = now
            if out:
                yield pa.RecordBatch.from_arrays([_joined([o[i] for o in out], t) for i, t in enumerate(arrow.types)], schema=arrow)
        if held:
            out = []
            flush(held, out)
            yield pa.RecordBatch.from_arrays([_joined([x], t) for x, t in zip(out[0], arrow.types, strict=True)], schema=arrow)

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("round", pa.int64())])


def compare_sketches(rows: DataFrame) -> DataFrame:
    """Stars (a, b) of alike sets within each (path, tile), and the path's round; rows: path, tile, side, set, sketch."""

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side, sets = table["side"].to_numpy(), table["set"].to_numpy()
        sketches = _sketches(table["sketch"])
        left = side != 1
        right = left if (side == 2).any() else ~left
        a, b = sets[left], sets[right]
        least, member = stars(_alike(sketches[left], sketches[right]) & (a[:, None] != b[None, :]), a, b)
        return least, member, np.full(len(least), table["round"][0].as_py(), dtype=np.int64)

    tagged = rows.withColumn("round", F.col("path").bitwiseAND(1))
    return by_group(tagged, ["path", "tile"], ["round", "side", "set", "sketch"], run, "a long, b long, round long", _EDGES)


def _tiled(rows: DataFrame, blocks: str) -> DataFrame:
    """Adds tile and side: rows are dealt to their group's number of blocks (a column), and each pair of blocks is a tile.

    side: 2 in a tile of one block with itself, else 0 or 1.
    """
    own = rows.withColumn("_n", F.col(blocks).cast("int")).withColumn("_b", F.pmod(F.xxhash64("set", F.lit(11)), F.col(blocks)).cast("int"))
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda o: F.struct(
            (F.least(o, F.col("_b")).cast("long") * F.col("_n") + F.greatest(o, F.col("_b"))).alias("tile"),
            F.when(o == F.col("_b"), 2).when(o > F.col("_b"), 0).otherwise(1).cast("int").alias("side"),
        ),
    )
    return own.withColumn("_t", F.explode(tiles)).select("*", "_t.tile", "_t.side").drop("_t", "_n", "_b", blocks)


_PIVOTED = pa.schema([("path", pa.int64()), ("set", pa.int64()), ("label", pa.int64()), ("sketch", pa.binary())])


def join_pivots(rows: DataFrame, own: DataFrame, level: int) -> DataFrame:
    """(path, set, label, sketch) of rows (path, set, sketch) of large buckets.

    ``label`` is the least set of those that look alike to a pivot together with this one in the same batch; it is null, and
    the sketch is there, if the set looks alike to no pivot.  Pivots come with their label once for each batch.
    """
    picked = F.array_distinct(F.array(*(F.min_by("set", F.xxhash64("set", "path", F.lit(PIVOTS * level + k))) for k in range(PIVOTS))))
    picks = rows.groupBy("path").agg(picked.alias("pivots")).select("path", F.explode("pivots").alias("set"))
    pivots = materialize(picks.join(own, "set").groupBy("path").agg(F.collect_list("set").alias("pivots"), F.collect_list("sketch").alias("pivot_sketches")), "pivots")
    met = join_checked(rows, pivots, "path", "inner", PIVOT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path, sets = b.column(0).to_numpy(), b.column(1).to_numpy()
            sketches = _sketches(b.column(2))
            for p in np.unique(path).tolist():
                at = np.flatnonzero(path == p)
                first = int(at[0])
                pivot_sets = np.array(b.column(3)[first].as_py(), dtype=np.int64)
                pivot_sketches = np.frombuffer(b"".join(b.column(4)[first].as_py()), dtype=np.uint32).reshape(-1, SKETCH)
                near = _alike(sketches[at], pivot_sketches)
                alone = at[~near.any(axis=1)]
                least, member = stars(near & (sets[at][:, None] != pivot_sets[None, :]), sets[at], pivot_sets)
                done = np.unique(np.concatenate([sets[at][near.any(axis=1)], member]))
                label = done.copy()
                label[np.searchsorted(done, member)] = least
                n = len(alone)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + len(done), p)), pa.array(np.concatenate([sets[alone], done])),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(label, pa.int64())]),
                        pa.concat_arrays([b.column(2).take(pa.array(alone)), pa.nulls(len(done), pa.binary())]),
                    ],
                    schema=_PIVOTED,
                )

    return met.select("path", "set", "sketch", "pivots", "pivot_sketches").mapInArrow(run, "path long, set long, label long, sketch binary")


def similar_edges(prints: DataFrame, runs: range) -> DataFrame:
    """Stars (a, b) and their round (0 or 1), of the runs of two rounds."""
    paths = start_runs(prints, runs)
    edges: list[DataFrame] = []

    def compared(full: DataFrame, blocks) -> None:
        edges.append(compare_sketches(_tiled(full.withColumn("blocks", blocks), "blocks").drop("n")))

    for level in range(1, MAX_DEPTH + 1):
        paths = materialize(paths, "paths")
        sizes = materialize(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        live = materialize(paths.join(sizes, "path"), "buckets")
        # sketches move only if their set shares a bucket
        wanted = materialize(live.select("set").distinct(), "bucket-sets")
        own = join_checked(prints.select("set", "sketch"), wanted, "set", "left_semi")
        full = live.join(own, "set")
        if live.where(F.col("n") > SMALL).isEmpty():
            compared(full, F.lit(1))
            break
        if level == MAX_DEPTH:
            compared(full, F.ceil(F.col("n") / TILE))
            break
        compared(full.where(F.col("n") <= SMALL), F.lit(1))
        large = full.where(F.col("n") > SMALL).select("path", "set", "sketch")
        if level >= DEPTH:
            met = materialize(join_pivots(large, own, level), "pivoted")
            edges.append(met.where("label != set").select(F.col("label").alias("a"), F.col("set").alias("b"), F.col("path").bitwiseAND(1).alias("round")))
            rest = met.where("label IS NULL").select("path", "set", "sketch")
            counts = materialize(rest.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "bucket-rest")
            rest = rest.join(counts, "path")
            compared(rest.where(F.col("n") <= SMALL), F.lit(1))
            large = rest.where(F.col("n") > SMALL).select("path", "set", "sketch")
            if counts.where(F.col("n") > SMALL).isEmpty():
                break
        paths = split_again(large, level)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


# --------------------------------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, of nodes that have edges.

    Alternating large-star and small-star steps; each keeps at most as many edges as before, and they end, after about
    log(n) rounds, when every edge leads to a root.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "cc")
    while True:
        # large star: what is above a node moves to the least of its neighbourhood; a hub's rows are summed before they
        # move, and the least nodes are a table of their own, so that Spark can split the hub in the join
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("v"), "m"), "cc-least")
        large = now.join(least, "v").select("u", F.col("m").alias("v"))
        # small star: a node and what is below it move to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-step")
        # done: every node has one parent, and no parent has one
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _round_recall(one: DataFrame, other: DataFrame) -> float:
    """Share of the sets with an alike one in ``other`` that have one in ``one`` too."""
    a = one.select(F.explode(F.array("a", "b")).alias("set")).distinct().withColumn("known", F.lit(True))
    b = other.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    n, known = b.join(a, "set", "left").agg(F.count("*"), F.count_if("known")).first()
    return known / n if n else 1.0


def families(prints: DataFrame, recall: float = RECALL) -> DataFrame:
    """(set, family) of the sets that have alike ones, by rounds of runs until the recall estimate is reached.

    The estimate is over sets, each of which is found if any of its alike ones is; sets with few alike ones near the
    threshold are found less often than it says.
    """
    found, rounds, left = None, 0, 1.0
    while rounds < MAX_ROUNDS and left > 1 - recall:
        fresh = materialize(similar_edges(prints, range(rounds * RUNS, (rounds + 2) * RUNS)), "edges")
        found = fresh if found is None else found.unionByName(fresh)
        rounds += 2
        left = max(0.0, 1 - _round_recall(fresh.where("round = 0"), fresh.where("round = 1"))) ** rounds
    if left > 1 - recall:
        warnings.warn(f"n-gram join: estimated recall {1 - left:.6f} after {rounds} rounds is below {recall}", stacklevel=2)
    return components(found).select(F.col("node").alias("set"), F.col("root").alias("family"))


# ------------------------------------------------------------------------------------------------ verification

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every sorted set in ``a`` with every one in ``b``, over the elements that both sides hold."""
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    inter = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(shared), 8192):
        part = shared[at : at + 8192]
        inter += _incidence(a, part) @ _incidence(b, part).T
    return inter.astype(np.float64)


def _incidence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    for i, s in enumerate(sets):
        k = np.searchsorted(vocabulary, s)
        k = k[k < len(vocabulary)] if len(s) else k
        inside = np.searchsorted(s, vocabulary[k]) if len(k) else k
        ok = inside < len(s)
        k, inside = k[ok], inside[ok]
        m[i, k[s[inside] == vocabulary[k]]] = 1.0
    return m


def verify_families(rows: DataFrame) -> DataFrame:
    """(a, b, links): stars of true links (links 0) and, with b null, how many documents a set links to in its tile.

    rows: family, tile, side, set, copies, size (of the set), held (sorted elements), base, gap: two sets of a family have
    base less both gaps in common, and the elements that both hold.
    """

    def run(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        side, ids, copies, size, base, gap = (table[c].to_numpy() for c in ("side", "set", "copies", "size", "base", "gap"))
        held = [np.frombuffer(x, dtype=np.uint64) for x in table["held"].to_pylist()]
        left = np.flatnonzero(side != 1)
        one = bool((side == 2).any())
        right = left if one else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            none = np.empty(0, dtype=np.int64)
            return none, pa.array([], pa.int64()), none
        common = shared_counts([held[i] for i in left], [held[i] for i in right]) + (base[left] - gap[left])[:, None] - gap[right][None, :]
        near = common >= (THRESHOLD - 1e-9) * (size[left][:, None] + size[right][None, :] - common)
        near &= ids[left][:, None] != ids[right][None, :]
        least, member = stars(near, ids[left], ids[right])
        nodes, links = [ids[left]], [near @ copies[right]]
        if not one:
            nodes.append(ids[right])
            links.append(near.T @ copies[left])
        nodes, links = np.concatenate(nodes), np.concatenate(links)
        some = links > 0
        b = np.concatenate([least, np.zeros(int(some.sum()), dtype=np.int64)])
        null = np.concatenate([np.zeros(len(least), dtype=bool), np.ones(int(some.sum()), dtype=bool)])
        return np.concatenate([member, nodes[some]]), pa.array(b, mask=null), np.concatenate([np.zeros(len(least), dtype=np.int64), links[some]])

    columns = ["side", "set", "copies", "size", "base", "gap", "held"]
    return by_group(rows, ["family", "tile"], columns, run, "a long, b long, links long", _LINKS)


def differences(rows: DataFrame) -> DataFrame:
    """Rows (family, set, copies, size, held, pivot) with ``held`` as the difference from the pivot; base and gap to make up for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, base, gap = [], [], []
            for own, other in zip(b.column(4), b.column(5), strict=True):
                s, p = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (own, other))
                held.append(np.setxor1d(s, p, assume_unique=True).tobytes())
                base.append(len(p))
                gap.append(len(p) - len(np.intersect1d(s, p, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(held, pa.binary()), pa.array(base, pa.int64()), pa.array(gap, pa.int64())], names=names)

    names = ["family", "set", "copies", "size", "held", "base", "gap"]
    return rows.select(*names[:5], "pivot").mapInArrow(run, "family long, set long, copies long, size long, held binary, base long, gap long")


def _blocks(rows: DataFrame, tile: int, least: int = 1) -> DataFrame:
    """family and the number of blocks that hold at most about ``tile`` of its sets and ``TILE_BYTES`` of their elements.

    ``least``: as many blocks for a family that gives each of them ``LEAST_BLOCK`` sets.
    """
    size = rows.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("held")).alias("bytes"))
    even = F.least(F.lit(least), F.ceil(F.col("n") / LEAST_BLOCK))
    return size.select("family", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / TILE_BYTES), even, F.lit(1)).cast("long").alias("blocks"))


def true_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``verify_families`` for members (family, set, copies) with their shingles (set, size, held)."""
    full = materialize(members.join(sets, "set").select("family", "set", "copies", "size", "held"), "family-shingles")
    wide = materialize(_blocks(full, TILE).where("blocks > 1"), "wide-families")
    small = join_checked(full, wide.select("family"), "family", "left_anti")
    zero = F.lit(0).cast("long")
    out = verify_families(small.select("*", zero.alias("base"), zero.alias("gap"), zero.alias("tile"), F.lit(2).alias("side")))
    if wide.isEmpty():
        return out
    # a family is named after one of its sets
    pivots = materialize(full.where("set = family").select("family", F.col("held").alias("pivot")), "family-pivots")
    pivots = materialize(join_checked(pivots, wide.select("family"), "family", "left_semi"), "wide-pivots")
    bytes_held = pivots.agg(F.coalesce(F.sum(F.length("pivot")), F.lit(0))).first()[0]
    near = full.join(F.broadcast(pivots) if bytes_held <= TILE_BYTES else pivots, "family")
    near = materialize(differences(near), "family-differences")
    dealt = join_checked(near, materialize(_blocks(near, WIDE_TILE, WIDE_BLOCKS), "family-blocks"), "family", "inner")
    return out.unionByName(verify_families(_tiled(dealt, "blocks")))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, size, held) once for each wanted set (materialized), rebuilt from one text that has it."""
    one = wanted.select(F.col("row").alias("_row"), "set")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(row_key(F.col("doc_id"), text).alias("_row"), text.cast("binary").alias("text"))
    rows = join_checked(keyed, one, "_row", "inner").select("set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["set", "size", "held"])

    return rows.mapInArrow(run, "set long, size long, held binary").dropDuplicates(["set"])


def distinct_sets(sized: DataFrame) -> DataFrame:
    """print, check, set, copies, least (of the rows: whether the id is null, the id, the key), sketch of every distinct set.

    Sets that agree in one hash only are told apart by the other: there it is their ``set``.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = sized.groupBy(F.col("set").alias("print"), "check").agg(F.count("*").alias("copies"), least.alias("least"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "sets")
    twice = materialize(classes.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print", F.lit(True).alias("twice")), "set-collisions")
    if twice.isEmpty():
        return classes.withColumn("set", F.col("print"))
    return join_checked(classes, twice, "print", "left").withColumn("set", F.when(F.col("twice"), F.col("check")).otherwise(F.col("print"))).drop("twice")


def ngram_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """row, doc_id, class_id, rep, n_links, n_class for every document."""
    rows = materialize(fingerprints(docs.select("doc_id", "text")), "prints")
    classes = distinct_sets(rows.where("size > 0"))
    family = materialize(families(classes.select("set", "sketch"), recall), "family-sets")
    members = materialize(family.join(classes.select("set", "copies", F.col("least.row").alias("row")), "set"), "members")
    checked = materialize(true_links(members.drop("row"), shingle_sets(docs, members.select("row", "set"))), "links")
    counts = checked.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    root = materialize(components(checked.where("b IS NOT NULL").select("a", "b")), "roots").select(F.col("node").alias("set"), "root")
    named = classes.select("print", "check", "set", "copies", "least").join(root, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = named.groupBy("root").agg(F.min("least").alias("first"), F.sum("copies").alias("n_class"))
    by_set = named.join(least, "root").join(counts, "set", "left").select(
        F.col("print").alias("set"), "check", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("rep"), "n_class",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    alone = F.col("size") == 0
    out = rows.select("row", "doc_id", "set", "check", "size").join(by_set, ["set", "check"], "left")
    return out.select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("row")).otherwise(F.col("rep")).alias("rep"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents")).drop("row", "rep")


#: The same by brute force: all pairs of different sets that share a shingle, and what links reach from each.
OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) > 0 THEN
    list_sort(list_distinct([array_to_string(ws[i : i + least({WORDS}, len(ws)) - 1], ' ') for i in range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)])) END AS s
  FROM w
),
sets AS (SELECT s, count(*) AS copies, min(doc_id) AS least_id, row_number() OVER () AS k FROM g WHERE s IS NOT NULL GROUP BY s),
sh AS (SELECT k, unnest(s) AS x, len(s) AS n FROM sets),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c, a.n + b.n - count(*) AS u FROM sh a JOIN sh b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n),
link AS (SELECT a, b FROM pairs WHERE c >= {THRESHOLD} * u UNION ALL SELECT b, a FROM pairs WHERE c >= {THRESHOLD} * u),
reach(k, m) AS (SELECT k, k FROM sets UNION SELECT reach.k, link.b FROM reach JOIN link ON link.a = reach.m),
class AS (SELECT reach.k, min(least_id) AS class_id, sum(copies)::BIGINT AS n_class FROM reach JOIN sets ON sets.k = reach.m GROUP BY 1),
linked AS (SELECT link.a AS k, sum(copies) AS n FROM link JOIN sets ON sets.k = link.b GROUP BY 1)
SELECT g.doc_id, CASE WHEN g.s IS NULL THEN g.doc_id ELSE class_id END AS class_id, coalesce(copies - 1 + coalesce(n, 0), 0)::BIGINT AS n_links,
  coalesce(n_class, 1) AS n_class
FROM g LEFT JOIN sets ON sets.s = g.s LEFT JOIN class USING (k) LEFT JOIN linked USING (k)
"""
