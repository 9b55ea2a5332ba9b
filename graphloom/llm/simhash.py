"""SimHash near-dedup by self-joins of binary tries.

Every distinct 64-bit fingerprint is a leaf of a binary trie. A self-join walks
pairs of nodes of equal depth together, adds up the bits in which the two paths
differ, and drops a pair as soon as that exceeds the budget. Node pairs are
arrays, and one step moves all of them a level down.

To spread the walk over many tasks, the trie is rotated so that each of
``budget + 1`` blocks of bits comes on top once. Two fingerprints within the
budget agree in at least one whole block, so in that rotation their walk stays on
the diagonal through the top block: it is enough to start, in each rotation, at
the node below each value of the top block. A start node with more leaves than
``max_leaves`` is cut into pairs of nodes some levels further down, which are
dealt to tasks by pair, again dropping pairs beyond the budget.

Each task returns a spanning forest of the links it found, which joins the same
components with at most one edge per leaf. Documents with the same fingerprint
form one class with one leaf, so large groups of copies cost nothing here.

``simhash_groups`` links single fingerprints. ``near_groups`` is for near copies
by similarity: texts whose word shingles agree to 0.8 differ in some ten of 64
bits, too many for a budget that tries can be pruned by. So every text has
several independent fingerprints, and texts link if those of any one table are
within the budget.

Defined results: null text counts as empty; a text without words has fingerprint
zero and is linked as such; an empty table gives no rows; a null id stays null and
is never a component's id unless all its members have null ids; the result
carries the id and its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.session import materialize

BITS = 64
BLOCK = 1 << 15
TASK_LEAVES = 1_000_000  # to a task, about


def _remix(h: np.ndarray, table: int) -> np.ndarray:
    """Hashes of another table from those of the first, which it leaves as they are."""
    if not table:
        return h
    z = h + np.uint64(table * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(text: str | None, width: int = 3, tables: int = 1, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHashes over word shingles, one for each table, in bounded memory."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(tables, np.uint64)
    width = min(width, len(words))
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(tables * BITS, np.int64)
    block = BLOCK // tables
    for i in range(0, len(starts), block):
        pieces = [buf[s:e] for s, e in zip(starts[i : i + block], ends[i : i + block])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
        wide = np.stack([_remix(h, t) for t in range(tables)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many as a byte can count
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return int(fingerprints(text, width, 1, seed)[0])


def _fingerprints(width: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprints(t, width, tables) for t in b.column(1).to_pylist()]
            flat = pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * tables), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["id", "fps"])

    return run


def rotations(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of each block: rotating left by shift brings it on top."""
    edges = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(s, e - s) for s, e in zip(edges, edges[1:])]


def _rotl(v: np.ndarray, s: int) -> np.ndarray:
    return v if s == 0 else (v << np.uint64(s)) | (v >> np.uint64(BITS - s))


def trie_pairs(v: np.ndarray, left, right, err, top: int, budget: int, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted ``v`` within the budget, from the given node pairs.

    left and right are (lo, hi) arrays of leaf ranges whose leaves agree in the
    first ``top`` bits; err counts the bits in which the two already differ. A
    node pair with left == right stands for the pairs inside that node. Pending
    node pairs beyond ``chunk`` wait on a stack, which bounds the memory.
    """
    stack = [(top, *left, *right, err)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, al, ah, bl, bh, e = stack.pop()
        if len(al) > chunk:
            half = len(al) // 2
            for cut in (slice(half, None), slice(None, half)):
                stack.append((depth, al[cut], ah[cut], bl[cut], bh[cut], e[cut]))
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            rest = ~leaf
            al, ah, bl, bh, e = al[rest], ah[rest], bl[rest], bh[rest], e[rest]
        if not len(al) or depth == BITS:
            continue
        if depth not in ones:
            bit = (v >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        other = ~same
        nl = np.concatenate([al, am, al, am[other]])
        nh = np.concatenate([am, ah, am, ah[other]])
        ml = np.concatenate([bl, bm, bm, bl[other]])
        mh = np.concatenate([bm, bh, bh, bm[other]])
        ne = np.concatenate([e, e, e + 1, e[other] + 1])
        ok = (nh > nl) & (mh > ml) & (ne <= budget) & ~((nl == ml) & (nh - nl == 1))
        if ok.any():
            stack.append((depth + 1, nl[ok], nh[ok], ml[ok], mh[ok], ne[ok]))


class Forest:
    """Union-find over array indices; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the ends of many links: one link for each pair of trees is looked at."""
        r, s = self.root[i], self.root[j]
        r, s = np.minimum(r, s), np.maximum(r, s)
        new = np.flatnonzero(r != s)
        if not len(new):
            return
        new = new[np.unique(r[new] * len(self.root) + s[new], return_index=True)[1]]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                up[x] = x = up.get(up[x], up[x])
            return x

        for x, y, r, s in zip(i[new].tolist(), j[new].tolist(), r[new].tolist(), s[new].tolist()):
            r, s = find(r), find(s)
            if r != s:
                up[max(r, s)] = min(r, s)
                self.a.append(x)
                self.b.append(y)
        self.root[list(up)] = [find(x) for x in list(up)]
        self.root = self.root[self.root]


def _batched(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= size:
            yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])
            held, n = [], 0
    if held:
        yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])


def _join_task(budget: int, leaves: int):
    """Walk the subtrees that were dealt to this task: (rot, deep, block, na, nb, fp),
    in order, whole subtrees of about so many leaves at a time.

    rot numbers the rotations of all tables, those of table t from t * (budget + 1) on; deep counts the levels below the top block at which a large node was cut;
    na and nb are the paths of the two nodes over those levels.
    """
    blocks = rotations(budget)

    def walk(rot, deep, na, nb, fp) -> Iterator[pa.RecordBatch]:
        for r in np.unique(rot).tolist():
            table, (shift, width) = r // len(blocks), blocks[r % len(blocks)]
            for d in np.unique(deep[rot == r]):
                at = (rot == r) & (deep == d)
                v, a, b = _rotl(fp[at].view(np.uint64), shift), na[at].astype(np.uint64), nb[at].astype(np.uint64)
                group = v >> np.uint64(BITS - width)
                path = (v >> np.uint64(BITS - width - d)) & np.uint64((1 << int(d)) - 1) if d else np.zeros_like(v)
                order = np.lexsort((v, path, b, a, group))
                v, a, b, group, path = v[order], a[order], b[order], group[order], path[order]
                new = np.concatenate([[True], (group[1:] != group[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (path[1:] != path[:-1])])
                lo = np.flatnonzero(new)
                hi = np.concatenate([lo[1:], [len(v)]])
                key = np.stack([group[lo], a[lo], b[lo]])
                on = a[lo] == b[lo]
                pair = np.flatnonzero(~on[:-1] & ~on[1:] & (key[:, 1:] == key[:, :-1]).all(axis=0)) if len(lo) > 1 else np.array([], int)
                diag = np.flatnonzero(on & (hi - lo > 1))
                left = (np.concatenate([lo[diag], lo[pair]]), np.concatenate([hi[diag], hi[pair]]))
                right = (np.concatenate([lo[diag], lo[pair + 1]]), np.concatenate([hi[diag], hi[pair + 1]]))
                err = np.concatenate([np.zeros(len(diag), np.int64), np.bitwise_count(a[lo[pair]] ^ b[lo[pair]]).astype(np.int64)])
                forest = Forest(len(v))
                for i, j in _batched(trie_pairs(v, left, right, err, width + int(d), budget)):
                    forest.add(i, j)
                back = _rotl(v, (BITS - shift) % BITS).view(np.int64)
                ends = [pa.array(back[np.array(x, dtype=np.int64)], pa.int64()) for x in (forest.a, forest.b)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(forest.a), table, np.int32)), *ends], names=["table", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            if not len(cols[0]):
                continue
            held.append(cols)
            if sum(len(h[0]) for h in held) < leaves:
                continue
            # all but the last group are complete
            cols = [np.concatenate(x) for x in zip(*held)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from walk(*(cols[i][:cut] for i in (0, 1, 3, 4, 5)))
            held = [[c[cut:] for c in cols]]
        if held:
            yield from walk(*(np.concatenate([h[i] for h in held]) for i in (0, 1, 3, 4, 5)))

    return run


def _deal(budget: int):
    """(fp, rot, deep) to one row for each node pair that the leaf belongs to."""
    blocks = rotations(budget)
    near: dict[int, np.ndarray] = {}

    def masks(d: int) -> np.ndarray:
        if d not in near:
            m = {0}
            for _ in range(budget):
                m |= {x ^ (1 << i) for x in m for i in range(d)}
            near[d] = np.array(sorted(m), np.uint64)
        return near[d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rot, deep = (batch.column(i).to_numpy() for i in range(3))
            for r in np.unique(rot).tolist():
                shift, width = blocks[r % len(blocks)]
                for d in np.unique(deep[rot == r]):
                    at = fp[(rot == r) & (deep == d)]
                    v = _rotl(at.view(np.uint64), shift)
                    path = (v >> np.uint64(BITS - width - d)) & np.uint64((1 << int(d)) - 1) if d else np.zeros_like(v)
                    m = masks(int(d))
                    other = (path[:, None] ^ m[None, :]).ravel()
                    own = np.repeat(path, len(m))
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, r, np.int32)),
                            pa.array(np.full(n, d, np.int32)),
                            pa.array(np.minimum(own, other).astype(np.int64)),
                            pa.array(np.maximum(own, other).astype(np.int64)),
                            pa.array(np.repeat(at, len(m))),
                            pa.array(np.repeat((v >> np.uint64(BITS - width)).astype(np.int64), len(m))),
                        ],
                        names=["rot", "deep", "na", "nb", "fp", "block"],
                    )

    return run


def near_fingerprints(fps: DataFrame, budget: int = 2, max_leaves: int = 100_000, walk: int = 200_000) -> DataFrame:
    """Edges (table, a, b) between distinct fingerprints that join all linked ones of a table.

    fps: columns table (from 0 on) and fp, distinct. The edges hold a spanning
    forest of the links that each task found.
    """
    blocks = rotations(budget)
    rot = []
    for r, (shift, width) in enumerate(blocks):
        v = F.col("fp") if shift == 0 else F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", BITS - shift))
        rot.append(F.struct((F.col("table") * len(blocks) + r).cast("int").alias("rot"), F.shiftrightunsigned(v, BITS - width).alias("block")))
    tries = fps.select("fp", F.explode(F.array(*rot)).alias("t")).select("fp", "t.rot", "t.block")
    large = tries.groupBy("rot", "block").count().where(F.col("count") > max_leaves)
    large = large.select("rot", "block", F.least(F.ceil(F.log2(F.col("count") / max_leaves)) + 2, F.lit(20)).cast("int").alias("cut"))
    large = materialize(large, "simhash-large")  # so that the join can split a hot block
    leaves = tries.join(large, ["rot", "block"], "left").select("fp", "rot", F.coalesce("cut", F.lit(0)).alias("deep"))
    dealt = leaves.mapInArrow(_deal(budget), "rot int, deep int, na long, nb long, fp long, block long")
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() * len(blocks) // TASK_LEAVES)
    keys = ["rot", "block", "na", "nb"]
    tasks = dealt.repartition(n, *keys).select("rot", "deep", "block", "na", "nb", "fp").sortWithinPartitions("rot", "deep", "block", "na", "nb")
    return tasks.mapInArrow(_join_task(budget, walk), "table int, a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, max_leaves: int = 100_000) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id (least id)."""
    kind = docs.schema[id_col].dataType.simpleString()
    f = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(_fingerprints(width, 1), f"id {kind}, fps array<long>")
    f = materialize(f.select("id", F.col("fps")[0].alias("fp")), "simhash")
    leaves = materialize(f.groupBy("fp").agg(F.min("id").alias("least")), "simhash-leaves")
    comps = materialize(connected_components(near_fingerprints(leaves.select(F.lit(0).alias("table"), "fp"), budget, max_leaves)), "simhash-components")
    named = leaves.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    linked = named.where("component is not null")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = linked.join(least, "component").select("fp", "component_id").union(named.where("component is null").select("fp", F.col("least").alias("component_id")))
    return f.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, budget: int = 4, tables: int = 16, max_leaves: int = 100_000) -> DataFrame:
    """One row per document with an id: id, component_id (least id of its near copies).

    Two texts link if their fingerprints over ``width`` words are within the budget
    in any table. Texts that agree in all tables form one class, so copies cost
    nothing. Rows with a null id have no row in the result and link nothing.
    More tables find more: a link is missed if it is out of the budget in all of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    f = materialize(texts.mapInArrow(_fingerprints(width, tables), f"id {kind}, fps array<long>"), "simhash")
    classes = materialize(f.groupBy("fps").agg(F.min("id").alias("least")), "simhash-classes")
    members = classes.select("least", F.posexplode("fps").alias("table", "fp"))
    leaves = materialize(members.groupBy("table", "fp").agg(F.min("least").alias("first"), F.count("*").alias("n")), "simhash-leaves")
    edges = materialize(near_fingerprints(leaves.select("table", "fp"), budget, max_leaves), "simhash-edges")
    for end in ("a", "b"):
        edges = edges.join(leaves.select("table", F.col("fp").alias(end), F.col("first").alias(f"{end}_id")), ["table", end])
    shared = materialize(leaves.where("n > 1").select("table", "fp", "first"), "simhash-shared")
    same = members.join(shared, ["table", "fp"]).select(F.col("least").alias("a"), F.col("first").alias("b"))
    links = edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).union(same).where("a != b")
    comps = materialize(connected_components(links), "simhash-components")
    named = classes.join(comps, classes["least"] == comps["node"], "left").select("fps", "least", F.coalesce("component", "least").alias("component_id"))
    moved = materialize(named, "simhash-named")
    return f.join(moved, "fps").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=simhash_groups, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, by ``groups``.

    Rows with a null id are kept; they belong to no component's choice.
    """
    gone = groups(docs, id_col, text_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
