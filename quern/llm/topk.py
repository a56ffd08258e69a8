"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt into cells, each by its nearest of some pivots, and cells into shards of bounded size; each shard becomes a ball
tree, packed as one row. Queries travel in packed blocks to the trees, never trees to queries, in three rounds: to
a shard of the cell with the highest inner-product bound; to the rest of that cell and the next NEAR cells; to all
others. Before each round a query's k-th score so far is brought up to date, and it travels only to cells whose bound,
q . pivot + |q| * radius, reaches that; within a tree, only nodes are opened whose own bound, q . centre + |q| * radius, does, the highest
first. The results, at most k a query and shard, are merged after each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Vectors of a shard, of a query block and of a leaf, on average; pivots at most, and rows for each among which they are chosen.
SHARD, BLOCK, LEAF, MOST_PIVOTS, TRIED = 4_096, 1_024, 128, 256, 16
#: Cells that round two visits after a query's first.
NEAR = 4


def pack(grid: np.ndarray) -> bytes:
    """Whole numbers in the least type that holds them."""
    for tag, kind in ((b"h", np.int16), (b"i", np.int32)):
        if not grid.size or (np.abs(grid).max() <= np.iinfo(kind).max):
            return tag + grid.astype(kind).tobytes()
    return b"d" + grid.astype(np.float64).tobytes()


def unpack(data: bytes, dim: int) -> np.ndarray:
    kind = {b"h": np.int16, b"i": np.int32, b"d": np.float64}[data[:1]]
    return np.frombuffer(data, kind, offset=1).reshape(-1, dim).astype(np.float64)


def grid_of(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows, the missing ones at the end 0."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


class BallTree:
    """Nodes over ``rows``: children (-1: leaf), first and last row in ``order``, centre and radius."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        n = len(rows)
        self.order = np.arange(n)
        nodes, todo = [], [(0, n, -1)]
        while todo:
            a, b, parent = todo.pop()
            own = rows[self.order[a:b]]
            centre = own.mean(0)
            radius = np.sqrt(((own - centre) ** 2).sum(1).max())
            me = len(nodes)
            nodes.append([a, b, -1, -1, centre, radius])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
            if b - a > leaf:
                far = own[((own - centre) ** 2).sum(1).argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                along = np.argsort(own @ (far - other), kind="stable")
                self.order[a:b] = self.order[a:b][along]
                middle = (a + b) // 2
                todo += [(middle, b, me), (a, middle, me)]
        self.ranges = np.array([x[:4] for x in nodes], np.int32).reshape(-1, 4)
        self.centres = np.array([x[4] for x in nodes], np.float64).reshape(len(nodes), -1)
        self.radii = np.array([x[5] for x in nodes], np.float64)


def _keep(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each query, ties to the smaller id, ordered by query."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
    return q[place < k], ids[place < k], score[place < k]


def search(tree: tuple, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best k rows of each query that reach kth (its k-th score so far), its own id left out.
    tree: (ranges, centres, radii) over rows in tree order."""
    ranges, centres, radii = tree
    bound = queries @ centres.T + np.sqrt((queries**2).sum(1))[:, None] * radii[None, :]
    bound += 1e-6 * (1 + np.abs(bound))  # rounding never hides a row
    for side in (2, 3):  # an inner node's bound caps those below it; parents come before children
        inner = np.flatnonzero(ranges[:, side] >= 0)
        for node in inner:
            np.minimum(bound[:, ranges[node, side]], bound[:, node], out=bound[:, ranges[node, side]])
    leaves = np.flatnonzero(ranges[:, 2] < 0)
    order = leaves[np.argsort(-bound[:, leaves], axis=1, kind="stable")]
    floor = kth.copy()
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # A query takes its leaves in the order of their bounds, in waves; the k-th score is brought up to date after each.
    first, last = 0, 1
    while first < len(leaves):
        wave = order[:, first:last]
        go = np.take_along_axis(bound, wave, 1) >= floor[:, None]
        if not go.any():
            break
        q, node = np.nonzero(go)[0], wave[go]
        by = np.argsort(node, kind="stable")
        found = [best]
        for group in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
            who, (a, b) = q[group], ranges[node[group[0]], :2]
            score = queries[who] @ rows[a:b].T
            i, j = np.nonzero((score >= floor[who][:, None]) & (own[who][:, None] != ids[None, a:b]))
            found.append((who[i], ids[a + j], score[i, j]))
        best = _keep(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        count = np.bincount(best[0], minlength=len(queries))
        full = np.flatnonzero(count >= k)
        floor[full] = np.maximum(floor[full], best[2][np.cumsum(count)[full] - 1])
        first, last = last, 4 * last
    return best


TREE = "cell int, part int, ids binary, rows binary, ranges binary, centres binary, radii binary"
FOUND = "block int, at int, query_id long, vec_id long, score long"


def _cells(rows: DataFrame, n: int, dim: int) -> tuple[np.ndarray, DataFrame]:
    """Pivots, and (vec_id, v, q, cell, distance, turn) of every row; turn counts rows, so that equal ones can be told apart.

    Pivots are rows from a sample of about TRIED rows for each, spread by their hash. Any choice is right."""
    n_pivots = int(min(MOST_PIVOTS, max(1, -(-n // SHARD))))
    hashed = rows.select(F.xxhash64("v").alias("h"), "v").filter(F.pmod("h", F.lit(max(1, n // (TRIED * n_pivots)))) == 0)
    some = [r.v for r in hashed.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(n_pivots).collect()]
    pivots = grid_of(pa.array(some or [[]], pa.list_(pa.float64())), dim)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def run(batches):
        p, turn = shared.value, TaskContext.get().partitionId() * 7919
        for batch in batches:
            x = grid_of(batch.column("v"), dim)
            cell = (x @ p.T - (p**2).sum(1) / 2).argmax(1)
            distance = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([pack(r) for r in x], pa.binary()), batch.column("q"), pa.array(cell, pa.int32()), pa.array(distance), pa.array(np.arange(turn, turn + len(x)))], names=["vec_id", "v", "q", "cell", "distance", "turn"]
            )
            turn += len(x)

    return pivots, settle(rows.mapInArrow(run, "vec_id long, v binary, q boolean, cell int, distance double, turn long"))


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of (vec_id, embedding) with the largest inner products with each row
    that the column ``is_query`` marks, its own vec_id left out, ties to the smaller vec_id; all, if there are fewer.

    Components become floor(64 * x). Rows whose embedding is null or has a null or non-finite component, and rows
    without vec_id, take no part; an empty embedding is a zero vector; where lengths differ, missing components count
    as 0. Repeated rows are candidates each (queries once for each vec_id and vector). Exact while scores stay below
    2**53. Other columns aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * 64).cast("double")).alias("v"), is_query.alias("q"))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, dim)
    pivots, dealt = _cells(rows, n, dim)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.count_if("q").alias("asked")).collect()  # a row a pivot
    parts = np.zeros(len(pivots), np.int64)
    radius, asked = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in sizes:
        parts[r.cell], radius[r.cell], asked[r.cell] = -(-r.n // SHARD), r.radius, -(-r.asked // BLOCK)
    base = np.concatenate([[0], np.cumsum(asked)])
    lookup = lambda x: F.get(F.lit([int(i) for i in x]), F.col("cell"))

    def pack_tree(part: pa.Table) -> pa.Table:
        ids = part.column("vec_id").to_numpy()
        grid = np.concatenate([unpack(v, dim) for v in part.column("v").to_pylist()])
        tree = BallTree(grid)
        made = [ids[tree.order].tobytes(), pack(grid[tree.order]), tree.ranges.tobytes(), tree.centres.tobytes(), tree.radii.tobytes()]
        return pa.table([part.column("cell").slice(0, 1), part.column("part").slice(0, 1), *(pa.array([x], pa.binary()) for x in made)], names=[c.split()[0] for c in TREE.split(", ")])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(parts.sum()) // 4)
    turned = F.pmod("turn", lookup(parts)).cast("int").alias("part")
    trees = settle(dealt.select("cell", turned, "vec_id", "v").groupBy("cell", "part").applyInArrow(pack_tree, TREE).repartition(tasks, "cell", "part"))

    def pack_block(part: pa.Table) -> pa.Table:
        ids = part.column("vec_id").to_numpy()
        grid = np.concatenate([unpack(v, dim) for v in part.column("v").to_pylist()])
        return pa.table({"block": part.column("block").slice(0, 1), "qids": pa.array([ids.tobytes()], pa.binary()), "qrows": pa.array([pack(grid)], pa.binary())})

    queries = dealt.filter("q").select("cell", "vec_id", "v").distinct()
    block = (lookup(base) + F.pmod(F.xxhash64("vec_id", "v"), lookup(np.maximum(asked, 1)))).cast("int").alias("block")
    blocks = settle(queries.select(block, "vec_id", "v").groupBy("block").applyInArrow(pack_block, "block int, qids binary, qrows binary"))
    balls = spark.sparkContext.broadcast((pivots, radius, parts))

    def route(step: int):
        """The trees that each query of a block has to see in a round: (block, cell, part) and those queries, packed."""

        def run(batches):
            p, r, n_parts = balls.value
            for batch in batches:
                for b in batch.to_pylist():
                    own, grid = np.frombuffer(b["qids"], np.int64), unpack(b["qrows"], dim)
                    kth = np.full(len(own), -np.inf) if b.get("kth") is None else np.frombuffer(b["kth"])
                    bound = grid @ p.T + np.sqrt((grid**2).sum(1))[:, None] * r[None, :]
                    bound = np.where(n_parts > 0, bound + 1e-6 * (1 + np.abs(bound)), -np.inf)
                    place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable")
                    out = []
                    for cell in np.flatnonzero(n_parts):
                        fits = bound[:, cell] >= kth
                        for part in range(n_parts[cell]):
                            early = (place[:, cell] == 0) & (part == b["block"] % n_parts[cell])
                            mine = (early, ~early & (place[:, cell] <= NEAR), place[:, cell] > NEAR)[step]
                            at = np.flatnonzero(fits & mine)
                            if len(at):
                                out.append((b["block"], int(cell), part, at.astype(np.int32).tobytes(), own[at].tobytes(), pack(grid[at]), kth[at].tobytes()))
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["block", "cell", "part", "at", "qids", "qrows", "kth"])

        return run

    def see(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in ("block", "at", "qids", "qrows", "kth", "ids", "rows", "ranges", "centres", "radii")}
                tree = np.frombuffer(r["ranges"], np.int32).reshape(-1, 4), np.frombuffer(r["centres"]).reshape(-1, dim), np.frombuffer(r["radii"])
                own, at = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["at"], np.int32)
                q, ids, score = search(tree, np.frombuffer(r["ids"], np.int64), unpack(r["rows"], dim), unpack(r["qrows"], dim), own, np.frombuffer(r["kth"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), r["block"], np.int32)), pa.array(at[q]), pa.array(own[q]), pa.array(ids), pa.array(score.astype(np.int64))], names=["block", "at", "query_id", "vec_id", "score"])

    sizes_of = blocks.select("block", (F.octet_length("qids") / 8).cast("int").alias("n"))

    def pack_kth(part: pa.Table) -> pa.Table:
        kth = np.full(part.column("n")[0].as_py(), -np.inf)
        kth[part.column("at").to_numpy()] = part.column("kth").to_numpy()
        return pa.table({"block": part.column("block").slice(0, 1), "kth": pa.array([kth.tobytes()], pa.binary())})

    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    best, asking = None, blocks
    for step in range(3):
        work = asking.mapInArrow(route(step), "block int, cell int, part int, at binary, qids binary, qrows binary, kth binary").repartition(tasks, "cell", "part")
        found = work.join(trees, ["cell", "part"]).mapInArrow(see, FOUND)
        all_found = found if best is None else best.drop("rank").union(found)
        best = settle(all_found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        held = best.groupBy("block", "at").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("kth")).filter(F.col("c") >= k)
        kths = held.join(sizes_of, "block").select("block", "n", "at", "kth").groupBy("block").applyInArrow(pack_kth, "block int, kth binary")
        asking = blocks.join(kths, "block", "left")
    return best.select("query_id", "rank", "vec_id", "score")
