"""Near-duplicate vectors by NN-descent.

A first neighbour graph comes from blocks of vectors that stand together in the order of random hyperplane codes.
Rounds of neighbours-of-neighbours joins then improve it: the neighbours of each vector, both ways, are compared with each
other.  Lists are cut to the k best for the search only: all pairs compared that reach the threshold join their components,
written as a spanning forest of each block.  Groups that may fill the lists of their members are covered by leaders, and the
same search over leaders, without pairs of one component, finds groups that lie within reach of each other by the triangle
inequality; their members are compared in full.  Links are counted in tiles of a component that only count, so a large group
costs neither a row per pair nor a task of its own.  Recall is audited against brute force for a bounded sample; below the goal
more rounds with new hyperplanes follow, and at last a comparison of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import runs
from .shared import components, kept

BLOCK, TILE = 128, 256
COVER = np.arccos(0.975)  # the largest angle between a leader and those it stands for
EDGES = "u long, v long, s double, kind int"
LISTED, LINKED, NEARBY = 0, 1, 2  # an entry of a list; joined by compared pairs; leaders whose members may link


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long binary values as doubles."""
    return np.array([np.frombuffer(x.as_py(), np.float64) for x in column]).reshape(len(column), -1)


def _edges(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    u, v, s, kind = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(kind.astype(np.int32))], ["u", "v", "s", "kind"])


def _roots(link: np.ndarray) -> np.ndarray:
    """The least index reachable of each row of a symmetric matrix of links."""
    root = np.arange(len(link))
    while True:
        least = np.minimum(root, np.where(link, root, len(root)).min(1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _compared(block: pa.Table, k: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Edges of a block's rows, rows of one part left out: k best of each, components at the threshold, pairs within reach."""
    ids, part, reach = (block.column(c).to_numpy() for c in ("node", "part", "reach"))
    x = _matrix(block.column("vec").combine_chunks())
    sims = np.where(part[:, None] == part, -2.0, x @ x.T)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    u, v, s = np.repeat(np.arange(len(ids)), k), best.ravel(), np.take_along_axis(sims, best, 1).ravel()
    out = [(u[s > -2], v[s > -2], s[s > -2], LISTED)]
    link = sims >= threshold
    root = np.arange(len(ids))
    if link.any():
        root = _roots(link)
        own = np.flatnonzero(root != np.arange(len(ids)))
        out.append((root[own], own, np.full(len(own), threshold), LINKED))
    if reach.any():
        near = np.cos(np.minimum(np.pi, np.arccos(threshold) + reach[:, None] + reach + 1e-9))
        a, b = np.nonzero((ids[:, None] < ids) & (sims > -2) & (sims >= near) & (root[:, None] != root))
        out.append((a, b, sims[a, b], NEARBY))
    u, v, s = (np.concatenate([o[i] for o in out]) for i in range(3))
    return ids[u], ids[v], s, np.concatenate([np.full(len(o[0]), o[3]) for o in out])


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, vec: doubles of length one) of usable vectors: not null or zero, all components finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                if i is None or not x or None in x:
                    continue
                a = np.array(x, np.float64)
                big = np.abs(a).max()
                if not np.isfinite(big) or big == 0:
                    continue
                a = a / big  # so that squares neither overflow nor vanish
                ids.append(i)
                out.append((a / np.sqrt(a @ a)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "vec"])

    rows = vectors.selectExpr(f"cast(`{id_col}` as long) AS id", f"cast(`{vec_col}` as array<double>) AS vec")
    return rows.mapInArrow(run, "id long, vec binary").withColumn("key", F.md5("vec"))


def _first_graph(nodes: DataFrame, n: int, k: int, tables: int, seed: int, threshold: float) -> DataFrame:
    bits = 48

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(x.as_py()) // 8 for x in batch.column("vec")])
            for d in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                signs = (_matrix(own.column("vec")) @ planes[d] > 0).reshape(-1, tables, bits)
                codes = signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                for t in range(tables):
                    lane = np.full(own.num_rows, t * 1_000_000 + d, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lane), pa.array(codes[:, t]), *(own.column(c) for c in ("node", "part", "reach", "vec"))], ["lane", "code", "node", "part", "reach", "vec"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane in _pieces(batches, ["lane"], 8 * BLOCK):
            change = np.flatnonzero(np.diff(lane.column("part").to_numpy())) + 1
            if not len(change):
                continue
            # Of a long run of one part only rows near its ends can meet others in a block.
            at = np.arange(lane.num_rows)
            after = np.searchsorted(change, at, "right")
            gap = np.minimum(np.where(after > 0, at - change[after - 1], BLOCK), np.where(after < len(change), change[np.minimum(after, len(change) - 1)] - at, BLOCK))
            lane = lane.filter(pa.array(gap < BLOCK // 4))
            found = []
            for a in range(0, max(1, lane.num_rows - BLOCK // 2), BLOCK // 2):
                block = lane.slice(a, BLOCK)
                if block.num_rows > 1:
                    found.append(_compared(block, max(2, k // 2), threshold))
            if found:
                yield _edges(found)

    spread = nodes.select("node", "part", "reach", "vec").mapInArrow(coded, "lane long, code long, node long, part long, reach double, vec binary")
    parts = max(1, min(4096, n * tables // 8192), spread.sparkSession.sparkContext.defaultParallelism)
    return spread.repartitionByRange(parts, "lane", "code", "node").sortWithinPartitions("lane", "code", "node").mapInArrow(compared, EDGES)


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """As runs(), but a run comes in pieces of so many rows, each with the last half block of the piece before."""
    held, size, last = [], 0, None
    for batch in batches:
        for part in runs(iter([batch]), keys):
            key = tuple(part.column(k)[0].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held, size = [], 0
            last = key
            held.append(part)
            size += part.num_rows
            if size >= most:
                table = pa.concat_tables(held)
                yield table
                held = [table.slice(table.num_rows - BLOCK // 2)]
                size = BLOCK // 2
    if held:
        yield pa.concat_tables(held)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar of each u's list, ties by the smaller v, and all its edges of other kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64()), ("kind", pa.int32())]))
        u, v, s, kind = (table.column(c).to_numpy() for c in ("u", "v", "s", "kind"))
        order = np.lexsort((v, -s, kind, u))
        u, v, s, kind = u[order], v[order], s[order], kind[order]
        fresh = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (kind[1:] != kind[:-1])][: len(u)]
        u, v, s, kind = u[fresh], v[fresh], s[fresh], kind[fresh]
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
        rank = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))  # lists come before other kinds
        held = (rank < k) | (kind != LISTED)
        yield _edges([(u[held], v[held], s[held], kind[held])])

    return edges.repartition("u").mapInArrow(run, EDGES)


def _joined(graph: DataFrame, nodes: DataFrame, fresh: DataFrame, k: int, threshold: float) -> DataFrame:
    """Edges between neighbours of the nodes in fresh, neighbours taken both ways."""
    lists = graph.where(F.col("kind") == LISTED)
    both = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "kind")
    around = _best(lists.unionByName(both), 2 * k).join(fresh, "u").select(F.col("u").alias("w"), F.col("v").alias("node"))
    rows = around.join(nodes.select("node", "part", "reach", "vec"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for group in runs(batches, ["w"]):
            if group.num_rows > 1:
                found.append(_compared(group, 3, threshold))
                size += group.num_rows
            if size > 20_000:
                yield _edges(found)
                found, size = [], 0
        if found:
            yield _edges(found)

    return rows.repartition("w").sortWithinPartitions("w").mapInArrow(run, EDGES)


def _searched(nodes: DataFrame, n: int, graph: DataFrame | None, k: int, tables: int, seed: int, threshold: float) -> DataFrame:
    """The graph after another round: blocks of new codes, then neighbours of neighbours."""
    first = _first_graph(nodes, n, k, tables, seed, threshold)
    before = graph
    graph = kept(_best(first if graph is None else first.unionByName(graph), k), "graph")
    lists = graph.where(F.col("kind") == LISTED)
    fresh = lists if before is None else lists.join(before.where(F.col("kind") == LISTED).select("u", "v"), ["u", "v"], "left_anti")
    return kept(_best(graph.unionByName(_joined(graph, nodes, fresh.select("u").distinct(), k, threshold)), k), "graph")


def _leaders(nodes: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """(leader, node, part, turn: the angle between them) of each node in a part of at least so many nodes."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    rows = nodes.select("node", "vec").join(parts, "node").join(sizes, "part")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / TILE)).cast("long")).select("part", "block", "node", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["part", "block"]):
            ids, x = block.column("node").to_numpy(), _matrix(block.column("vec").combine_chunks())
            turn = np.arccos(np.clip(x @ x.T, -1, 1))
            lead, open_ = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
            while open_.any():
                a = int(open_.argmax())
                own = open_ & (turn[a] <= COVER)
                own[a] = True
                lead[own], open_ = a, open_ & ~own
            angle = np.where(lead == np.arange(len(ids)), 0.0, turn[lead, np.arange(len(ids))])
            yield pa.RecordBatch.from_arrays([pa.array(ids[lead]), pa.array(ids), block.column("part").combine_chunks(), pa.array(angle)], ["leader", "node", "part", "turn"])

    return rows.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(run, "leader long, node long, part long, turn double")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts after links (a, b) between parts."""
    to = components(links, "a", "b").withColumnRenamed("id", "part")
    return kept(parts.join(to, "part", "left").select("node", F.coalesce("component_id", "part").alias("part")), "parts")


def _between(nodes: DataFrame, parts: DataFrame, k: int, tables: int, seed: int, threshold: float) -> DataFrame:
    """parts after links between groups whose members' lists their own group may fill, until a search finds no more."""
    while True:
        led = kept(_leaders(nodes, parts, k // 2 + 1), "led")
        heads = led.groupBy(F.col("leader").alias("node")).agg(F.first("part").alias("part"), F.max("turn").alias("reach"))
        heads = kept(heads.join(nodes.select("node", "vec"), "node"), "heads")
        n = heads.count()
        if n < 2:
            return parts
        graph = _searched(heads, n, None, k, tables, seed, threshold)
        named = heads.select("node", "part")
        pairs = graph.where(F.col("kind") != LISTED).select("u", "v", "kind").distinct()
        pairs = pairs.join(named.select(F.col("node").alias("u"), F.col("part").alias("a")), "u").join(named.select(F.col("node").alias("v"), F.col("part").alias("b")), "v")
        pairs = kept(pairs.where("a <> b"), "pairs")
        direct = _merged(named.select("node", "part"), pairs.where(F.col("kind") == LINKED))
        at = lambda c: direct.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
        asked = pairs.where(F.col("kind") == NEARBY).join(at("u"), "u").join(at("v"), "v").where("u_part <> v_part").select("u", "v", "a", "b")
        rows = asked.withColumn("leader", F.explode(F.array("u", "v"))).join(led.select("leader", "node"), "leader").join(nodes.select("node", "vec"), "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pair in runs(batches, ["u", "v"]):
                left = pair.column("leader").to_numpy() == pair.column("u")[0].as_py()
                x = _matrix(pair.column("vec").combine_chunks())
                if (x[left] @ x[~left].T >= threshold).any():
                    yield pa.RecordBatch.from_arrays([pa.array([pair.column(c)[0].as_py()], pa.int64()) for c in ("a", "b")], ["a", "b"])

        met = rows.select("u", "v", "a", "b", "leader", "vec").repartition("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, "a long, b long")
        links = kept(pairs.where(F.col("kind") == LINKED).select("a", "b").unionByName(met).distinct(), "between")
        if links.isEmpty():
            return parts
        parts = _merged(parts, links)


def _counted(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(node, others: rows of other nodes of its component at the threshold or above), in tiles of a component's blocks."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("m"))
    rows = nodes.join(parts, "node").join(sizes, "part").withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select("part", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, size = [], [], 0
        for tile in runs(batches, ["part", "x", "y"]):
            ids, copies, block = (tile.column(c).to_numpy() for c in ("node", "copies", "block"))
            x = _matrix(tile.column("vec").combine_chunks())
            left = block == tile.column("x")[0].as_py()
            right = block == tile.column("y")[0].as_py()
            link = (x[left] @ x[right].T >= threshold) & (ids[left][:, None] != ids[right])
            found.append(ids[left])
            total.append(link @ copies[right])
            if tile.column("x")[0].as_py() != tile.column("y")[0].as_py():
                found.append(ids[right])
                total.append(copies[left] @ link)
            size += len(ids)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(total).astype(np.int64))], ["node", "others"])
                found, total, size = [], [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(total).astype(np.int64))], ["node", "others"])

    made = tiles.repartition("part", "x", "y").sortWithinPartitions("part", "x", "y").mapInArrow(run, "node long, others long")
    return made.groupBy("node").agg(F.sum("others").alias("others"))


def _against(rows: DataFrame, asked: list[tuple[int, int, bytes]], threshold: float, out: str, answer) -> DataFrame:
    """answer(query indexes, their ids and parts, link matrix, rows of a batch) of all rows against the queries (node, part, vec)."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(v) for *_, v in shared.value])
        ids, parts = (np.array([r[i] for r in shared.value], np.int64) for i in (0, 1))
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.array([len(x.as_py()) for x in batch.column("vec")])
            for d in np.unique(lengths).tolist():
                q = np.flatnonzero(sizes == d)
                if not len(q):
                    continue
                if d not in held:
                    held[d] = np.array([np.frombuffer(shared.value[i][2], np.float64) for i in q])
                own = batch.filter(pa.array(lengths == d))
                yield answer(ids[q], parts[q], held[d] @ _matrix(own.column("vec")).T >= threshold, own)

    return rows.mapInArrow(run, out)


def audit(nodes: DataFrame, parts: DataFrame, counted: DataFrame, threshold: float, queries: int = 256, most_bytes: int = 16 << 20) -> float:
    """The least recall among classes of nodes with about equally many links (powers of two), from a sample against all nodes.

    A node's recall is the share of its links that were found; a class's is the mean over its nodes, so a large group says
    nothing about pairs.  About ``queries`` nodes are asked for each power of two of the component's size, and of nodes without a
    link as many as show a loss of 2 % of the small components, as far as most_bytes of vectors allow.  1 if no node has a link.
    """
    sizes = parts.groupBy("part").agg(F.count("*").alias("m"))
    of = nodes.join(parts.join(sizes, "part").select("node", "m"), "node", "left").join(counted, "node", "left")
    of = kept(of.select("node", "vec", "copies", F.coalesce(F.floor(F.log2("m")), F.lit(0)).cast("int").alias("layer"), F.coalesce("others", F.lit(0)).alias("found")), "layers")
    layers = {r["layer"]: (r["n"], r["bytes"]) for r in of.groupBy("layer").agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("bytes")).collect()}  # a row a power of two
    small = sum(n for layer, (n, _) in layers.items() if 0 < layer <= 2)
    share = {}
    for layer, (n, size) in layers.items():
        wanted = queries if layer else max(4 * queries, 150 * n // max(1, small))
        share[layer] = min(1.0, max(queries, min(wanted, most_bytes // size)) / n)
    picked = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("layer")) if share else F.lit(0.0)
    chosen = of.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < picked * (1 << 30)).select("node", "vec", "layer", "found").collect()

    def answer(ids: np.ndarray, _: np.ndarray, link: np.ndarray, own: pa.RecordBatch) -> pa.RecordBatch:
        link &= ids[:, None] != own.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(link @ own.column("copies").to_numpy())], ["node", "n"])

    made = _against(of.select("node", "vec", "copies"), [(r["node"], 0, bytes(r["vec"])) for r in chosen], threshold, "node long, n long", answer)
    there = {r["node"]: r["n"] for r in made.groupBy("node").agg(F.sum("n").alias("n")).where("n > 0").collect()}  # of the queries
    classes: dict[int, list[float]] = {}
    for r in chosen:
        n = there.get(r["node"], 0)
        if n:
            own = classes.setdefault(int(n).bit_length(), [0.0, 0.0])
            own[0] += min(1.0, r["found"] / n) / share[r["layer"]]
            own[1] += 1 / share[r["layer"]]
    return min((a / b for a, b in classes.values()), default=1.0)


def _all_compared(nodes: DataFrame, parts: DataFrame, threshold: float, most_bytes: int = 8 << 20) -> DataFrame:
    """parts after all links there are: every vector against every other, chunk by chunk."""
    parts = kept(nodes.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part")), "parts")
    chunks = -(-(nodes.agg(F.sum(F.length("vec"))).first()[0] or 0) // most_bytes)

    def answer(ids: np.ndarray, own: np.ndarray, link: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        other = batch.column("part").to_numpy()
        a, b = np.nonzero(link & (own[:, None] != other))
        pairs = np.unique(np.stack([own[a], other[b]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    for chunk in range(chunks):
        rows = nodes.select("node", "vec").join(parts, "node")
        asked = rows.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(chunks)) == chunk).collect()  # about most_bytes
        links = kept(_against(rows, [(r["node"], r["part"], bytes(r["vec"])) for r in asked], threshold, "a long, b long", answer).distinct(), "rest")
        if not links.isEmpty():
            parts = _merged(parts, links)
    return parts


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.9, k: int = 8, tables: int = 8, goal: float = 0.98, most_rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row (id_col, n_links, component_id, kept) per row of vectors.

    Vectors of one length link at a cosine of ``threshold`` or more, in double precision; null or zero vectors, such with null or
    non-finite components, and rows with a null id link with nothing.  Equal vectors are one node and count as often as they
    occur.  n_links counts the other rows linked directly, component_id is the smallest id reachable, its own included (null
    for a null id), kept tells whether it is the row's own.  Every link returned is true.  Links between components that
    the graph search misses are lost as long as the audited recall reaches ``goal``; if it does not in most_rounds rounds, all
    vectors are compared with all others.
    """
    usable = kept(unit_vectors(vectors, id_col, vec_col), "unit")
    nodes = kept(usable.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "nodes")
    n = nodes.count()
    alone = nodes.select("node", F.col("node").alias("part"), F.lit(0.0).alias("reach"), "vec")
    graph, parts, counted = None, None, None
    for round_ in range(most_rounds):
        graph = _searched(alone, n, graph, k, tables, 100 + round_, threshold)
        linked = graph.where((F.col("s") >= threshold) | (F.col("kind") == LINKED))
        parts = kept(components(linked, "u", "v").select(F.col("id").alias("node"), F.col("component_id").alias("part")), "parts")
        parts = _between(nodes, parts, k, tables, 200 + round_, threshold)
        counted = kept(_counted(nodes, parts, threshold), "counted")
        if audit(nodes, parts, counted, threshold) >= goal:
            break
    else:
        parts = _all_compared(nodes, parts, threshold)
        counted = kept(_counted(nodes, parts, threshold), "counted")
    named = nodes.join(parts, "node", "left").join(counted, "node", "left").select(
        "key", F.coalesce("part", "node").alias("part"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    by_id = usable.select("id", "key").join(named, "key").select("id", "part", "links")
    usable_ids = by_id.withColumn("row", F.lit(1))
    rest = vectors.selectExpr(f"cast(`{id_col}` as long) AS id", f"cast(`{vec_col}` as array<double>) AS vec")
    bad = "id IS NULL OR vec IS NULL OR size(vec) = 0 OR exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) OR forall(vec, x -> x = 0)"
    single = rest.where(bad).select("id", F.col("id").alias("part"), F.lit(0).cast("long").alias("links"))
    out = usable_ids.drop("row").unionByName(single)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("part").alias("component_id"), F.coalesce(F.col("id") == F.col("part"), F.lit(False)).alias("kept"))
