"""Exact Jaccard self-join of documents on word n-grams with token-combination prefixes.

Tokens are 64-bit hashes of n-grams; documents with equal sets are one node.  Tokens are rare or frequent (frequent ones
are found by counting over all documents) and ordered rare first, then by hash.  A node's prefix is long enough
that two nodes that link must share a signature: a rare token of both prefixes, or two frequent tokens of one of
32 classes.  With c tokens of a class in the prefix, c - 1 of them count towards its length (all of them for rare
tokens), so that missing every pair of the class costs more differences than a link allows.  A node whose whole set is
too short for that also signs each frequent token by itself.

Small groups of a signature give pairs; a large group gives pairs with its leader, the node with the fewest rare
tokens.  Members that do not link to the leader are then compared with members of other components, as far as the
lengths, the shared signatures, the triangle inequality (Jaccard distance is a metric) and the parity bits of the
sets, a lower bound of their difference, leave a link possible.  What remains is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import trimmed
from .shared import bounded, components, kept
from .textnum import mix, shingle_sets, text_chunks

BITS, CLASSES, SKETCH, SMALL_GROUP = 1 << 22, 32, 48, 8
FREQUENT_SHARE, FREQUENT_LEAST = 5e-4, 8
LEVEL = 12  # sets of 2 ** (LEVEL + k) tokens or more have 2 ** k times the classes
_A, _B, _ALONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def node_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a set, from its sorted tokens."""
    n = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    total = mix(tokens ^ (n * _B)).sum(keepdims=True) + np.array([len(tokens)], np.uint64) * _A
    return int(mix(total).view(np.int64)[0])


def need_of(n: int, percent: int) -> int:
    """Differences that no link survives: n less the least overlap, and one."""
    return n - -(-n * percent // 100) + 1


def classes_of(n: int) -> int:
    """Classes of frequent tokens of a set of n tokens: a power of two, so that tokens of one class are of one class among fewer, too."""
    return CLASSES << max(0, (n >> LEVEL).bit_length() - 1)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """(single signatures, combined signatures, tokens after the prefix, frequent tokens in it, rare tokens in it).

    The prefix is long enough for the set's own classes; pairs are signed by the classes of the smallest set that may link, which are as
    many or fewer and so sign the pairs of both.
    """
    need = need_of(len(tokens), percent)
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need], rare[:0], len(tokens) - need, 0, need
    hot = tokens[frequent]
    kind = (hot >> np.uint64(40)).astype(np.int64) % classes_of(len(tokens))
    order = np.argsort(kind, kind="stable")
    first = np.zeros(len(hot), bool)
    first[order[np.r_[True, kind[order][1:] != kind[order][:-1]]]] = len(hot) > 0
    covered = len(rare) + np.cumsum(~first)
    enough = np.flatnonzero(covered >= need)
    alone = not len(enough)
    stop = len(hot) if alone else int(enough[0]) + 1
    made = []
    kind = kind[:stop] % classes_of(-(-len(tokens) * percent // 100))
    order = np.argsort(kind, kind="stable")
    for own in np.split(hot[:stop][order], np.flatnonzero(np.diff(kind[order])) + 1):
        i, j = np.triu_indices(len(own), 1)
        made.append(mix(own[i] * _A + own[j] * _B))
    if alone:
        made.append(mix(hot ^ _ALONE))
    return rare, np.concatenate(made) if made else hot[:0], len(hot) - stop, stop, len(rare)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """One bit a place, set where an odd number of tokens falls: as many places as tokens or up to twice, 256 to 32,768.

    A token in one of two sets changes one bit, so sets differ in at least as many tokens as their bits differ.
    """
    places = min(1 << 15, max(256, 1 << max(0, len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(bits_a: Column, half_a: Column, n_a: Column, bits_b: Column, half_b: Column, n_b: Column, percent: int) -> Column:
    """Whether the parity bits leave a link possible; of sets with twice the places the halves are taken together."""
    x = F.when(F.size(bits_a) > F.size(bits_b), half_a).otherwise(bits_a)
    y = F.when(F.size(bits_b) > F.size(bits_a), half_b).otherwise(bits_b)
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    # intersection = (n_a + n_b - difference) / 2 and 100 * intersection >= percent * union
    return (n_a + n_b - differ) * (100 + percent) >= (n_a + n_b) * (2 * percent)


def _flags(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    where = tokens & np.uint64(BITS - 1)
    return (bits[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Sets:
    """The distinct nodes of a task's documents; a node that was seen lately is not given again."""

    def __init__(self, length: int) -> None:
        self.length, self.seen = length, set()

    def __call__(self, batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[tuple[object, int, np.ndarray]]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for row, data, offsets in text_chunks(batch, "text"):
                for k, tokens in enumerate(shingle_sets(data, offsets, self.length)):
                    key = node_key(tokens)
                    if not every:
                        if not len(tokens) or key in self.seen:
                            continue
                        if len(self.seen) >= 1 << 20:
                            self.seen.clear()
                        self.seen.add(key)
                    yield ids[row + k], key, tokens


def _long_batches(parts: Iterator[tuple[np.ndarray, ...]], names: list[str], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of 64-bit columns from tuples of arrays."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held, strict=True)], names)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _counted(texts: DataFrame, run, least: int) -> DataFrame:
    return texts.mapInArrow(trimmed(run), "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("token").bitwiseAND(BITS - 1).alias("bit")).distinct()


def frequent_bits(texts: DataFrame, length: int) -> np.ndarray:
    """A bit table (512 KiB) of the places of frequent tokens; what else falls on a place counts as frequent too.

    First the 48 smallest tokens of every node are counted, then all tokens of nodes with an eighth of those
    frequent, as copies with few changes have.  A token is frequent from FREQUENT_SHARE of the documents.
    """
    spark = texts.sparkSession
    least = max(FREQUENT_LEAST, int(texts.count() * FREQUENT_SHARE))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _long_batches(((t[:SKETCH],) for _, _, t in _Sets(length)(batches)), ["token"])

    bits = np.zeros(BITS // 8, np.uint8)

    def add(found: DataFrame) -> None:
        for r in found.toLocalIterator():  # at most BITS rows, a partition at a time
            bits[r["bit"] >> 3] |= 1 << (r["bit"] & 7)

    add(_counted(texts, smallest, least))
    shared = spark.sparkContext.broadcast(bits.copy())

    def all_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen() -> Iterator[tuple[np.ndarray]]:
            for _, _, t in _Sets(length)(batches):
                if _flags(t[:SKETCH], shared.value).mean() >= 0.125:
                    yield (t[~_flags(t, shared.value)],)

        yield from _long_batches(chosen(), ["token"])

    add(_counted(texts, all_of_copies, least))
    return bits


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, sig) of rows (sig, node, n): pairs of small groups; of large groups a row (a = b = node) with sig.

    Rows come sorted by signature, and a task holds one batch of them and the small group that the batch may have cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            none = [np.zeros(0, np.int64)] * 3
            held, big, done = none, None, None  # big: a large group that goes on, done: its last node so far
            for batch in chain(batches, [None]):
                if batch is not None:
                    held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("sig", "node", "n"), strict=True)]
                sig, node, n = held
                fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
                if big is not None:
                    fresh &= (sig != big) | (node != done)
                sig, node, n = sig[fresh], node[fresh], n[fresh]
                held = none
                if not len(sig):
                    continue
                edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])
                size = np.diff(edge)
                large = size > SMALL_GROUP
                large[0] |= big is not None and sig[0] == big
                big, done = (sig[-1], node[-1]) if large[-1] else (None, None)
                if batch is not None and not large[-1]:  # the next batch may go on with this group
                    held = [x[edge[-2] :] for x in (sig, node, n)]
                    size, large, edge = size[:-1], large[:-1], edge[:-1]
                for m in np.unique(size[(size > 1) & ~large]).tolist():
                    at = edge[:-1][(size == m) & ~large, None]
                    i, j = np.triu_indices(m, 1)
                    x, y = (at + i).ravel(), (at + j).ravel()
                    ok = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                    yield node[x][ok], node[y][ok], np.zeros(int(ok.sum()), np.int64)
                wide = np.flatnonzero(np.repeat(large, size))
                yield node[wide], node[wide], sig[wide]

        yield from _long_batches(parts(), ["a", "b", "sig"])

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism * 4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "sig").sortWithinPartitions("sig", "node").mapInArrow(trimmed(run), "a long, b long, sig long")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(a, b, na, nb, same: size of the intersection) of pairs of nodes; sets are made anew from one text of each node."""
    wanted = kept(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "id"), "wanted")
    chosen = texts.join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            found = [(k, t) for (_, k, t), want in zip(_Sets(length)(iter([batch]), every=True), ids.tolist(), strict=True) if k == want]
            for a in range(0, len(found), 500):
                some = found[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([t.tobytes() for _, t in some], pa.large_binary()).cast(pa.binary())], ["node", "tokens"])

    sets = kept(chosen.mapInArrow(trimmed(run), "node long, tokens binary").dropDuplicates(["node"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, na, nb = [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(v, u)
                same.append(int((v[np.minimum(at, len(v) - 1)] == u).sum()))
                na.append(len(u))
                nb.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in (na, nb, same))], ["a", "b", "na", "nb", "same"])

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return kept(joined.mapInArrow(trimmed(compare), "a long, b long, na long, nb long, same long"), "compared")


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_shingles, component_id) per row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set is its distinct runs of ``length`` words, the whole
    sequence if it has fewer, and empty without words or text (null).  Documents link when 100 * intersection >=
    percent * union; empty sets link with nothing.  component_id is the smallest id that links reach, its own included.  Rows
    with one id count as one document with the links of all its texts; a null id has no component (null) and links with
    nothing.  An empty table gives no rows; other columns are not read.
    """
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.where("id IS NOT NULL")
    bits = texts.sparkSession.sparkContext.broadcast(frequent_bits(known, length))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parity = [], []
            for _, key, tokens in _Sets(length)(iter([batch]), every=True):
                _, _, rest, hot, rare = signatures(tokens, _flags(tokens, bits.value), percent) if len(tokens) else (0, 0, 0, 0, 0)
                rows.append((key, len(tokens), rest, hot, rare))
                parity.append(parity_bits(tokens))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            half = [x[: len(x) // 2] ^ x[len(x) // 2 :] for x in parity]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (parity, half)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns), *lists], ["id", "node", "n", "rest", "hot", "rare", "bits", "half"])

    described = kept(texts.mapInArrow(trimmed(describe), "id long, node long, n long, rest long, hot long, rare long, bits array<long>, half array<long>"), "described")
    some = described.where("n > 0 AND id IS NOT NULL")
    every = [F.max(c).alias(c) for c in ("n", "rest", "hot", "rare")]
    nodes = kept(some.groupBy("node").agg(F.min("id").alias("id"), *every, F.first("bits").alias("bits"), F.first("half").alias("half")), "nodes")

    def signed(combined: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts() -> Iterator[tuple[np.ndarray, ...]]:
                for _, key, tokens in _Sets(length)(batches):
                    sigs = signatures(tokens, _flags(tokens, bits.value), percent)[combined]
                    if len(sigs):
                        yield sigs.view(np.int64), np.full(len(sigs), key, np.int64), np.full(len(sigs), len(tokens), np.int64)

            yield from _long_batches(parts(), ["sig", "node", "n"])

        return known.mapInArrow(trimmed(run), "sig long, node long, n long")

    found = kept(_groups(signed(False), percent), "grouped")
    large = found.where("a = b")
    members = large.select("sig", F.col("a").alias("node")).union(signed(True).select("sig", "node")).distinct().join(nodes.select("node", "n", "rare"), "node")
    members = kept(members, "members")
    leaders = members.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("rare", "node", "n")).alias("lead")).where("m > 1")
    members = kept(members.join(leaders, "sig").select("sig", "node", "n", "m", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n")), "led")
    sketch = nodes.select("node", "bits", "half")  # joined only where pairs are compared, as it is wider than all else
    few, many = members.where(F.col("m") <= SMALL_GROUP).join(sketch, "node"), members.where(F.col("m") > SMALL_GROUP)
    alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    x, y = (few.select("sig", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "bits", "half")]) for s in "ab")
    ab = [F.col(f"{s}_{c}") for s in "ab" for c in ("bits", "half", "n")]
    small_pairs = x.join(y, "sig").where((F.col("a_node") < F.col("b_node")) & alike(F.col("a_n"), F.col("b_n")) & may_link(*ab, percent))
    small_pairs = small_pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.lit(0).alias("c"))
    led = many.where((F.col("node") != F.col("leader")) & alike(F.col("n"), F.col("leader_n")))
    led_pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.lit(0).alias("c"))
    candidates = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("c")).union(small_pairs).union(led_pairs)
    candidates = candidates.groupBy("a", "b").agg(F.sum("c").alias("c"))
    in_large = large.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("large"))
    facts = kept(nodes.join(in_large, "node", "left").select("node", "n", "rest", "hot", F.coalesce("large", F.lit(0)).alias("large")), "facts")

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose shared signatures and rests allow a link."""
        for s in ("a", "b"):
            pairs = pairs.join(facts.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "rest", "hot", "large")]), s)
        most = F.col("c") + F.least("large_a", "large_b") + F.least("hot_a", "hot_b") + F.greatest("rest_a", "rest_b")
        pairs = kept(pairs.where(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b"), "bounded")
        for s in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "bits", "half")]), s)
        return pairs.where(may_link(*[F.col(f"{s}_{c}") for s in "ab" for c in ("bits", "half", "n")], percent)).select("a", "b")

    first = _verified(kept(possible(candidates), "pairs"), known, nodes, length)
    is_link = (F.col("same") * 100 >= (F.col("na") + F.col("nb") - F.col("same")) * percent) & (F.col("same") > 0)
    links = first.where(is_link).select("a", "b")
    if not many.isEmpty():
        links = kept(links.union(_rest(many, links, first, possible, alike, percent, known, nodes, length, is_link)), "links")
    parts = components(links, "a", "b").select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    by_node = nodes.select("node", "id").join(parts, "node", "left").select("node", "id", F.coalesce("part", "node").alias("part"))
    least = by_node.groupBy("part").agg(F.min("id").alias("least"))
    named = kept(by_node.join(least, "part").select("node", "id", "least"), "named")
    # Rows with one id are one document: their nodes' components meet.
    twice = kept(some.select("id", "node").distinct().groupBy("id").agg(F.count("*").alias("k")).where("k > 1"), "twice")
    out = described.join(named.select("node", "least"), "node", "left")
    answer = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("least")), F.col("id"))).alias("component_id"))
    if twice.isEmpty():
        return answer
    joint = components(kept(answer.where(f"`{id_col}` IS NOT NULL"), "answer"), id_col, "component_id")
    merged = answer.join(joint.select(F.col("id").alias("of"), F.col("component_id").alias("to")), F.col(id_col) == F.col("of"), "left")
    return merged.select(id_col, "n_shingles", F.coalesce("to", "component_id").alias("component_id"))


def _rest(many, links, first, possible, alike, percent, known, nodes, length, is_link) -> DataFrame:
    """Further links in large groups: members that are not in their leader's component against members of other ones."""
    parts = kept(components(links, "a", "b").select(F.col("id").alias("node"), F.col("component_id").alias("part")), "parts")
    at = kept(many.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "at")
    lead = parts.select(F.col("node").alias("leader"), F.col("part").alias("leader_part"))
    far = first.select("a", "b", (1 - F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))).alias("far"))
    far = far.select(F.col("a").alias("node"), F.col("b").alias("leader"), "far").union(far.select("b", "a", "far"))
    at = at.join(lead, "leader", "left").withColumn("leader_part", F.coalesce("leader_part", "leader")).join(far, ["node", "leader"], "left")
    at = kept(at.select("sig", "node", "n", "part", "leader_part", F.when(F.col("node") == F.col("leader"), 0.0).otherwise(F.col("far")).alias("far")), "at")
    sketch = nodes.select("node", "bits", "half")
    apart = kept(at.where("part <> leader_part"), "apart")
    x = apart.join(sketch, "node").select("sig", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"), F.col("far").alias("fx"), F.col("bits").alias("bx"), F.col("half").alias("hx"))
    y = at.join(apart.select("sig").distinct(), "sig", "left_semi").join(sketch, "node").select("sig", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("part").alias("py"), F.col("leader_part").alias("ly"), F.col("far").alias("fy"), F.col("bits").alias("by"), F.col("half").alias("hy"))
    near = F.coalesce(F.abs(F.col("fx") - F.col("fy")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    open_pairs = x.join(y, "sig").where((F.col("px") != F.col("py")) & alike(F.col("nx"), F.col("ny")) & near & may_link(*map(F.col, ("bx", "hx", "nx", "by", "hy", "ny")), percent) & ((F.col("py") == F.col("ly")) | (F.col("x") < F.col("y"))))
    pairs = open_pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    pairs = kept(possible(pairs.withColumn("c", F.lit(0))), "open")
    return _verified(pairs, known, nodes, length).where(is_link).select("a", "b")


def without_near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and others) with one row of each component of near_duplicates: that of the smallest doc_id.

    Of rows with one doc_id one stays.  Rows with a null doc_id link with nothing and stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), length, percent)
    going = kept(found.where("doc_id <> component_id").select(F.col("doc_id").alias("going")).distinct(), "going")
    out = docs.join(going, docs["doc_id"].cast("long") == going["going"], "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    if repeated.isEmpty():
        return out
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
