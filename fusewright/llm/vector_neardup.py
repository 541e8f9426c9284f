"""Near-duplicate vectors by NN-descent.

1. Equal vectors of one label become one node with a count.  A label of at most ``LEAF`` nodes is a single leaf,
   compared pair by pair; the rest is for larger ones.
2. A first neighbour graph comes from random-projection trees, as deep as the label's own count asks for: nodes
   of a leaf compare with one another.
3. NN-descent refines it: every node introduces its neighbours and reverse neighbours to one another
   (neighbours of neighbours), and each keeps its best.  Rounds end when they find no further link.
4. The audit compares what the result would say of some nodes of each label with brute force over the label; a
   label below the wanted recall, or in which no link was seen, gets more trees and rounds if it has more than ``PIECE`` nodes.  One that
   never passes is compared pair by pair, in pieces, whatever its size.  Of a label of at most ``PIECE`` nodes every node is audited, and
   no link may be missing.
5. Links are the edges at or above the threshold.  A node whose whole list is above it may have more links
   than the list holds: then its list is enlarged to all nodes of its component, with which it is compared
   piece by piece, without pairs ever being rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without label, have no links and are kept; vectors of different length never link; a null vec_id is never the
name of a component unless it stands alone; rows of equal vec_id are separate vectors; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, components, discard, picked, rows_of, store

LIST, TREES, LEAF, PIECE, MEMBERS, AUDITED, SEED = 12, 10, 128, 1024, 256, 200, 11
CHUNK = 4096
MORE_TREES, WANTED_RECALL, MOST_ROUNDS = 10, 0.995, 6


def _unit(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_VEC = pa.schema([("vec_id", pa.int64()), ("space", pa.string()), ("vec", pa.binary())])


def _prepare(batches):
    for batch in batches:
        labels = batch.column("label").to_pylist()
        out = []
        for label, e in zip(labels, batch.column("embedding").to_pylist()):
            ok = label is not None and bool(e) and None not in e
            v = np.array(e, np.float64) if ok else None
            ok = ok and bool(np.isfinite(v).all()) and bool(v.any())
            out.append((f"{label}/{len(e)}", v.tobytes()) if ok else (None, None))
        yield rows_of(_VEC, [batch.column("vec_id"), [o[0] for o in out], [o[1] for o in out]])


def _groups(batches):
    """Rows of one ``key`` after the other; partitions are sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array(batch.column("key").to_pylist(), dtype=object)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cut[:-1], cut[1:]):
            if held and held[0].column("key")[0].as_py() != key[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


_NEAR = pa.schema([("node", pa.int64()), ("near", pa.list_(pa.struct([("less", pa.float64()), ("other", pa.int64())])))])
_NEAR_SQL = "node long, near array<struct<less:double,other:long>>"


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of unit vectors to 12 decimals, so that a pair has one value in whatever group it meets.

    Rounding moves none over the threshold: there the plain sum of products decides, which is the same everywhere.
    """
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    for at in range(0, len(i), 65536):
        a, b = i[at : at + 65536], j[at : at + 65536]
        s[a, b] = (x[a] * y[b]).sum(axis=1)
    return np.where(s >= threshold, np.maximum(np.round(s, 12), threshold), np.minimum(np.round(s, 12), np.nextafter(threshold, -1.0)))


def _best_within(threshold):
    """Of each group's members, the best neighbours within the group; ``less`` is the cosine's negative."""

    def run(batches):
        for table in _groups(batches):
            table = table.combine_chunks()
            node = table.column("node").to_numpy()
            _, first = np.unique(node, return_index=True)
            node = node[first]
            if len(node) < 2:
                continue
            x = _unit(table.column("vec").take(pa.array(first)).to_pylist())
            s = cosines(x, x, threshold)
            np.fill_diagonal(s, -2.0)
            k = min(LIST, len(node) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            less = -np.take_along_axis(s, best, axis=1)
            flat = pa.StructArray.from_arrays([pa.array(less.ravel()), pa.array(node[best].ravel())], names=["less", "other"])
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([pa.array(node), near], schema=_NEAR)

    return run


def _grouped(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: key, node, vec; the members' best neighbours in each group."""
    return rows.select("key", "node", "vec").repartition("key").sortWithinPartitions("key").mapInArrow(_best_within(threshold), _NEAR_SQL)


def _merge(*lists: DataFrame) -> DataFrame:
    """The best ``LIST`` distinct neighbours of each node."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("node").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, LIST).alias("near"))


def _leaves(nodes: DataFrame, trees: range) -> DataFrame:
    """key, node, vec for each tree: the signs along the tree's ``depth`` random directions name the leaf."""

    def run(batches):
        schema = pa.schema([("key", pa.string()), ("node", pa.int64()), ("vec", pa.binary())])
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            shapes = np.array([(len(v), d) for v, d in zip(vecs, batch.column("depth").to_pylist())], np.int64).reshape(-1, 2)
            out = []
            for size, depth in np.unique(shapes, axis=0).tolist():
                at = np.flatnonzero((shapes == (size, depth)).all(axis=1))
                x = _unit([vecs[i] for i in at])
                space = [batch.column("space")[int(i)].as_py() for i in at]
                for t in trees:
                    directions = np.random.default_rng([SEED, t, size]).standard_normal((x.shape[1], depth))
                    bits = np.packbits(x @ directions > 0, axis=1)
                    out += [(f"{t}/{s}/{b.tobytes().hex()}", i) for s, b, i in zip(space, bits, at.tolist())]
            yield rows_of(schema, [[o[0] for o in out], batch.column("node").take(pa.array([o[1] for o in out], pa.int64())), batch.column("vec").take(pa.array([o[1] for o in out], pa.int64()))])

    named = nodes.mapInArrow(run, "key string, node long, vec binary")
    # a leaf of many nodes (one tight cluster, say) is dealt into pieces
    large = named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE)
    cut = named.join(large, "key", "left")
    return cut.withColumn("key", F.concat_ws("#", "key", F.pmod(F.xxhash64("node", "key"), F.coalesce(F.ceil(F.col("n") / PIECE).cast("long"), F.lit(1)))))


def _introduced(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Neighbours of neighbours: each node brings its neighbours and reverse neighbours together."""
    ahead = graph.select("node", F.explode("near.other").alias("other"))
    met = ahead.select(F.col("node").alias("pivot"), F.col("other").alias("node")).unionByName(ahead.select(F.col("other").alias("pivot"), "node")).distinct()
    own = met.select("pivot").distinct().select("pivot", F.col("pivot").alias("node"))
    met = met.unionByName(own)
    busy = met.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS)
    met = met.join(busy, "pivot", "left")
    key = F.concat_ws("#", "pivot", F.pmod(F.xxhash64("node", "pivot"), F.coalesce(F.ceil(F.col("n") / MEMBERS).cast("long"), F.lit(1))))
    return _grouped(met.select(key.alias("key"), "node").join(nodes.select("node", "vec"), "node"), threshold)


def _links(graph: DataFrame, threshold: float) -> DataFrame:
    pairs = graph.select("node", F.explode("near").alias("x")).where(F.col("x.less") <= -threshold)
    return pairs.select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct()


def _asked(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Nodes to audit, with a weight: of each label's nodes with full, part and empty lists about the root of their label's count; all of a small label."""
    n_links = F.coalesce(F.expr(f"size(filter(near, x -> x.less <= {-threshold}))"), F.lit(0))
    kind = F.when(n_links >= LIST, 2).when(n_links > 0, 1).otherwise(0)
    state = nodes.select("node", "space", "total").join(graph, "node", "left").select("node", "space", "total", kind.alias("kind"))
    share = F.col("members") / F.greatest(F.lit(float(AUDITED)), F.sqrt("total"), F.when(F.col("total") <= PIECE, F.col("total").cast("double")))
    sizes = state.groupBy("space", "kind").agg(F.count(F.lit(1)).alias("members"), F.first("total").alias("total")).select("space", "kind", F.greatest(F.lit(1.0), share).alias("weight"))
    drawn = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) * F.col("weight") < (1 << 30)
    return state.join(sizes, ["space", "kind"]).where(drawn).select("node", "kind", "weight")


def _true_links(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all links of the asked nodes a, by brute force over their labels in chunks."""
    chunks = F.ceil(F.col("total") / CHUNK).cast("long")
    every = nodes.select(F.concat_ws("#", "space", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks)).alias("key"), "node", "vec", F.lit(False).alias("asks"))
    mine = nodes.join(asked.select("node"), "node").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    both = every.unionByName(mine.select(F.concat_ws("#", "space", "chunk").alias("key"), "node", "vec", F.lit(True).alias("asks")))

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for table in _groups(batches):
            node, asks = table.column("node").to_numpy(), np.array(table.column("asks").to_pylist(), bool)
            x = _unit(table.column("vec").to_pylist())
            q, base, names, others = x[asks], x[~asks], node[asks], node[~asks]
            for at in range(0, len(q), 512):
                i, j = np.nonzero(cosines(q[at : at + 512], base, threshold) >= threshold)
                a, b = names[at + i], others[j]
                yield rows_of(schema, [a[a != b], b[a != b]])

    return both.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _unproven(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """The labels (``space``, ``total``) whose audit did not reach ``WANTED_RECALL`` or saw no link of a list that is not full.

    Found is what the result counts: an edge of the graph, or a pair of one component with a node whose list is enlarged.
    Every node weighs the same however many links it has, and full lists are judged apart from the others.
    """
    asked = store(_asked(nodes, graph, threshold), "asked")
    links = store(_links(graph, threshold), "links")
    comp = store(components(nodes.select(F.col("node").alias("id")), links), "components").select(F.col("id").alias("node"), "component_id")
    counted = _full(graph, threshold).select(F.col("node").alias("a"), F.lit(True).alias("counted"))
    pairs = _true_links(nodes, asked, threshold).select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = pairs.join(links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("listed")), ["x", "y"], "left")
    pairs = pairs.join(comp.select(F.col("node").alias("a"), F.col("component_id").alias("c")), "a").join(comp.select(F.col("node").alias("b"), F.col("component_id").alias("d")), "b")
    pairs = pairs.join(counted, "a", "left")
    hit = F.coalesce("listed", F.col("counted") & (F.col("c") == F.col("d")), F.lit(False))
    shares = pairs.groupBy(F.col("a").alias("node")).agg(F.avg(hit.cast("double")).alias("share")).join(asked, "node").join(nodes.select("node", "space", "total"), "node")
    recall = lambda of: F.sum(F.when(of, F.col("weight") * F.col("share"))) / F.sum(F.when(of, F.col("weight")))
    wanted = F.when(F.first("total") <= PIECE, 1.0).otherwise(WANTED_RECALL)
    judged = shares.groupBy("space").agg(recall(F.col("kind") < 2).alias("open"), F.coalesce(recall(F.col("kind") == 2), F.lit(1.0)).alias("full"), wanted.alias("wanted"))
    passed = judged.where("open >= wanted and full >= wanted")
    out = store(nodes.select("space", "total").distinct().join(passed, "space", "left_anti"), "unproven")
    for table in (asked, links):
        discard(table)
    return out


def _full(graph: DataFrame, threshold: float) -> DataFrame:
    return graph.where(f"size(near) >= {LIST} and element_at(near, {LIST}).less <= {-threshold}").select("node")


def _roots(close: np.ndarray) -> np.ndarray:
    """For each member of a group the first member it reaches."""
    root = np.full(len(close), -1)
    for i in range(len(close)):
        front = np.array([i] if root[i] < 0 else [], np.int64)
        root[front] = i
        while len(front):
            front = np.flatnonzero(close[front].any(axis=0) & (root < 0))
            root[front] = i
    return root


def _all_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """members: group, node, n, vec.  (node, linked, root) of each node in each pair of pieces of its group.

    The sum of ``linked`` is exact; edges to ``root`` connect whatever links of the group connect.
    """
    size = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("pieces"))
    member = members.join(size, "group").withColumn("piece", F.pmod(F.xxhash64("node", F.lit("piece")), F.col("pieces")))
    paired = member.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    keyed = paired.select(F.concat_ws("#", "group", F.least("piece", "with"), F.greatest("piece", "with")).alias("key"), "node", "n", "piece", "vec")

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("linked", pa.int64()), ("root", pa.int64())])
        for table in _groups(batches):
            piece, n, node = (table.column(c).to_numpy() for c in ("piece", "n", "node"))
            x = _unit(table.column("vec").to_pylist())
            close = np.empty((len(node), len(node)), bool)
            for at in range(0, len(node), 512):
                close[at : at + 512] = cosines(x[at : at + 512], x, threshold) >= threshold
            if piece.min() != piece.max():  # pairs within one piece are counted where it meets itself
                close &= piece[:, None] != piece[None, :]
            np.fill_diagonal(close, False)
            close |= close.T
            yield rows_of(schema, [node, np.concatenate([close[at : at + 512] @ n for at in range(0, len(node), 512)]), node[_roots(close)]])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "node long, linked long, root long")


def _counted(nodes: DataFrame, comp: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Exact links (node, linked) of every node with a full list: it is compared with all nodes of its component, piece by piece."""
    members = comp.join(comp.join(full, "node", "left_semi").select("component_id").distinct(), "component_id", "left_semi")
    size = members.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("pieces"))
    member = members.join(size, "component_id").join(nodes.select("node", "n", "vec"), "node").withColumn("piece", F.pmod(F.xxhash64("node", F.lit("piece")), F.col("pieces")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    name = lambda piece, part: F.concat_ws("#", "component_id", piece, part).alias("key")
    # those who ask a piece come in parts of a piece's size, each with a copy of that piece
    base = member.withColumn("part", every).select(name("piece", "part"), "node", "n", "vec", F.lit(False).alias("asks"))
    asks = member.join(full, "node", "left_semi").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("pieces"))).withColumn("with", every)
    rows = base.unionByName(asks.select(name("with", "part"), "node", "n", "vec", F.lit(True).alias("asks")))

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("linked", pa.int64())])
        for table in _groups(batches):
            asks, n, node = np.array(table.column("asks").to_pylist(), bool), table.column("n").to_numpy(), table.column("node").to_numpy()
            if not asks.any() or asks.all():
                continue
            x = _unit(table.column("vec").to_pylist())
            q, base, names = x[asks], x[~asks], node[asks]
            linked = [((cosines(q[at : at + 512], base, threshold) >= threshold) & (names[at : at + 512, None] != node[~asks][None, :])) @ n[~asks] for at in range(0, len(q), 512)]
            yield rows_of(schema, [names, np.concatenate(linked)])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _searched(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(graph by NN-descent, labels whose audit did not pass)."""
    graph = store(_merge(_grouped(_leaves(nodes, range(TREES)), threshold)), "graph")
    trees, known = TREES, _links(graph, threshold).count()
    for left in reversed(range(MOST_ROUNDS)):
        better = store(_merge(graph, _introduced(nodes, graph, threshold)), "graph")
        discard(graph)
        graph, before = better, known
        known = _links(graph, threshold).count()
        if left and known > before * 1.001 + 1:
            continue
        unproven = _unproven(nodes, graph, threshold)
        again = unproven.where(F.col("total") > PIECE)  # a small label needs no further rounds: its pairs are few
        if not left or again.isEmpty():
            return graph, unproven
        again = nodes.join(again.select("space"), "space", "left_semi")
        more = store(_merge(graph, _grouped(_leaves(again, range(trees, trees + MORE_TREES)), threshold)), "graph")
        discard(graph)
        graph, trees = more, trees + MORE_TREES
        known = _links(graph, threshold).count()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label); pairs only within a label."""
    plain = picked(vectors, vec_id="long", embedding="array<double>", label="string")
    rows = store(plain.mapInArrow(_prepare, "vec_id long, space string, vec binary").withColumn("hash", F.xxhash64("space", "vec")), "vectors")
    name = F.coalesce("vec_id", F.lit(NULL_ID))
    valid = rows.where("vec is not null")
    # what is one node is decided on label and vector; nodes are numbered in a stored table, so numbers stay
    found = valid.groupBy("hash", "space", "vec").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("least"))
    numbered = store(found.withColumn("node", F.monotonically_increasing_id()), "numbered")
    totals = numbered.groupBy("space").agg(F.count(F.lit(1)).alias("total"))
    depth = F.when(F.col("total") <= LEAF, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log2(F.col("total") / LEAF)))).cast("int")
    nodes = store(numbered.join(totals, "space").select("node", "space", "vec", "n", "least", "total", depth.alias("depth")), "nodes")
    whole, large = nodes.where(F.col("total") <= LEAF), nodes.where(F.col("total") > LEAF)
    graph, unproven = _searched(large, threshold) if not large.isEmpty() else (large.sparkSession.createDataFrame([], _NEAR_SQL), None)
    if unproven is not None:
        whole = whole.unionByName(large.join(unproven.select("space"), "space", "left_semi").select(whole.columns))
        graph = graph.join(whole, "node", "left_anti")
    pairs = store(_all_pairs(whole.select(F.col("space").alias("group"), "node", "n", "vec"), threshold), "pairs")
    links = store(_links(graph, threshold), "links")
    joined = links.unionByName(pairs.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    comp = store(components(nodes.select(F.col("node").alias("id")), joined), "components").select(F.col("id").alias("node"), "component_id")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("listed"))
    exact = _counted(large, comp, _full(graph, threshold), threshold).unionByName(pairs.groupBy("node").agg(F.sum("linked").alias("linked")))
    least = comp.join(nodes, "node").groupBy("component_id").agg(F.min("least").alias("first"))
    known = nodes.select("node", "n").join(comp, "node").join(least, "component_id").join(listed, "node", "left").join(exact, "node", "left")
    known = known.select("node", "first", (F.coalesce("linked", "listed", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = store(numbered.select("hash", "space", "vec", "node").join(known, "node").drop("node"), "known")
    for table in (pairs, links):
        discard(table)
    out = rows.join(known, ["hash", "space", "vec"], "left")
    component = F.nullif(F.coalesce("first", "vec_id"), F.lit(NULL_ID))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
