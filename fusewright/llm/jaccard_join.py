"""Similarity join on sets of five-word shingles with a count-vector R-tree; links make components.

1. Every document's shingles are hashed; documents of equal sets become one class.
2. Classes meet by their least shingle hashes, and an R-tree over each meeting's count vectors bounds the
   overlap of pairs by the summed minima of coordinates.  Only classes with a surviving pair send their whole
   sets; surviving pairs are verified on these.  A pair in one component already needs no proof.
3. Round one uses the least hash of every class, round two the following ones, and there only meetings of
   different components.  Links go into a distributed component search.

Routing: with |A and B| >= 4/9 (|A| + |B|) the classes share one of the first |A| - ceil(0.8 |A|) + 1 hashes in
order.  All of these are used up to ``tokens``, 24 unless asked otherwise; with 24 a pair at the very threshold is
missed with a chance below 0.2 ** 24 = 2e-17, as rare as a collision of the hashes themselves.  ``tokens=None`` uses all of
them, which is exact whatever the hashes are like, and takes a fifth of all shingles through the shuffle.

A meeting of over ``MEET`` classes is cut by size: sets whose sizes differ by more than a quarter cannot link, so bands of
sizes by powers of 5/4 meet themselves and their neighbours only.  Bands are cut into pieces, and each pair of pieces is a task of its own.

Defined cases: no words or null text: empty set, linked with nothing; one to four words: the whole sequence
is one shingle; a null ``doc_id`` takes part, sorts last and is null again in the result; rows with equal
``doc_id`` stay separate rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _M2, mix, sequence_grams
from .common import BLOCK_DOCS, NULL_ID, as_before, batchwise, block_rows, components, discard, open_blocks, pack_blocks, pack_rows, rows_of, rows_schema, store
from .rtree import CountTree
from .words import doc_ranges, lower_ascii, word_hashes, word_spans

SHINGLE, TOKENS, GROUPS, MEET = 5, 24, 64, 2000


def block_sets(block, which=None):
    """(place, sorted distinct shingle hashes) of the block's documents."""
    body = lower_ascii(block.bytes)
    starts, ends = word_spans(body, block.starts[block.sizes > 0])
    hashes = word_hashes(body, starts, ends)
    first, last = doc_ranges(starts, block.starts, block.ends)
    for i in range(len(block)) if which is None else which:
        h = hashes[first[i] : last[i]]
        if len(h) >= SHINGLE:
            yield i, np.unique(sequence_grams(h, SHINGLE))
        elif len(h):
            yield i, sequence_grams(h, len(h)) ^ mix(np.array([len(h)], np.uint64) * _M2)
        else:
            yield i, np.empty(0, np.uint64)


def counts_of(members: np.ndarray) -> np.ndarray:
    return np.bincount(((members >> np.uint64(5)) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


_SKETCH = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("tokens", pa.list_(pa.int64())), ("counts", pa.binary())])


def _sketch(tokens):
    def run(batches):
        for batch in batches:
            for _, block in open_blocks(batch):
                out = []
                for i, s in block_sets(block):
                    prefix = len(s) - -(-4 * len(s) // 5) + 1
                    prefix = prefix if tokens is None else min(tokens, prefix)
                    mark = np.array([np.bitwise_xor.reduce(mix(s)), mix(s * _M2).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else None
                    out.append((block.block_id * BLOCK_DOCS + i, int(block.ids[i]), len(s), mark, s[:prefix].view(np.int64).tolist(), counts_of(s).tobytes()))
                yield rows_of(_SKETCH, list(zip(*out)))

    return run


class _Sets:
    """Disjoint sets of small integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x):
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(x, x)) != root:
            self.up[x] = root
            x = above
        return root

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def _meetings(batches):
    """Rows of one meeting after the other; partitions are sorted by ``meet``."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array(batch.column("meet").to_pylist(), dtype=object)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cut[:-1], cut[1:]):
            if held and held[0].column("meet")[0].as_py() != key[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


def _surviving(table, counts, later_rounds):
    """(position, position) of the pairs of a meeting which the R-tree lets through."""
    sizes = table.column("n").to_numpy()
    comp = table.column("comp").to_numpy()
    piece = table.column("piece").to_numpy()
    two = piece.min() != piece.max()  # two pieces of a cut meeting: pairs within one belong elsewhere
    if later_rounds:
        tokens, token = table.column("tokens").to_pylist(), table.column("token")[0].as_py()
    tree = CountTree(counts, sizes)
    for q, p in tree.pairs():
        a, b = tree.order[q], tree.order[p]
        ok = comp[a] != comp[b]
        if two:
            ok &= piece[a] != piece[b]
        for x, y in zip(a[ok].tolist(), b[ok].tolist()):
            if later_rounds:
                common = np.intersect1d(tokens[x], tokens[y], assume_unique=True)
                if common[0] != token:
                    continue  # the pair meets at a smaller token too
            yield x, y


def _counts(table):
    return np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).reshape(-1, GROUPS)


_WANTED = pa.schema([("row", pa.int64()), ("meet", pa.string())])


def _survivors(later_rounds):
    def run(batches):
        for table in _meetings(batches):
            comp = table.column("comp").to_numpy()
            if table.num_rows < 2 or comp.min() == comp.max():
                continue
            live = np.zeros(table.num_rows, bool)
            for a, b in _surviving(table, _counts(table), later_rounds):
                live[a] = live[b] = True
            rows = table.column("row").to_numpy()[live]
            if len(rows):
                yield rows_of(_WANTED, [rows, [table.column("meet")[0].as_py()] * len(rows)])

    return run


_WHOLE = pa.schema([("row", pa.int64()), ("meet", pa.string()), ("members", pa.binary())])


def _whole_sets(batches):
    for batch in batches:
        wanted = batch.column("wanted")
        for k, block in open_blocks(batch):
            meets: dict[int, list[str]] = {}
            for x in wanted[k].as_py():
                meets.setdefault(x["row"] % BLOCK_DOCS, []).append(x["meet"])
            out = [(block.block_id * BLOCK_DOCS + i, m, s.tobytes()) for i, s in block_sets(block, sorted(meets)) for m in meets[i]]
            yield rows_of(_WHOLE, list(zip(*out)))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(later_rounds):
    def run(batches):
        for table in _meetings(batches):
            members = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
            comp, rows = table.column("comp").to_pylist(), table.column("row").to_pylist()
            groups, links = _Sets(), []
            for a, b in _surviving(table, _counts(table), later_rounds):
                if groups.find(comp[a]) != groups.find(comp[b]):
                    shared = len(np.intersect1d(members[a], members[b], assume_unique=True))
                    if 9 * shared >= 4 * (len(members[a]) + len(members[b])):
                        groups.join(comp[a], comp[b])
                        links.append((comp[a], comp[b]))
            if links:
                yield rows_of(_LINK, list(zip(*links)))

    return run


def _cut(meets: DataFrame, meet: int) -> DataFrame:
    """Adds ``meet`` and ``piece``: members of a large meeting go to each pair of pieces that has theirs.

    A piece is a number within a band of sizes; it meets the pieces of its own band and of the two beside it.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("long")  # sizes of a ratio of 5/4 at most are one band apart at most
    pieces = meets.groupBy("token", band.alias("band")).agg(F.count(F.lit(1)).alias("m"))
    large = pieces.groupBy("token").agg(F.sum("m").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / meet).cast("long")))).alias("pieces")).where(F.col("all") > meet).drop("all")
    both = meets.withColumn("band", band).join(large, "token", "left")
    own = F.pmod(F.xxhash64("row"), F.coalesce(F.try_element_at("pieces", "band"), F.lit(1)))
    both = both.withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.shiftleft(F.col("band"), 32) + own))
    count = lambda k: F.coalesce(F.try_element_at("pieces", F.col("band") + k), F.lit(0))
    numbers = lambda k: F.sequence(F.lit(0).cast("long"), F.greatest(count(k), F.lit(1)) - 1)
    some = lambda k: F.when(count(k) > 0, F.transform(numbers(k), lambda x: F.shiftleft(F.col("band") + k, 32) + x)).otherwise(F.array().cast("array<bigint>"))
    others = F.when(F.col("pieces").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(some(-1), some(0), some(1)))
    paired = both.withColumn("_other", F.explode(others))
    return paired.withColumn("meet", F.concat_ws(":", "token", F.least("piece", "_other"), F.greatest("piece", "_other"))).drop("pieces", "_other", "band")


def _round(meets: DataFrame, blocks: DataFrame, later_rounds: bool, meet: int) -> DataFrame:
    """Verified links between components among the members (row, token, n, comp, counts, tokens) of meetings."""
    cut = _cut(meets, meet)
    wanted = cut.repartition("meet").sortWithinPartitions("meet").mapInArrow(_survivors(later_rounds), "row long, meet string")
    wanted = store(wanted, "wanted")
    by_block = wanted.groupBy(F.expr(f"row div {BLOCK_DOCS}").alias("block_id")).agg(F.collect_list(F.struct("row", "meet")).alias("wanted"))
    whole = blocks.join(by_block, "block_id").mapInArrow(batchwise(_whole_sets), "row long, meet string, members binary")
    full = whole.join(cut.join(wanted, ["row", "meet"], "left_semi"), ["row", "meet"])
    links = full.repartition("meet").sortWithinPartitions("meet").mapInArrow(_verify(later_rounds), "a long, b long")
    out = store(links, "verified")
    discard(wanted)
    return out


def _classes(blocks: DataFrame, tokens: int | None, meet: int) -> tuple[DataFrame, DataFrame]:
    """(sketch of every row; mark, n and smallest reachable doc_id of every class of equal sets)."""
    sketch = store(blocks.mapInArrow(batchwise(_sketch(tokens)), "row long, doc_id long, n long, mark binary, tokens array<long>, counts binary"), "sketch")
    least = sketch.where("n > 0").groupBy("mark", "n").agg(F.min(F.struct("doc_id", "row")).alias("x"))
    least = least.select("mark", F.col("x.row").alias("row"), F.col("x.doc_id").alias("least"))
    own = sketch.join(least.select("row", "least"), "row").select("row", "mark", "n", "tokens", "counts", "least")
    classes = store(own, "classes")
    first = classes.select("row", F.col("tokens")[0].alias("token"), "n", F.col("row").alias("comp"), "counts", F.lit(None).cast("array<long>").alias("tokens"))
    links = _round(first, blocks, False, meet)
    comp = store(components(classes.select(F.col("row").alias("id")), links), "components").select(F.col("id").alias("row"), F.col("component_id").alias("comp"))
    every = classes.select("row", F.explode("tokens").alias("token")).join(comp, "row")
    open_tokens = every.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("token")
    members = every.join(open_tokens, "token").join(classes.select("row", "n", "counts", "tokens"), "row")
    members = store(members, "members")
    links = links.unionByName(_round(members, blocks, True, meet))
    discard(members)
    comp = components(classes.select(F.col("row").alias("id")), links)
    named = comp.join(classes.select(F.col("row").alias("id"), "mark", "n", "least"), "id")
    smallest = named.groupBy("component_id").agg(F.min("least").alias("smallest"))
    return sketch, store(named.join(smallest, "component_id").select("mark", "n", "smallest", "component_id"), "classes")


def _labelled(blocks: DataFrame, tokens: int | None = TOKENS, meet: int = MEET) -> DataFrame:
    """row, doc_id, n, smallest and component_id (a row of the component) of every packed row.

    An empty set has its own doc_id as smallest, and no component_id.
    """
    sketch, classes = _classes(blocks, tokens, meet)
    return sketch.select("row", "doc_id", "n", "mark").join(classes, ["mark", "n"], "left").withColumn("smallest", F.coalesce("smallest", "doc_id"))


def jaccard_components(docs: DataFrame, tokens: int | None = TOKENS, meet: int = MEET) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest ``doc_id`` linked by any path, or its own)."""
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return _labelled(pack_blocks(docs), tokens, meet).select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("smallest").alias("component_id"))


def _keep(names):
    def run(batches):
        for batch in batches:
            places = batch.column("places")
            for k, block in open_blocks(batch):
                yield block_rows(block, names, np.sort(np.array(places[k].as_py(), np.int64)))

    return run


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the first row that has its smallest ``doc_id``, and every row of an empty set; no others.

    Components are told apart by row numbers, so unrelated documents of equal or null ``doc_id`` all stay.
    """
    blocks = pack_rows(docs)
    lean = blocks.drop("rest")
    labelled = _labelled(lean)
    kept = labelled.where("n > 0 and doc_id = smallest").groupBy("component_id").agg(F.min("row").alias("row")).select("row").unionByName(labelled.where("n = 0").select("row"))
    places = kept.groupBy(F.expr(f"row div {BLOCK_DOCS}").alias("block_id")).agg(F.collect_list(F.expr(f"row % {BLOCK_DOCS}")).alias("places"))
    return as_before(blocks.join(places, "block_id").mapInArrow(batchwise(_keep(docs.columns)), rows_schema(docs)), docs)
