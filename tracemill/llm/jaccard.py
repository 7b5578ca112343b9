"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists of rare shingles for heavy ones.

A text's set holds the hashes of its distinct n-word shingles (of the whole text when it has fewer words). Two sets
link when their Jaccard similarity is at least num / den. Equal sets are one node; the join runs on nodes.

1. Survivors. A node that links shares at least num / den of its elements with others. Pieces of text send their
   elements, packed by shard, each once (those that several nodes of the piece hold without an owner, so that a
   frequent shingle is one entry a piece); shards answer, packed by home of the node, how many elements of each node
   others hold, and nodes with too few are out. Counts may only err upwards.
2. Keys. Elements of survivors are counted by Spark, and ordered by (count, hash). A heavy set goes into the
   inverted lists of its rarest elements, as many as it may lack in a partner and one more, so that two linked sets
   meet in one list at least. A light set enumerates its subsets instead: the larger set of a linked pair has L
   elements, of which ceil(num * L / den) are common, and equal subsets of so many elements meet. The boundary is
   the largest size up to which subsets cost no more rows than lists, scanned at their measured mean length.
3. Stars. Each node is compared with the smallest node of the lists where it meets it most often; components of
   these links are found.
4. Open lists, those that hold several components, are scanned in blocks: every node outside a list's main
   component against all others of different components. A pair is refuted by its sizes, or by sketches: the parity
   of elements in each of SKETCH buckets differs in no more places than the sets differ in elements. Of what is
   left, each node names its nearest ones, those pairs are compared exactly, components are joined, and the lists
   that are still open are scanned again for four times as many, until no node has more to name: joined components
   leave no pair that was not there before. So neither a group of near copies nor one of near misses is ever written
   out as pairs of one another but for those that must be compared.

Comparisons are exact on whole sets, and every linking pair that could join two components is compared.

Edge cases: null and empty texts have the empty set and link with nothing; repeated rows are one node; a null id
counts as absent when the smallest id of a component is taken; rows are told apart by id and hash of the text, so
null ids and an id of several texts do no harm; other columns, whatever their names, are ignored by clusters() and
kept by keep_one(); texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.components import connect
from tracemill.llm.shared import lean, lean_group, materialise, release, small
from tracemill.llm.tokens import U, Words, column, mix, pieces, rolled, spans_hash

WIDTH, NUM, DEN = 4, 85, 100
#: Bytes of text for each shard of the elements, and of each piece that packs its own.
SHARD, CHUNK = 12_000_000, 2_000_000
#: Shards whose share of the nodes is one home: its answers, at most an entry of 16 bytes an element, fit a task.
HOME = 4
#: Subsets that one set may have in memory at once.
SUBSETS = 2000
#: Bits of a sketch; rows of a block of an open list, and of a task that takes several lists.
SKETCH, BLOCK, BIN = 2048, 16_000, 40_000
#: Owner of an element that several nodes of its piece hold.
MANY = -1


def overlap(total: int, num: int, den: int) -> int:
    """Least common elements of a linking pair whose sizes sum to total."""
    return -(-num * total // (num + den))


def prefix(size: int, num: int, den: int) -> int:
    """Elements of a set of which a linked one has at least one, whichever they are."""
    return size - -(-num * size // den) + 1


def larger(size: int, num: int, den: int) -> range:
    """Sizes that the larger set of a linked pair with a set of this size may have."""
    return range(size, size * den // num + 1)


def boundary(mean: float, num: int, den: int) -> int:
    """Largest size up to which subsets make no more rows than lists of this mean length cost."""
    size = 0
    while True:
        rows = sum(math.comb(size + 1, -(-num * top // den)) for top in larger(size + 1, num, den))
        if rows > min(SUBSETS, prefix(size + 1, num, den) * (1 + mean)):
            return size
        size += 1


class Sets:
    """Distinct shingles of texts, by text and hash."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, width: int):
        words = Words(buf, offsets, lower=True)
        at, hashes = rolled(words.hash, words.bounds, width)
        text = words.texts()[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        whole = spans_hash(words.hash, words.bounds[:-1][short], words.bounds[1:][short])
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, whole])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        self.text, self.hash = text[new], hashes[new]
        self.n = len(words.counts)
        self.size = np.bincount(self.text, minlength=self.n)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([np.zeros(1, U), np.cumsum(self.hash)])
        other = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.hash))])
        pick = lambda c: c[self.begin[1:]] - c[self.begin[:-1]]
        self.node = (mix(pick(total) ^ mix(pick(other) + self.size.astype(U))) >> U(1)).view(np.int64)  # not negative

    def parts(self, i: int) -> np.ndarray:
        return self.hash[self.begin[i] : self.begin[i + 1]]


def _summary(width: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(1))
            for a, b in pieces(offsets):
                sets = Sets(buf, offsets[a : b + 1], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets.size, pa.int64()), pa.array(sets.node), batch.column(2).slice(a, b - a)], names=["id", "n_shingles", "node", "tie"])

    return run


PACK = "shard int, low binary, owner binary, nodes binary"


def _packs(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "low", "owner", "nodes"])


def _packed(width: int, shards: int):
    """For each piece and shard: five bytes of each element, its owner's place among the pack's nodes (MANY: several),
    and the nodes; and once a piece, without elements, how many of each node's elements other nodes of the piece hold."""

    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(0))
            for a, b in pieces(offsets, CHUNK):
                sets = Sets(buf, offsets[a : b + 1], width)
                first = np.zeros(sets.n, bool)
                first[np.unique(sets.node, return_index=True)[1]] = True
                mine = first[sets.text]
                hashes, owner = sets.hash[mine], sets.text[mine]
                if not len(hashes):
                    continue
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                times = np.diff(np.concatenate([head, [len(hashes)]]))
                repeated = np.repeat(times > 1, times)
                holders = np.flatnonzero(first & (sets.size > 0))
                local = np.bincount(owner[repeated], minlength=sets.n)[holders]
                home = int(sets.node[holders[0]] % shards)
                rows = [(home, b"", local.astype("<i4").tobytes(), sets.node[holders].tobytes())]
                owner = np.where(times > 1, MANY, owner[head])
                hashes = hashes[head]
                shard = (hashes % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                low = (hashes >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                for s in np.flatnonzero(np.diff(cut)):
                    at = order[cut[s] : cut[s + 1]]
                    known = owner[at] != MANY
                    nodes, number = np.unique(owner[at][known], return_inverse=True)
                    place = np.full(len(at), MANY)
                    place[known] = number
                    rows.append((int(s), low[at].tobytes(), place.astype("<i2" if len(nodes) < 32768 else "<i4").tobytes(), sets.node[nodes].tobytes()))
                yield _packs(rows)

    return run


def _totals(nodes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes, and the sum of each one's counts."""
    each, place = np.unique(np.concatenate([np.zeros(0, np.int64), *nodes]), return_inverse=True)
    return each, np.bincount(place, np.concatenate([np.zeros(0), *counts]), len(each)).astype(np.int64)


ANSWER = "home int, nodes binary, counts binary"


def _shared(homes: int):
    """For each home of nodes: which of them have elements in a shard that other nodes hold, and at least how many."""

    def run(rows: pa.Table) -> pa.Table:
        low, node, out, counts = [], [], [], []
        for lows, owners, held in zip(*(rows[c].combine_chunks() for c in ("low", "owner", "nodes"))):
            lows, owners, nodes = lows.as_buffer(), owners.as_buffer(), np.frombuffer(held.as_buffer(), np.int64)
            if not lows.size:
                out.append(nodes)
                counts.append(np.frombuffer(owners, "<i4").astype(np.int64))
                continue
            five = np.frombuffer(lows, np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            low.append(wide.view("<u8").reshape(-1))
            place = np.frombuffer(owners, "<i2" if owners.size == 2 * len(five) else "<i4")
            node.append(np.where(place == MANY, MANY, np.concatenate([nodes, [MANY]])[place]))
        if low:
            low, node = np.concatenate(low), np.concatenate(node)
            order = np.argsort(low, kind="stable")
            low, node = low[order], node[order]
            head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            times = np.diff(np.concatenate([head, [len(low)]]))
            odd = (node == MANY) | (node != np.repeat(node[head], times))
            held = np.repeat(np.logical_or.reduceat(odd, head), times) & (node != MANY)
            each, n = np.unique(node[held], return_counts=True)
            out.append(each)
            counts.append(n)
        each, n = _totals(out, counts)
        order = np.argsort(each % homes, kind="stable")
        each, n = each[order], n[order]
        cut = np.searchsorted(each % homes, np.arange(homes + 1))
        some = np.flatnonzero(np.diff(cut))
        packed = [pa.array([x[cut[h] : cut[h + 1]].tobytes() for h in some], pa.binary()) for x in (each, n)]
        return pa.table({"home": pa.array(some, pa.int32()), "nodes": packed[0], "counts": packed[1]})

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """(node, n) of a home's nodes: at least how many of its elements other nodes hold."""
    read = lambda c: [np.frombuffer(x.as_buffer(), np.int64) for x in rows[c].combine_chunks()]
    each, n = _totals(read("nodes"), read("counts"))
    return pa.table({"node": pa.array(each), "n": pa.array(n)})


def sketch(elements: np.ndarray) -> bytes:
    """Parity of the number of elements in each bucket."""
    bucket = (elements >> U(40)) % U(SKETCH)
    return np.packbits(np.bincount(bucket.astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _contents(width: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(1))
            for a, b in pieces(offsets):
                sets = Sets(buf, offsets[a : b + 1], width)
                raw = [sets.parts(i).tobytes() for i in range(b - a)]
                marks = [sketch(sets.parts(i)) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets.size, pa.int64()), pa.array(raw, pa.binary()), pa.array(marks, pa.binary())], names=["node", "size", "content", "sketch"])

    return run


def _elements(batches):
    """(node, size, key) of each element."""
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        node = batch.column(0).to_numpy()
        size = np.array([len(c) // 8 for c in batch.column(1).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, size)), pa.array(np.repeat(size, size)), pa.array(flat)], names=["node", "size", "key"])


@cache
def _subsets(n: int, t: int) -> np.ndarray:
    return np.array(list(combinations(range(n), t)), np.int64).reshape(-1, t)


def _light(top: int, num: int, den: int):
    """(key, node) of the subsets of sets of at most `top` elements."""

    def run(batches):
        for batch in batches:
            nodes, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = np.frombuffer(raw, U)
                for size in larger(len(mine), num, den):
                    if size <= top:
                        got = mine[_subsets(len(mine), -(-num * size // den))].sum(1, dtype=U)
                        keys.append(mix(got + mix(np.full(1, size, U))))
                        nodes.append(np.full(len(got), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def meetings(contents: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(key, node) of the lists and subsets that more than one node has; and (key, x): the smallest node of each."""
    elements = materialise(contents.select("node", "content").mapInArrow(lean(_elements), "node long, size long, key long"), "elements")
    counts = materialise(elements.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    rows, squares = counts.agg(F.sum("df"), F.sum(F.col("df") * F.col("df"))).first()
    top = boundary(squares / rows if rows else 0.0, num, den)
    least = -(-num * (top + 1) // den)  # smaller sets have no heavy partner
    rare = F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rare")
    shared = elements.filter(F.col("size") >= least).join(counts, "key").groupBy("node", "size").agg(rare)
    # Elements that no other survivor holds come first in the order and make no list.
    wanted = F.col("size") - F.ceil(F.col("size") * num / F.lit(den)) + 1 - (F.col("size") - F.size("rare"))
    heavy = shared.filter(wanted > 0).select("node", F.explode(F.slice("rare", F.lit(1), wanted.cast("int"))).alias("r")).select("r.key", "node")
    light = contents.filter(F.col("size") <= top).select("node", "content").mapInArrow(lean(_light(top, num, den)), "key long, node long")
    lists = materialise(heavy.unionByName(light), "lists")
    release(elements, counts)
    pivots = materialise(lists.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("key", "x"), "pivots")
    return lists, pivots


def _linked(num: int, den: int):
    def run(batches):
        for batch in batches:
            hits = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                hits.append(den * common >= num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hits, pa.bool_())], names=["x", "y", "linked"])

    return run


def verify(pairs: DataFrame, contents: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) of the pairs, a written table, that link, by their whole sets."""
    left = contents.select(F.col("node").alias("x"), F.col("content").alias("cx"))
    right = contents.select(F.col("node").alias("y"), F.col("content").alias("cy"))
    both = small(pairs).join(left, "x").join(right, "y").select("x", "y", "cx", "cy")
    return both.mapInArrow(lean(_linked(num, den)), "x long, y long, linked boolean").filter("linked").select("x", "y")


def candidates(root: np.ndarray, size: np.ndarray, marks: np.ndarray, ask: np.ndarray, hold: np.ndarray, num: int, den: int, limit: int):
    """(x, y) of places: of those in `hold` that each of `ask` may link with in another component, the nearest `limit`;
    and whether there are more."""
    xs, ys, more = [], [], False
    step = max(1, 2_000_000 // max(1, len(hold)))
    for at in range(0, len(ask), step):
        mine = ask[at : at + step]
        low, high = np.minimum(size[mine][:, None], size[hold]), np.maximum(size[mine][:, None], size[hold])
        i, j = np.nonzero((root[mine][:, None] != root[hold]) & (den * low >= num * high))
        differ = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(marks[mine[i[c : c + 50_000]]] ^ marks[hold[j[c : c + 50_000]]]).sum(1, dtype=np.int64) for c in range(0, len(i), 50_000))])
        total = size[mine[i]] + size[hold[j]]
        may = differ <= total - 2 * -(-num * total // (num + den))
        i, j, differ = i[may], j[may], differ[may]
        order = np.lexsort((j, differ, i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        more |= bool((nth >= limit).any())
        xs.append(mine[i[nth < limit]])
        ys.append(hold[j[nth < limit]])
    return np.concatenate([np.zeros(0, int), *xs]), np.concatenate([np.zeros(0, int), *ys]), more


def _scanned(num: int, den: int, limit: int):
    """(x, y) that a task's lists leave to compare; (-1, -1) when there are more."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["key"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        key, node, root, main, size, role = (rows[c].to_numpy() for c in ("key", "node", "root", "main", "size", "role"))
        marks = np.frombuffer(b"".join(rows["sketch"].to_pylist()), U).reshape(len(key), -1)
        found, more = [np.zeros((0, 2), np.int64)], False
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            part = np.arange(a, b)
            ask = part[(role[part] == 1) | ((role[part] == 2) & (root[part] != main[part]))]
            x, y, left = candidates(root, size, marks, ask, part[role[part] != 1], num, den, limit)
            more |= left
            found.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1))
        pairs = np.unique(np.concatenate([*found, np.full((int(more), 2), -1)]), axis=0)
        return pa.table({"x": pa.array(pairs[:, 0]), "y": pa.array(pairs[:, 1])})

    return run


def open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the lists that hold several components, with the list's length, its main component and that one's share."""
    rooted = materialise(lists.join(small(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    by = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    several = by.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("root", "n").alias("main"), F.count("*").alias("roots"))
    several = materialise(several.filter("roots > 1").drop("roots"), "open")
    members = materialise(rooted.join(small(several), "key"), "lists")
    release(rooted, several)
    return members


def open_pairs(members: DataFrame, marks: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """(x, y) of nodes of open lists, of different components, that may link: of each node the nearest `limit` in a list;
    (-1, -1) when there are more."""
    rows = members.count()
    members = members.join(marks, "node")
    holds, asks = F.ceil(F.col("total") / F.lit(BLOCK)).cast("int"), F.ceil((F.col("total") - F.col("most")) / F.lit(BLOCK)).cast("int")
    members = members.withColumn("holds", holds).withColumn("asks", asks).withColumn("own", F.xxhash64("node"))
    slot = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    # A list of one block is a part of its bin's task; of longer ones, each block meets each block of nodes that ask.
    held = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda j: slot(F.pmod("own", "holds"), j, 0))
    asked = F.transform(F.sequence(F.lit(0), F.col("holds") - 1), lambda i: slot(i, F.pmod(F.xxhash64("own"), "asks"), 1))
    none = F.array().cast("array<struct<i:int,j:int,role:int>>")
    slots = F.when(F.col("holds") * F.col("asks") == 1, F.array(slot(F.lit(0), F.lit(0), 2))).otherwise(F.concat(held, F.when(F.col("root") != F.col("main"), asked).otherwise(none)))
    bins = 1 + rows // BIN
    tasks = members.withColumn("slot", F.explode(slots)).select("key", "node", "root", "main", "size", "sketch", F.col("slot.i").alias("i"), F.col("slot.j").alias("j"), F.col("slot.role").alias("role"))
    tasks = tasks.withColumn("bin", F.when(F.col("role") == 2, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")))
    return tasks.groupBy("bin", "i", "j").applyInArrow(lean_group(_scanned(num, den, limit)), "x long, y long").distinct()


def _tie(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(key, n_shingles, node, component, root, tie) of each row; component: the smallest key that links reach, root: what
    all rows of a component share, tie: a hash of the text."""
    raw = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), _tie(text).alias("tie"))
    shards = 1 + (raw.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD
    kind = docs.schema[key].dataType.simpleString()
    summary = materialise(raw.mapInArrow(lean(_summary(width)), f"id {kind}, n_shingles long, node long, tie long"), "sets")
    # Answers travel packed as the requests do: at most one entry an element, and a row for each shard and home.
    answers = raw.select("text").mapInArrow(lean(_packed(width, shards)), PACK).groupBy("shard").applyInArrow(lean_group(_shared(1 + shards // HOME)), ANSWER)
    shared = answers.groupBy("home").applyInArrow(lean_group(_summed), "node long, n long")
    nodes = summary.filter("n_shingles > 0").groupBy("node").agg(F.min("n_shingles").alias("size"), F.min(F.struct("id", "tie")).alias("h"))
    # One text of each survivor.
    survivors = materialise(nodes.join(shared, "node").filter(F.col("n") * den >= F.col("size") * num).select("node", F.col("h.id").alias("h_id"), F.col("h.tie").alias("h_tie")), "survivors")
    texts = raw.join(small(survivors), F.col("id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie"))).select("node", "text")
    contents = materialise(texts.mapInArrow(lean(_contents(width)), "node long, size long, content binary, sketch binary").dropDuplicates(["node"]), "contents")
    lists, pivots = meetings(contents, num, den)
    stars = lists.join(small(pivots), "key").filter("node <> x").groupBy("x", F.col("node").alias("y")).agg(F.count("*").alias("met"))
    best = materialise(stars.groupBy("y").agg(F.max_by("x", F.struct("met", -F.col("x"))).alias("x")).select("x", "y"), "stars")
    links = materialise(verify(best, contents, num, den), "links")
    roots = materialise(connect(links), "roots")
    done = materialise(best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "done")
    release(survivors, pivots, best)
    members = open_lists(lists, roots)
    release(lists)
    limit, more = 1, True
    while more:
        found = open_pairs(members, contents.select("node", "size", "sketch"), num, den, limit)
        fresh = materialise(found.join(done, ["x", "y"], "left_anti"), "fresh")
        more = not fresh.filter("x < 0").isEmpty()
        pairs = fresh.filter("x >= 0")
        before = [fresh]
        if not pairs.isEmpty():
            new = materialise(verify(pairs, contents, num, den), "new")
            before += [new, done]
            done = materialise(done.union(pairs), "done")
            if not new.isEmpty():
                before += [links, roots]
                links = materialise(links.union(new), "links")
                roots = materialise(connect(links), "roots")
                if more:
                    before.append(members)
                    members = open_lists(members.select("key", "node"), roots)
        release(*before)
        limit *= 4
    release(members, done, contents)
    release(links)
    named = summary.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = materialise(named, "named")
    final = named.groupBy("root").agg(F.min("least").alias("component"))
    out = summary.join(named.join(final, "root").select("node", "component", "root"), "node")
    out = materialise(out.select(F.col("id").alias(key), "n_shingles", "node", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component")).alias("component"), "root", "tie"), "clusters")
    release(summary, roots, named)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without those that another of their component stands for: the smallest key's first row stays, one of a null key only
    where no other is. Rows without words stay."""
    found = clusters(docs, key, text, **how)
    rows = materialise(found.filter("n_shingles > 0").groupBy(F.col(key).alias("k_key"), F.col("tie").alias("k_tie"), "root").agg(F.count("*").alias("twins")), "rows")
    first = F.min(F.struct(F.col("k_key").isNull().alias("null"), "k_key", "k_tie")).alias("first")
    groups = materialise(rows.groupBy("root").agg(first, F.count("*").alias("n")).filter("n > 1").select("root", "first"), "groups")
    stays = F.col("k_key").eqNullSafe(F.col("first.k_key")) & (F.col("k_tie") == F.col("first.k_tie"))
    gone = rows.join(groups, "root").filter(~stays).select("k_key", "k_tie")
    twins = rows.join(groups, "root", "left").filter("twins > 1").filter(F.col("first").isNull() | stays).select("k_key", "k_tie")
    gone, twins = materialise(gone, "gone"), materialise(twins, "twins")
    release(found, rows, groups)
    same = F.col(key).eqNullSafe(F.col("k_key")) & (_tie(text) == F.col("k_tie"))
    alone = docs.join(small(gone.unionByName(twins)), same, "left_anti")
    # Of rows that repeat key and text, one stays.
    both = docs.join(small(twins), same)
    twin = Window.partitionBy("k_key", "k_tie").orderBy(F.lit(0))
    one = both.withColumn("_tm_row", F.row_number().over(twin)).filter("_tm_row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(one)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


QUERIES = {"op6_jaccard": op6_jaccard}
ORACLES: dict[str, str] = {}
