"""Near-duplicate vectors: range search in robust-pruned flat graphs over overlapping cluster shards.

Vectors of one label (and length) link when their cosine is at least the threshold. Equal vectors are one node
with a multiplicity, so copies are never expanded. Nodes fall into shards around centroids of their label, drawn by
hash. The midpoint of a linking pair has a nearest centroid, and both ends lie within half the largest distance r of
a link from it; so a node joins every shard whose centroid may be the nearest one of a point within r / 2, and each
linking pair shares a shard. A shard larger than LIMIT is cut into blocks and searched by pairs of blocks, so
no task holds more than twice LIMIT, whatever the shard. Then:

1. each task links a node with its nearest ones and prunes them robustly (a neighbour goes when another kept one
   is nearer to it by ALPHA);
2. the lists of a node from all its tasks are united;
3. each task searches the united graph of its nodes: greedily from the medoid to each node, from there and from the
   node itself expanding as long as the cosine stays near the threshold; every hit is verified in double
   precision;
4. each task audits: the hits of all its nodes are compared with a scan, in rows of blocks, and what the graph missed
   is added. The graph alone loses links between tight groups, whose nearest ones are all their own.

A pair that several tasks hold is counted by the first of them; tasks return per node the links it has, and a
spanning forest of them, never all pairs.

Edge cases: a null label, a null, empty or zero vector, and one with null or non-finite components, link with
nothing; repeated rows of one id count as separate vectors; a null id counts as absent when the smallest id of a
component is taken, and is itself kept only in a component of null ids; components of any number type do; other columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.components import components
from tracemill.llm.shared import materialise, release

THRESHOLD = 0.98
#: Rows that a shard should have before others join it, rows of a block, rows of a label that stay one shard.
SHARD, LIMIT, WHOLE = 2500, 4000, 10_000
#: Nearest centroids of a node that may rule out the others.
RIVALS = 8
#: Centroids in all; they are sent with the function.
CENTROIDS = 20_000
DEGREE, NEAREST, ALPHA, SLACK = 16, 24, 1.2, 0.03


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: components known and finite, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square of a component over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prune(x: np.ndarray, near: np.ndarray, similarity: np.ndarray) -> list[np.ndarray]:
    """Of each node's nearest ones (in order), those to keep."""
    n, width = near.shape
    distance = np.sqrt(np.maximum(0, 2 - 2 * similarity))
    alive = np.ones((n, width), bool)
    kept = np.zeros((n, width), bool)
    between = np.sqrt(np.maximum(0, 2 - 2 * x[near] @ x[near].transpose(0, 2, 1)))
    for i in range(width):
        take = alive[:, i] & (kept.sum(1) < DEGREE)
        kept[:, i] = take
        alive &= ~(take[:, None] & (ALPHA * between[:, i] <= distance))
    return [row[k] for row, k in zip(near, kept)]


def graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each node, and the reverse of each such edge."""
    n, out = len(x), []
    width = min(NEAREST, n - 1)
    for a in range(0, n, 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, width - 1, 1)[:, :width] if width else np.zeros((len(s), 0), int)
        value = np.take_along_axis(s, near, 1)
        order = np.argsort(-value, 1, kind="stable")
        out += prune(x, np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1))
    left = np.repeat(np.arange(n), [len(o) for o in out])
    right = np.concatenate([*out, np.zeros(0, int)]).astype(int)
    both = np.unique(np.concatenate([left * n + right, right * n + left]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def products(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, some at a time: a node may have very many neighbours."""
    parts = 1 + len(left) // 50_000
    return np.concatenate([np.einsum("nd,nd->n", x[a], x[b]) for a, b in zip(np.array_split(left, parts), np.array_split(right, parts))])


def search(x: np.ndarray, neighbours: list[np.ndarray], threshold: float) -> np.ndarray:
    """Pairs (x < y) found by range-expanding greedy search, coded x * n + y."""
    n = len(x)
    begin = np.concatenate([[0], np.cumsum([len(v) for v in neighbours])])
    flat = np.concatenate([*neighbours, np.zeros(0, int)]).astype(int)
    spread = lambda at: (np.repeat(begin[at] - np.concatenate([[0], np.cumsum(begin[at + 1] - begin[at])[:-1]]), begin[at + 1] - begin[at]) + np.arange((begin[at + 1] - begin[at]).sum()))
    # From the medoid greedily to each node.
    at = np.full(n, int(np.argmax(x @ x.sum(0))))
    best = x @ x[at[0]] if n else np.zeros(0)
    moving = np.arange(n)
    while len(moving):
        lens = begin[at[moving] + 1] - begin[at[moving]]
        next_to, who = flat[spread(at[moving])], np.repeat(moving, lens)
        s = products(x, next_to, who)
        order = np.lexsort((s, who))
        last = np.flatnonzero(np.concatenate([who[order][1:] != who[order][:-1], [True]])) if len(order) else order
        top, node = order[last], who[order][last]
        better = s[top] > best[node]
        at[node[better]], best[node[better]] = next_to[top[better]], s[top[better]]
        moving = node[better]
    # Then outwards, as long as the cosine is near enough.
    seen = np.unique(np.concatenate([np.arange(n) * n + at, np.arange(n) * n + np.arange(n)]))
    edge, hits = seen, []
    while len(edge):
        q, v = edge // n, edge % n
        lens = begin[v + 1] - begin[v]
        code = np.unique(np.repeat(q, lens) * n + flat[spread(v)])
        place = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
        code = code[seen[place] != code]
        s = products(x, code // n, code % n)
        hits.append(code[s >= threshold])
        seen = np.union1d(seen, code)
        edge = code[s >= threshold - SLACK]
    own = np.einsum("nd,nd->n", x, x[at]) >= threshold
    hits.append(np.arange(n)[own] * n + at[own])
    code = np.unique(np.concatenate(hits))
    q, v = code // n, code % n
    return np.unique((np.minimum(q, v) * n + np.maximum(q, v))[q != v])


def scan(x: np.ndarray, rows: np.ndarray, threshold: float) -> np.ndarray:
    """The same of some rows by comparing them with all."""
    n, out = len(x), [np.zeros(0, int)]
    for part in np.array_split(rows, 1 + len(rows) // 256):
        q, v = np.nonzero(x[part] @ x.T >= threshold)
        q = part[q]
        out.append(np.minimum(q, v)[q != v] * n + np.maximum(q, v)[q != v])
    return np.unique(np.concatenate(out))


def shards_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The centroids that may be the nearest of the midpoint of a row and another one that it links with."""
    half, out = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2, []
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ centroids.T
        may = np.ones(s.shape, bool)
        width = min(RIVALS, s.shape[1])
        for rival in np.argpartition(-s, width - 1, 1)[:, :width].T:
            # A point nearer to c than to the rival is at most `half` away: a plane lies between them.
            apart = np.sqrt(np.maximum(0, 2 - 2 * centroids[rival] @ centroids.T))
            may &= s + half * apart + 1e-7 >= np.take_along_axis(s, rival[:, None], 1)
        out += [np.flatnonzero(row) for row in may]
    return out


def _assign(centroids: dict, threshold: float):
    def run(batches):
        for batch in batches:
            groups, rows = batch.column(1).to_pylist(), []
            x = batch.column(2)
            for group in sorted(set(groups)):
                mine = np.flatnonzero([g == group for g in groups])
                if group not in centroids:
                    rows += [(m, [0]) for m in mine.tolist()]
                    continue
                found = shards_of(unit(matrix(x.take(pa.array(mine)))), centroids[group], threshold)
                rows += zip(mine.tolist(), [f.tolist() for f in found])
            rows.sort()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"])

    return run


def _built(rows: pa.Table) -> pa.Table:
    x = unit(matrix(rows["vector"]))
    node = rows["node"].to_numpy()
    lists = graph(x) if len(x) > 1 else [np.zeros(0, int)]
    return pa.table({"node": pa.array(node), "near": pa.array([node[v] for v in lists], pa.list_(pa.int64()))})


def _found(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["node"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        x, node, times = unit(matrix(rows["vector"])), rows["node"].to_numpy(), rows["times"].to_numpy()
        n = len(x)
        near = rows["near"].combine_chunks()
        lens = np.array([len(v) for v in near])
        flat = near.flatten().to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(node, flat), n - 1)
        inside = node[place] == flat
        owner = np.repeat(np.arange(n), lens)[inside]
        code = np.unique(np.concatenate([owner * n + place[inside], place[inside] * n + owner]))
        lists = np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))
        pairs = search(x, lists, threshold)
        pairs = np.union1d(pairs, scan(x, np.arange(n), threshold))
        a, b = pairs // n, pairs % n
        # The first task that holds both ends counts the pair.
        block = rows["block"].to_numpy()
        i, j, shard = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["shard"][0].as_py()
        mine = (block[a] != block[b]) | (i == j)
        a, b = a[mine], b[mine]
        before = [[s for s in r if s < shard] for r in rows["shards"].to_pylist()]
        wide = np.full((n, max(map(len, before))), -1)
        for k, s in enumerate(before):
            wide[k, : len(s)] = s
        held = np.unique(np.concatenate([np.array([-1]), (np.arange(n)[:, None] * shard + wide)[wide >= 0]]))
        for k in range(wide.shape[1]):
            # held is sorted: whether b is in the k-th shard of a, too.
            code = b * shard + wide[a, k]
            there = (wide[a, k] >= 0) & (held[np.minimum(np.searchsorted(held, code), len(held) - 1)] == code)
            a, b = a[~there], b[~there]
        links = np.bincount(a, times[b], n) + np.bincount(b, times[a], n)
        # A spanning forest: the smallest reachable node of each.
        root = np.arange(n)
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        return pa.table({"node": pa.array(node), "links": pa.array(links.astype(np.int64)), "toward": pa.array(node[root])})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    good = usable(F.col(vector)) & F.col(label).isNotNull()
    rows = materialise(
        vectors.select(F.col(key).alias("id"), F.when(good, F.xxhash64(F.col(label).cast("string"), F.col(vector))).alias("node"), F.concat_ws(":", F.col(label).cast("string"), F.size(vector)).alias("group"), F.when(good, F.col(vector)).alias("vector")), "vectors"
    )
    nodes = materialise(rows.filter("node is not null").groupBy("node").agg(F.first("group").alias("group"), F.first("vector").alias("vector"), F.count("*").alias("times"), F.min("id").alias("least")), "nodes")
    per = max(SHARD, nodes.count() // CENTROIDS + 1)
    # Labels of one shard need no centroid; the others, being larger than that, are at most CENTROIDS.
    counts = {r["group"]: r["count"] for r in nodes.groupBy("group").count().filter(F.col("count") > max(WHOLE, per)).collect()}
    sizes = {g: -(-c // per) for g, c in counts.items()}
    wanted = nodes.sparkSession.createDataFrame([(g, k, counts[g]) for g, k in sizes.items()] or [("", 0, 1)], "g string, k long, total long")
    # The first k of each label in hash order; a threshold, four deviations above k, keeps the draw small.
    share = (F.col("k") + 4 * F.sqrt("k") + 8) / F.col("total")
    order = F.pmod(F.xxhash64("node", F.lit("centroid")), F.lit(1 << 30))
    drawn = nodes.join(F.broadcast(wanted), F.col("group") == F.col("g")).withColumn("order", order).filter(F.col("order") < F.ceil(share * (1 << 30)) + 1).select("group", "order", "node", "vector")
    centroids = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["order"], r["node"])) if sizes else []:
        if len(centroids.setdefault(r["group"], [])) < sizes[r["group"]]:
            centroids[r["group"]].append(r["vector"])
    centroids = {g: unit(np.array(v, np.float64)) for g, v in centroids.items()}
    placed = nodes.select("node", "group", "vector", "times").mapInArrow(_assign(centroids, threshold), f"node long, group string, vector {dict(nodes.dtypes)['vector']}, times long, shards array<int>")
    placed = materialise(placed, "placed")
    members = placed.withColumn("shard", F.explode("shards"))
    blocks = members.groupBy("group", "shard").agg(F.ceil(F.count("*") / F.lit(LIMIT)).cast("int").alias("blocks"))
    blocked = members.join(blocks, ["group", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = blocked.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    tasks = materialise(tasks, "tasks")
    task = ["group", "shard", "i", "j"]
    lists = tasks.groupBy(*task).applyInArrow(_built, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = materialise(tasks.join(united, "node").groupBy(*task).applyInArrow(_found(threshold), "node long, links long, toward long"), "found")
    release(placed, tasks)
    forest = found.filter("node <> toward").select(F.col("node").alias("x"), F.col("toward").alias("y")).distinct()
    roots = components(forest)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "times", "least").join(sums, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("node", (F.col("links") + F.col("times") - 1).alias("n"), "component")
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.x = e.vec_id
"""

QUERIES = {"op4_vectors": op4_vectors}
ORACLES = {"op4_vectors": OP4_SQL}
