"""Approximate nearest neighbours by inner product over balanced posting lists.

A vector of norm r gets one more component, sqrt(R^2 - r^2) with R the largest norm, and a query a 0: then the
largest inner product is the least Euclidean distance. Centroids are fitted, with a penalty on crowded ones, to a
bounded sample (SAMPLE rows, by hash); every row is indexed. A row joins its nearest list, and those further lists
whose centroid is at most (1 + REPLICATE) times as far and not nearer to a list it is already in than to the row
(COPIES at most). Queries find their lists by a greedy beam walk over the centroids' neighbour graph, held in
memory, whose edges go both ways and whose components are joined and entered one by one; distance-ratio pruning keeps
those at most (1 + ratio) times as far as the first. The ratio is the smallest
that reaches TARGET recall on the sample; where none does, the centroids are scanned and all lists searched. Lists
longer than LIMIT are cut into blocks of rows, and their queries into blocks of QUERIES_A_TASK. A query begins with its best k
of a part of the sample, and searches its lists nearest first, in rounds: each round takes GROWTH times as many rows as were
seen before it. A task returns a row only if it reaches the k-th best score that its query has from earlier rounds, which no
row of the result falls short of, so a round returns about k * (GROWTH - 1) rows a query instead of k a list; a window
merges those of a query. A matrix product finds what may be among the best; scores, order and
ties go by the inner products of the original vectors in double precision, one row at a time, so that equal vectors
have equal scores everywhere.

Edge cases: rows of a null id take no part, nor do vectors that are null, empty, zero, or hold null or non-finite
components, nor those of another length than most; with fewer candidates than k all are returned; ties go to the
smaller id; rows that repeat both id and vector are one candidate and one query, rows of one id with different
vectors are several, each query with its own ranks; no row is a candidate for a query of its own id; other columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.shared import materialise
from tracemill.llm.vectors import matrix, usable

K = 20
EVERY = 20
SAMPLE = 12_000
#: Rows a list should have, centroids at most (they are sent with the function), rows of a block.
LIST, CENTROIDS, LIMIT = 512, 20_000, 4096
#: Queries of a list that one task takes.
QUERIES_A_TASK = 4096
REPLICATE, COPIES = 0.06, 3
TARGET, BEAM, DEGREE = 0.97, 32, 24
#: Rows seen grow so many times a round; bytes (in double precision) of the rows of the sample that queries begin with.
GROWTH, BEGIN_BYTES = 4, 16_000_000
RATIOS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.17, 0.2, 0.25, 0.3, 0.4, 0.6, 1e9)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))[:, None]], 1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def fit(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Balanced k-means: a list's distance grows with its share of the rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centre = x[rng.permutation(len(x))[:k]]
    load = np.ones(k)
    for _ in range(8):
        d = np.concatenate([distances(part, centre) for part in np.array_split(x, 1 + len(x) // 2000)])
        own = np.argmin(d * (1 + 0.05 * np.log(np.maximum(load, 1e-3)))[None, :], 1)
        count = np.bincount(own, minlength=k)
        load = 0.5 * load + 0.5 * count * k / len(x)
        for c in np.flatnonzero(count):
            centre[c] = x[own == c].mean(0)
    return centre


class Centroids:
    """Centroids with a neighbour graph and the lists that rows and queries belong to."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre
        n = len(centre)
        width = min(DEGREE, n - 1)
        near = []
        for a in range(0, n, 512):
            d = distances(centre[a : a + 512], centre)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near.append(np.argsort(d, 1)[:, :width])
        right = np.concatenate([row for part in near for row in part] or [np.zeros(0, int)]).astype(int)
        left = np.repeat(np.arange(n), width)
        root = np.arange(n)
        while len(left):
            # The smallest centroid of each component.
            before = root.copy()
            np.minimum.at(root, left, before[right])
            np.minimum.at(root, right, before[left])
            root = root[root]
            if (root == before).all():
                break
        # Each component is entered at its most central centroid.
        entries = []
        for r in np.unique(root):
            mine = np.flatnonzero(root == r)
            entries.append(mine[np.argmin(((centre[mine] - centre[mine].mean(0)) ** 2).sum(1))])
        self.entries = np.array(entries)
        both = np.unique(np.concatenate([left * n + right, right * n + left]))
        self.begin = np.searchsorted(both // n, np.arange(n + 1))
        self.near = both % n

    def walk(self, q: np.ndarray, ratio: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Lists by distance: beam search from all components; the beam widens until its last is out of the ratio."""
        n = len(self.centre)
        if ratio >= RATIOS[-1]:
            dist = np.sqrt(((self.centre - q) ** 2).sum(1))
            order = np.argsort(dist, kind="stable")
            return order, dist[order]
        dist = np.full(n, np.inf)
        dist[self.entries] = np.sqrt(((self.centre[self.entries] - q) ** 2).sum(1))
        opened = np.zeros(n, bool)
        while True:
            order = np.argsort(dist, kind="stable")
            order = order[np.isfinite(dist[order])]
            edge = order[: max(beam, int((dist[order] <= (1 + ratio) * dist[order[0]]).sum()))]
            todo = edge[~opened[edge]]
            if not len(todo):
                break
            opened[todo] = True
            fresh = np.unique(np.concatenate([self.near[self.begin[t] : self.begin[t + 1]] for t in todo]))
            fresh = fresh[np.isinf(dist[fresh])]
            dist[fresh] = np.sqrt(((self.centre[fresh] - q) ** 2).sum(1))
        kept = order[dist[order] <= (1 + ratio) * dist[order[0]]]
        return kept, dist[kept]

    def lists(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each row: the nearest, and further ones at the boundary."""
        out = []
        for part in np.array_split(x, 1 + len(x) // 2000):
            d = distances(part, self.centre)
            width = min(8, d.shape[1])
            near = np.argpartition(d, width - 1, 1)[:, :width]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
            for i, row in enumerate(near):
                chosen = [int(row[0])]
                for c in row[1:]:
                    if len(chosen) == COPIES or d[i, c] > (1 + REPLICATE) * d[i, row[0]]:
                        break
                    if all(((self.centre[c] - self.centre[b]) ** 2).sum() > d[i, c] ** 2 for b in chosen):
                        chosen.append(int(c))
                out.append(chosen)
        return out


def tune(centroids: Centroids, x: np.ndarray, most: float, k: int) -> float:
    """The smallest ratio that reaches the target recall for a few queries of the sample."""
    raw = x[:, :-1]
    lists = centroids.lists(x)
    holds = np.zeros((len(x), len(centroids.centre)), bool)
    for i, row in enumerate(lists):
        holds[i, row] = True
    asked = np.arange(min(64, len(x)))
    truth = []
    for q in asked:
        s = raw @ raw[q]
        s[q] = -np.inf
        truth.append(np.argsort(-s, kind="stable")[: min(k, len(x) - 1)])
    for ratio in RATIOS:
        hit = total = 0
        for q, want in zip(asked, truth):
            probe = np.concatenate([raw[q], [0.0]])
            got = holds[want][:, centroids.walk(probe, ratio)[0]].any(1)
            hit, total = hit + got.sum(), total + len(want)
        if hit >= TARGET * total:
            return ratio
    return RATIOS[-1]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, best first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def once(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that repeat both id and vector, once."""
    if len(np.unique(ids)) == len(ids):
        return x, ids
    first = np.sort(np.unique(np.column_stack([ids, (x + 0.0).view(np.int64)]), axis=0, return_index=True)[1])
    return x[first], ids[first]


def nearest(qs: np.ndarray, own: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of its k best among the rows x that reach its floor."""
    out = []
    # A product of matrices may err in the last bits: whatever it puts this near the k-th or the floor is scored anew.
    slack = 1e-12 * np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((qs * qs).sum(1))
    for a in range(0, len(qs), 256):
        scores = qs[a : a + 256] @ x.T
        for i, s in enumerate(scores, a):
            s[ids == own[i]] = -np.inf
            floor = max(floors[i], np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else floors[i]
            place = np.flatnonzero((s >= floor - slack[i]) & (s > -np.inf))
            exact = (x[place] * qs[i]).sum(1)
            top = best(exact, ids[place], k)
            top = top[exact[top] >= floors[i]]
            out.append((ids[place[top]], exact[top]))
    return out


def _post(centroids: Centroids, most: float):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            lists = centroids.lists(lifted(x, most)) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    return run


def _ask(centroids: Centroids, ratio: float, x: np.ndarray, ids: np.ndarray, k: int):
    """Lists of each query, nearest first, its k best of the rows x, and the k-th best score."""

    def run(batches):
        for batch in batches:
            qs = matrix(batch.column(1))
            found = nearest(qs, batch.column(0).to_numpy(), np.full(len(qs), -np.inf), x, ids, k) if len(qs) else []
            lists = [centroids.walk(q, ratio)[0].tolist() for q in np.concatenate([qs, np.zeros((len(qs), 1))], 1)] if len(qs) else []
            floors = [score[-1] if len(score) == k else -np.inf for _, score in found]
            begin = [[{"vec_id": i, "score": v} for i, v in zip(near.tolist(), score.tolist())] for near, score in found]
            new = [pa.array(lists, pa.list_(pa.int32())), pa.array(floors, pa.float64()), pa.array(begin, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lists", "floor", "found"])

    return run


def _searched(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found, own, tie = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if queries.num_rows and rows.num_rows:
            own, tie = queries["id"].to_numpy(), queries["tie"].to_numpy()
            found = nearest(matrix(queries["vector"]), own, queries["floor"].to_numpy(), *once(matrix(rows["vector"]), rows["id"].to_numpy()), k)
        sizes = np.array([len(ids) for ids, _ in found], int)
        ids, scores = (np.concatenate([np.zeros(0, kind), *(f[c] for f in found)]) for c, kind in enumerate((np.int64, float)))
        return pa.table({"query_id": np.repeat(own, sizes), "tie": np.repeat(tie, sizes), "vec_id": ids, "score": scores})

    return run


def rounds(seen: int, lists: int) -> list[tuple[int, int]]:
    """Ranges of a query's lists, by place, that rounds search after `seen` rows."""
    out, low, total = [], 0, max(seen, LIST)
    while low < lists:
        total *= GROWTH
        out.append((low, max(low + 1, (total - max(seen, LIST)) // LIST)))
        low = out[-1][1]
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query."""
    take = lambda df: df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    valid = take(rows)
    common = valid.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return valid.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    valid = materialise(valid.filter(F.size("vector") == common["d"]), "vectors")
    asked = take(queries).filter(F.size("vector") == common["d"]).dropDuplicates(["id", "vector"])
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, most = valid.agg(F.count("*"), F.sqrt(F.max(square))).first()
    bound = int(min(1.0, SAMPLE / total) * (1 << 30))
    drawn = valid.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < bound + 1).select("id", "vector").limit(2 * SAMPLE).collect()
    drawn = sorted(drawn, key=lambda r: (r["id"], r["vector"]))
    drawn = drawn or [valid.first()]
    raw, raw_ids = np.array([r["vector"] for r in drawn], np.float64), np.array([r["id"] for r in drawn], np.int64)
    chosen = np.random.default_rng(5).permutation(len(raw))[: max(1, BEGIN_BYTES // (8 * raw.shape[1]))]
    begin = once(raw[chosen], raw_ids[chosen])
    sample = lifted(raw, most)
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(3).permutation(len(sample))]
    centroids = Centroids(fit(sample, max(1, min(CENTROIDS, total // LIST))))
    ratio = tune(centroids, sample, most, k)
    kind = dict(valid.dtypes)["vector"]
    schema = f"id long, vector {kind}, lists array<int>"
    posted = materialise(valid.mapInArrow(_post(centroids, most), schema), "postings").withColumn("list", F.explode("lists")).drop("lists")
    asked = asked.repartition(F.col("id")).mapInArrow(_ask(centroids, ratio, *begin, k), f"{schema}, floor double, found array<struct<vec_id: long, score: double>>")
    asked = materialise(asked.withColumn("tie", F.xxhash64("vector")), "probes")
    near = asked.select(F.col("id").alias("query_id"), "tie", F.inline("found"))
    probes, task = asked.drop("found"), ["list", "block", "turn"]
    order = Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), "vec_id")
    parts = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    spans = rounds(len(begin[1]), len(centroids.centre))
    for low, high in spans:
        if low:
            near = materialise(near, "nearest").drop("rank")
            floors = near.groupBy(F.col("query_id").alias("id"), "tie").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
            probes = asked.join(floors, ["id", "tie"], "left").withColumn("floor", F.coalesce("least", "floor")).drop("least", "found")
        probing = probes.withColumn("list", F.explode(F.slice("lists", low + 1, high - low))).drop("lists")
        # One row a list: as many as there are centroids.
        cuts = materialise(parts(posted, LIMIT, "blocks").join(parts(probing, QUERIES_A_TASK, "turns"), "list"), "blocks")
        held = posted.join(cuts, "list").select("id", "vector", "list", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int").alias("block"), each("turns", "turn"))
        asking = probing.join(cuts, "list").select("id", "tie", "vector", "floor", "list", each("blocks", "block"), F.pmod(F.xxhash64("id", "tie"), F.col("turns")).cast("int").alias("turn"))
        found = asking.groupBy(*task).cogroup(held.groupBy(*task)).applyInArrow(_searched(k), "query_id long, tie long, vec_id long, score double")
        # A row that several lists hold is one candidate; both steps go by the query, so they share one shuffle.
        distinct = near.unionByName(found).repartition("query_id", "tie").dropDuplicates(["query_id", "tie", "vec_id", "score"])
        near = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))


QUERIES = {"op10_ann": op10_ann}
ORACLES: dict[str, str] = {}
