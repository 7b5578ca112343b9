"""Substring deduplication by recompression.

A document is a sequence of words. Rounds replace runs of one symbol, and pairs of a left-kind and a right-kind
symbol, by a name that is a hash of what it stands for; the kind of a symbol in a round is a hash bit of its name.
So a name means the same words wherever it is formed, and all documents are named alike without a table that Spark
would have to give out and join in every round.
A symbol of at least LEAST words is not merged further. Each symbol carries the interval of words that its being
formed depends on (its neighbours' part in the decision included): a symbol whose interval lies in a window is
formed in every copy of that window. Hence:

1. A symbol that only one document has excludes all windows around it; Spark counts symbols over all documents.
2. The windows left, those whose interior symbols are all shared, and the few with no interior symbol, are
   hashed (96 bits) and meet their equals; the smallest document of each hash keeps it, the rest remove it.

Documents with the same words as an earlier one are removed whole beforehand (only the first of them takes part),
and documents without candidate windows are settled in the first pass, so that only texts with candidates are
read again. Symbols and windows are counted by aggregation with map-side combine, joined by shuffle.

Edge cases: null and empty texts have no words; texts shorter than the window lose nothing; a null id is larger
than every id, so such rows never cause a removal; rows of the same id do not remove each other; rows that repeat get
the same result; other columns, whatever their names, are ignored; an empty table gives no rows; texts of any length
are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import lean, materialise, release
from tracemill.llm.tokens import U, Words, column, mix, pieces, rolled, spans_hash

WINDOW = 50
LEAST = 6
ROUNDS = 8
RUN_EVERY = 4
FAR = np.int64(1) << 60
#: A null id stands for the largest.
NO_ID = (1 << 63) - 1


def symbols(values: np.ndarray, bounds: np.ndarray, least: int = LEAST, rounds: int = ROUNDS):
    """(name, text, lo, hi) of the symbols of at least `least` words; lo:hi is the interval each depends on, beyond
    any text when it depends on where the text begins or ends."""
    counts = np.diff(bounds)
    n = len(values)
    name, text = values.copy(), np.repeat(np.arange(len(counts)), counts)
    start, end = np.arange(n), np.arange(1, n + 1)
    lo, hi = start.copy(), end.copy()
    for turn in range(rounds):
        done = end - start >= least
        if turn % RUN_EVERY == 0 and len(name) > 1:
            equal = (name[1:] == name[:-1]) & (text[1:] == text[:-1]) & ~done[1:]
            together = text[1:] == text[:-1]
            left, right = np.full(len(name), -FAR), np.full(len(name), FAR)
            left[1:][together] = lo[:-1][together]
            right[:-1][together] = hi[1:][together]
            head = np.concatenate([[True], ~equal])
            first = np.flatnonzero(head)
            last = np.concatenate([first[1:], [len(name)]]) - 1
            length = last - first + 1
            # That a run ends here is known from its neighbours.
            lo2 = np.where(done[first], lo[first], np.minimum(lo[first], left[first]))
            hi2 = np.where(done[first], hi[last], np.maximum(hi[last], right[last]))
            name = np.where(length > 1, mix(name[first] ^ mix(length.astype(U) + U(0x5851F42D4C957F2D))), name[first])
            text, start, end, lo, hi = text[first], start[first], end[last], lo2, hi2
            done = end - start >= least
        if len(name) < 2:
            break
        side = ((name ^ U(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)) * U(0xD6E8FEB86659FD93)) >> U(63)
        leftish = side.astype(bool)
        together = text[1:] == text[:-1]
        pair = together & leftish[:-1] & ~leftish[1:] & ~done[:-1] & ~done[1:]
        merged = np.zeros(len(name), bool)
        merged[:-1] |= pair
        merged[1:] |= pair
        # One that stays owes that to the neighbour it might have joined.
        stays = ~merged & ~done
        right, left = np.full(len(name), FAR), np.full(len(name), -FAR)
        right[:-1][together] = hi[1:][together]
        left[1:][together] = lo[:-1][together]
        hi = np.where(stays & leftish, np.maximum(hi, right), hi)
        lo = np.where(stays & ~leftish, np.minimum(lo, left), lo)
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * U(0xA24BAED4963EE407) + mix(name[at + 1]))
        end[at], lo[at], hi[at] = end[at + 1], np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, text, start, end, lo, hi = name[keep], text[keep], start[keep], end[keep], lo[keep], hi[keep]
    whole = end - start >= least
    return name[whole], text[whole], lo[whole], hi[whole]


def interior(words: Words, window: int):
    """The symbols that some window of this length surely holds, by text and place."""
    name, text, lo, hi = symbols(words.hash, words.bounds)
    fits = (lo >= 0) & (hi < FAR) & (hi - lo <= window)
    return name[fits], text[fits], lo[fits], hi[fits]


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of begins:ends."""
    steps = np.bincount(np.maximum(begins, 0), minlength=n + 1)[: n + 1].astype(np.int64)
    steps -= np.bincount(np.clip(ends, 0, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and check of each window."""
    at, first = rolled(words.hash, words.bounds, window)
    _, second = rolled(words.hash, words.bounds, window, seed=1)
    return at, first.view(np.int64), (second >> U(33)).astype(np.int32)


def _list(values: np.ndarray, lens: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32), pa.array(values, kind))


def _survey(window: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(2))
            for a, b in pieces(offsets):
                words = Words(buf, offsets[a : b + 1])
                name, text, lo, hi = interior(words, window)
                held = np.unique(np.stack([text.astype(U), name], 1), axis=0) if len(name) else np.zeros((0, 2), U)
                at = rolled(words.hash, words.bounds, window)[0]
                closed = _covered(len(words.hash), hi - window, lo + 1)
                opened = np.bincount(words.texts()[at[~closed[at]]], minlength=b - a) > 0
                total = spans_hash(words.hash, words.bounds[:-1], words.bounds[1:], seed=2)
                texts = [bytes(buf[offsets[i] : offsets[i + 1]]).split() for i in range(a, b)]
                digest = [hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns[:2]], pa.array(words.counts, pa.int64()), pa.array(digest), pa.array(total.view(np.int64)), pa.array(opened), _list(held[:, 1].view(np.int64), np.bincount(held[:, 0].astype(int), minlength=b - a), pa.int64())],
                    names=["id", "tie", "n_words", "digest", "total", "open", "names"],
                )

    return run


def _candidates(window: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(1))
            rank, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            shared = batch.column(2)
            for a, b in pieces(offsets):
                words = Words(buf, offsets[a : b + 1])
                name, text, lo, hi = interior(words, window)
                part = shared.slice(a, b - a)
                known = np.stack([np.repeat(np.arange(b - a), np.diff(np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in part])]))).astype(U), part.flatten().to_numpy(zero_copy_only=False).view(U)], 1)
                known = np.sort(mix(known[:, 1] + mix(known[:, 0])))
                sought = mix(name + mix(text.astype(U)))
                place = np.minimum(np.searchsorted(known, sought), max(0, len(known) - 1))
                alone = known[place] != sought if len(known) else np.ones(len(sought), bool)
                at, first, second = _windows(words, window)
                out = ~_covered(len(words.hash), hi[alone] - window, lo[alone] + 1)[at]
                text = words.texts()[at[out]]
                rows = np.unique(np.stack([text, first[out], second[out].astype(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rank[a:b][rows[:, 0]]), pa.array(tie[a:b][rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], names=["rank", "tie", "first", "second"])

    return run


def _removals(window: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(1))
            for a, b in pieces(offsets):
                words = Words(buf, offsets[a : b + 1])
                at, first, second = _windows(words, window)
                marks = batch.column(2).slice(a, b - a)
                lens = np.array([len(x) if x is not None else 0 for x in marks])
                flat = marks.flatten()
                f, s = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                key = lambda text, f, s: mix(mix(f.view(U) + mix(text.astype(U))) ^ s.astype(np.int64).view(U))
                known = np.sort(key(np.repeat(np.arange(b - a), lens), np.ascontiguousarray(f), s))
                sought = key(words.texts()[at], first, second)
                place = np.minimum(np.searchsorted(known, sought), max(0, len(known) - 1))
                hit = at[known[place] == sought] if len(known) else at[:0]
                gone = _covered(len(words.hash), hit, hit + window)
                digest = []
                for i in range(b - a):
                    text = bytes(buf[offsets[a + i] : offsets[a + i + 1]]).split()
                    left = gone[words.bounds[i] : words.bounds[i + 1]]
                    digest.append(hashlib.sha256(b" ".join([w for w, g in zip(text, left.tolist()) if not g])).hexdigest())
                removed = np.bincount(words.texts()[gone], minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(3).slice(a, b - a), pa.array(removed, pa.int64()), pa.array(digest)], names=["rank", "tie", "cut_words", "cut_digest"])

    return run


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row."""
    spark = docs.sparkSession
    raw = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    surveyed = raw.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(lean(_survey(window)), "id long, tie long, n_words long, digest string, total long, open boolean, names array<long>")
    survey = materialise(surveyed.withColumn("rank", F.coalesce("id", F.lit(NO_ID))), "survey")
    firsts = survey.filter(F.col("n_words") >= window).groupBy("total", "digest").agg(F.min("rank").alias("first"))
    marked = materialise(survey.join(firsts, ["total", "digest"], "left").withColumn("copy", F.coalesce(F.col("rank") > F.col("first"), F.lit(False))), "marked")
    release(survey)
    live = marked.filter(F.col("first").isNotNull() & ~F.col("copy"))
    # Rows that repeat id and text are one from here; rows of one id, or of none, are told apart by their text.
    row = ["rank", "tie"]
    held = live.select(*row, F.explode("names").alias("name")).distinct()
    shared = held.groupBy("name").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").select("name")
    mine = held.join(shared, "name").groupBy(*row).agg(F.collect_list("name").alias("shared"))
    none = F.array().cast("array<long>")
    chosen = live.filter("open").select(*row).distinct().join(mine, row, "full").select(*row, F.coalesce("shared", none).alias("shared"))
    texts = raw.withColumn("rank", F.coalesce("id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text")).join(chosen, row)
    texts = materialise(texts.select("rank", "tie", "text", "shared"), "texts")
    windows = texts.select("rank", "text", "shared", "tie").mapInArrow(lean(_candidates(window)), "rank long, tie long, first long, second int")
    owners = windows.groupBy("first", "second").agg(F.min("rank").alias("owner"), F.max("rank").alias("other")).filter("owner < other")
    repeated = windows.join(owners.drop("other"), ["first", "second"]).filter("owner < rank")
    marks = repeated.groupBy(*row).agg(F.collect_set(F.struct("first", "second")).alias("marks"))
    cut = texts.select(*row, "text").dropDuplicates(row).join(marks, row).select("rank", "text", "marks", "tie")
    cut = cut.mapInArrow(lean(_removals(window)), "rank long, tie long, cut_words long, cut_digest string")
    out = marked.join(cut, row, "left")
    empty = F.sha2(F.lit(""), 256)
    return out.select(
        F.col("id").alias(key),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("cut_digest", "digest")).alias("kept_sha256"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH split_up AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split_up WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM starts),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM windows JOIN owners USING (h) WHERE owner < doc_id),
lists AS (SELECT doc_id, count(*) AS n_removed, list(p ORDER BY p) AS ps FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN coalesce(array_to_string(w, ' '), '') ELSE coalesce(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i))), ' '), '') END) AS kept_sha256
FROM split_up s LEFT JOIN lists USING (doc_id)
"""

QUERIES = {"op3_substrings": op3_substrings}
ORACLES = {"op3_substrings": OP3_SQL}
