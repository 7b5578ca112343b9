"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are the character n-grams (3 to 5) of the word with its ends marked, and the whole, hashed into 2^BITS rows of an
embedding table; its vector is the mean of their rows, a text's vector the mean of its distinct words' vectors (so repeating a word
adds nothing), and a
softmax over that gives the score. Embeddings and softmax are learnt together (Adagrad) from a bounded sample of
labelled documents: at most SAMPLE of each class, those of the smallest hash. The sample and the model are the
only things on the driver, both of fixed size. As all is linear up to the softmax, scoring needs one number per
bucket (1 MB, broadcast with the function).

Edge cases: null and empty texts score the prior of the sample (no words, only the bias); labels that are null or
have no document are not used; without any usable label of both classes every text scores 0; repeated rows score
alike; an empty table gives no rows. Words are split at blanks and the controls 9 to 13, and lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import lean
from tracemill.llm.tokens import STEP, Words, column, mix, pieces, spans_hash

#: The embedding table has 2^BITS rows.
BITS = 17
DIM = 8
SHORTEST, LONGEST = 3, 5
#: Labelled documents of class 0 and of class 1 that are used to learn, and the bytes of text they may have in all.
SAMPLE, SAMPLE_BYTES = (3000, 1500), 24_000_000
#: A text of fewer distinct words counts as filled up with neutral ones.
PAD = 16
#: Passes over the sample; a small one gets about STEPS batches in all at least.
EPOCHS, STEPS, RATE, BATCH = 8, 600, 0.15, 64
THRESHOLD = 0.7
#: Bytes of text that are scored at a time.
SCORED = 1 << 18


def subwords(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of all n-grams, and the whole, of the chosen words; owner counts along chosen."""
    lens = words.ends[chosen] - words.starts[chosen]
    # The words, each between line ends: no word has one.
    stops = np.cumsum(lens + 1)
    buf = np.full(int(stops[-1]) + 1 if len(stops) else 1, 10, np.uint8)
    place = np.arange(lens.sum()) + np.repeat(np.arange(1, len(lens) + 1), lens)
    take = np.arange(lens.sum()) + np.repeat(words.starts[chosen] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) if len(lens) else np.zeros(0, int)
    buf[place] = words.bytes[take]
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    mark = chars == 10
    passed = np.cumsum(mark)
    values = mix(chars.astype(np.uint64) + np.uint64(1))
    ends_at = np.flatnonzero(mark)
    owner, bucket = [np.arange(len(lens))], [spans_hash(values, ends_at[:-1], ends_at[1:] + 1)]
    # The name of an n-gram comes from that of its beginning and its last character.
    names = values
    for k in range(2, LONGEST + 1):
        names = mix(names[:-1] * STEP + values[k - 1 :])
        if k >= SHORTEST:
            at = np.flatnonzero(passed[k - 2 : len(chars) - 1] == passed[: len(names)])  # no mark but at its ends
            owner.append(passed[at] - 1)
            bucket.append(names[at])
    return np.concatenate(owner), (np.concatenate(bucket) >> np.uint64(64 - BITS)).astype(np.int32)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the piece's distinct words, and (text, number of the word) of each text's distinct words."""
    found, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    pairs = np.unique(words.texts() * max(1, len(found)) + number)
    return first, pairs // max(1, len(found)), pairs % max(1, len(found))


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (begin, word), n-grams of each word (begin, bucket)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    begin, word, gram_begin, gram, so_far, end = [0], [], [np.zeros(1, np.int64)], [], 0, 0
    for a, b in pieces(offsets):
        words = Words(buf, offsets[a : b + 1])
        first, text, number = distinct(words)
        owner, bucket = subwords(words, first)
        order = np.argsort(owner, kind="stable")
        gram.append(bucket[order])
        gram_begin.append(end + np.cumsum(np.bincount(owner, minlength=len(first))))
        end += len(owner)
        word.append((number + so_far).astype(np.int32))
        so_far += len(first)
        begin.extend(begin[-1] + np.cumsum(np.bincount(text, minlength=b - a)))
    return np.array(begin), np.concatenate([*word, np.zeros(0, np.int32)]), np.concatenate(gram_begin), np.concatenate([*gram, np.zeros(0, np.int32)])


def _ranges(begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions begin[r]:begin[r + 1] of the rows one after another, and how many each has."""
    lens = begin[rows + 1] - begin[rows]
    return np.repeat(begin[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum()), lens


def train(texts: list[str], labels: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    """(contribution per bucket, bias): a text's score is the sigmoid of its words' mean contribution plus bias."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS), -1e3
    rng = np.random.default_rng(seed)
    begin, word, gram_begin, gram = _bags(texts)
    texts.clear()  # the driver holds the sample once
    table = rng.normal(0, 1.0 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 1.0 / DIM, DIM), 0.0
    seen_table, seen_out, seen_bias = np.full((1 << BITS, DIM), 1e-6, np.float32), np.full(DIM, 1e-6), 1e-6
    for _ in range(max(EPOCHS, STEPS * BATCH // len(y))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            where, lens = _ranges(begin, rows)
            text = np.repeat(np.arange(len(rows)), lens)
            grams, sizes = _ranges(gram_begin, word[where])
            bucket = gram[grams]
            # Weight of an n-gram in its text: 1 / (n-grams of its word) / (words of its text).
            share = np.repeat(1.0 / sizes / np.maximum(lens, PAD)[text], sizes).astype(np.float32)
            owner = np.repeat(text, sizes)
            part = table[bucket] * share[:, None]
            vector = np.stack([np.bincount(owner, part[:, d], len(rows)) for d in range(DIM)], 1)
            # Means over hundreds of words are small; the scale is part of the softmax layer.
            logit = SCALE * vector @ out + bias
            slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[rows]) / len(rows)
            g_out, g_bias = SCALE * vector.T @ slope, slope.sum()
            force = np.bincount(bucket, share * slope[owner], 1 << BITS)
            used = np.flatnonzero(force)
            g_used = np.outer(force[used], SCALE * out)
            seen_table[used] += g_used**2
            table[used] -= RATE * g_used / np.sqrt(seen_table[used])
            seen_out += g_out**2
            out = out - RATE * g_out / np.sqrt(seen_out)
            seen_bias += g_bias**2
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    return (SCALE * table @ out).astype(np.float64), float(bias)


SCALE = 50.0


def scores_of(buf: np.ndarray, offsets: np.ndarray, contributions: np.ndarray, bias: float) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in pieces(offsets, SCORED):
        words = Words(buf, offsets[a : b + 1])
        first, text, number = distinct(words)
        owner, bucket = subwords(words, first)
        each = np.bincount(owner, contributions[bucket], len(first)) / np.maximum(np.bincount(owner, minlength=len(first)), 1)
        count = np.bincount(text, minlength=b - a)
        logit = bias + np.bincount(text, each[number], b - a) / np.maximum(count, PAD)
        out.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
    return np.concatenate(out)


def scorer(contributions: np.ndarray, bias: float, out: str):
    def run(batches):
        for batch in batches:
            scores = scores_of(*column(batch.column(batch.num_columns - 1)), contributions, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], out])

    return run


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits the model to labelled rows; the caller has taken held-out rows from labels."""
    marked = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("l_key")).agg(F.max(label).alias("l_label"))
    mine = marked.select("l_key", "l_label", F.xxhash64("l_key").alias("l_order"))
    # limit() keeps a class within its bound; ordering by a hash makes that a fixed draw.
    chosen = mine.filter("l_label = 1").orderBy("l_order", "l_key").limit(sample[1]).unionByName(mine.filter("l_label = 0").orderBy("l_order", "l_key").limit(sample[0]))
    rows = docs.select(F.col(key).alias("d_key"), F.coalesce(F.col(text), F.lit("")).alias("d_text")).join(F.broadcast(chosen), F.col("d_key") == F.col("l_key"))
    # Lengths first: texts that do not fit are left out, and never reach the driver.
    rows = rows.withColumn("d_tie", F.xxhash64("d_text"))
    lengths = rows.groupBy("l_order", "d_tie").agg(F.sum(F.octet_length("d_text")).alias("size"))
    fits, size = [], 0
    for row in sorted(lengths.collect()):
        if size + row["size"] <= SAMPLE_BYTES:
            size += row["size"]
            fits.append((row["l_order"], row["d_tie"]))
    if not fits:
        return train([], [])
    # From Arrow, as a list of rows would start Python workers, under a daemon of their own, on each executor.
    fits = docs.sparkSession.createDataFrame(pa.table({name: pa.array([f[i] for f in fits], pa.int64()) for i, name in enumerate(("l_order", "d_tie"))}))
    got = sorted(rows.join(F.broadcast(fits), ["l_order", "d_tie"]).select("l_order", "d_key", "d_text", "l_label").collect())
    texts, marks = [r.d_text for r in got], [r.l_label for r in got]
    del got
    return train(texts, marks)


def score(docs: DataFrame, model: tuple[np.ndarray, float], *columns: str, text: str = "text", out: str = "score") -> DataFrame:
    """The named columns of docs, and the score in column `out`."""
    fed = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_tm_text"))
    kept = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{out}` double"
    return fed.mapInArrow(lean(scorer(*model, out)), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = score(docs, learn(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
