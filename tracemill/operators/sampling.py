"""Operators on token distributions in long form (row, token, logit), drafts, prefixes and balanced parts."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracemill.session import ship


def softmax(df: DataFrame) -> DataFrame:
    """p and logp of each token, stable: the row's maximum is taken off first."""
    w = Window.partitionBy("row")
    shifted = F.col("logit") - F.max("logit").over(w)
    df = df.withColumn("__s", shifted).withColumn("__z", F.log(F.sum(F.exp("__s")).over(w)))
    return df.withColumn("logp", F.col("__s") - F.col("__z")).withColumn("p", F.exp("logp")).drop("__s", "__z")


def entropy(df: DataFrame) -> DataFrame:
    return softmax(df).groupBy("row").agg((-F.sum(F.col("p") * F.col("logp"))).alias("entropy"))


def min_p(df: DataFrame, share: float, temperature: float) -> DataFrame:
    """Tokens at least `share` as likely as the likeliest, at a temperature."""
    scaled = softmax(df.withColumn("logit", F.col("logit") / temperature))
    return scaled.withColumn("__m", F.max("p").over(Window.partitionBy("row"))).filter(F.col("p") >= share * F.col("__m")).drop("__m")


def top_k_top_p(df: DataFrame, k: int, p: float) -> DataFrame:
    """The k likeliest tokens (ties with the last stay), then the fewest of these with mass p, at least one."""
    by = Window.partitionBy("row").orderBy(F.desc("logit"))
    kept = df.withColumn("__r", F.rank().over(by)).filter(F.col("__r") <= k).drop("__r")
    kept = softmax(kept)
    up = Window.partitionBy("row").orderBy("logit", F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("logit"), "token"))
    return kept.withColumn("__c", F.sum("p").over(up)).withColumn("__n", last).filter((F.col("__c") > 1 - p) | (F.col("__n") == 1)).drop("__c", "__n")


def penalised(df: DataFrame, count: Column, repetition: float, frequency: float, presence: float) -> DataFrame:
    """Logits after repetition, frequency and presence penalties for tokens seen count times."""
    seen = count > 0
    x = F.when(seen & (F.col("logit") > 0), F.col("logit") / repetition).when(seen, F.col("logit") * repetition).otherwise(F.col("logit"))
    return df.withColumn("logit", x - frequency * count - presence * seen.cast("double"))


def race(df: DataFrame, seed: int) -> DataFrame:
    """One token per row drawn by its probability: the winner of an exponential race with hashed noise."""
    u = (F.pmod(F.xxhash64("row", "token", F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return softmax(df).groupBy("row").agg(F.max_by("token", F.col("p") / -F.log(u)).alias("token"))


def draft(tokens: list[int], shortest: int, longest: int, k: int) -> list[int] | None:
    """The tokens after the first earlier place of the longest repeated suffix of shortest to longest tokens."""
    n = len(tokens)
    for size in range(min(longest, n - 1), shortest - 1, -1):
        suffix = tokens[n - size :]
        at = next((i for i in range(n - size) if tokens[i : i + size] == suffix), None)
        if at is not None:
            return tokens[at + size : at + size + k]
    return None


def last_hash(blocks: Column) -> Column:
    """Hash of the last block with all before it; empty without blocks."""
    return F.aggregate(blocks, F.lit(""), lambda h, block: F.sha2(F.concat_ws("|", h, block), 256))


@F.pandas_udf(ArrayType(StringType()))
def chain(blocks: pd.Series) -> pd.Series:
    """Hash of each block with all before it."""

    def linked(parts) -> list[str]:
        h, out = "", []
        for part in parts:
            h = hashlib.sha256(f"{h}|{part}".encode()).hexdigest()
            out.append(h)
        return out

    return pd.Series([linked(b) for b in blocks])


def word_blocks(text: Column, size: int) -> Column:
    """Full blocks of `size` words, joined by blanks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    none = F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        full = F.floor(F.size(w) / size).cast("int")
        return F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))).otherwise(none)

    # Bound once: inside the lambda the text would be split anew for each block.
    return F.transform(F.array(words), lambda w: cut(w))[0]


def cached_prefix(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Longest prefix, in blocks, that a row of smaller key has too; the last block never counts."""
    ship(df.sparkSession)
    parts = df.select(key, F.size(blocks).alias("n"), F.posexplode(chain(F.col(blocks))).alias("i", "h"))
    first = parts.groupBy("h").agg(F.min(key).alias("first"))
    hit = parts.join(first, "h").filter((F.col("first") < F.col(key)) & (F.col("i") < F.col("n") - 1)).groupBy(key).agg((F.max("i") + 1).cast("long").alias("cached"))
    return df.select(key).join(hit, key, "left").withColumn("cached", F.coalesce("cached", F.lit(0)).cast("long"))


def balanced_parts(lengths: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Indices in `parts` parts of nearly equal sums, by largest differencing; equal: of equal numbers too."""
    if equal and len(lengths) % parts:
        raise ValueError("the items do not divide into parts of equal number")
    empty = lambda: [(0, ()) for _ in range(parts)]
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    heap = []
    groups = [order[a : a + parts] for a in range(0, len(order), parts)] if equal else [[i] for i in order]
    for serial, group in enumerate(groups):
        sets = empty()
        for slot, i in enumerate(group):
            sets[slot] = (lengths[i], (i,))
        sets.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], serial, sets))
    serial = len(groups)
    while len(heap) > 1:
        # The two partial partitions that are most uneven cancel out: largest parts meet smallest.
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sets = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda s: -s[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], serial, sets))
        serial += 1
    return [sorted(s[1]) for s in (heap[0][2] if heap else empty())]


def micro_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Balanced parts, as few as the token budget allows."""
    return balanced_parts(lengths, max(1, -(-sum(lengths) // budget)))


def largest_eigenvalue(matrices: np.ndarray) -> np.ndarray:
    """Of symmetric matrices, one per row."""
    return np.linalg.eigvalsh(matrices)[..., -1]


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def balance_rows(batches):
    """(uid, rids, lens) -> part (of two) of each response; one row per prompt, so batches hold many prompts."""
    for pdf in batches:
        out = []
        for uid, rids, lens in zip(pdf["uid"], pdf["rids"], pdf["lens"]):
            of = {i: p for p, members in enumerate(balanced_parts([int(x) for x in lens], 2)) for i in members}
            out += [(uid, rid, of[i]) for i, rid in enumerate(rids)]
        yield pd.DataFrame(out, columns=["uid", "rid", "part"])


def draft_rows(batches):
    for pdf in batches:
        got = [draft(list(t), 1, 3, 3) or [] for t in pdf["tokens"]]
        yield pd.DataFrame({"seq": pdf["seq"], "draft": [",".join(map(str, g)) for g in got]})
