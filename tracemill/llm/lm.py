"""LM scoring with an Elias-Fano bigram trie.

The model (Witten-Bell, interpolated with add-one unigrams; nothing is pruned) is a table of shards:

* word shards: the sorted hashes of the words in Elias-Fano form; of each its count and, as a context, the quantised
  weight of the lower order; and the numbers of tokens and distinct words as text;
* bigram shards: the contexts, and the monotone pointers to their successors, in Elias-Fano form; the successors'
  hashes, sorted within their context; their smoothed probabilities given the context, quantised on a log scale.

A word's shard is its hash; a bigram's is its context's hash plus a part of the successor's, so that no context,
however frequent, fills a shard: the parts of a context are added up where the context's word is, and the sums go
back to the parts. Counting reads the texts in pieces, each of which sends every word and bigram once with its count.
For scoring, each piece of text asks every shard for its distinct words and bigrams; shards answer in the order
asked, and the answers meet the piece's texts, packed, to score them. Pieces are told by the task that reads them,
their number in it and a checksum of their texts, so that a rerun that reads other pieces fails instead of mixing
them. Nothing is broadcast, no row is a single n-gram, and the shards are as many as the bytes of text ask for.
Counts are added up by whole hashes. The level keeps 40 bits of a successor, and pieces ask by 40 bits of context and
successor: of s contexts in a shard and t successors one that was never seen is taken for another in about
(s + t) / 2^40 cases; words are asked for by whole hashes.

Levels are byte buffers of table rows that Arrow maps into the worker, and they are searched as they are: the high
bits of a key tell the few places where it can be (the h-th zero of the unary part), its low bytes are compared
there; the pointers of the context found give the range in which the successor is sought.

Edge cases: null and empty texts consist of the end alone; without training documents all counts are 0 and every
probability 1; repeated rows are scored alike; words and texts may be of any length; columns other than key and
text, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import lean, lean_group, materialise, release
from tracemill.llm.tokens import U, Words, column, mix, pieces

CHUNK = 5_000_000
SHARD = 16_000_000
BEGIN, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
WORDS, BIGRAMS, TEXTS, CONTEXTS = 0, 1, 2, 3
BLOB = "kind int, shard int, chunk long, a binary, b binary, c binary, d binary"
NAMES = ["kind", "shard", "chunk", "a", "b", "c", "d"]
#: Bits of hashes that bigrams are asked by; steps of a probability's code for each doubling; no such bigram.
ASKED, STEPS, ABSENT = 40, 1024, 0xFFFF
REST = U(64 - ASKED)
#: Place of the k-th one in each byte, highest bit first.
ONES = np.array([[*[7 - i for i in range(7, -1, -1) if byte >> i & 1], *[0] * 8][:8] for byte in range(256)], np.int64)
POPULATION = np.array([bin(byte).count("1") for byte in range(256)], np.int64)


class EliasFano:
    """A sorted array of 64-bit values, read in place: low bytes as they are, high bits in unary (a zero ends each)."""

    def __init__(self, raw):
        self.n, self.keep = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        self.low = np.frombuffer(raw, np.uint8, self.n * self.keep, 16).reshape(self.n, self.keep)
        self.high = np.frombuffer(raw, np.uint8, offset=16 + self.n * self.keep)
        # Directory: ones, and so zeros, up to each byte.
        self.ones = np.cumsum(POPULATION[self.high])
        self.zeros = 8 * np.arange(1, len(self.high) + 1) - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        keep = max(0, -(-(top.bit_length() - max(n, 1).bit_length()) // 8))
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :keep].tobytes()
        high = (values >> U(8 * keep)).astype(np.int64) if keep < 8 else np.zeros(n, np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, bool)
        bits[high + np.arange(n)] = True
        return np.array([n, keep], "<u8").tobytes() + low + np.packbits(bits).tobytes()

    def _low(self, at: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.keep] = self.low[at]
        return wide.view("<u8").reshape(-1)

    def _nth(self, directory: np.ndarray, flip: int, nth: np.ndarray) -> np.ndarray:
        """Bit position of the nth one (zero, if flip), from 0."""
        byte = np.searchsorted(directory, nth, "right")
        before = np.where(byte > 0, directory[byte - 1], 0)
        return 8 * byte + ONES[self.high[byte] ^ flip, nth - before]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        if not len(at):
            return np.zeros(0, U)
        high = (self._nth(self.ones, 0, at) - at).astype(U)
        return self._low(at) | (high << U(8 * self.keep) if self.keep < 8 else U(0))

    def decode(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def first(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first value that is not below each key, n where there is none."""
        out = np.full(len(keys), self.n)
        if not self.n or not len(keys):
            return out
        high = keys >> U(8 * self.keep) if self.keep < 8 else np.zeros(len(keys), U)
        inside = high < U(self.zeros[-1])
        h = high[inside].astype(np.int64)
        # Values of high part h stand between the (h - 1)-th and the h-th zero.
        end = np.minimum(self._nth(self.zeros, 0xFF, h) - h, self.n)
        begin = np.where(h > 0, self._nth(self.zeros, 0xFF, np.maximum(h - 1, 0)) - h + 1, 0)
        low = keys[inside] & U((1 << 8 * self.keep) - 1) if self.keep < 8 else keys[inside]
        out[inside] = ranged(self._low, begin, end, low)
        return out

    def find(self, keys: np.ndarray, rest: np.uint64 = U(0)) -> np.ndarray:
        """Places of the first values that agree with the keys but for the last `rest` bits, -1 where there is none."""
        at = self.first(keys << rest)
        hit = at < self.n
        hit[hit] = self.get(at[hit]) >> rest == keys[hit]
        return np.where(hit, at, -1)


def ranged(values, begin: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """First place in begin:end whose value is not below the key, for each key; values(places) are sorted in a range."""
    low, high = begin.copy(), end.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = values(middle) < keys[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of the width that the largest needs, packed."""
    width = "<u2" if not len(values) or int(values.max()) < 1 << 16 else "<u4" if int(values.max()) < 1 << 32 else "<u8"
    return width[2:].encode() + zlib.compress(values.astype(width).tobytes(), 1)


def unsqueezed(raw) -> np.ndarray:
    raw = memoryview(raw)
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{chr(raw[0])}").astype(np.int64)


def _cut(values: np.ndarray) -> bytes:
    """The leading bits of the hashes."""
    return (values >> REST).astype("<u8").view(np.uint8).reshape(len(values), 8)[:, : ASKED // 8].tobytes()


def _uncut(raw) -> np.ndarray:
    got = np.frombuffer(np.ascontiguousarray(raw), np.uint8).reshape(-1, ASKED // 8)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, : ASKED // 8] = got
    return out.view("<u8").reshape(len(got))


class Profile:
    """Distinct words and bigrams of some texts, by shard, and which of them each token is."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, shards: int):
        words = Words(buf, offsets, lower=True)
        sequence = np.full(len(words.hash) + len(words.counts), END, U)
        sequence[np.arange(len(words.hash)) + words.texts()] = words.hash
        known, number = np.unique(np.concatenate([sequence, [BEGIN]]), return_inverse=True)
        word, sizes = number[:-1], words.counts + 1
        self.keys, self.word, self.sizes = known, word, sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = int(np.searchsorted(known, BEGIN))
        self.context = np.empty_like(word)
        self.context[1:] = word[:-1]
        self.context[np.cumsum(sizes) - sizes] = self.begin
        pairs, self.pair = np.unique(self.context * len(known) + word, return_inverse=True)
        left, right = pairs // len(known), pairs % len(known)
        parts = U(max(1, -(-shards // 32)))
        self.left, self.right = known[left], known[right]
        self.word_shard = (mix(known) % U(shards)).astype(np.int64)
        pair_shard = ((mix(self.left) + (mix(self.right) % parts) * U(0x9E3779B1)) % U(shards)).astype(np.int64)
        # Stable: within a shard, words and (context, successor) stay sorted.
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.pair_order = np.argsort(pair_shard, kind="stable")
        self.word_cut = np.searchsorted(self.word_shard[self.word_order], np.arange(shards + 1))
        self.pair_cut = np.searchsorted(pair_shard[self.pair_order], np.arange(shards + 1))

    def blobs(self, shards: int, chunk: int, counting: bool):
        """A row for each kind and shard that has any: keys, and when counting their counts."""
        rows = []
        if counting:
            words = np.bincount(self.word, minlength=len(self.keys))
            words[self.begin] = len(self.sizes)
            pairs = np.bincount(self.pair, minlength=len(self.left))
        for shard in range(shards):
            mine = self.word_order[self.word_cut[shard] : self.word_cut[shard + 1]]
            if len(mine):
                rows.append((WORDS, shard, chunk, EliasFano.encode(self.keys[mine]), b"", b"", squeezed(words[mine]) if counting else b""))
            mine = self.pair_order[self.pair_cut[shard] : self.pair_cut[shard + 1]]
            if len(mine):
                left, right = self.left[mine], self.right[mine]
                contexts, pointers = _trie(left, U(0) if counting else REST)
                rows.append((BIGRAMS, shard, chunk, contexts, pointers, right.tobytes() if counting else _cut(right), squeezed(pairs[mine]) if counting else b""))
        return rows


def _trie(left: np.ndarray, rest: np.uint64 = U(0)) -> tuple[bytes, bytes]:
    """The distinct contexts of sorted bigrams, without their last `rest` bits, and pointers to the first successor of
    each and past the last."""
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, int)
    return EliasFano.encode(left[first] >> rest), EliasFano.encode(np.concatenate([first, [len(left)]]).astype(U))


def table(rows) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=NAMES)


class Row:
    """One row of blobs, its buffers as Arrow has them."""

    def __init__(self, rows: pa.Table, i: int):
        self.kind, self.shard, self.chunk = (rows[c][i].as_py() for c in NAMES[:3])
        self.a, self.b, self.c, self.d = (rows[c][i].as_buffer() for c in NAMES[3:])


def _rows(rows: pa.Table) -> list[Row]:
    rows = rows.combine_chunks()
    return [Row(rows, i) for i in range(rows.num_rows)]


def _spread(row: Row) -> np.ndarray:
    """The context of each bigram of a row."""
    return np.repeat(EliasFano(row.a).decode(), np.diff(EliasFano(row.b).decode().astype(np.int64)))


def _count(shards: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column(batch.column(0))
            for a, b in pieces(offsets, CHUNK):
                yield from table(Profile(buf, offsets[a : b + 1], shards).blobs(shards, 0, True)).to_batches()

    return run


def _gather(shards: int):
    """Counts of one kind and shard from all pieces: merged words, or the bigrams and what their contexts have of them,
    which goes to the shards of the contexts' words."""

    def run(rows: pa.Table) -> pa.Table:
        rows = _rows(rows)
        kind, shard = rows[0].kind, rows[0].shard
        counts = np.concatenate([unsqueezed(r.d) for r in rows])
        if kind == WORDS:
            keys, number = np.unique(np.concatenate([EliasFano(r.a).decode() for r in rows]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, number, counts)
            return table([(WORDS, shard, 0, EliasFano.encode(keys), b"", b"", total.astype("<u8").tobytes())])
        left = np.concatenate([_spread(r) for r in rows])
        right = np.concatenate([np.frombuffer(r.c, U) for r in rows])
        order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        left, right, counts = left[new], right[new], np.add.reduceat(counts, new)
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        followers = np.diff(np.concatenate([first, [len(left)]]))
        contexts, pointers = _trie(left)
        out = [(BIGRAMS, shard, 0, contexts, pointers, _cut(right), squeezed(counts))]
        home = (mix(left[first]) % U(shards)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            mine = by[cut[s] : cut[s + 1]]
            out.append((CONTEXTS, int(s), shard, EliasFano.encode(left[first][mine]), squeezed(followers[mine]), b"", b""))
        return table(out)

    return run


def _words(rows: pa.Table) -> pa.Table:
    """A word shard: b holds the weight of the lower order (16 bits); and for each part of contexts the base-2 logarithm
    of what their counts are divided by."""
    rows = _rows(rows)
    merged = [r for r in rows if r.kind == WORDS]
    keys = EliasFano(merged[0].a).decode() if merged else np.zeros(0, U)
    counts = np.frombuffer(merged[0].d, "<u8").astype(np.int64) if merged else np.zeros(0, np.int64)
    followers = np.zeros(len(keys), np.int64)
    parts = [(r, np.searchsorted(keys, EliasFano(r.a).decode())) for r in rows if r.kind == CONTEXTS]
    for r, at in parts:
        followers[at] += unsqueezed(r.b)
    whole = np.maximum(counts + followers, 1)
    real = keys != BEGIN
    totals = f"{counts[real].sum()} {(counts[real] > 0).sum()}".encode()
    out = [(WORDS, rows[0].shard, 0, EliasFano.encode(keys), np.round(65535 * followers / whole).astype("<u2").tobytes(), totals, counts.astype("<u8").tobytes())]
    for r, at in parts:
        out.append((CONTEXTS, int(r.chunk), 1, r.a.to_pybytes(), np.log2(whole[at]).astype("<f4").tobytes(), b"", b""))
    return table(out)


def _bigrams(rows: pa.Table) -> pa.Table:
    """A bigram shard: d holds the code of each bigram's probability given its context."""
    rows = _rows(rows)
    level = next(r for r in rows if r.kind == BIGRAMS)
    contexts = EliasFano(level.a)
    below = np.zeros(contexts.n)
    for r in rows:
        if r.kind == CONTEXTS:
            below[contexts.find(EliasFano(r.a).decode())] = np.frombuffer(r.b, "<f4")
    lens = np.diff(EliasFano(level.b).decode().astype(np.int64))
    code = np.round(STEPS * (np.repeat(below, lens) - np.log2(unsqueezed(level.d)))).clip(0, ABSENT - 1)
    return table([(BIGRAMS, level.shard, 0, level.a.to_pybytes(), level.b.to_pybytes(), level.c.to_pybytes(), code.astype("<u2").tobytes())])


def build(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """The model of all docs: one row per kind and shard."""
    raw = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = F.col("kind")
    counts = materialise(raw.mapInArrow(lean(_count(shards)), BLOB).groupBy("kind", "shard").applyInArrow(lean_group(_gather(shards)), BLOB), "lm-counts")
    words = materialise(counts.filter(kind != BIGRAMS).groupBy("shard").applyInArrow(_words, BLOB), "lm-words")
    bigrams = counts.filter(kind == BIGRAMS).unionByName(words.filter(kind == CONTEXTS)).groupBy("shard").applyInArrow(_bigrams, BLOB)
    model = materialise(words.filter(kind == WORDS).unionByName(bigrams), "lm-model")
    release(counts, words)
    return model


def totals(model: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones."""
    both = F.split(F.col("c").cast("string"), " ")
    row = model.filter(F.col("kind") == WORDS).agg(F.sum(both[0].cast("long")), F.sum(both[1].cast("long"))).first()
    return row[0] or 0, row[1] or 0


def _pieced(batches):
    """(number, column of ids, buffer, offsets) of the pieces of a task's rows (id, text)."""
    number = TaskContext.get().partitionId() << 48
    for batch in batches:
        buf, offsets = column(batch.column(1))
        for a, b in pieces(offsets, CHUNK):
            check = zlib.crc32(buf[offsets[a] : offsets[b]].tobytes()) & 0xFFFFFF
            yield number | check, batch.column(0).slice(a, b - a), buf, offsets[a : b + 1]
            number += 1 << 24


def _ask(shards: int):
    """Requests of each piece."""

    def run(batches):
        for piece, _, buf, offsets in _pieced(batches):
            yield from table(Profile(buf, offsets, shards).blobs(shards, piece, False)).to_batches()

    return run


def _packed(batches):
    """Each piece's ids, lengths and bytes."""
    for piece, ids, buf, offsets in _pieced(batches):
        sink = pa.BufferOutputStream()
        ids = pa.RecordBatch.from_arrays([ids], names=["id"])
        with pa.ipc.new_stream(sink, ids.schema) as out:
            out.write_batch(ids)
        packed = zlib.compress(buf[offsets[0] : offsets[-1]].tobytes(), 1)
        yield from table([(TEXTS, 0, piece, sink.getvalue().to_pybytes(), squeezed(np.diff(offsets)), packed, b"")]).to_batches()


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each request of a shard: count and weight of words; codes of bigrams; in the order asked."""
    asked = _rows(asked)
    if not asked:
        return table([])
    level = _rows(model)[0] if model.num_rows else None
    keys = EliasFano(level.a if level else EliasFano.encode(np.zeros(0, U)))
    out = []
    if asked[0].kind == WORDS:
        counts = np.frombuffer(level.d, "<u8") if level else np.zeros(0, "<u8")
        weight = np.frombuffer(level.b, "<u2") if level else np.zeros(0, "<u2")
        for r in asked:
            at = keys.find(EliasFano(r.a).decode())
            take = lambda v: np.where(at >= 0, v[at], 0) if len(v) else np.zeros(len(at), v.dtype)
            out.append((WORDS, r.shard, r.chunk, squeezed(take(counts)), squeezed(take(weight)), b"", b""))
        return table(out)
    pointers = EliasFano(level.b if level else EliasFano.encode(np.zeros(1, U)))
    successors = np.frombuffer(level.c if level else b"", np.uint8).reshape(-1, ASKED // 8)
    codes = np.frombuffer(level.d, "<u2") if level else np.zeros(0, "<u2")
    leading = lambda place: _uncut(successors[place])
    for r in asked:
        contexts, lens = EliasFano(r.a).decode(), np.diff(EliasFano(r.b).decode().astype(np.int64))
        at = keys.find(contexts, REST)
        there = np.maximum(at, 0)
        begin = np.where(at >= 0, pointers.get(there) if keys.n else 0, 0).astype(np.int64)
        end = np.where(at >= 0, pointers.get(there + 1) if keys.n else 0, 0).astype(np.int64)
        begin, end, right = np.repeat(begin, lens), np.repeat(end, lens), _uncut(r.c)
        place = ranged(leading, begin, end, right)
        hit = place < end
        hit[hit] = leading(place[hit]) == right[hit]
        code = np.full(len(right), ABSENT, np.int64)
        code[hit] = codes[place[hit]]
        out.append((BIGRAMS, r.shard, r.chunk, squeezed(code), b"", b"", b""))
    return table(out)


def _scored(shards: int, n: int, v: int):
    def run(rows: pa.Table, texts: pa.Table) -> pa.Table:
        if not rows.num_rows or texts.num_rows != 1:
            raise ValueError("the rows of a task changed between two readings")
        rows, texts = _rows(rows), _rows(texts)[0]
        ids = pa.ipc.open_stream(texts.a).read_all()["id"]
        offsets = np.concatenate([[0], np.cumsum(unsqueezed(texts.b))])
        profile = Profile(np.frombuffer(zlib.decompress(texts.c), np.uint8), offsets, shards)
        got = {(r.kind, r.shard): r for r in rows}
        order = lambda kind: [got[kind, s] for s in range(shards) if (kind, s) in got]
        count, weight, code = (np.zeros(m) for m in (len(profile.keys), len(profile.keys), len(profile.left)))
        count[profile.word_order] = np.concatenate([unsqueezed(r.a) for r in order(WORDS)])
        weight[profile.word_order] = np.concatenate([unsqueezed(r.b) for r in order(WORDS)]) / 65535
        code[profile.pair_order] = np.concatenate([unsqueezed(r.a) for r in order(BIGRAMS)])
        both = np.where(code == ABSENT, 0, 2.0 ** (-code / STEPS))
        single = ((count + 1) / (n + 1 * (v + 1)))[profile.word]
        mixed = np.where(count[profile.context] > 0, both[profile.pair] + weight[profile.context] * single, single)
        total = lambda x: np.bincount(profile.text, x, len(profile.sizes))
        known = total(count[profile.word] > 0).astype(np.int64)
        return pa.table([ids, pa.array(profile.sizes, pa.int64()), pa.array(known), pa.array(total(np.log10(single))), pa.array(total(np.log10(mixed)))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row, under a model of that many shards."""
    n, v = totals(model)
    raw = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    asked, packed = raw.mapInArrow(lean(_ask(shards)), BLOB), raw.mapInArrow(lean(_packed), BLOB)
    answers = asked.groupBy("kind", "shard").cogroup(model.groupBy("kind", "shard")).applyInArrow(_answer, BLOB)
    kind = raw.schema["id"].dataType.simpleString()
    # Written, so that the requests' shuffle files go before the texts are shuffled.
    answers = materialise(answers, "lm-answers")
    out = answers.groupBy("chunk").cogroup(packed.groupBy("chunk")).applyInArrow(_scored(shards, n, v), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def shards_of(docs: DataFrame, text: str = "text") -> int:
    """Shards for these texts."""
    return 1 + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = shards_of(docs)
    model = build(docs.filter(~held_out()), shards)
    scored = score(docs, model, shards)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm": op9_lm}
ORACLES: dict[str, str] = {}
