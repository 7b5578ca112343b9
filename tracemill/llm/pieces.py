"""SentencePiece encoding and decoding by a forward pass shared among words with a common prefix.

The given models are of the BPE kind, for which a Viterbi pass that maximises the sum of scores does not give the
model's own ids (merges go by rank). What the forward pass carries is therefore, for each prefix of a word, the
last piece of that prefix's encoding: the one piece that ends there and is compatible with the last piece of what
stands before it, i.e. the merges leave the two apart. That state depends on the prefix alone, so the distinct
marked words are sorted, which lines them up as a depth-first walk of their trie, and each word starts from the
states of the prefix it shares with the one before. The ids are exactly those of the sentencepiece library.

No piece holds a word mark after another character, so a text falls into marked words that are encoded by
themselves. Each worker keeps a bounded table of words. The vocabulary is read on the driver from `model` and sent
with the function (its size is fixed by the model, some 0.5 MB).

Edge cases: null and empty texts have no tokens; characters outside the vocabulary become byte pieces, so every
text decodes to itself unless it holds the word mark U+2581 itself, which stands for a blank; words may be of any
length; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import kept, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words, and pairs of pieces, that a worker remembers; texts are taken in groups of so many characters.
REMEMBERED = 200_000
GROUP = 500_000


def vocabulary(model: str = MODEL) -> tuple[tuple[str, float, int], ...]:
    """(piece, score, byte value or -1, or -2 for control and unknown) by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        kind = int(piece[3:5], 16) if sp.is_byte(i) else -2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else -1
        out.append((piece, sp.get_score(i), kind))
    return tuple(out)


class Codec:
    def __init__(self, pieces):
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == -1}
        self.scores = {p: s for p, s, kind in pieces if kind == -1}
        self.byte_ids = {kind: i for i, (_, _, kind) in enumerate(pieces) if kind >= 0}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == -2)
        self.decoded = [bytes([kind]) if kind >= 0 else b"" if kind == -2 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        #: All ends of pieces: a run of characters that is none ends the search for longer pieces.
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        got = self.apart.get((left, right))
        if got is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            got = self.apart[left, right] = self.merge(left + right) == [left, right]
        return got

    def learn(self, words) -> None:
        """Encodes the words, sorted, each from the states of the prefix it shares with the last."""
        last: list[str] = [""]  # last[i]: last piece of the first i characters
        before = ""
        ids, tails, compatible, apart = self.ids, self.tails, self.compatible, self.apart
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                begin = end - 1
                found = word[begin:end]  # a single character, in the vocabulary or not, is a part of its own
                piece = found
                while True:
                    if piece in ids or begin == end - 1:
                        if begin == 0:
                            found = piece
                            if self._whole(piece):
                                break
                        else:
                            left = last[begin]
                            ok = apart.get((left, piece))
                            if (compatible(left, piece) if ok is None else ok) and self._whole(piece):
                                found = piece
                                break
                    begin -= 1
                    if begin < 0:
                        break
                    piece = word[begin:end]
                    if piece not in tails:
                        break
                last.append(found)
            before = word
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            self.words[word] = np.array([i for p in reversed(parts) for i in self._ids(p)], "<u4").tobytes()

    def _whole(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        got = self.apart.get(("", piece))
        if got is None:
            got = self.apart["", piece] = self.merge(piece) == [piece]
        return got

    def _ids(self, piece: str):
        got = self.ids.get(piece)
        if got is not None:
            return (got,)
        return [self.byte_ids.get(b, self.unknown) for b in piece.encode("utf-8", "replace")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, units = 0, []
            while at < len(texts) and (size < GROUP or not units):
                text = texts[at]
                size += len(text)
                units.append(UNITS.findall(MARK + text.replace(" ", MARK)) if text else [])
                at += 1
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            fresh = set().union(*units).difference(self.words)
            self.learn(fresh)
            get = self.words.__getitem__
            out.extend(b"".join(map(get, u)) for u in units)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; the blank before the first word is dropped."""
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


_codecs: dict[int, Codec] = kept("pieces")


def _codec(pieces) -> Codec:
    key = hash(pieces)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces)
    return _codecs[key]


def _run(pieces, digest: bool):
    def run(batches):
        codec = _codec(pieces)
        for batch in batches:
            names, n = batch.schema.names, batch.num_columns
            texts = [t or "" for t in batch.column(n - 1).to_pylist()]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                coded = codec.encode(part)
                kept = [c.slice(at, len(part)) for c in batch.columns[:-1]]
                if digest:
                    same = [codec.decode(np.frombuffer(c, "<u4")) == t.encode() for c, t in zip(coded, part)]
                    new = [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array(same)]
                    yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names[:-1], "n_tokens", "ids_sha256", "round_trip"])
                else:
                    ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*kept, ids], names=[*names[:-1], "ids"])

    return run


def _apply(docs: DataFrame, columns, text: str, model: str, digest: bool) -> DataFrame:
    kept = docs.select(*columns)
    new = "n_tokens long, ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], new])
    return docs.select(*columns, F.col(text).alias("coded_text")).mapInArrow(lean(_run(vocabulary(model), digest), "pieces"), schema)


def encode(docs: DataFrame, *columns: str, text: str = "text", model: str = MODEL) -> DataFrame:
    """The named columns of docs, and ids: array of the text's token ids."""
    return _apply(docs, columns, text, model, digest=False)


def decode(coded: DataFrame, *columns: str, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The named columns of coded, and text; null ids give an empty text."""
    pieces = vocabulary(model)

    def run(batches):
        codec = _codec(pieces)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], int)).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*columns).schema], "text string"])
    return coded.select(*columns, F.col(ids).alias("coded_ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, *columns: str, text: str = "text", model: str = MODEL) -> DataFrame:
    """The named columns of docs, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), and round_trip:
    whether decoding gives the text back."""
    return _apply(docs, columns, text, model, digest=True)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


QUERIES = {"op7_pieces": op7_pieces}
ORACLES: dict[str, str] = {}
