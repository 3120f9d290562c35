"""Token ids by a vocabulary: merging by rank, or the most likely pieces, one pass over each Arrow batch with a table of the words seen.

A text's words are found by the vocabulary's pattern; a word's ids are worked out once in a worker. Nothing but the vocabulary file is needed.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: How byte-level vocabularies part a text into words. A fixed value.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps; then it starts afresh. Longer ones than so many characters aren't kept.
TABLE_WORDS, TABLE_CHARS = 1 << 17, 64
#: Bytes of text, or ids, that a worker has as Python objects at once, a row at least.
_BYTES_AT_ONCE, _IDS_AT_ONCE = 1 << 20, 1 << 17
#: What an unknown character costs beside the least likely piece. A fixed value.
_UNKNOWN_COST = 10.0
_SPACE = "▁"


def vocabulary_path(name: str) -> str:
    """A public vocabulary's file: in the folder MILLRACE_TOKENIZERS names, else where the package of such files puts it."""
    if folder := os.environ.get("MILLRACE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary(NamedTuple):
    """Tokens as bytes with their ids; how pairs merge, or how likely pieces are; and strings that are one token wherever they stand."""

    ids: dict[bytes, int]
    merges: dict[tuple[bytes, bytes], int] | None  # None: a pair's rank is the id of what it makes
    scores: dict[str, tuple[int, float]] | None  # pieces of a unigram model
    unknown: int
    special: dict[str, int]


def _byte_of() -> dict[str, int]:
    """The byte that each printable character of a vocabulary file stands for."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def load_vocabulary(path: str) -> Vocabulary:
    """A file of ranks (.tiktoken), or a .json one of byte-level pair merging or of unigram pieces over words that begin with a space mark."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        return Vocabulary(ranks, None, None, -1, {})
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    if spec.get("normalizer"):
        raise ValueError(f"{path}: a vocabulary that changes texts first isn't read here")
    if model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not model.get("ignore_merges"):
        byte = _byte_of()
        raw = lambda token: bytes(byte[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        return Vocabulary(ids, {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}, None, -1, special)
    if model.get("type") == "Unigram" and before.get("type") == "Metaspace" and before.get("prepend_scheme") == "always":
        pieces = {p: (k, s) for k, (p, s) in enumerate(model["vocab"])}
        return Vocabulary({p.encode(): k for p, (k, _) in pieces.items()}, None, pieces, model["unk_id"], special)
    raise ValueError(f"{path}: not a vocabulary of a kind that is read here")


def merged(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of a word: of all adjacent pairs the one of least rank, leftmost first, is merged, until none has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    rank = (lambda a, b: vocabulary.ids.get(a + b)) if vocabulary.merges is None else lambda a, b: vocabulary.merges.get((a, b))
    following, preceding = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
    waiting = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, made = heapq.heappop(waiting)
        j = following[i]
        if not parts[i] or j == len(parts) or parts[i] + parts[j] != made or rank(parts[i], parts[j]) is None:
            continue
        parts[i], parts[j] = made, b""
        following[i] = j = following[j]
        if j < len(parts):
            preceding[j] = i
        for a, b in ((preceding[i], i), (i, j)):
            if a >= 0 and b < len(parts) and (r := rank(parts[a], parts[b])) is not None:
                heapq.heappush(waiting, (r, a, parts[a] + parts[b]))
    return [vocabulary.ids[p] for p in parts if p]


class _Trie:
    """Pieces by their characters: ``ends`` at a node gives the piece's id and score."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.root: dict = {}
        for piece, own in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = own

    def from_(self, word: str, begin: int):
        """(end, id, score) of every piece that stands at a place."""
        node = self.root
        for k in range(begin, len(word)):
            if (node := node.get(word[k])) is None:
                return
            if own := node.get(""):
                yield k + 1, *own


def likeliest(word: str, trie: _Trie, unknown: int, least: float) -> list[int]:
    """Ids of the pieces that make a word with the greatest sum of scores; neighbouring unknown characters are one token."""
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)] + [(float("-inf"), -1, -1)] * len(word)
    for i in range(len(word)):
        score, whole = best[i][0], False
        for end, token, own in trie.from_(word, i):
            whole |= end == i + 1
            if score + own > best[end][0]:
                best[end] = (score + own, i, token)
        if not whole and score + least - _UNKNOWN_COST > best[i + 1][0]:
            best[i + 1] = (score + least - _UNKNOWN_COST, i, unknown)
    out: list[int] = []
    at = len(word)
    while at > 0:
        _, before, token = best[at]
        if token != unknown or not out or out[-1] != unknown:
            out.append(token)
        at = before
    return out[::-1]


class Tokenizer:
    """Ids of texts, with a table of the words seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.table = vocabulary, {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else lambda t: [t]
        if vocabulary.scores is None:
            self.find = regex.compile(WORDS).findall
        else:
            self.trie, self.least = _Trie(vocabulary.scores), min(s for _, s in vocabulary.scores.values())
            self.find = regex.compile(f"{_SPACE}?[^{_SPACE}]+|{_SPACE}").findall

    def _word(self, word: str) -> list[int]:
        if (ids := self.table.get(word)) is None:
            v = self.vocabulary
            ids = merged(word.encode(), v) if v.scores is None else likeliest(word, self.trie, v.unknown, self.least)
            if len(word) <= TABLE_CHARS:
                if len(self.table) >= TABLE_WORDS:
                    self.table.clear()
                self.table[word] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.vocabulary.special[part])
                continue
            if self.vocabulary.scores is not None and part:
                part = part.replace(" ", _SPACE)
                part = part if part.startswith(_SPACE) else _SPACE + part
            for word in self.find(part):
                out += self._word(word)
        return out


def _parts(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' sizes add up to ``most`` or less, or one row."""
    total, lo = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def token_ids(df: DataFrame, path: str, text: str = "text", name: str = "token_ids") -> DataFrame:
    """Add the ids of a text column as the library of the vocabulary file gives them, without added tokens; strings of special tokens are these tokens.

    The file is read on the driver and sent once, a fixed size. Null stays null, an empty text has no ids. A column called ``name`` is replaced.
    """
    df = df.drop(name)
    shared = df.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(path)))

    def encode(batches):
        own = Tokenizer(Vocabulary(*shared.value))
        for batch in batches:
            for part in _parts(batch, pc.binary_length(batch.column(text)), _BYTES_AT_ONCE):
                rows = [None if t is None else own.ids(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.int32()))], [*part.schema.names, name])

    return df.mapInArrow(encode, StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def token_texts(df: DataFrame, path: str, ids: str = "token_ids", name: str = "text") -> DataFrame:
    """Add the text that token ids stand for; bytes that are no UTF-8 become replacement characters, an id that isn't known is an error. Null stays null."""
    df = df.drop(name)
    vocabulary = load_vocabulary(path)
    known = {i: t for t, i in vocabulary.ids.items()} | {i: s.encode() for s, i in vocabulary.special.items()}
    shared = df.sparkSession.sparkContext.broadcast((known, vocabulary.scores is not None))

    def decode(batches):
        known, marked = shared.value
        for batch in batches:
            for part in _parts(batch, pc.list_value_length(batch.column(ids)), _IDS_AT_ONCE):
                rows = [None if x is None else b"".join([known[i] for i in x]).decode("utf-8", "replace") for x in part.column(ids).to_pylist()]
                if marked:
                    rows = [r and r.replace(_SPACE, " ").removeprefix(" ") for r in rows]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.string())], [*part.schema.names, name])

    return df.mapInArrow(decode, StructType([*df.schema.fields, StructField(name, StringType())]))


def token_stats(pieces: DataFrame, by: str, path: str, most: int) -> DataFrame:
    """(by, n_tokens, n_loss_tokens) of rendered conversations: ``pieces`` (array of struct<text, w>), each piece encoded by itself, cut after ``most`` tokens; the first
    token is no target."""
    each = pieces.select(by, F.posexplode("pieces").alias("k", "p")).select(by, "k", F.col("p.text").alias("text"), F.col("p.w").alias("w"))
    sized = token_ids(each, path).select(by, "k", "w", F.size("token_ids").cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("k"))
    inside = F.greatest(F.least(F.col("upto"), F.lit(most)) - F.greatest(F.col("upto") - F.col("n"), F.lit(1)), F.lit(0))
    own = sized.withColumn("upto", upto).groupBy(by)
    return own.agg((F.least(F.max("upto"), F.lit(most)) - 1).alias("n_tokens"), F.sum(F.when(F.col("w") > 0, inside).otherwise(0)).alias("n_loss_tokens"))


def frequent_ids(df: DataFrame, ids: str = "token_ids") -> DataFrame:
    """(token_id, n): how often each id occurs, summed in tasks first."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token_id", "n"])

    return df.where(F.size(ids) > 0).select(ids).mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
