"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

The count of a word is its initial symbols minus its merges; no token identifiers
are made. Words are counted once per batch of distinct words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._words import slices, words_of

#: A worker keeps so many words' counts, then starts afresh.
CACHE_WORDS = 1 << 20


class Merges(NamedTuple):
    """What counting needs of a tokenizer file."""

    ranks: dict[tuple[str, str], int]
    suffix: str  # marks a word's last symbol
    pattern: str  # finds the words of a normalised text
    special: list[str]  # strings that count as one token wherever a text has them


def load_merges(path: str) -> Merges:
    """Read a tokenizers .json file of the kind: NFC, white space to spaces, lower case; words by a pattern; bytes; BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x.get("type") for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec.get(part) or {}).get(name) or []]
    model = spec.get("model") or {}
    if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or model.get("type") != "BPE" or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path}: not a tokenizer of the kind that is counted here")
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return Merges({p: i for i, p in enumerate(pairs)}, model["end_of_word_suffix"] or "", split["pattern"]["Regex"], [x["content"] for x in spec["added_tokens"]])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the adjacent pair of lowest rank, leftmost first, is merged again and again."""
    n = left = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    symbols = [*symbols]
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], a + b))
    return left


class Counter:
    """Counts the tokens of pieces of text without ASCII white space."""

    def __init__(self, merges: Merges):
        self.merges, self.symbols = merges, byte_symbols()
        self.find = regex.compile(merges.pattern).findall
        self.cut = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)").split
        self.words: dict[str, int] = {}
        self.pieces: dict[bytes, int] = {}

    def word(self, word: str) -> int:
        if (n := self.words.get(word)) is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            symbols = [self.symbols[b] for b in word.encode()]
            symbols[-1] += self.merges.suffix
            n = self.words[word] = merged_length(symbols, self.merges.ranks)
        return n

    def text(self, text: str) -> int:
        parts = self.cut(text)
        total = len(parts) - 1
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            # the library lower-cases each character by itself; a whole string's final sigma would differ
            low = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            total += sum(map(self.word, self.find(low)))
        return total

    def piece(self, piece: bytes) -> int:
        if (n := self.pieces.get(piece)) is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            n = self.text(piece.decode("utf-8", "replace"))
            if len(piece) <= 64:
                self.pieces[piece] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to documents.

    ``docs`` needs a string ``text``; its other columns stay, but for one of the
    three names, which is replaced. ``vocabulary`` is the path of the tokenizer file,
    read on the driver; its merges, a fixed size, go to the executors once. The
    count is what the file's library gives without added tokens, truncation or
    padding. Null counts as empty: no bytes, no tokens. Each row is counted by
    itself, repeated or not, over its whole text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_merges(vocabulary)))
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = docs.columns

    def count(batches):
        counter = Counter(Merges(*shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
                data = w.data.tobytes()
                each = np.array([counter.piece(data[a:b]) for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)], np.int64)
                tokens = np.bincount(w.row, weights=each[which], minlength=part.num_rows).astype(np.int64) if len(one) else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens)], [*names, "n_tokens"])

    out = docs.mapInArrow(count, StructType([*docs.schema.fields, StructField("n_tokens", LongType())]))
    return out.select(*names, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
