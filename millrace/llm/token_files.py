"""Token ids in compressed binary files (operator 13).

Ids are counted over all documents; a canonical Huffman code of limited length packs
them. A file holds whole documents in the order of their ids, its code, and the bit at which every block of
ids begins, so that blocks are decoded without each other.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ._huffman import canonical, code_lengths, pack, unpack
from ._store import Scratch
from ._words import AS_IS, U64, bytes_of, hashes_of, slices

#: A file ends with the document that brings it to so many ids; a task writes so many ids, and there are so many tasks at most.
IDS_PER_FILE, IDS_PER_TASK, MOST_TASKS = 1 << 21, 1 << 24, 1 << 16
#: Ids of a block, and bits of a code at most.
BLOCK, LIMIT = 128, 20
#: A worker keeps the ids of so many pieces of text, some 40 bytes for each; so many are given to the library in one text.
CACHE_PIECES, LINES = 1 << 20, 1 << 14
#: File starts are broadcast up to this number, else joined.
BROADCAST_FILES = 200_000

#: A file: this head; then, as the head tells their sizes, the code (bits of each id from 0 on, deflated), the documents' ids, a flag for those
#: that have none, numbers of ids, the blocks' first bits, and the packed words. All numbers are little-endian.
HEAD = "<8sIIIIQIIIQ"
HEAD_BYTES = struct.calcsize(HEAD)
MAGIC = b"MRTOKID1"

#: A byte that may stand before a cut and one that may stand behind it, if it is ASCII; of two-byte letters those of Latin-1 are told.
_SEEN = np.array([0x20 < c < 0x7F for c in range(256)])
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_POINT = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places at which the library's words are parted whatever else the text holds: in front of a single space or a line end behind something
    that is seen, and of a point or comma behind a letter or digit. Special strings hold no such place."""
    latin = np.zeros(len(data) + 1, bool)  # second bytes of Latin-1 letters
    latin[1:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter = _ALNUM[data] | latin[:-1]
    seen = _SEEN[data] | latin[:-1]
    begins = _SEEN[data] | latin[1:]  # a Latin-1 letter's first byte has its second behind it
    here, before = data[1:-1], slice(0, -2)
    cut = (here == 0x20) & seen[before] & begins[2:]
    cut |= (here == 0x0A) & seen[before]
    cut |= _POINT[here] & letter[before]
    return np.flatnonzero(cut) + 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, ascending, where each occurs, and each key's number among them; by sorting, which is quicker here than numpy's own."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    return keys[one], one, which


class Encoder:
    """Ids of texts as the library gives them; pieces that recur are encoded once.

    Pieces are told by 64-bit hashes. New ones are given to the library in one text, a line each: a line end
    is a token of its own there, and parts what comes back. Those with white space inside or a special string go by themselves.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lines, others = [], []
        for k, p in enumerate(pieces):
            own = p[1:] if p[0] == " " else p
            plain = self.line is not None and own and own.isprintable() and " " not in own and "<|" not in own
            (lines if plain else others).append(k)
        for lo in range(0, len(lines), LINES):
            part = lines[lo : lo + LINES]
            (made,) = self.library.encode_batch_fast(["\n".join(pieces[k] for k in part) + "\n"], add_special_tokens=False)
            ids = np.array(made.ids, np.int32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(part):
                raise ValueError("the tokenizer joins line ends with words")
            for k, a, b in zip(part, np.concatenate(([0], ends[:-1] + 1)).tolist(), ends.tolist(), strict=True):
                out[k] = ids[a:b]
        for k, made in zip(others, self.library.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = np.array(made.ids, np.int32)
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Keep the ids of new pieces; their keys ascend."""
        made = self._encoded(pieces)
        size = np.array([len(x) for x in made], np.int64)
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(size) - size)
        self.size, self.keys = np.insert(self.size, at, size), np.insert(self.keys, at, keys)
        self.flat = np.concatenate((self.flat, *made))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the number of each row's."""
        data, offsets = bytes_of(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = np.sort(np.concatenate((cut_places(data), offsets)))
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        start, end = at[:-1], at[1:]
        keys, one, which = _distinct(hashes_of(data, start, end, AS_IS))
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if len(self.keys) + new.sum() > CACHE_PIECES:
            self._clear()
            new[:] = True
        raw = data.tobytes()
        pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
        self._learn(keys[new], pieces)
        place = np.searchsorted(self.keys, keys)
        first, n = self.first[place][which], self.size[place][which]
        ids = self.flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)]
        row = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)


def _encoder(spec: str) -> Encoder:
    """The encoder that this worker keeps from task to task: what it has learnt of one tokenizer stays."""
    held = sys.modules.setdefault("_millrace_encoder", types.ModuleType("_millrace_encoder")).__dict__
    if held.get("spec") != spec:
        held.update(spec=spec, encoder=Encoder(spec))
    return held["encoder"]


def id_bytes(spec: str, end_id: int) -> str:
    """The kind of number, of two bytes or four, that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id, *Tokenizer.from_str(spec).get_vocab().values()) < 1 << 16 else "<u4"


def encode(docs: DataFrame, spec: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, n, ids): the number and the ids of each text with ``end_id`` behind, as bytes. ``spec`` is the text of a tokenizers .json file, a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = encoder.texts(part.column("text"))
                ids = np.insert(ids.astype(kind), np.cumsum(n), end_id)
                at = (np.concatenate(([0], np.cumsum(n + 1))) * ids.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n + 1), packed], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids, and how many each row has."""
    _, where, held = column.buffers()
    at = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4)
    ids = np.frombuffer(held, np.uint8)[at[0] : at[-1]].view(kind) if held is not None else np.zeros(0, kind)
    return ids, np.diff(at).astype(np.int64) // np.dtype(kind).itemsize


def _counts(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents. One row for each id of the vocabulary comes to the driver."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column("ids"), kind)[0], minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = rows.column("id").to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    out[ids] = rows.column("n").to_numpy()
    return out


def _file(part: int, seq: int, ids: np.ndarray, doc_ids: pa.Array, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, begins = pack(ids, lengths, codes, BLOCK)
    code = zlib.compress(lengths.tobytes(), 6)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    body = b"".join([code, doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), n.astype("<u8").tobytes(), begins.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    return struct.pack(HEAD, MAGIC, part, seq, len(n), BLOCK, len(ids), len(code), len(words), zlib.crc32(body), len(body)) + body


def _files(batches: Iterator[pa.RecordBatch], part: int, kind: str, lengths: np.ndarray, codes: np.ndarray) -> Iterator[bytes]:
    """Files of whole documents, each of IDS_PER_FILE ids or little more."""
    held, total, seq = [], 0, 0

    def full() -> bytes:
        ids, n = (np.concatenate(x) for x in zip(*[_flat(b.column("ids"), kind) for b in held], strict=True))
        return _file(part, seq, ids, pa.concat_arrays([b.column("doc_id") for b in held]), n, lengths, codes)

    for batch in batches:
        lo, upto = 0, np.cumsum(_flat(batch.column("ids"), kind)[1])
        while lo < batch.num_rows:
            before = int(upto[lo - 1]) if lo else 0
            hi = min(batch.num_rows, int(np.searchsorted(upto, before + IDS_PER_FILE - total)) + 1)
            held.append(batch.slice(lo, hi - lo))
            total += int(upto[hi - 1]) - before
            lo = hi
            if total >= IDS_PER_FILE:
                yield full()
                held, total, seq = [], 0, seq + 1
    if held:
        yield full()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, limit: int = LIMIT) -> None:
    """Write the token ids of all documents, each followed by ``end_id``, as files under ``path``, by ascending doc_id.

    ``docs`` needs doc_id and text; other columns are ignored. ``tokenizer`` is the path of a tokenizers .json file of byte-level words, read on the driver.
    Ids are those the library gives for the whole text without added tokens, truncation or
    padding; special strings in texts as its default has them. Null counts as empty: the end id alone. Null ids come last; rows of one id
    stand in the order of their number of ids and checksum, repeated rows side by side. Codes have at most ``limit`` bits.
    A document is never parted, so one of very many ids makes a large file. An empty table writes no file with content.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    store = Scratch(docs.sparkSession, "token_files")
    kind = id_bytes(spec, end_id)
    encoded = store.keep(encode(docs, spec, end_id, kind).withColumns({"tie": F.xxhash64("ids"), "rid": F.monotonically_increasing_id()}), "encoded")
    counts = _counts(encoded, kind)
    lengths = code_lengths(counts, limit)
    shared = docs.sparkSession.sparkContext.broadcast((lengths, canonical(lengths)[1]))
    tasks = int(min(MOST_TASKS, max(1, -(-int(counts.sum()) // IDS_PER_TASK))))
    order = [F.col("doc_id").asc_nulls_last(), "n", "tie", "rid"]

    def write(batches):
        for file in _files(batches, TaskContext.get().partitionId(), kind, *shared.value):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], ["value"])

    ordered = encoded.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the text writer puts the bytes as they are, a file for each row, and a line end behind
    files = ordered.select("doc_id", "ids").mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    store.drop("encoded")


def read_file(content: bytes) -> tuple[int, int, pa.Array, np.ndarray, np.ndarray]:
    """Part, place in the part, document ids, numbers of ids and the ids of one file."""
    part, seq, docs, block, total, code, packed, crc, size = _head(content)
    body = memoryview(content)[HEAD_BYTES : HEAD_BYTES + size]
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("a file of token ids is cut short or damaged")
    blocks = -(-total // block)
    at = np.cumsum([code, 8 * docs, docs, 8 * docs, 8 * blocks, 4 * packed])
    lengths = np.frombuffer(zlib.decompress(body[: at[0]]), np.uint8)
    ids, null, n, begins, words = (np.frombuffer(body[a:b], t) for a, b, t in zip(at[:-1], at[1:], ("<i8", np.uint8, "<u8", "<u8", "<u4"), strict=True))
    return part, seq, pa.array(ids, mask=null > 0), n.astype(np.int64), unpack(words, begins, total, lengths, block)


def _head(content: bytes) -> tuple[int, ...]:
    if len(content) < HEAD_BYTES or content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    return struct.unpack_from(HEAD, content)[1:]


def _starts(files: DataFrame) -> DataFrame:
    """(part, seq, first): ids in all files before each; one row for each part, MOST_TASKS at most, comes to the driver."""

    def heads(batches):
        for batch in batches:
            rows = [_head(c.as_buffer().slice(0, min(c.as_buffer().size, HEAD_BYTES)).to_pybytes()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 4)], ["part", "seq", "total"])

    each = files.mapInArrow(heads, "part long, seq long, total long")
    parts = sorted(map(tuple, each.groupBy("part").agg(F.sum("total")).collect()))
    before = np.cumsum([0] + [n for _, n in parts]).tolist()
    base = files.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(parts, before, strict=False)], "part long, base long")
    inside = F.coalesce(F.sum("total").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = each.withColumn("inside", inside).join(F.broadcast(base), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("first"))
    return F.broadcast(out) if each.count() <= BROADCAST_FILES else out


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row for each document of the files under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of
    the ids as little-endian 32-bit numbers) and, ``with_ids``, ids.

    A null doc_id is read as null; repeated rows are read as often as they were written. A folder without content gives no rows; a file that is damaged,
    or none of the kind, is an error. A file is held in memory whole.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    names = ["part", "seq", "inside", "doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                part, seq, doc_ids, n, ids = read_file(content.as_py())
                at = np.concatenate(([0], np.cumsum(n)))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                same = lambda v: pa.array(np.full(len(n), v, np.int64))  # noqa: B023,E731
                columns = [same(part), same(seq), pa.array(at[:-1]), doc_ids, pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [StructField(x, LongType()) for x in names[:6]] + [StructField("ids", ArrayType(IntegerType()))] * with_ids
    out = files.mapInArrow(read, StructType(fields)).join(_starts(files), ["part", "seq"])
    return out.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), *names[4:])
