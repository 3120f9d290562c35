import heapq
import random
import zlib

import numpy as np
import pytest

from millrace.llm import token_files
from millrace.llm._huffman import canonical, code_lengths, pack, unpack
from millrace.llm.queries import op13_token_files, tokenizer_path
from millrace.llm.token_files import Encoder, read_file, read_token_files, write_token_files

PATH = tokenizer_path("byte_bpe_50k.json")


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(PATH)


def total_of_huffman(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def least_limited(counts, limit):
    """Least total over all lengths that a code can have, tried one by one."""
    counts = sorted(c for c in counts if c)
    best = None

    def go(k, room, cost, least):
        nonlocal best
        if k < 0:
            best = cost if best is None else min(best, cost)
            return
        for n in range(least, limit + 1):
            if room >= 2 ** (limit - n):
                go(k - 1, room - 2 ** (limit - n), cost + counts[k] * n, n)

    go(len(counts) - 1, 2**limit, 0, 1)
    return best


def test_code_lengths_are_least():
    r = random.Random(5)
    for _ in range(150):
        counts = np.array([r.choice([0, 1, 2, 3, 5, 100, 10**12]) for _ in range(r.randrange(2, 60))])
        lengths = code_lengths(counts, 40)
        assert ((lengths > 0) == (counts > 0)).all()
        if (counts > 0).sum() > 1:
            assert int((lengths * counts).sum()) == total_of_huffman(counts.tolist())
    for _ in range(60):
        counts = np.array([r.choice([1, 1, 2, 7, 60]) for _ in range(r.randrange(2, 8))])
        lengths = code_lengths(counts, 3)
        assert lengths.max() <= 3 and int((lengths * counts).sum()) == least_limited(counts.tolist(), 3)
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)
    assert code_lengths(np.zeros(4, int), 5).tolist() == [0] * 4 and code_lengths(np.array([0, 3]), 5).tolist() == [0, 1]


def test_packing_comes_back():
    r = np.random.Generator(np.random.PCG64(6))
    for k in range(60):
        counts = r.integers(0, 50, int(r.integers(1, 400))) ** 3
        if not counts.any():
            continue
        limit = int(np.ceil(np.log2(max(2, (counts > 0).sum())))) + int(r.integers(0, 8))
        lengths = code_lengths(counts, limit)
        symbols = r.choice(np.flatnonzero(counts), int(r.integers(0, 900)))
        words, begins = pack(symbols, lengths, canonical(lengths)[1], 32)
        assert (unpack(words, begins, len(symbols), lengths, 32) == symbols).all()
        if len(begins) > 2:  # a block by itself, from its checkpoint
            own = symbols[64:96]
            assert (unpack(words, begins[2:3], len(own), lengths, 32) == own).all()


def test_pieces_give_the_ids_of_whole_texts():
    import pyarrow as pa

    own, encoder = library(), Encoder(open(PATH, encoding="utf-8").read())
    texts = ["", "a b", " a  b c \n d", "don't we'll x's 5's", "a <|endoftext|> b<|endoftext|>c d <|endoftext| >", "é a b c d e　f", "日本 語 a 1 2", "x" * 3000 + " y", "\r\n a\tb "]
    r = random.Random(7)
    texts += ["".join(r.choice(list("ab1é' \n\t.<|>日😀 ")) for _ in range(r.randrange(60))) for _ in range(500)]
    for _ in range(2):
        ids, n = encoder.texts(pa.array(texts))
        at = np.concatenate(([0], np.cumsum(n)))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids, t


def expected(rows):
    own, start, out = library(), 0, []
    for doc_id, ids in sorted([(d, own.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows], key=lambda r: (r[0] is None, r[0] or 0)):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_query_equals_the_library(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    out = op13_token_files(spark, data)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted([tuple(r) for r in out.collect()], key=key) == expected(rows)


def test_odd_rows_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 50)
    monkeypatch.setattr(token_files, "IDS_PER_TASK", 400)
    rows = [(k if k % 4 else None, "x y z " * (k % 7), 1) for k in range(120)] + [(5, None, 1), (-9, "", 2), (7, "w " * 30_000, 3), (3, "x y z " * 3, 1), (3, "x y z " * 3, 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "1 AS ids", "2 AS seq").repartition(4)
    write_token_files(docs, str(tmp_path / "f"), PATH)
    out = read_token_files(spark, str(tmp_path / "f")).collect()
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
    want = expected([r[:2] for r in rows])
    # rows of one id may stand in either order
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in out) == sorted((d or -1, n, c) for d, _, n, c in want)
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [d for d, *_ in want]
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered[:-1]]).tolist()
    files = [f for f in (tmp_path / "f").glob("*.txt") if f.stat().st_size]
    assert len(files) > 5
    with pytest.raises(ValueError):
        read_file(files[0].read_bytes()[:-9])
    with pytest.raises(ValueError):
        read_file(b"something else" * 20)
    write_token_files(docs.limit(0), str(tmp_path / "none"), PATH)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0
