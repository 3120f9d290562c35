import random

import pytest

from millrace.llm.queries import tokenizer_path
from millrace.llm.token_counts import Merges, Counter, load_merges, merged_length, token_counts

PATH = tokenizer_path("word_bpe_49k.json")


def test_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    r = random.Random(1)
    texts = ["", None, "don't we'll  I'M <|endoftext|>x<|startoftext|><|END|>", "ΣΊΣΥΦΟΣ ΣΑΣ.Σ", "é \u0301e a\u00a0b\u3000日本語 12345 ٣٤ İI ﬁ Ǆ ß\u200b\0x", "a" * 5000, "ab" * 3000 + " c", "<|endoftext|", " \n\t\x0b\x0c\x1c\x1d\x85z"]
    letters = list("abcdefghij '-<>|!?.éÉΣσς\u0301\u0308 \n ẞ가日😀\u200d\u0345")
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS word").repartition(3)
    out = token_counts(df, PATH, limit=20)
    assert out.columns == ["doc_id", "text", "word", "n_bytes", "n_tokens", "over_limit"]
    for row in out.collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((row.text or "").encode()), n > 20), row.text


def naive(symbols, ranks):
    symbols = list(symbols)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not pairs:
            return len(symbols)
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_heap_against_scanning():
    r = random.Random(2)
    for _ in range(300):
        made = ["a", "b", "c"]
        ranks = {}
        for k in range(8):
            p = (r.choice(made), r.choice(made))
            if p not in ranks:
                ranks[p] = k
                made.append(p[0] + p[1])
        s = [r.choice("abc") for _ in range(r.randrange(1, 25))]
        assert merged_length(s, ranks) == naive(s, ranks)


def test_cache_starts_afresh(monkeypatch):
    import millrace.llm.token_counts as m

    monkeypatch.setattr(m, "CACHE_WORDS", 3)
    c = Counter(Merges({("a", "b</w>"): 0}, "</w>", "[a-z]+", []))
    assert [c.piece(x) for x in (b"ab", b"a", b"b", b"aab", b"ab", b"ab")] == [1, 1, 1, 2, 1, 1]


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises((ValueError, KeyError)):
        load_merges(tokenizer_path("byte_bpe_50k.json"))


def test_all_documents_of_the_table_against_the_library(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = token_counts(docs, PATH).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.n_tokens == len(library.encode(row.text or "", add_special_tokens=False).ids)
