import base64
import json
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from millrace.operators import render
from millrace.operators.tokenize import Tokenizer, frequent_ids, load_vocabulary, token_ids, token_stats, token_texts, vocabulary_path

JSON, RANKS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
ODD = ["", "a b", "a  b \n c", "don't we'll x's", "a<|endoftext|> b<|endoftext|>", "日本 語 é́  x", "x" * 3000, "ab" * 2000 + " 123 45", " \t\n "]


def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(JSON)


def test_ids_of_all_documents_are_the_librarys(spark, data):
    own = library()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = token_ids(docs.union(spark.createDataFrame(list(enumerate(ODD, 10**6)), "doc_id long, text string")), JSON).collect()
    assert len(rows) > 150
    for r in rows:
        assert r.token_ids == own.encode(r.text, add_special_tokens=False).ids


def test_files_of_ranks(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs, ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer(load_vocabulary(RANKS))
    r = random.Random(3)
    for t in ODD + ["".join(r.choice("abcé '<|>1\n日") for _ in range(r.randrange(80))) for _ in range(300)]:
        assert ours.ids(t) == theirs.encode_ordinary(t)


def test_likeliest_pieces_are_the_librarys(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(4)
    pieces = {"<unk>": 0.0} | {p: -r.random() * 12 for p in ["▁", *"abcde"]} | {"".join(r.choice("▁abcde") for _ in range(r.randrange(2, 6))): -r.random() * 14 for _ in range(60)}
    theirs = tokenizers.Tokenizer(tokenizers.models.Unigram(list(pieces.items()), 0))
    theirs.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always")
    theirs.save(str(tmp_path / "u.json"))
    ours = Tokenizer(load_vocabulary(str(tmp_path / "u.json")))
    for _ in range(600):
        t = "".join(r.choice("abcdex y") for _ in range(r.randrange(25)))
        assert ours.ids(t) == theirs.encode(t, add_special_tokens=False).ids, t


def test_other_kinds_of_vocabulary_are_an_error(tmp_path):
    with pytest.raises(ValueError, match="changes texts"):
        load_vocabulary(vocabulary_path("word_bpe_49k.json"))
    (tmp_path / "x.json").write_text(json.dumps({"model": {"type": "WordPiece"}}))
    with pytest.raises(ValueError, match="not a vocabulary"):
        load_vocabulary(str(tmp_path / "x.json"))


def test_texts_come_back(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "id int, said string").selectExpr("*", "1 AS token_ids")
    ids = token_ids(rows, JSON, "said")
    assert ids.columns == ["id", "said", "token_ids"]
    back = token_texts(ids, JSON).collect()
    assert len(back) == len(ODD) + 1 and all(r.text == r.said for r in back)
    counts = {r.token_id: r.n for r in frequent_ids(ids).collect()}
    want = {}
    for r in back:
        for i in r.token_ids or []:
            want[i] = want.get(i, 0) + 1
    assert counts == want
    assert token_ids(rows.limit(0), JSON, "said").count() == 0


def test_statistics_of_rendered_conversations(spark, data):
    own = library()
    c = render.conversations(spark.read.parquet(f"{data}/conversations.parquet"))
    pieces = c.select("conv_id", render.pieces(c, "role_colon", "all_assistant_messages").alias("pieces"))
    got = {r.conv_id: (r.n_tokens, r.n_loss_tokens) for r in token_stats(pieces, "conv_id", JSON, 200).collect()}
    for row in pieces.collect():
        weights = [w for p in row.pieces for w in [p["w"]] * len(own.encode(p["text"], add_special_tokens=False).ids)][:200]
        assert got[row.conv_id] == (len(weights) - 1, sum(w > 0 for w in weights[1:]))


def test_rows_are_worked_on_in_bounded_parts(spark, tmp_path, monkeypatch):
    from millrace.operators import tokenize

    texts = [None if k % 7 == 0 else "word " * (k % 40) for k in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = list(tokenize._parts(batch, pc.binary_length(batch.column("text")), 300))
    sizes = [[len(t or "") for t in p.column("text").to_pylist()] for p in parts]
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts and len(parts) > 50
    assert all(sum(s) <= 300 or len(s) == 1 for s in sizes)
    monkeypatch.setattr(tokenize, "_BYTES_AT_ONCE", 300)
    monkeypatch.setattr(tokenize, "_IDS_AT_ONCE", 50)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    back = token_texts(token_ids(rows, JSON).drop("text"), JSON).collect()
    assert {r.k: r.text for r in back} == dict(enumerate(texts))
