"""Pluggable tokenizers as Arrow UDFs; bytes are the default and need no vocabulary."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

Encode, Decode = Callable[[str], list[int]], Callable[[list[int]], str]


def byte_codec(specials: tuple[str, ...] = ()) -> tuple[Encode, Decode]:
    """UTF-8 bytes as ids 0 to 255, each special string as one id from 256 on."""
    import re

    cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
    ids = {s: 256 + i for i, s in enumerate(specials)}

    def encode(text: str) -> list[int]:
        parts = cut.split(text) if cut else [text]
        return [i for p in parts for i in ([ids[p]] if p in ids else p.encode())]

    def decode(tokens: list[int]) -> str:
        return b"".join(specials[t - 256].encode() if t > 255 else bytes([t]) for t in tokens).decode("utf-8", "replace")

    return encode, decode


def library_codec(path: str) -> tuple[Encode, Decode]:
    """A tokenizer file of the tokenizers or sentencepiece library, by its ending."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda s: t.encode(s, add_special_tokens=False).ids, lambda x: t.decode(x, skip_special_tokens=False)
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return p.encode, p.decode


_CODECS: dict = {}


def _codec(path: str | None, specials: tuple[str, ...]) -> tuple[Encode, Decode]:
    """The codec, made once in a worker."""
    key = (path, specials)
    if key not in _CODECS:
        _CODECS[key] = byte_codec(specials) if path is None else library_codec(path)
    return _CODECS[key]


def encoder(path: str | None = None, specials: tuple[str, ...] = ()):
    """A UDF from text to token ids."""

    def encode_all(texts: pd.Series) -> pd.Series:
        encode = _codec(path, specials)[0]
        return texts.map(lambda t: None if t is None else encode(t))

    return F.pandas_udf(encode_all, ArrayType(IntegerType()))


def decoder(path: str | None = None, specials: tuple[str, ...] = ()):
    """A UDF from token ids to text."""

    def decode_all(tokens: pd.Series) -> pd.Series:
        decode = _codec(path, specials)[1]
        return tokens.map(lambda t: None if t is None else decode([int(x) for x in t]))

    return F.pandas_udf(decode_all, StringType())


def truncated(most: int, path: str | None = None, specials: tuple[str, ...] = ()):
    """A UDF that gives a text's first ``most`` tokens as text; bytes of a character that the cut splits go."""

    def cut_all(texts: pd.Series) -> pd.Series:
        encode, decode = _codec(path, specials)

        def cut(text: str | None) -> str | None:
            if text is None or len(ids := encode(text)) <= most:
                return text
            return decode(list(ids[:most])).rstrip("\ufffd")

        return texts.map(cut)

    return F.pandas_udf(cut_all, StringType())
