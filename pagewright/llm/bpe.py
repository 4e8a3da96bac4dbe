"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as S

RANKS = "byte_bpe_50k.tiktoken"
#: Texts over this many characters are encoded in pieces.
PIECE_CHARS = 1 << 16
#: Runs of this many white-space characters or more are taken apart from the text around them.
LONG_RUN = 4096
#: White space as the tokenizer's pattern knows it, a fixed value of Unicode.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_encoding(path: str, pattern: str):
    """The encoding of a rank file. It stays in the library's registry, so a worker process that is used again
    reads the file once."""
    import base64

    import tiktoken

    known, name = tiktoken.registry.ENCODINGS, f"{path}\0{pattern}"
    if name not in known:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        known[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return known[name]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut before white space that follows other characters, at the first such place after ``size`` characters.

    The pattern starts a match at every such place: only runs of white space go on over white space, and none
    can begin before it; nothing in the pattern looks back, and what looks ahead from the end of a piece sees no
    white space. So the pieces have the ids of the whole. A text without such a place is one piece.
    """
    import re

    at, cut = 0, re.compile(r"(?<=\S)[ \n]")
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def matches_and_texts(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """The text in pieces, each with whether it is a single match of the pattern.

    The library's regular expression overflows its stack on a run of a million white-space characters. A match starts
    where such a run does, as no other match holds white space but for a space before it. It takes the run up to its
    last character, or all of it at the end of the text; what is left begins with that character and is encoded as ever.
    """
    import re

    at = 0
    for m in re.finditer(f"[{WHITE}]{{{LONG_RUN},}}+", text):
        end = m.end() - (m.end() < len(text))
        yield from ((piece, False) for piece in safe_pieces(text[at:m.start()], size))
        yield text[m.start():end], True
        at = end
    yield from ((piece, False) for piece in safe_pieces(text[at:], size))


def encode_text(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` with binary column ``ids_col``: the token ids of the whole text, each four bytes, little-endian.

    The rank file lies at ``ranks_path`` on every worker. Each match of ``pattern`` is encoded by itself; the
    strings of special tokens are ordinary text. NULL and empty text have no ids; every row stays and gets ids
    from its own text alone, in the task that reads it; an empty table stays empty. Other columns pass through, one of
    the name ``ids_col`` is replaced. A pattern of the caller's own must treat white space as the default one does: runs of it
    are matches but for their last character, and one space may begin another match.
    """
    path, pat = ranks_path or default_ranks(), pattern or default_pattern()

    @S.pandas_udf("binary")
    def encode(texts):
        import numpy as np
        import pandas as pd

        enc = load_encoding(path, pat)

        def ids(text):
            out = [np.array(enc._encode_single_piece(piece) if single else enc.encode_ordinary(piece), dtype="<u4") for piece, single in matches_and_texts(text, piece_chars)]
            return np.concatenate(out).tobytes()

        return pd.Series([ids(t) for t in texts], dtype=object)

    return docs.withColumn(ids_col, encode(S.coalesce(S.col(f"`{text_col}`"), S.lit(""))))


def decode_ids(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with binary column ``bytes_col``: the bytes of the ids' tokens one after the other; they need not be
    whole characters. NULL ids have no bytes."""
    path, pat = ranks_path or default_ranks(), pattern or default_pattern()

    @S.pandas_udf("binary")
    def decode(ids):
        import numpy as np
        import pandas as pd

        enc = load_encoding(path, pat)
        return pd.Series([enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in ids], dtype=object)

    return df.withColumn(bytes_col, decode(S.coalesce(S.col(f"`{ids_col}`"), S.lit(b""))))
