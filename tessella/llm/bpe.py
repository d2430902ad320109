"""Byte-level BPE: tiktoken over a local rank file, long texts cut at safe boundaries first.

A cut is safe where a match of the pattern always ends: before white space that follows
something else, and before the last character of a run of white space that goes on with
something else. Ids are the same as of the uncut text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import pick

#: Unicode's White_Space, which the pattern's \s means (Python's own \s has four more).
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A text of more characters is cut; so is a run of white space of at least LONG_RUN, on
#: which the pattern's look-ahead would use the stack of the regex engine up.
LONG_TEXT = 1 << 16
LONG_RUN = 256
#: A rank file is broadcast with each task's code; files over this many bytes are refused.
MAX_RANK_BYTES = 64 << 20

_RUN = re.compile(f"{SPACE}{{{LONG_RUN},}}")
_SAFE = re.compile(f"(?<!{SPACE}){SPACE}")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding(
        "local",
        pat_str=pattern,
        mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        special_tokens={},
    )


def pieces(text: str, longest: int = LONG_TEXT) -> Iterator[tuple[str, bool]]:
    """Parts of the text to encode apart; True marks a part that is one match of the pattern."""
    at = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        end -= end < len(text)
        yield from ((x, False) for x in _cut(text[at:start], longest))
        yield text[start:end], True
        at = end
    yield from ((x, False) for x in _cut(text[at:] if at else text, longest))


def _cut(text: str, longest: int) -> Iterator[str]:
    at = 0
    while len(text) - at > longest:
        safe = _SAFE.search(text, at + longest)
        if safe is None:
            break
        yield text[at : safe.start()]
        at = safe.start()
    if at < len(text):
        yield text[at:] if at else text


def encode_text(encoding: tiktoken.Encoding, text: str, longest: int = LONG_TEXT) -> np.ndarray:
    """The ids of one text as uint32, as ``encode_ordinary`` gives them."""
    parts = [
        np.asarray(encoding._encode_single_piece(x.encode()) if one else encoding.encode_ordinary(x), "<u4")
        for x, one in pieces(text, longest)
    ]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _coder(df: DataFrame, rank_file: str, pattern: str) -> Callable[[], tiktoken.Encoding]:
    with open(rank_file, "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_file} has over {MAX_RANK_BYTES} bytes")
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    return lambda: _encoding(sent.value, pattern)


def encode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, n_tokens, ids): each row's ids as little-endian unsigned 32-bit integers.

    rank_file is a path on the driver. Special tokens are ordinary text. With ``decoded``
    the ids are decoded again in the same pass, as a binary column ``decoded``.
    Null and empty texts have no ids. One row for each input row, repeated rows too;
    a null key stays null. Memory: a batch and one text's ids.
    """
    rows = pick(df, key, text)
    coder = _coder(df, rank_file, pattern)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [encode_text(encoding, x or "") for x in part.column(1).to_pylist()]
                out = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decoded:
                    out.append(pa.array([encoding.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [key, "n_tokens", "ids"] + ["decoded"] * decoded
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the raw bytes of each row's ids; they need not be valid UTF-8. Null: empty."""
    rows = pick(df, key, ids)
    coder = _coder(df, rank_file, pattern)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder()
        for batch in batches:
            raw = [encoding.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[key, "decoded"])

    return rows.mapInArrow(run, f"`{key}` {kind}, decoded binary")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of what ``encode(decoded=True)`` returns."""
    return encoded.select(
        key,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


