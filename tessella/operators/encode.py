"""Texts as unit vectors: chunk frames, a hashed encoder in SQL, and an adapter for a model file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import hashed
from tessella.functions.vectors import mean_vector, unit

# Ids of a chunk without the two that frame it, and from one chunk's start to the next.
BODY, STRIDE = 510, 384
FIRST_ID, LAST_ID, EMPTY_ID = 101, 102, 0
BATCH, GUARD = 16, 1e-12


def chunk_bounds(n: Column, body: int = BODY, stride: int = STRIDE) -> Column:
    """An array of (chunk_no, lo, hi): frames over n ids, the last being the first that reaches the end.

    A text without ids has one frame, for the stand-in id.
    """
    n = F.greatest(n, F.lit(1))
    last = F.greatest(F.ceil((n - body) / F.lit(float(stride))).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk_no"), (k * stride).alias("lo"), F.least(n, k * stride + body).alias("hi")))


def chunks(rows: DataFrame, key: str, ids: str, body: int = BODY, stride: int = STRIDE) -> DataFrame:
    """(key, chunk_no, ids): framed and padded by nothing; overlapping by body - stride."""
    filled = F.when(F.size(ids) > 0, F.col(ids)).otherwise(F.array(F.lit(EMPTY_ID)))
    each = rows.select(key, filled.alias("_ids"), F.explode(chunk_bounds(F.size(ids), body, stride)).alias("c"))
    return each.select(key, "c.chunk_no", F.concat(F.array(F.lit(FIRST_ID)), F.slice("_ids", F.col("c.lo") + 1, F.col("c.hi") - F.col("c.lo")), F.array(F.lit(LAST_ID))).alias("ids"))


def hashed_encoder(rows: DataFrame, key: str, text: str, size: int = 64, body: int = BODY, stride: int = STRIDE) -> DataFrame:
    """(key, embedding): a stand-in encoder without a model, in SQL functions alone.

    Each chunk's words are added up with hashed signs in hashed places; chunks are averaged,
    then brought to length one. Texts without words have a zero vector.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    tokens = rows.select(key, words.alias("_w"))
    each = tokens.select(key, "_w", F.explode(chunk_bounds(F.size("_w"), body, stride)).alias("c")).select(key, F.slice("_w", F.col("c.lo") + 1, F.col("c.hi") - F.col("c.lo")).alias("_w"))
    draw = F.transform("_w", lambda w: hashed(w))
    zero = F.array_repeat(F.lit(0.0), size)
    place = each.select(key, draw.alias("_h"))
    one = lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.pmod(h, F.lit(size)) == i, F.when(F.pmod(F.floor(h / size), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    vector = F.aggregate("_h", zero, lambda s, h: F.zip_with(s, one(h), lambda a, b: a + b))
    means = place.select(key, vector.alias("_v")).groupBy(key).agg(mean_vector(F.col("_v")).alias("_v"))
    return means.select(key, unit(F.col("_v"), GUARD).cast("array<float>").alias("embedding"))


def model_encoder(rows: DataFrame, key: str, text: str, model: str, tokenizer: str, size: int, batch: int = BATCH) -> DataFrame:
    """(key, embedding) by an ONNX text encoder: first token of each chunk, chunks averaged, length one.

    Chunks of a batch of rows are sorted by length and padded together. The files' paths are
    read on the executors. Null texts are empty.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import onnxruntime as ort
        import pandas as pd
        from tokenizers import Tokenizer

        tok, session = Tokenizer.from_file(tokenizer), ort.InferenceSession(model, providers=["CPUExecutionProvider"])
        names = {i.name for i in session.get_inputs()}
        for pdf in parts:
            framed, owner = [], []
            for i, t in enumerate(pdf[text].fillna("")):
                ids = tok.encode(t, add_special_tokens=False).ids or [EMPTY_ID]
                for at in range(0, len(ids), STRIDE):
                    framed.append([FIRST_ID, *ids[at : at + BODY], LAST_ID])
                    owner.append(i)
                    if at + BODY >= len(ids):
                        break
            vectors, order = np.zeros((len(framed), size), np.float64), np.argsort([len(x) for x in framed], kind="stable")
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                longest = max(len(framed[i]) for i in own)
                ids = np.array([framed[i] + [0] * (longest - len(framed[i])) for i in own], np.int64)
                mask = np.array([[1] * len(framed[i]) + [0] * (longest - len(framed[i])) for i in own], np.int64)
                feed = {"input_ids": ids, "attention_mask": mask} | ({"token_type_ids": np.zeros_like(ids)} if "token_type_ids" in names else {})
                vectors[own] = session.run(None, feed)[0][:, 0, :]
            sums = np.zeros((len(pdf), size))
            np.add.at(sums, owner, vectors)
            mean = sums / np.maximum(1, np.bincount(owner, minlength=len(pdf)))[:, None]
            mean /= np.linalg.norm(mean, axis=1, keepdims=True) + GUARD
            yield pd.DataFrame({key: pdf[key], "embedding": [x.astype(np.float32) for x in mean]})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")
