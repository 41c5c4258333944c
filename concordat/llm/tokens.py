"""Sizes of documents in tokens of a public tokenizer, and their hashed vectors projected to a few dimensions."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (ranks of a byte-level BPE); a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are split before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Token ids are hashed into this many vector components, which are projected to DIMS dimensions.
COMPONENTS = 4096
DIMS = 3
BITS = 10
#: A text is encoded in pieces of about this many characters, so that memory stays bounded.
PIECE = 200_000
#: Where a new pre-token surely begins, whatever stands before: white space after other characters, the end of a run of
#: letters or digits. Cut there, the pieces give the same tokens as the whole text.
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")



def load(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of `size` characters and as many more as the next pre-token boundary takes."""
    at = 0
    while len(text) - at > size:
        m = _BOUNDARY.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((COMPONENTS, DIMS)).astype(np.float32)


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims) with coordinates below 2**bits."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def squash(v: np.ndarray) -> np.ndarray:
    """Projected vectors to integer coordinates; the scale is fixed, so a document's key never depends on the others."""
    return np.clip((np.tanh(v * 1.2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def measured(docs: DataFrame, id_column: str, text_column: str, keep: Sequence[str] = (), path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens int, curve long, v0, v1, v2 float, keep...) of every document; NULL and empty texts have 0 tokens,
    curve 0 and a zero vector.

    curve is the Hilbert index of the document's projected vector, v0..v2 that vector; the columns of `keep` are passed
    through.
    """
    names = [f"v{k}" for k in range(DIMS)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, proj = load(path), projection()
        for b in it:
            sizes, vectors = [], []
            for t in b["_t"]:
                size, total = 0, np.zeros(COMPONENTS, np.int64)
                for piece in pieces(t or ""):
                    ids = np.asarray(enc.encode_ordinary(piece), np.int64)
                    size += len(ids)
                    total += np.bincount((ids * 2654435761 >> 7) % COMPONENTS, minlength=COMPONENTS)
                sizes.append(size)
                weight = np.sqrt(total.astype(np.float32))  # frequent tokens count less
                vectors.append(weight @ proj / max(1e-6, float(np.linalg.norm(weight))))
            v = np.asarray(vectors, np.float32).reshape(-1, DIMS)
            out = b.drop(columns="_t")
            out["n_tokens"] = np.asarray(sizes, np.int32)
            out["curve"] = np.where(np.asarray(sizes) > 0, hilbert(squash(v)), 0)
            for k, n in enumerate(names):
                out[n] = v[:, k]
            yield out

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), *keep, F.col(text_column).alias("_t"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{head}, n_tokens int, curve long, " + ", ".join(f"{n} float" for n in names))


def with_topics(sized: DataFrame) -> DataFrame:
    """sized (of measured) with `topic`: the octant its vector lies in about the corpus's medians, so that the topics are
    of like size whatever the projection. Documents without tokens have topic 0."""
    names = [f"v{k}" for k in range(DIMS)]
    middle = sized.where("n_tokens > 0").agg(*[F.percentile_approx(n, 0.5, 10000).alias(n) for n in names]).first()  # one row
    bits = [F.when(F.col(n) > F.lit(float(middle[n] or 0)), 1 << k).otherwise(0) for k, n in enumerate(names)]
    return sized.withColumn("topic", F.when(F.col("n_tokens") > 0, sum(bits[1:], bits[0])).otherwise(0)).drop(*names)
