"""Differences between two copies of a dataset by characteristic-polynomial set reconciliation.

Each copy is reduced, per bucket of keys, to the values of its characteristic polynomial prod(z - h) at a few fixed
points of GF(2**61 - 1), h being the row hashes. The quotient of both copies' values is a rational function whose
numerator and denominator have only the differing row hashes as roots. It is interpolated under a degree bound that
doubles until further points verify it; each copy then finds which of its own hashes are roots, and only those rows are
fetched and compared field by field. What crosses between the copies is a few numbers a bucket, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import materialize, materialize_all

P = (1 << 61) - 1
#: Hashes start here; the evaluation points are 1, 2, 3, ... below it.
FIRST_HASH = 1 << 20
#: Rows a bucket holds on average.
BUCKET_ROWS = 64
#: Points that only verify.
CHECKS = 2
FIRST_POINTS = 32 + CHECKS


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b in GF(2**61 - 1), element by element, uint64."""
    u = np.uint64
    a1, a0, b1, b0 = a >> u(31), a & u(0x7FFFFFFF), b >> u(31), b & u(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    s = ((a1 * b1) << u(1)) + (mid >> u(30)) + ((mid & u(0x3FFFFFFF)) << u(31)) + a0 * b0
    s = (s & u(P)) + (s >> u(61))
    return np.where(s >= u(P), s - u(P), s)


def evaluate(sets: Sequence[np.ndarray], points: int) -> np.ndarray:
    """Characteristic polynomials of the sets at 1..points: array (sets, points). The empty set gives 1."""
    width = 1 << max(0, max((len(s) for s in sets), default=0) - 1).bit_length()
    h = np.zeros((len(sets), width), np.uint64)
    there = np.zeros((len(sets), width), bool)
    for i, s in enumerate(sets):
        h[i, : len(s)], there[i, : len(s)] = s, True
    z = np.arange(1, points + 1, dtype=np.uint64)
    f = np.where(there[:, None, :], np.uint64(P) - h[:, None, :] + z[None, :, None], np.uint64(1))
    while f.shape[2] > 1:
        half = f.shape[2] // 2
        f = mulmod(f[:, :, :half], f[:, :, half:])
    return f[:, :, 0]


def _value(poly: Sequence[int], x: int) -> int:
    v = 0
    for c in reversed(poly):
        v = (v * x + c) % P
    return v


def _trim(p: list[int]) -> list[int]:
    while p and not p[-1]:
        p.pop()
    return p


def _quotient(f: Sequence[int], delta: int, bound: int) -> tuple[list[int], list[int]] | None:
    """Monic numerator and denominator, degrees differing by delta and adding up to at most bound, through f at 1..bound+1."""
    top = (bound + delta) // 2
    k = bound + 1
    if top < 0 or top - delta < 0:
        return None
    # Newton interpolation, and the polynomial that vanishes on all points
    coefs, interp, vanish = list(f[:k]), [], [1]
    for j in range(1, k):
        inv = pow(j, -1, P)
        for i in range(k - 1, j - 1, -1):
            coefs[i] = (coefs[i] - coefs[i - 1]) * inv % P
    for j in range(k):
        interp += [0] * (len(vanish) - len(interp))
        for i, v in enumerate(vanish):
            interp[i] = (interp[i] + coefs[j] * v) % P
        z = j + 1
        vanish = [((vanish[i - 1] if i else 0) - (z * vanish[i] if i < len(vanish) else 0)) % P for i in range(len(vanish) + 1)]
    # remainders of Euclid's algorithm until the numerator's degree fits
    r0, r1, t0, t1 = vanish, _trim(interp), [], [1]
    while len(r1) - 1 > top:
        inv, t2, r = pow(r1[-1], -1, P), list(t0), list(r0)
        for shift in range(len(r) - len(r1), -1, -1):
            q = r[shift + len(r1) - 1] * inv % P
            if not q:
                continue
            for i, c in enumerate(r1):
                r[shift + i] = (r[shift + i] - q * c) % P
            t2 += [0] * (shift + len(t1) - len(t2))
            for i, c in enumerate(t1):
                t2[shift + i] = (t2[shift + i] - q * c) % P
        r0, r1, t0, t1 = r1, _trim(r), t1, _trim(t2)
    if not r1 or not t1 or len(r1) - len(t1) != delta:
        return None
    a, b = pow(r1[-1], -1, P), pow(t1[-1], -1, P)
    return [c * a % P for c in r1], [c * b % P for c in t1]


def decode(left: Sequence[int], right: Sequence[int], n_left: int, n_right: int) -> tuple[list[int], list[int]] | None:
    """Polynomials whose roots are the hashes only left and only right; None when these points don't suffice."""
    f = [int(a) * pow(int(b), -1, P) % P for a, b in zip(left, right)]
    if n_left == n_right and all(v == 1 for v in f):
        return [1], [1]
    bound = max(2, abs(n_left - n_right))
    while bound + 1 + CHECKS <= len(f):
        found = _quotient(f, n_left - n_right, bound)
        if found and all(_value(found[0], z) == f[z - 1] * _value(found[1], z) % P for z in range(bound + 2, bound + 2 + CHECKS)):
            return found
        bound *= 2
    return None


def roots(hashes: np.ndarray, poly: Sequence[int]) -> np.ndarray:
    """Those of the hashes that are roots."""
    v = np.full(len(hashes), poly[-1], np.uint64)
    for c in reversed(poly[:-1]):
        v = mulmod(v, hashes) + np.uint64(c)
        v = np.where(v >= np.uint64(P), v - np.uint64(P), v)
    return hashes[v == 0]


def row_hash(columns: Sequence[Column]) -> Column:
    """Field element of a row; NULL differs from every text."""
    return F.pmod(F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns]), F.lit(P - FIRST_HASH)) + FIRST_HASH


def _buckets(rows: DataFrame, n: int) -> DataFrame:
    """(_bucket, hs): the row hashes of each of n buckets of keys; reads the two hash columns only."""
    return rows.select(F.pmod("_k", F.lit(n)).alias("_bucket"), "_h").groupBy("_bucket").agg(F.collect_list("_h").alias("hs"))


def _sketch(buckets: DataFrame, points: int, side: str) -> DataFrame:
    @F.pandas_udf("array<long>")
    def values(hs: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(hs), 64):
            out += list(evaluate([np.asarray(x, np.uint64) for x in hs.iloc[i : i + 64]], points).astype(np.int64))
        return pd.Series(out, dtype=object)

    return buckets.select("_bucket", values("hs").alias(f"e{side}"), F.size("hs").alias(f"n{side}"))


def _decoded(sketches: DataFrame, points: int) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for bucket, el, er, nl, nr in zip(b["_bucket"], b["el"], b["er"], b["nl"], b["nr"]):
                one = [1] * points
                found = decode(one if el is None else el, one if er is None else er, int(nl), int(nr))
                if found != ([1], [1]):
                    rows.append((bucket, found is not None, *(found or (None, None))))
            yield pd.DataFrame(rows, columns=["_bucket", "ok", "pl", "pr"])

    return sketches.fillna(0, ["nl", "nr"]).mapInPandas(run, "_bucket long, ok boolean, pl array<long>, pr array<long>")


def _own_roots(buckets: DataFrame, decoded: DataFrame, poly: str) -> DataFrame:
    """(_bucket, _h) of the roots, and whether a bucket has as many as the degree says."""

    @F.pandas_udf("array<long>")
    def found(hs: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([list(roots(np.asarray(h, np.uint64), [int(c) for c in q]).astype(np.int64)) for h, q in zip(hs, p)], dtype=object)

    wanted = decoded.where(F.size(poly) > 1).select("_bucket", poly)
    hit = wanted.join(buckets, "_bucket", "left").select("_bucket", (F.size(poly) - 1).alias("degree"), F.coalesce("hs", F.expr("cast(array() as array<long>)")).alias("hs"), poly)
    return hit.select("_bucket", "degree", found("hs", poly).alias("roots"))


def differing_rows(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of each copy that have no equal row in the other.

    left and right hold one row a key, with the columns `key` and `fields` (text, NULL allowed; NULL equals NULL).
    Empty tables are allowed: then every row of the other copy differs.
    """
    cols = [*key, *fields]
    sides = []
    for df in (left, right):
        k = F.xxhash64(F.lit(1), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key])
        sides.append(df.select(*cols, k.alias("_k"), row_hash([F.col(c) for c in cols]).alias("_h")))
    sides = materialize_all(sides, "rows")
    n_buckets = max(8, max(s.count() for s in sides) // bucket_rows)
    sets = materialize_all([_buckets(s, n_buckets) for s in sides], "sets")
    points, open_buckets, only = FIRST_POINTS, None, ([], [])
    while True:
        now = sets if open_buckets is None else [s.join(open_buckets, "_bucket", "left_semi") for s in sets]
        both = _sketch(now[0], points, "l").join(_sketch(now[1], points, "r"), "_bucket", "full_outer")
        decoded = materialize(_decoded(both, points), "decoded")
        good = decoded.where("ok")
        found = materialize_all([_own_roots(s, good, p) for s, p in zip(now, ("pl", "pr"))], "roots")
        wrong = [f.where(F.size("roots") != F.col("degree")).select("_bucket") for f in found]
        failed = decoded.where("not ok").select("_bucket").unionByName(wrong[0]).unionByName(wrong[1]).distinct()
        bad = materialize(failed, "open")
        for side, f in zip(only, found):
            side.append(f.join(bad, "_bucket", "left_anti").select("_bucket", F.explode("roots").alias("_h")))
        if bad.isEmpty():
            break
        open_buckets, points = bad, (points - CHECKS) * 4 + CHECKS
        if points >= FIRST_HASH:
            raise ValueError("a bucket differs in more rows than there are evaluation points; lower bucket_rows")
    out = []
    for df, parts in zip(sides, only):
        hits = parts[0]
        for x in parts[1:]:
            hits = hits.unionByName(x)
        out.append(df.withColumn("_bucket", F.pmod("_k", F.lit(n_buckets))).join(hits, ["_bucket", "_h"], "left_semi").select(*cols))
    return out[0], out[1]


def field_differences(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], missing_right: str = "missing_in_target", missing_left: str = "missing_in_source", **options: int) -> DataFrame:
    """(key, fld, expected, target): a row per differing field, or one per key that only one copy holds."""
    a, b = differing_rows(left, right, key, fields, **options)
    a = a.select(*key, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{i}") for i, c in enumerate(fields)])
    b = b.select(*key, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{i}") for i, c in enumerate(fields)])
    null = F.lit(None).cast("string")
    per_field = F.filter(
        F.array(*[F.struct(F.lit(c).alias("fld"), F.col(f"a_{i}").alias("expected"), F.col(f"b_{i}").alias("target"), (~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}"))).alias("differs")) for i, c in enumerate(fields)]),
        lambda x: x["differs"],
    )
    gone = lambda name: F.array(F.struct(F.lit(name).alias("fld"), null.alias("expected"), null.alias("target"), F.lit(True).alias("differs")))
    joined = a.join(b, list(key), "full_outer")
    found = F.when(F.col("_b").isNull(), gone(missing_right)).when(F.col("_a").isNull(), gone(missing_left)).otherwise(per_field)
    return joined.select(*key, F.explode(found).alias("x")).select(*key, "x.fld", "x.expected", "x.target")
