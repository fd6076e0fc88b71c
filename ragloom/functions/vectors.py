"""Vector column functions: cosine distance, rescaled similarity, text codec.

These are per-row expressions for pairs that are already joined on a key;
top-k scans over whole tables use ``operators.vector_search`` instead.
Arithmetic is done in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine_similarity(a, b) -> Column:
    """cos(a, b); NULL when either vector is NULL, has zero norm, or widths differ."""
    a, b = _col(a), _col(b)
    na, nb = norm(a), norm(b)
    ok = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb))


def cosine_distance(a, b) -> Column:
    """G1: ``a <=> b`` = 1 - cos(a, b)."""
    return F.lit(1.0) - cosine_similarity(a, b)


def semantic_score(a, b) -> Column:
    """``1 - (a <=> b) / 2``, i.e. (1 + cos) / 2 in [0, 1]."""
    return F.lit(1.0) - cosine_distance(a, b) / F.lit(2.0)


def cosine_distance_sql(a: str, b: str) -> str:
    return f"(1.0 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]))"


def semantic_score_sql(a: str, b: str) -> str:
    return f"(1.0 - {cosine_distance_sql(a, b)} / 2.0)"


def scale(v, w: float) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double") * F.lit(w))


def weighted_sum(a, b, wa: float, wb: float) -> Column:
    """Element-wise ``wa * a + wb * b`` as ARRAY<DOUBLE>."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * F.lit(wa) + y.cast("double") * F.lit(wb))


# ---------------------------------------------------------------- text codec (A10)

def vector_to_text(v) -> Column:
    """``"[" + ",".join(str(x)) + "]"``; element text is Spark's shortest float form."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(v), lambda x: x.cast("string")), ","), F.lit("]"))


def text_to_vector(s) -> Column:
    """Parse a JSON number list into ARRAY<FLOAT>; NULL when it does not parse."""
    return F.from_json(_col(s), "array<float>", {"mode": "PERMISSIVE"})


def width_is(v, dim: int) -> Column:
    return F.size(_col(v)) == F.lit(dim)


def require_width(v, dim: int) -> Column:
    """The vector itself, or a runtime error naming the expected width (A11 check)."""
    v = _col(v)
    return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(
        F.raise_error(F.concat(F.lit(f"Embedding size mismatch: expected {dim}, got "), F.size(v).cast("string")))
    )
