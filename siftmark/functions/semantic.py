"""The semantic digests ``pls1`` and ``pls1c``: SimHash of embeddings, plain or centred on a mean."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterable, Sequence
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.hashing import hyperplanes, sign_bits

PLAIN, CENTRED = "pls1", "pls1c"
#: Fixed value: the model that the default hasher names.
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
Embed = Callable[[str], Sequence[float]]
#: A number of bits (of at most nine digits), and whole bytes of hex digits.
COUNT, BYTES = re.compile("[0-9]{1,9}"), re.compile("(?:[0-9a-fA-F]{2})*")
#: Stand-ins for exponents of numbers that aren't finite, in the sums of ``reference_mean``.
NAN, UP, DOWN = 100_001, 100_002, 100_003


def clean_model_id(model_id: str | None) -> str:
    """Without white space, ``:`` as ``_``; ``unknown`` if there is none."""
    return "".join(model_id.split()).replace(":", "_") if model_id else "unknown"


def mean_id(mean: Sequence[float]) -> str:
    """Eight hex digits that identify a reference mean."""
    return blake2b(struct.pack(f"<{len(mean)}d", *mean), digest_size=4).hexdigest()


class SemanticHasher:
    """SimHash of ``n_bits`` hyperplanes; with ``mean``, vectors are centred on it first."""

    def __init__(self, embed_fn: Embed | None = None, n_bits: int = 256, seed: int = 1, mean: Sequence[float] | None = None, model_id: str = "default"):
        self.embed_fn, self.n_bits, self.seed = embed_fn, n_bits, seed
        self.mean = None if mean is None else [float(x) for x in mean]
        self.model_id = clean_model_id(model_id)
        self.ref_id = None if mean is None else mean_id(self.mean)
        self._dim: int | None = None

    @property
    def scheme(self) -> str:
        return PLAIN if self.mean is None else CENTRED

    @property
    def prefix(self) -> str:
        """What a digest says before its bits."""
        return ":".join([self.scheme, self.model_id, *([] if self.ref_id is None else [self.ref_id]), str(self.n_bits)])

    def _planes(self, dim: int) -> np.ndarray:
        if self._dim not in (None, dim):
            raise ValueError(f"vectors of {self._dim} and of {dim} dimensions")
        if self.mean is not None and len(self.mean) != dim:
            raise ValueError(f"a mean of {len(self.mean)} dimensions and a vector of {dim}")
        self._dim = dim
        return hyperplanes(self.seed, self.n_bits, dim)

    def signature_bits(self, vector: Sequence[float]) -> list[int]:
        """Sign bits of one vector."""
        planes = self._planes(len(vector))
        rows = np.array([vector], np.float64)
        return sign_bits(rows if self.mean is None else rows - np.array(self.mean), planes)[0].astype(int).tolist()

    def digest(self, text: str) -> str:
        """Digest of a text through ``embed_fn``, or through the default model."""
        from siftmark.functions.providers import default_embed

        bits = self.signature_bits((self.embed_fn or default_embed)(text))
        return f"{self.prefix}:{bits_to_hex(bits)}"

    def bits_of(self, vectors: Column, dim: int) -> Column:
        """Column of packed bits (binary, first bit highest) of vectors of ``dim`` numbers; null for null."""
        planes, mean = self._planes(dim), None if self.mean is None else np.array(self.mean)

        @F.pandas_udf("binary")
        def pack(rows: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(rows), dtype=object)
            known = np.flatnonzero(rows.notna().to_numpy())
            if len(known):
                values = rows.iloc[known]
                if any(len(v) != dim for v in values):
                    raise ValueError(f"a vector that hasn't {dim} dimensions")
                x = np.stack([np.asarray(v, np.float64) for v in values])
                packed = np.packbits(sign_bits(x if mean is None else x - mean, planes), axis=1)
                out.iloc[known] = [p.tobytes() for p in packed]
            return out

        return pack(vectors)

    def digest_of(self, vectors: Column, dim: int) -> Column:
        """Column of digests of vectors."""
        return F.concat(F.lit(self.prefix + ":"), F.lower(F.hex(self.bits_of(vectors, dim))))

    def embed_of(self, texts: Column) -> Column:
        """Column of embeddings through ``embed_fn``, which each worker gets once."""
        embed = self.embed_fn
        if embed is None:
            from siftmark.functions.providers import default_embed as embed

        return F.pandas_udf(_iterate(embed), "array<double>")(texts)


def _iterate(embed: Embed):
    """Embeds batches of texts, by the function's attribute ``many`` (texts to vectors) if it has one."""
    from collections.abc import Iterator

    many = getattr(embed, "many", None) or (lambda texts: [embed(t) for t in texts])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[float(x) for x in v] for v in many([t or "" for t in batch])], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def bits_to_hex(bits: Sequence[int]) -> str:
    """Bits packed from the highest, padded to whole bytes."""
    return np.packbits(np.array(bits, np.uint8)).tobytes().hex() if len(bits) else ""


def hex_to_bits(text: str, n_bits: int) -> list[int]:
    """The first ``n_bits`` bits of hex digits."""
    return np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8))[:n_bits].tolist()


def parse_semantic_digest(digest: str) -> tuple[str, str, str | None, int, list[int]]:
    """Scheme, model, id of the mean or None, number of bits, bits."""
    parts = digest.split(":")
    if not (parts[0] == PLAIN and len(parts) == 4 or parts[0] == CENTRED and len(parts) == 5):
        raise ValueError("not a semantic digest")
    if not COUNT.fullmatch(parts[-2]) or not BYTES.fullmatch(parts[-1]):
        raise ValueError("not a semantic digest: its number of bits or its hex digits are malformed")
    n = int(parts[-2])
    return parts[0], parts[1], parts[2] if parts[0] == CENTRED else None, n, hex_to_bits(parts[-1], n)


def semantic_similarity(a: str, b: str) -> float:
    """Share of equal bits; ValueError if scheme, model, mean or length differ."""
    x, y = parse_semantic_digest(a), parse_semantic_digest(b)
    for k, what in enumerate(("schemes", "models", "reference means", "lengths")):
        if x[k] != y[k]:
            raise ValueError(f"digests of different {what}: {x[k]} and {y[k]}")
    return sum(p == q for p, q in zip(x[4], y[4], strict=False)) / x[3] if x[3] else 0.0


def semantic_digest(text: str) -> str:
    """Digest by the default model, which is loaded on first use."""
    return SemanticHasher(model_id=DEFAULT_MODEL).digest(text)


def fit_reference_mean(embed_fn: Embed, texts: Iterable[str]) -> list[float]:
    """Mean of the embeddings of texts; ValueError for none, or for vectors of different lengths."""
    vectors = [embed_fn(t) for t in texts]
    if not vectors:
        raise ValueError("a reference mean needs texts")
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors of different dimensions")
    return [sum(column) / len(vectors) for column in zip(*vectors, strict=True)]


def reference_mean(vectors: DataFrame, column: str) -> list[float]:
    """Mean of a column of vectors, rounded once from the exact sum, however rows are partitioned.

    Each task adds the mantissas that share an exponent as whole numbers, Spark adds those, and the
    driver gets at most a row for each dimension and exponent. Null vectors are left out; numbers
    that aren't finite make the mean of their dimension infinite or NaN, as in a plain sum.
    """

    def run(batches):
        sums: dict[tuple[int, int], int] = {}
        lengths: dict[int, int] = {}
        for batch in batches:
            rows = [v for v in batch.column(0).to_pylist() if v is not None]
            for v in rows:
                lengths[len(v)] = lengths.get(len(v), 0) + 1
            if len(lengths) == 1 and rows:
                values = np.array(rows, np.float64)
                if not (finite := np.isfinite(values)).all():
                    for code, odd in ((NAN, np.isnan(values)), (UP, values == np.inf), (DOWN, values == -np.inf)):
                        for d in np.flatnonzero(odd.any(0)).tolist():
                            sums[d, code] = sums.get((d, code), 0) + int(odd[:, d].sum())
                    values = np.where(finite, values, 0.0)
                mantissa, exponent = np.frexp(values)
                whole = (mantissa * 2.0**53).astype(np.int64)
                for d in range(whole.shape[1]):
                    for e in np.unique(exponent[:, d]):
                        at = exponent[:, d] == e
                        sums[d, int(e)] = sums.get((d, int(e)), 0) + sum(whole[at, d].tolist())
        keys = [*sums]
        yield pa.record_batch(
            [pa.array([k[0] for k in keys] + [-1] * len(lengths), pa.int32()), pa.array([k[1] for k in keys] + [*lengths], pa.int32()), pa.array([str(sums[k]) for k in keys] + [str(n) for n in lengths.values()], pa.string())],
            names=["axis", "exponent", "total"],
        )

    parts = vectors.select(column).mapInArrow(run, "axis int, exponent int, total string")
    rows = parts.groupBy("axis", "exponent").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    lengths = {r.exponent: int(r.total) for r in rows if r.axis < 0}
    if not lengths:
        raise ValueError("a reference mean needs vectors")
    if len(lengths) > 1:
        raise ValueError("vectors of different dimensions")
    ((dim, n),) = lengths.items()
    exact, endless = [Fraction(0)] * dim, {}
    for r in rows:
        if (odd := {NAN: math.nan, UP: math.inf, DOWN: -math.inf}.get(r.exponent)) is not None and r.axis >= 0:
            endless[r.axis] = endless.get(r.axis, 0.0) + odd
        elif r.axis >= 0:
            exact[r.axis] += int(r.total) * Fraction(2) ** (r.exponent - 53)
    return [endless[d] if d in endless else _rounded(x) / n for d, x in enumerate(exact)]


def _rounded(x: Fraction) -> float:
    """The nearest double; infinite beyond the largest."""
    try:
        return float(x)
    except OverflowError:
        return math.copysign(math.inf, x)


def dimension(vectors: DataFrame, column: str) -> int:
    """The one dimension of a column of vectors; ValueError for several, or none."""
    found = [r.n for r in vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).distinct().limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"vectors of dimensions {sorted(found)}" if found else "no vectors")
    return found[0]


def parsed(digests: Column, strict: bool = True) -> Column:
    """Struct (scheme, model_id, ref_id, n_bits, hex); a malformed digest raises, or is null if not ``strict``."""
    p = F.split(digests, ":")
    scheme, n = F.element_at(p, 1), F.size(p)
    shaped = ((scheme == PLAIN) & (n == 4)) | ((scheme == CENTRED) & (n == 5))
    good = shaped & F.try_element_at(p, n - 1).rlike(f"^{COUNT.pattern}$") & F.element_at(p, n).rlike(f"^{BYTES.pattern}$")
    value = F.struct(
        scheme.alias("scheme"),
        F.try_element_at(p, F.lit(2)).alias("model_id"),
        F.when(scheme == CENTRED, F.try_element_at(p, F.lit(3))).alias("ref_id"),
        F.try_element_at(p, F.when(scheme == CENTRED, 4).otherwise(3)).try_cast("int").alias("n_bits"),
        F.try_element_at(p, F.when(scheme == CENTRED, 5).otherwise(4)).alias("hex"),
    )
    kind = "struct<scheme:string,model_id:string,ref_id:string,n_bits:int,hex:string>"
    error = F.raise_error(F.concat(F.lit("not a semantic digest: "), F.substring(digests, 1, 60))).cast(kind) if strict else F.lit(None).cast(kind)
    return F.when(digests.isNull(), F.lit(None).cast(kind)).when(good, value).otherwise(error)


def bits(hex_digits: Column, n_bits: Column) -> Column:
    """Array of the first ``n_bits`` bits of hex digits."""
    each = F.transform(F.split(hex_digits, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    spread = F.flatten(F.transform(F.filter(each, lambda v: v.isNotNull()), lambda v: F.transform(F.array(F.lit(3), F.lit(2), F.lit(1), F.lit(0)), lambda s: F.call_function("shiftright", v, s).bitwiseAND(1))))
    return F.slice(spread, F.lit(1), n_bits)


def words(packed: Column, n_bits: int) -> Column:
    """Packed bits as an array of 64-bit numbers, padded by zeros: cheap to compare by exclusive or."""
    padded = F.rpad(F.hex(packed), -(-n_bits // 64) * 16, "0")
    return F.array(*(F.conv(F.substring(padded, 16 * k + 1, 16), 16, -10).cast("long") for k in range(-(-n_bits // 64))))


def word_similarity(x: Column, y: Column, n_bits: int) -> Column:
    """Share of equal bits of two columns from ``words``."""
    if n_bits == 0:
        return F.lit(0.0)
    differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, -(-n_bits // 64))), F.bit_count(x[0].bitwiseXOR(y[0])))
    return (n_bits - differ) / F.lit(n_bits)


def digest_similarity(a: Column, b: Column, strict: bool = True) -> Column:
    """Similarity of two columns of semantic digests; not comparable ones raise, or are null if not ``strict``."""
    x, y = parsed(a, strict), parsed(b, strict)
    same = (x["scheme"] == y["scheme"]) & (x["model_id"] == y["model_id"]) & x["ref_id"].eqNullSafe(y["ref_id"]) & (x["n_bits"] == y["n_bits"])
    equal = F.aggregate(F.zip_with(bits(x["hex"], x["n_bits"]), bits(y["hex"], y["n_bits"]), lambda p, q: F.coalesce(p == q, F.lit(False)).cast("int")), F.lit(0), lambda s, v: s + v)
    error = F.raise_error(F.lit("digests of different schemes, models, reference means or lengths")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(~same, error).when(x["n_bits"] == 0, F.lit(0.0)).otherwise(equal / x["n_bits"])
