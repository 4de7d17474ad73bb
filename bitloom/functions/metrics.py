"""Distance metrics between two packed hashes, as columns.

Every metric is a function of the contingency counts n11, n10, n01, n00, of masked counts or
of weighted counts; Catalyst shares the exclusive-or and the counts of one select. All
metrics named in NORMALISED lie in [0, 1]; the others are what their names say.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession, functions as F

from bitloom.functions import bits as B

Words = Sequence[Column]


@dataclass(frozen=True)
class Counts:
    """Contingency counts of two hashes; with weights, sums of weights. Only those that a metric asks for enter its plan."""

    u: Words
    v: Words
    n: Column
    count: Callable[[Words], Column]

    @property
    def n11(self) -> Column:
        return self.count([a.bitwiseAND(b) for a, b in zip(self.u, self.v)])

    @property
    def n10(self) -> Column:
        return self.count([a.bitwiseAND(F.bitwise_not(b)) for a, b in zip(self.u, self.v)])

    @property
    def n01(self) -> Column:
        return self.count([b.bitwiseAND(F.bitwise_not(a)) for a, b in zip(self.u, self.v)])

    @property
    def r(self) -> Column:
        return self.count([a.bitwiseXOR(b) for a, b in zip(self.u, self.v)])

    @property
    def su(self) -> Column:
        return self.count(self.u)

    @property
    def sv(self) -> Column:
        return self.count(self.v)

    @property
    def n00(self) -> Column:
        return self.n - self.n11 - self.r


def counts(u: Words, v: Words, n_bits: int, w: Sequence[float] | None = None) -> Counts:
    if w is None:
        return Counts(u, v, F.lit(float(n_bits)), lambda x: B.count(x).cast("double"))
    return Counts(u, v, F.lit(float(sum(w))), lambda x: B.weighted(x, w).cast("double"))


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def _cosine(n11: Column, su: Column, sv: Column) -> Column:
    """1 - n11 / sqrt(su sv); null for an all-zero hash, which has no direction."""
    return _ratio(F.lit(0.0) + F.sqrt(su * sv) - n11, F.sqrt(su * sv), None)


def _from_counts(f: Callable[[Counts], Column]) -> Callable:
    return lambda u, v, n, w=None: f(counts(u, v, n, w))


def _correlation(c: Counts) -> Column:
    den = F.sqrt(c.su * (c.n - c.su) * c.sv * (c.n - c.sv))
    return _ratio(den - (c.n * c.n11 - c.su * c.sv), den, None)


def _jensenshannon(c: Counts) -> Column:
    """Natural logarithm; bits of each hash spread evenly over its set bits."""
    p, q = 1 / c.su, 1 / c.sv
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    left = c.n11 * (part(p) + part(q) - 2 * part((p + q) / 2)) + c.n10 * (part(p) - 2 * part(p / 2)) + c.n01 * (part(q) - 2 * part(q / 2))
    return F.when((c.su == 0) | (c.sv == 0), F.lit(None).cast("double")).otherwise(F.sqrt(F.greatest(left / 2, F.lit(0.0))))


def _minkowski(u: Words, v: Words, n: int, w=None, p: float = 2.0) -> Column:
    return F.pow(counts(u, v, n, w).r, F.lit(1.0 / p))


def _seuclidean(u: Words, v: Words, n: int, w=None, V: Sequence[float] = ()) -> Column:
    if len(V) != n:
        raise ValueError("seuclidean needs V, the variance of each bit")
    return F.sqrt(B.weighted([a.bitwiseXOR(b) for a, b in zip(u, v)], [1.0 / x for x in V]))


def _mahalanobis(u: Words, v: Words, n: int, w=None, VI: Sequence[Sequence[float]] = ()) -> Column:
    """sqrt(d' VI d), d = u - v; a quadratic form has no counts, so this one runs over bit pairs."""
    if len(VI) != n:
        raise ValueError("mahalanobis needs VI, an n x n matrix")
    bit = lambda ws, i: F.shiftrightunsigned(ws[i // 64], i % 64).bitwiseAND(F.lit(1).cast("long"))
    d = F.array(*(bit(u, i) - bit(v, i) for i in range(n)))
    flat = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in VI))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.get(F.transform(F.array(d), lambda x: dot(F.transform(flat, lambda row: dot(row, x)), x)), F.lit(0)))


def ngram_cosine(u: Words, v: Words, n: int, w=None, ngram_size: int = 2, rounding: int = 4) -> Column:
    """Cosine distance of all ngram_size x ngram_size windows: a cosine weighted by how many windows hold each cell."""
    c = counts(u, v, n, B.window_coverage(n, ngram_size))
    return F.bround(_cosine(c.n11, c.su, c.sv), rounding)


def convolution(u: Words, v: Words, n: int, w=None, filter: Sequence[Sequence[float]] | None = None, mode: str = "sum_diffs", max_value: float | None = None, rounding: int = 4, compat: bool = False) -> Column:  # noqa: A002
    """Zero-padded convolution of the differing bits, over its largest value: a Hamming distance weighted by filter mass.

    With weights the sum is divided by that of mass times weight; compat divides weights by
    their sum and keeps the largest value of no weights.
    """
    if mode not in ("sum_diffs", "sum_similar"):
        raise ValueError(f"unknown mode {mode}")
    mass = B.filter_mass(n, filter or [[1.0] * 3] * 3)
    scale = [1.0] * n if w is None else [x / sum(w) for x in w] if compat else [float(x) for x in w]
    both = [m * s for m, s in zip(mass, scale)]
    top = float(max_value if max_value is not None else sum(mass) if compat or w is None else sum(both))
    diff = B.weighted([a.bitwiseXOR(b) for a, b in zip(u, v)], both)
    return F.bround((diff if mode == "sum_diffs" else F.lit(sum(both)) - diff) / top, rounding)


def max_convolution_value(n: int, filter: Sequence[Sequence[float]]) -> float:  # noqa: A002
    return sum(B.filter_mass(n, filter))


def _line(u: Words, v: Words, n: int, lines: Sequence[int], kind: str, w) -> Column:
    """Distance on the cells of some lines."""
    weights = [0.0] * n
    for i in lines:
        weights[i] = 1.0 if w is None else float(w[i])
    c = counts(u, v, n, weights)
    return c.r / float(sum(weights)) if kind == "hamming" else _cosine(c.n11, c.su, c.sv)


def _hatched(u: Words, v: Words, n: int, w, distance: str, whole: bool) -> Column:
    if distance not in ("hamming", "cosine"):
        raise ValueError(f"unknown distance {distance}")

    def part(lines: list[list[int]]) -> Column:
        if whole:
            return _line(u, v, n, [i for line in lines for i in line], distance, w)
        total = _line(u, v, n, lines[0], distance, w)
        for line in lines[1:]:
            total = total + _line(u, v, n, line, distance, w)
        return total / len(lines)

    m = {k: part(x) for k, x in B.line_masks(n).items()}
    return (F.least(m["er"], m["or"]) + F.least(m["ec"], m["oc"])) / 2


def hatched_matrix(u: Words, v: Words, n: int, w=None, distance: str = "cosine", rounding: int = 4) -> Column:
    """Means of the distances of even and odd rows, columns alike; the smaller of each, then their mean."""
    return F.bround(_hatched(u, v, n, w, distance, whole=False), rounding)


def hatched_matrix2(u: Words, v: Words, n: int, w=None, distance: str = "cosine", rounding: int = 4) -> Column:
    """As hatched_matrix, with all even (odd) rows (columns) joined to one vector first."""
    return F.bround(_hatched(u, v, n, w, distance, whole=True), rounding)


def hatched_matrix_fast(u: Words, v: Words, n: int, w=None, distance: str = "hamming") -> Column:
    return _hatched(u, v, n, w, distance, whole=True)


def synthetic(u: Words, v: Words, n: int, w=None, intra: bool = False, seed: int = 42) -> Column:
    """Ignores the hashes: 0.1 x Pareto(10) within files, normal(0.5, 0.05) between them."""
    return F.lit(0.1) * (F.pow(1 - F.rand(seed), F.lit(-0.1)) - 1) if intra else F.lit(0.5) + F.lit(0.05) * F.randn(seed)


BUILT_IN: dict[str, Callable] = {
    "hamming": _from_counts(lambda c: c.r / c.n),
    "cosine": _from_counts(lambda c: _cosine(c.n11, c.su, c.sv)),
    "jaccard": _from_counts(lambda c: _ratio(c.r, c.n11 + c.r)),
    "dice": _from_counts(lambda c: _ratio(c.r, 2 * c.n11 + c.r)),
    "braycurtis": _from_counts(lambda c: _ratio(c.r, 2 * c.n11 + c.r)),
    "rogerstanimoto": _from_counts(lambda c: 2 * c.r / (c.n11 + c.n00 + 2 * c.r)),
    "sokalmichener": _from_counts(lambda c: 2 * c.r / (c.n11 + c.n00 + 2 * c.r)),
    "russellrao": _from_counts(lambda c: (c.n - c.n11) / c.n),
    "sokalsneath": _from_counts(lambda c: _ratio(2 * c.r, c.n11 + 2 * c.r)),
    "yule": _from_counts(lambda c: F.when(c.n10 * c.n01 == 0, F.lit(0.0)).otherwise(2 * c.n10 * c.n01 / (c.n11 * c.n00 + c.n10 * c.n01))),
    "kulczynski1": _from_counts(lambda c: _ratio(c.n11, c.r, None)),
    "cityblock": _from_counts(lambda c: c.r),
    "sqeuclidean": _from_counts(lambda c: c.r),
    "canberra": _from_counts(lambda c: c.r),
    "euclidean": _from_counts(lambda c: F.sqrt(c.r)),
    "minkowski": _minkowski,
    "chebyshev": _from_counts(lambda c: (c.r > 0).cast("double")),
    "correlation": _from_counts(_correlation),
    "jensenshannon": _from_counts(_jensenshannon),
    "seuclidean": _seuclidean,
    "mahalanobis": _mahalanobis,
}
CUSTOM: dict[str, Callable] = {
    "test_synthetic": synthetic,
    "ngram_cosine_distance": ngram_cosine,
    "convolution_distance": convolution,
    "hatched_matrix": hatched_matrix,
    "hatched_matrix2": hatched_matrix2,
    "hatched_matrix_fast": hatched_matrix_fast,
}
NORMALISED = ("hamming", "cosine", "jaccard", "dice", "braycurtis", "rogerstanimoto", "sokalmichener", "russellrao", "sokalsneath", "jensenshannon", "ngram_cosine_distance", "convolution_distance", "hatched_matrix", "hatched_matrix2", "hatched_matrix_fast")


@dataclass(frozen=True)
class Metric:
    """A named distance with its parameters."""

    name: str
    function: Callable
    parameters: dict = field(default_factory=dict)

    def distance(self, u: Words, v: Words, n_bits: int, weights: Sequence[float] | None = None) -> Column:
        return self.function(u, v, n_bits, weights, **self.parameters)


def register_metric(name: str, function: Callable) -> None:
    """Add a function (u words, v words, bits, weights=None, **parameters) -> Column."""
    CUSTOM[name] = function


def list_metrics() -> list[str]:
    return sorted({*BUILT_IN, *CUSTOM})


def make_metrics(spec: dict[str, str | Callable | tuple]) -> list[Metric]:
    """Metrics from {label: name | function | (name or function, parameters)}.

    The specification must not be empty, names and functions must be registered, and every
    metric must give a double between two all-ones hashes of 64 bits; the error names all
    that fail.
    """
    if not spec:
        raise ValueError("no metrics")
    known, out, bad = {**BUILT_IN, **CUSTOM}, [], []
    ones = [F.lit(-1).cast("long")]
    session = SparkSession.getActiveSession()
    for label, value in spec.items():
        parts = value if isinstance(value, tuple) else (value, {})
        f, kwargs = (parts[0], parts[1] if len(parts) > 1 else {}) if 1 <= len(parts) <= 2 else (None, {})
        f = known.get(f) if isinstance(f, str) else f if f in known.values() else None
        if f is None or not isinstance(kwargs, dict):
            bad.append(label)
            continue
        m = Metric(label, f, dict(kwargs))
        try:
            column = m.distance(ones, ones, 64)
            if session is not None and session.range(1).select(column.alias("d")).schema["d"].dataType.simpleString() != "double":
                bad.append(label)
                continue
        except (TypeError, ValueError):
            bad.append(label)
            continue
        out.append(m)
    if bad:
        raise ValueError(f"invalid metrics: {', '.join(map(str, bad))}")
    return out
