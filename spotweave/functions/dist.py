"""Tails of distributions as column expressions, evaluated in the JVM.

The incomplete gamma and beta functions come from the math library on Spark's
class path; everything else is built of Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GAMMA = "org.apache.commons.math3.special.Gamma"
_BETA = "org.apache.commons.math3.special.Beta"
#: Variances and moments up to this are none.
TINY = 1e-10


def _num(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _call(cls: str, method: str, *args: Column | float) -> Column:
    return F.try_reflect(F.lit(cls), F.lit(method), *(_num(a) for a in args)).cast("double")


#: Lanczos' approximation with g = 607/128: fixed values.
_LANCZOS_G = 607.0 / 128.0
_LANCZOS = (
    0.99999999999999709182, 57.156235665862923517, -59.597960355475491248, 14.136097974741747174, -0.49191381609762019978, 0.33994649984811888699e-4, 0.46523628927048575665e-4, -0.98374475304879564677e-4,
    0.15808870322491248884e-3, -0.21026444172410488319e-3, 0.21743961811521264320e-3, -0.16431810653676389022e-3, 0.84418223983852743293e-4, -0.26190838401581408670e-4, 0.36899182659531622704e-5,
)


def log_gamma(x: Column | float) -> Column:
    """ln of the gamma function for x > 0, in Spark's own arithmetic, so that it
    may stand inside aggregates."""
    x = _num(x)
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(_LANCZOS_G + 0.5)
    return (x + 0.5) * F.ln(t) - t + F.ln(F.lit(2.5066282746310002) * series / x)


def gamma_q(a: Column | float, x: Column | float) -> Column:
    """Upper regularised incomplete gamma function."""
    return F.when(_num(x) <= 0, F.lit(1.0)).otherwise(_call(_GAMMA, "regularizedGammaQ", a, F.greatest(_num(x), F.lit(1e-300))))


def chi2_sf(x: Column | float, df: Column | float) -> Column:
    return gamma_q(_num(df) / 2, _num(x) / 2)


def ncx2_sf(x: Column, df: Column, shift: Column) -> Column:
    """Non-central chi-squared tail: a Poisson mixture of central ones, over
    twelve standard deviations of the Poisson law beyond its mean."""

    def mixture(v: Column) -> Column:
        top = F.ceil(v.half + 12 * F.sqrt(v.half) + 30).cast("int")
        terms = F.transform(F.sequence(F.lit(0), top), lambda j: F.exp(-v.half + j * F.ln(v.half) - log_gamma(j + F.lit(1.0))) * gamma_q(v.df / 2 + j, v.x / 2))
        mixed = F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))
        return F.when(v.half <= 1e-9, chi2_sf(v.x, v.df)).otherwise(mixed)

    return _let(mixture, x=_num(x), df=_num(df), half=F.greatest(_num(shift), F.lit(0.0)) / 2)


def t_sf2(t: Column, df: Column) -> Column:
    """Two-sided Student tail."""
    return F.when(t.isNull() | (df <= 0), F.lit(None)).otherwise(_call(_BETA, "regularizedBeta", _num(df) / (_num(df) + t * t), _num(df) / 2, 0.5))


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each computed once: expressions that
    use a value many times would else hold as many copies of it."""
    bound = F.array(F.struct(*(v.cast("double").alias(k) for k, v in values.items())))
    return F.transform(bound, body)[0]


def liu_sf(q: Column, c1: Column, c2: Column, c3: Column, c4: Column, kurtosis: bool = False) -> Column:
    """Tail of a weighted sum of chi-squares with cumulants c_p = sum of the
    p-th powers of the weights, by the four-moment fit of Liu, Tang and Zhang.

    No variance: a step at the mean.
    """

    def moments(v: Column) -> Column:
        return _let(shape, q=v.q, c1=v.c1, c2=v.c2, s1=v.c3 / F.pow(v.c2, F.lit(1.5)), s2=v.c4 / (v.c2 * v.c2))

    def shape(v: Column) -> Column:
        root = v.s1 - F.sqrt(F.greatest(v.s1 * v.s1 - v.s2, F.lit(0.0)))
        a = F.when(v.s1 * v.s1 > v.s2, 1 / root).otherwise(1 / F.sqrt(v.s2) if kurtosis else 1 / v.s1)
        return _let(fit, z=(v.q - v.c1) / F.sqrt(2 * v.c2), s1=v.s1, s2=v.s2, a=a)

    def fit(v: Column) -> Column:
        shift = F.when(v.s1 * v.s1 > v.s2, F.greatest(v.s1 * F.pow(v.a, F.lit(3)) - v.a * v.a, F.lit(0.0))).otherwise(F.lit(0.0))
        return _let(place, z=v.z, a=v.a, shift=shift)

    def place(v: Column) -> Column:
        return _let(lambda w: ncx2_sf(w.z * F.sqrt(2 * (w.df + 2 * w.shift)) + w.df + w.shift, w.df, w.shift), z=v.z, shift=v.shift, df=v.a * v.a - 2 * v.shift)

    def whole(v: Column) -> Column:
        flat = F.when(v.q > v.c1 + TINY, F.lit(0.0)).otherwise(F.lit(1.0))
        return F.when(v.c2 <= TINY, flat).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moments(v))))

    return _let(whole, q=_num(q), c1=_num(c1), c2=_num(c2), c3=_num(c3), c4=_num(c4))


def welch_sf(q: Column, c1: Column, c2: Column) -> Column:
    """Tail by a scaled chi-square with the same mean c1 and variance 2 c2."""
    return F.when((c2 <= TINY / 2) | (c1 <= TINY), F.when(q > c1 + TINY, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(chi2_sf(q * c1 / c2, c1 * c1 / c2))


def hsic_pvalue(null: str, q: Column, k: dict[int, float] | dict[int, Column], f: dict[int, Column], n: Column | float) -> Column:
    """P-value of tr(Y'KY) from kernel and feature cumulants; 1 if either has no
    variance."""
    c = {p: _num(k[p]) * f[p] / F.pow(F.greatest(_num(n) - 1, F.lit(1.0)), F.lit(p)) for p in f}
    tail = liu_sf(q, c[1], c[2], c[3], c[4]) if null == "liu" else welch_sf(q, c[1], c[2])
    return F.when((_num(k[2]) <= 0) | (f[2] <= 0) | (c[2] <= TINY), F.lit(1.0)).otherwise(tail)


def fisher_combine(log_p_sum: Column, k: Column) -> Column:
    """Tail of -2 sum(ln p) over k tests."""
    return gamma_q(k, -log_p_sum)


def tippett_combine(least_p: Column, k: Column) -> Column:
    return 1 - F.pow(1 - least_p, k)


def null_method(name: str) -> str:
    """The canonical name of a null distribution; old names still work."""
    import warnings

    old = {"eig": "liu", "clt": "welch", "trace": "welch"}
    if name in old:
        warnings.warn(f"null method {name!r} is now called {old[name]!r}", DeprecationWarning, stacklevel=2)
        return old[name]
    if name not in ("liu", "welch", "perm", "none"):
        raise ValueError(f"null method must be liu, welch, perm or none, not {name!r}")
    return name
