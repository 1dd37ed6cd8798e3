"""Column functions with the numeric edge cases of C arithmetic spelled out.

ANSI mode raises on division by zero, and ``ln`` gives null outside its domain; the functions here
give the IEEE results instead, inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 1e-15


def _nan() -> Column:
    return F.lit("NaN").cast("double")


def _inf(sign: int = 1) -> Column:
    return F.lit("Infinity" if sign > 0 else "-Infinity").cast("double")


def divide(a: Column, b: Column) -> Column:
    """a / b where x/0 is an infinity with the sign of x and 0/0 is NaN."""
    at_zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), _nan()).when(a > 0, _inf()).otherwise(_inf(-1))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def divide_check_zero(a: Column, b: Column) -> Column:
    """a / b, but 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def log(a: Column) -> Column:
    """Natural logarithm: -infinity at 0, NaN below."""
    return F.when(a == 0, _inf(-1)).when(a < 0, _nan()).otherwise(F.ln(a))


def weighted_sqrt(a: Column, scale: float = 1.0, negative_to_zero: bool = False) -> Column:
    """sqrt(scale * a); negative a becomes 0 on request, else NaN."""
    x = F.sqrt(F.lit(float(scale)) * a)
    return F.when(a < 0, F.lit(0.0)).otherwise(x) if negative_to_zero else x


def weighted_power(a: Column, scale: float = 1.0) -> Column:
    """scale * a * a."""
    return F.lit(float(scale)) * a * a


def reciprocal(a: Column, scale: float = 1.0, set_zero: bool = False, threshold: float = SMALL) -> Column:
    """scale / a; with ``set_zero`` 0 where |a| is at most the threshold."""
    x = divide(F.lit(float(scale)), a)
    return F.when(F.abs(a) <= threshold, F.lit(0.0)).otherwise(x) if set_zero else x


def zero_small(a: Column, threshold: float = SMALL) -> Column:
    return F.when(F.abs(a) <= threshold, F.lit(0.0)).otherwise(a)


def sgn(a: Column) -> Column:
    """-1, 0 or 1 as an integer."""
    return F.signum(a).cast("int")


#: Stateless one-argument functors.
UNARY: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "abs": F.abs,
    "sq": lambda x: x * x,
    "sqrt": F.sqrt,
    "nz": lambda x: F.when(x != 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    "negate": lambda x: -x,
    "exp": F.exp,
    "log": log,
    "sin": F.sin,
    "cos": F.cos,
    "tanh": F.tanh,
    "asin": F.asin,
    "acos": F.acos,
    "atanh": F.atanh,
    "sgn": sgn,
}

#: Two-argument functors.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": divide,
    "div_checkzero": divide_check_zero,
    "pow": F.pow,
    "mod": lambda a, b: a % b,
    "min": F.least,
    "max": F.greatest,
    "greater": lambda a, b: a > b,
    "less": lambda a, b: a < b,
    "greater_or_equal": lambda a, b: a >= b,
    "less_or_equal": lambda a, b: a <= b,
    "equal": lambda a, b: a == b,
    "notequal": lambda a, b: a != b,
}


def const_op(name: str, value: float) -> Callable[[Column], Column]:
    """A two-argument functor with its second argument fixed."""
    return lambda x: BINARY[name](x, F.lit(value))


def compose(*outer_first: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """compose(f, g)(x) = f(g(x))."""

    def run(x: Column) -> Column:
        for f in reversed(outer_first):
            x = f(x)
        return x

    return run


def map_args(f: Callable[..., Column], *maps: Callable[[Column], Column]) -> Callable[..., Column]:
    """f with each argument mapped first."""
    return lambda *args: f(*(m(a) for m, a in zip(maps, args, strict=True)))
