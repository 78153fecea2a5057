"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the age-gap buckets and their upper bounds in years.
AGE_GAPS = (("0-1 год", 1), ("2-5 лет", 5), ("6-10 лет", 10))
AGE_GAP_REST = ">10 лет"

# Labels for a clear and for an unclear difference of two means.
CLEAR, UNCLEAR = "высокая", "средняя"


def age_gap_rank(gap: Column) -> Column:
    """1 to 4 for a difference of ages."""
    rank = F.when(gap <= AGE_GAPS[0][1], 1)
    for i, (_, upper) in enumerate(AGE_GAPS[1:], start=2):
        rank = rank.when(gap <= upper, i)
    return rank.otherwise(len(AGE_GAPS) + 1)


def age_gap_label(rank: Column) -> Column:
    labels = [label for label, _ in AGE_GAPS] + [AGE_GAP_REST]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), rank)


def rounded(value: Column | str, digits: int) -> Column:
    """Round half up. Summation noise far below the last digit is taken out first."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(F.round(value, 9), digits)


def format_users(users: Column) -> Column:
    """A user count as '1.0M', '5k' or plain digits, 'N/A' when missing."""
    return (
        F.when(users.isNull(), "N/A")
        .when(users >= 1_000_000, F.format_string("%.1fM", users / 1_000_000))
        .when(users >= 1000, F.format_string("%.0fk", users / 1000))
        .otherwise(users.cast("string"))
    )


#: Steps of the continued fraction, whatever the degrees of freedom, and the least divisor in it.
STEPS, TINY = 300, 1e-300


def two_sided_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic: the incomplete beta function at x = n / (n + t^2).

    I_x(n/2, 1/2) is a continued fraction, taken by Lentz's method for a fixed number of
    steps, of x where that converges fast and of 1 - x, the complement, elsewhere; so
    small values keep their digits.
    """
    n, square = freedom.cast("double"), t * t
    x, rest = n / (n + square), square / (n + square)
    a, half = n / 2, F.lit(0.5)
    front = F.exp(a * F.log(x) + 0.5 * F.log(rest) - _log_beta_half(a))
    direct = x < (a + 1) / (a + 2.5)
    small = front * _beta_fraction(a, half, x) / a
    large = 1 - front * _beta_fraction(half, a, rest) / 0.5
    return F.when(square == 0, 1.0).when(x == 0, 0.0).otherwise(F.when(direct, small).otherwise(F.greatest(F.lit(0.0), large)))


def _log_beta_half(a: Column) -> Column:
    """log B(a, 1/2)."""
    return _log_gamma(a) + 0.5723649429247001 - _log_gamma(a + 0.5)  # half the logarithm of pi


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the product of the eight factors."""
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)  # half the logarithm of 2 pi


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def away(value: Column) -> Column:
        return F.when(F.abs(value) < TINY, TINY).otherwise(value)

    def turn(c: Column, d: Column, h: Column, part: Column) -> tuple[Column, Column, Column]:
        d, c = 1 / away(1 + part * d), away(1 + part / c)
        return c, d, h * c * d

    def step(state: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        c, d, h = turn(state["c"], state["d"], state["h"], even)
        half_way = F.array(_named(c, d, h))
        whole = F.transform(half_way, lambda s: _named(*turn(s["c"], s["d"], s["h"], odd)))
        return F.element_at(whole, 1)

    first = 1 / away(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _named(F.lit(1.0), first, first), step)["h"]


def _named(c: Column, d: Column, h: Column) -> Column:
    return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
