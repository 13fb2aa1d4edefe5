"""Column expressions shared by the table jobs. All are native and codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcast import constants as K


def rate(total: Column, n: Column) -> Column:
    """Per-game rate; null when there are no games."""
    return F.try_divide(total.cast("double"), n)


def shrink(current: Column, n: Column, prior: Column, k: float = K.TEAM_PSEUDOGAMES) -> Column:
    """Blend a rate toward a prior with pseudo-count ``k``; a missing side gives way to the other.

    Kept to two mentions of each input: these expressions nest, and a plan repeats
    an input once per mention.
    """
    w = n.cast("double") / (n + F.lit(k))
    return F.coalesce(w * current + (F.lit(1.0) - w) * prior, current, prior)


def shrink_weight(current: Column, n: Column, prior: Column, k: float = K.TEAM_PSEUDOGAMES) -> Column:
    """Weight that :func:`shrink` puts on the current value (0 without one, 1 without a prior)."""
    return (
        F.when(current.isNull(), F.lit(0.0))
        .when(prior.isNull(), F.lit(1.0))
        .otherwise(n.cast("double") / (n + F.lit(k)))
    )


def blended_rate(cur_total: Column, cur_n: Column, prior_total: Column, prior_n: Column, k: float = K.TEAM_PSEUDOGAMES) -> Column:
    return shrink(rate(cur_total, cur_n), cur_n, rate(prior_total, prior_n), k)


def usable(value: Column) -> Column:
    """The value when strictly positive and finite, else null. (NaN sorts above infinity.)"""
    return F.when((value > 0) & (value < F.lit(float("inf"))), value)


def pythagorean(pf: Column, pa: Column, exponent: float | Column = K.PYTHAGOREAN_EXPONENT) -> Column:
    """``pf^x / (pf^x + pa^x)`` in the overflow-safe form; null for unusable input."""
    x = usable(exponent) if isinstance(exponent, Column) else F.lit(float(exponent))
    return F.lit(1.0) / (F.lit(1.0) + F.pow(usable(pa) / usable(pf), x))


def log5(a: Column, b: Column) -> Column:
    """Chance that a side of strength ``a`` beats one of strength ``b``; even when undetermined."""
    den = a + b - F.lit(2.0) * a * b
    return F.when(den <= 0, F.lit(0.5)).otherwise((a - a * b) / den)


def clamp(p: Column, eps: float = K.PROBABILITY_FLOOR) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))


def logit(p: Column) -> Column:
    return -F.log(F.lit(1.0) / clamp(p) - F.lit(1.0))


def sigmoid(z: Column) -> Column:
    """Logistic curve; ``exp`` overflowing to infinity gives the limit 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_home_field(p: Column, neutral: Column, bump: float = K.HOME_FIELD_LOGIT) -> Column:
    """Add the home bump in log-odds space; a neutral (not an unknown) site keeps ``p``."""
    return F.when(F.coalesce(neutral, F.lit(False)), p).otherwise(sigmoid(logit(p) + F.lit(bump)))


def home_field_only(neutral: Column, bump: float = K.HOME_FIELD_LOGIT) -> Column:
    return F.when(F.coalesce(neutral, F.lit(False)), F.lit(0.5)).otherwise(sigmoid(F.lit(bump)))


def forecast_uncertainty(home_games: Column, away_games: Column) -> Column:
    fewest = F.least(home_games, away_games).cast("double")
    return F.least(F.lit(1.0) / F.sqrt(fewest + 1), F.lit(1.0))


def home_payout(p_home: Column, p_tie: Column) -> Column:
    """Expected payout of the home contract, a tie settling at one half."""
    return p_home + p_tie * F.lit(K.TIE_PAYOUT)


def away_payout(p_home: Column, p_tie: Column) -> Column:
    return (F.lit(1.0) - p_home - p_tie) + p_tie * F.lit(K.TIE_PAYOUT)


def platt(p: Column, a: float | Column, b: float | Column) -> Column:
    a = a if isinstance(a, Column) else F.lit(float(a))
    b = b if isinstance(b, Column) else F.lit(float(b))
    return sigmoid(a + b * logit(p))


def kelly_fraction(p_win: Column, odds: Column, cap: float = 0.05) -> Column:
    """Capped Kelly stake share; zero when the odds pay nothing."""
    b = odds - F.lit(1.0)
    raw = F.when(b > 0, (b * p_win - (F.lit(1.0) - p_win)) / b).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), raw))


def position_size(bankroll: Column, fraction: Column) -> Column:
    return F.greatest(F.lit(0.0), bankroll * F.greatest(F.lit(0.0), fraction))


def squared_error(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2.0))


def log_loss(p: Column, y: Column) -> Column:
    q = clamp(p, K.LOG_LOSS_FLOOR)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def reliability_bin(p: Column, bins: int = 10) -> Column:
    """Half-open bin number; the last bin is closed.

    The floor is corrected against the floating-point bin edges ``i * (1/bins)``,
    so a value sitting exactly on an edge lands where a direct comparison puts it.
    """
    width = F.lit(1.0 / bins)
    guess = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return (
        F.when(p < guess * width, guess - 1)
        .when((guess < bins - 1) & (p >= (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )


def days_since_epoch(ts: Column) -> Column:
    return F.datediff(ts, F.lit("1970-01-01").cast("date"))


def hours_before(ts: Column, hours: int) -> Column:
    return ts - F.expr(f"INTERVAL '{hours}' HOUR")


def hours_after(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"INTERVAL '{hours}' HOUR")
