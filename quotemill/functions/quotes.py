"""Quote scalars, fair value and measurement variance as pure column expressions.

All of them stay in the JVM. ANSI mode raises on division by zero, so ratios use
``try_divide`` and are null where they have no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0


def tiers(value: Column, steps: list[tuple[float, float]], beyond: float, strict: bool = False) -> Column:
    """The factor of the first step that ``value`` does not exceed (or is below, if strict)."""
    out = None
    for most, factor in steps:
        hit = value < most if strict else value <= most
        out = F.when(hit, F.lit(factor)) if out is None else out.when(hit, F.lit(factor))
    return out.otherwise(F.lit(beyond))


def rounded(value: Column, places: int) -> Column:
    """``value`` rounded as the SQL rounds: the product with the power of ten, halves away from zero, and back.

    ``F.round`` goes by the decimal digits, so what lies a last bit below a half goes down there and up here.
    """
    return F.round(value * 10.0**places) / 10.0**places


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def positive_mid(bid: Column, ask: Column) -> Column:
    """Mid of a quote whose two sides are both above zero, else null."""
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2.0)


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.try_divide(ask - bid, mid(bid, ask)) * BPS


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    return F.try_divide(ask * bid_size + bid * ask_size, bid_size + ask_size)


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    return F.try_divide(bid_size - ask_size, bid_size + ask_size)


def to_bps(ratio: Column) -> Column:
    return ratio * BPS


def finite(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def copysign(size: Column, sign: Column) -> Column:
    return F.abs(size) * F.when(sign < 0, -1.0).otherwise(1.0)


def fresh(age_ms: Column, most_ms: float) -> Column:
    return F.coalesce(age_ms <= most_ms, F.lit(False))


def is_perp(exchange: Column) -> Column:
    return exchange.endswith("_perp")


def micro_alpha(mid_: Column, micro: Column, spread: Column, imb: Column, age_ms: Column, depth: Column) -> Column:
    """How far the fair value leans from the mid to the microprice, 0 to 1."""
    missing = mid_.isNull() | micro.isNull() | imb.isNull() | spread.isNull() | (spread <= 0)
    by_spread = tiers(spread, [(1, 1.0), (2, 0.6), (5, 0.25)], 0.0)
    by_age = tiers(F.coalesce(age_ms, F.lit(0)), [(100, 1.0), (250, 0.7), (500, 0.4)], 0.0)
    depth = F.coalesce(depth, F.lit(0.0))
    by_depth = F.when(depth <= 0, 0.5).otherwise(tiers(depth, [(1, 0.6), (5, 0.8)], 1.0, strict=True))
    return F.when(missing, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(imb) * by_spread * by_age * by_depth)))


def raw_fair_value(mid_: Column, micro: Column, alpha: Column) -> Column:
    return F.when(mid_.isNull(), micro).when(micro.isNull(), mid_).otherwise(mid_ + alpha * (micro - mid_))


def measurement_variance(mid_: Column, spread: Column, mid_vol: Column, micro_vol: Column, depth: Column, age_ms: Column, min_noise_bps: float = 1.5, reference_notional: float = 250_000.0, floor: float = 1e-10) -> Column:
    """Variance of a venue's quote from its spread, volatility, depth and age; null without a positive mid."""
    zero = F.lit(0.0)
    s = F.coalesce(spread, zero) / BPS
    v = F.greatest(F.coalesce(mid_vol, zero), F.coalesce(micro_vol, zero)) / BPS
    noise = F.greatest(s * s + v * v, F.lit((min_noise_bps / BPS) ** 2))
    notional = F.coalesce(depth, zero) * mid_
    thin = F.when(notional <= 0, BPS).when(notional >= reference_notional, 1.0).otherwise(F.pow(F.try_divide(F.lit(reference_notional), notional), F.lit(2.0)))
    stale = tiers(F.coalesce(age_ms, F.lit(0)), [(100, 1.0), (250, 1.2), (500, 1.5)], 2.0)
    return F.when(mid_ > 0, F.greatest(noise * thin * stale * mid_ * mid_, F.lit(floor)))


def amm_price(sqrt_price_x96: Column, decimals_shift: float = 1e12, inverse: bool = False) -> Column:
    """Price of a concentrated-liquidity pool from its Q64.96 square root."""
    root = sqrt_price_x96 / F.lit(2.0**96)
    price = root * root * decimals_shift
    return F.try_divide(F.lit(decimals_shift**2), price) if inverse else price


def amm_amounts(liquidity: Column, root: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Token amounts of a position with the square roots of its bounds, at a square-root price."""
    at = F.least(F.greatest(root, low), high)
    return liquidity * (F.try_divide(F.lit(1.0), at) - F.try_divide(F.lit(1.0), high)), liquidity * (at - low)


def amm_liquidity(value: Column, root: Column, low: Column, high: Column) -> Column:
    """Liquidity that ``value`` (in the second token) buys at a square-root price inside the bounds."""
    zero, one = amm_amounts(F.lit(1.0), root, low, high)
    return F.try_divide(value, zero * root * root + one)
