"""Column expressions for money and returns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(c: Column) -> Column:
    """Number from text, null when it is not a finite one."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def annualise(cum_pct: Column, years: float) -> Column:
    """Cumulative percent over ``years`` -> yearly fraction; null for text and for -100 or less."""
    v = number(cum_pct)
    return F.when(v > -100, F.pow(1 + v / 100, F.lit(1.0 / years)) - 1)


def js_round(c: Column) -> Column:
    """Round half up towards plus infinity."""
    return F.floor(c + 0.5)


def savings_value(start: Column, monthly: Column, years: Column, gross: Column, fee: Column) -> Column:
    """Lump sum plus deposits at the start of every month at the net yearly rate."""
    n = js_round(years * 12)
    m = F.pow(F.greatest(F.lit(1e-9), 1 + gross - fee), F.lit(1 / 12)) - 1
    g = F.pow(1 + m, n)
    deposits = F.when(F.abs(m) < 1e-12, monthly * n).otherwise(monthly * (1 + m) * (g - 1) / F.when(F.abs(m) >= 1e-12, m))
    return start * g + deposits


def gross_return(model_return: Column, cost: Column) -> Column:
    """Model return plus cost, to the nearest half percent."""
    return js_round((model_return + cost) * 200) / 200
