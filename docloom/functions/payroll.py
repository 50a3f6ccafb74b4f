"""Payroll expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import round_half_up

#: Rates and limits of the standard of 2026-07-01.
PENSION, PENSION_LOW, PENSION_HIGH = 0.0475, 410_000.0, 6_590_000.0
HEALTH, CARE, EMPLOYMENT = 0.03595, 0.1314, 0.009
BRACKETS = ((14e6, 0.06), (50e6, 0.15), (88e6, 0.24), (150e6, 0.35), (300e6, 0.38), (500e6, 0.40), (1e9, 0.42), (float("inf"), 0.45))


def down_to_ten(c: Column) -> Column:
    return (F.floor(c / 10.0) * 10).cast("double")


def pension_base(monthly: Column) -> Column:
    return F.least(F.lit(PENSION_HIGH), F.greatest(F.lit(PENSION_LOW), monthly))


def progressive_tax(base: Column) -> Column:
    """Tax by brackets, added from the lowest on."""
    tax, below = F.lit(0.0), 0.0
    for limit, rate in BRACKETS:
        part = base - below if limit == float("inf") else F.least(base, F.lit(limit)) - below
        tax = tax + F.greatest(F.lit(0.0), part) * rate
        below = limit
    return tax


def _stepwise(x: Column, steps: list[tuple[float | None, float, float, float]]) -> Column:
    """(limit, constant, from, rate): up to the limit constant + (x - from) * rate."""
    out = None
    for limit, constant, start, rate in steps:
        value = F.lit(constant) + (x - start) * rate
        if out is None:
            out = F.when(x <= limit, value)
        else:
            out = out.otherwise(value) if limit is None else out.when(x <= limit, value)
    return out


def monthly_income_tax(monthly: Column, dependents: Column, children: Column) -> Column:
    """The estimated tax; dependents are not raised to one here."""
    gross = monthly * 12.0
    earned = F.least(F.lit(20e6), _stepwise(gross, [(5e6, 0.0, 0.0, 0.7), (15e6, 3.5e6, 5e6, 0.4), (45e6, 7.5e6, 15e6, 0.15), (100e6, 12e6, 45e6, 0.05), (None, 14.75e6, 100e6, 0.02)]))
    special = F.when(dependents == 1, F.lit(3.1e6) + gross * 0.04).when(dependents == 2, F.lit(3.6e6) + gross * 0.04).otherwise(F.lit(5e6) + gross * 0.07)
    base = F.greatest(F.lit(0.0), gross - earned - dependents * 1.5e6 - pension_base(monthly) * PENSION * 12.0 - special)
    tax = progressive_tax(base)
    credit = F.when(tax <= 1.3e6, tax * 0.55).otherwise(F.lit(715e3) + (tax - 1.3e6) * 0.3)
    cap = F.when(gross <= 33e6, F.lit(740e3)).when(gross <= 70e6, F.greatest(F.lit(660e3), F.lit(740e3) - (gross - 33e6) * 0.008)).otherwise(F.greatest(F.lit(500e3), F.lit(660e3) - (gross - 70e6) * 0.005))
    child = F.when(children <= 0, F.lit(0.0)).when(children == 1, F.lit(250e3)).when(children == 2, F.lit(550e3)).otherwise(F.lit(550e3) + (children - 2) * 400e3)
    return F.greatest(F.lit(0.0), tax - F.least(credit, cap) - child) / 12.0


def net_pay(monthly: Column, dependents: Column, children: Column) -> dict[str, Column]:
    """Every deduction, their sum, and what is left."""
    out = {"pension": down_to_ten(pension_base(monthly) * PENSION), "health": down_to_ten(monthly * HEALTH)}
    out["long_term_care"] = down_to_ten(out["health"] * CARE)
    out["employment"] = down_to_ten(monthly * EMPLOYMENT)
    out["income_tax"] = down_to_ten(monthly_income_tax(monthly, F.greatest(F.lit(1), dependents), children))
    out["local_tax"] = down_to_ten(out["income_tax"] * 0.1)
    total = sum(list(out.values())[1:], out["pension"])
    return out | {"deductions": total, "net": F.greatest(F.lit(0.0), monthly - total)}


def weekly_allowance(hours: Column, wage: Column) -> dict[str, Column]:
    paid = F.when(hours >= 15, F.least(hours / 40.0, F.lit(1.0)) * 8.0).otherwise(0.0)
    return {"eligible": hours >= 15, "paid_hours": paid, "allowance": round_half_up(paid * wage)}


def severance(hire: Column, retire: Column, wages: Column, bonus: Column, leave_pay: Column, period_days: Column, hours: Column) -> dict[str, Column]:
    days = F.datediff(retire, hire) + 1
    eligible = (days >= 365) & (hours >= 15)
    extra = (bonus + leave_pay) * 3.0 / 12.0
    daily = F.when(period_days > 0, (wages + extra) / period_days).otherwise(0.0)
    return {"eligible": eligible, "service_days": days.cast("long"), "extra": extra, "daily": daily, "severance": F.when(eligible, daily * 30.0 * days / 365.0).otherwise(0.0)}
