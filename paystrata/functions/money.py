"""Exact decimal arithmetic: sums, means, percentages, the pay formula."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from paystrata.schema import MONEY, MONEY_SUM, RATIO


@dataclass(frozen=True)
class PayRates:
    """Rates of the pay formula; the defaults are fixed values of the model."""

    allowance: Decimal = Decimal("0.10")
    overtime: Decimal = Decimal("0.05")
    tax: Decimal = Decimal("0.10")
    sss: Decimal = Decimal("1350.00")
    philhealth: Decimal = Decimal("450.00")
    pagibig: Decimal = Decimal("200.00")


DEFAULT_RATES = PayRates()


def total(amount: Column | str) -> Column:
    """Sum of an amount column; NULL over no rows, as in SQL."""
    return F.sum(amount).cast(MONEY_SUM)


def total_or_zero(amount: Column | str) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY_SUM)


def quotient(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """``numerator / denominator`` rounded half up; NULL when dividing by zero.

    Decimal division keeps at least eleven places here, so the final rounding
    sees the exact quotient.
    """
    return F.round(F.try_divide(numerator, denominator), places).cast(RATIO)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return quotient(part * F.lit(100), whole, places)


def mean(amount: Column | str) -> Column:
    """Average over the non-NULL values, rounded to two places."""
    return quotient(F.sum(amount).cast(MONEY_SUM), F.count(amount))


def portion(amount: Column, rate: Decimal) -> Column:
    return F.round(amount * F.lit(rate), 2).cast(MONEY)


def net_of(parts: dict[str, Column]) -> dict[str, Column]:
    """Gross, total deductions and net of already rounded components."""
    gross = parts["basic_salary"] + parts["allowances_amount"] + parts["overtime_amount"]
    deductions = (parts["tax_amount"] + parts["sss_amount"] + parts["philhealth_amount"]
                  + parts["pagibig_amount"] + parts["other_deductions"])
    return {
        "gross_amount": gross.cast(MONEY),
        "total_deductions_amount": deductions.cast(MONEY),
        "net_amount": (gross - deductions).cast(MONEY),
    }


def pay_columns(basic: Column, rates: PayRates = DEFAULT_RATES) -> dict[str, Column]:
    """Every amount of one payroll record, from the basic salary alone."""
    parts = {
        "basic_salary": basic.cast(MONEY),
        "allowances_amount": portion(basic, rates.allowance),
        "overtime_amount": portion(basic, rates.overtime),
        "tax_amount": portion(basic, rates.tax),
        "sss_amount": F.lit(rates.sss).cast(MONEY),
        "philhealth_amount": F.lit(rates.philhealth).cast(MONEY),
        "pagibig_amount": F.lit(rates.pagibig).cast(MONEY),
        "other_deductions": F.lit(Decimal("0.00")).cast(MONEY),
    }
    return {**parts, **net_of(parts)}
