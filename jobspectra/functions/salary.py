"""Salary rules: text parsing, currency, tax and the point estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspectra.schema import MONEY, TAX_RATE

# --- fixed values: rate of each currency to the base currency; others count as 1 ------
RATES_TO_BASE = {
    "RUR": "1", "RUB": "1", "USD": "90", "EUR": "100", "KZT": "0.2",
    "UAH": "2.5", "BYR": "28", "GEL": "34", "UZS": "0.007",
}
DEFAULT_CURRENCY = "RUR"
RAW_COLUMNS = ("salary_from", "salary_to", "salary_currency", "salary_gross")
# -------------------------------------------------------------------------------------


_MONEY, _RATE = "decimal(14,2)", "decimal(14,6)"


def rate_to_base(code: str) -> str:
    """SQL of the rate of a currency code; an unknown code counts as the base."""
    pairs = ", ".join(f"'{c}', CAST({r} AS {_RATE})" for c, r in RATES_TO_BASE.items())
    return f"coalesce(try_element_at(map({pairs}), {code}), CAST(1 AS {_RATE}))"


def net_in_base(amount: str, rate: str, gross: str, tax: str = TAX_RATE) -> str:
    """SQL of one bound in the base currency after tax; unknown ``gross`` counts as gross.
    A zero amount is a missing amount; one that overflows the money type gives NULL."""
    kept = f"CAST(if(coalesce({gross}, true), 1 - {tax}, 1) AS decimal(5,4))"
    return f"try_cast(nullif({amount}, CAST(0 AS {_MONEY})) * {rate} * {kept} AS {_MONEY})"


def point_estimate(low: str, high: str) -> str:
    return f"coalesce(CAST(({low} + {high}) * 0.5 AS {_MONEY}), {low}, {high})"


def with_salary(df: DataFrame, tax: str = TAX_RATE) -> DataFrame:
    """Replaces the four raw salary columns by the seven normalized ones, all NULL when
    neither bound is given.

    One projection per step, so later steps refer to a column instead of repeating its
    expression.
    """
    kept = [c for c in df.columns if c not in RAW_COLUMNS]
    code = f"upper(coalesce(nullif(salary_currency, ''), '{DEFAULT_CURRENCY}'))"
    typed = df.selectExpr(
        *kept, f"try_cast(salary_from AS {_MONEY}) AS amount_from", f"try_cast(salary_to AS {_MONEY}) AS amount_to",
        f"{code} AS _code", f"{rate_to_base(code)} AS _rate", "salary_gross AS _gross")
    has = "amount_from IS NOT NULL OR amount_to IS NOT NULL"
    net = typed.selectExpr(
        *kept, "amount_from", "amount_to", f"if({has}, _code, NULL) AS currency", f"if({has}, _gross, NULL) AS gross",
        f"{net_in_base('amount_from', '_rate', '_gross', tax)} AS from_net",
        f"{net_in_base('amount_to', '_rate', '_gross', tax)} AS to_net")
    return net.selectExpr("*", f"{point_estimate('from_net', 'to_net')} AS estimate")


def overflows() -> str:
    """SQL: a bound of the raw salary columns does not fit the money type, as given or in the base currency."""
    code = f"upper(coalesce(nullif(salary_currency, ''), '{DEFAULT_CURRENCY}'))"
    bound = lambda c: f"({c} <> 0 AND {net_in_base(f'try_cast({c} AS {_MONEY})', rate_to_base(code), 'salary_gross')} IS NULL)"
    return f"(coalesce({bound('salary_from')}, false) OR coalesce({bound('salary_to')}, false))"


def salary_from_text(text: Column) -> Column:
    """Struct (amount_from, amount_to, currency, gross) read from a salary phrase."""
    clean = F.lower(text)
    has = lambda *words: _any_of(clean, words)
    gross = (F.when(has("на руки", "net"), F.lit(False))
             .when(has("до вычета", "gross"), F.lit(True)))
    currency = (F.when(has("руб", "₽"), "RUR").when(has("usd", "$"), "USD")
                .when(has("eur", "€"), "EUR"))
    # Thin and narrow spaces inside numbers are digit separators too.
    runs = F.regexp_extract_all(clean, F.lit(r"([0-9\s\x{a0}\x{2009}\x{202f}]+)"), 1)
    digits = F.transform(runs, lambda run: F.regexp_replace(run, r"[^0-9]", ""))
    numbers = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.try_cast(MONEY))
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    starts, ends = has("от"), has("до")
    both = F.size(numbers) >= 2
    low = F.when(starts, first).when(ends, F.lit(None).cast(MONEY)).otherwise(first)
    high = F.when(starts & ends, second).when(starts, F.lit(None).cast(MONEY)).when(ends, first).when(both, second)
    return F.struct(low.alias("amount_from"), high.alias("amount_to"),
                    currency.alias("currency"), gross.alias("gross"))


def _any_of(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def convert_estimate(net: Column, rate: Column, basis: str = "net", tax: str = TAX_RATE) -> Column:
    """A stored net amount shown in another currency (``rate`` to base) and basis."""
    if basis not in ("net", "gross"):
        raise ValueError("basis must be 'net' or 'gross'")
    keep = F.lit(1.0) - F.lit(float(tax)) if basis == "gross" else F.lit(1.0)
    return F.round(net.cast("double") / rate.cast("double") / keep, 4)
