"""Price columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NET_MARKS = "[＋+]税|税別|本体"


def _whole(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def parse_price(c: Column) -> Column:
    """First run of digits and commas; a run without digits is null."""
    return _whole(F.regexp_extract(c, "[0-9,]+", 0))


def parse_yen_price(c: Column) -> Column:
    """Amount at the start of the text that is followed by 円."""
    return _whole(F.regexp_extract(c, "^([0-9,]+)円", 1))


def tax_inclusive(amount: Column, text: Column, style: str = "mark") -> Column:
    """Gross amount: ten percent on top, rounded down, when the text says the price is net.

    `mark`: a net mark follows the amount; `label`: 税抜 without 税込.
    """
    net = {
        "mark": text.rlike(f"円\\s*({NET_MARKS})"),
        "label": F.contains(text, F.lit("税抜")) & ~F.contains(text, F.lit("税込")),
    }[style]
    return F.when(net, F.floor(amount * F.lit(1.1))).otherwise(amount)


def parse_usd(c: Column) -> Column:
    digits = F.replace(F.regexp_extract(c, "\\$\\s*([0-9,]+\\.[0-9]{2})", 1), F.lit(","), F.lit(""))
    return digits.try_cast("decimal(12,2)")


def currency_if_priced(price: Column, code: str) -> Column:
    return F.when(price.isNotNull(), F.lit(code))


def typed_price(prices: Column, price_type: str = "03") -> Column:
    """Integer amount of the first price of the wanted type."""
    first = F.get(F.filter(prices, lambda p: p["PriceType"] == price_type), F.lit(0))
    return F.regexp_extract(first["PriceAmount"], "^\\s*([+-]?[0-9]+)", 1).try_cast("bigint")
