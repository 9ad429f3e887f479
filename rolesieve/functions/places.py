"""Country of a search location and the currency that goes with it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from ..config import CURRENCY_BY_COUNTRY, DEFAULT_CURRENCY


def country_of(location: Column) -> Column:
    low = F.lower(location)
    return (
        F.when(low.contains("india"), "in")
        .when(low.contains("bangladesh"), "bd")
        .when(low.contains("united kingdom") | low.contains("uk"), "gb")
        .otherwise("us")
    )


def currency_of(country: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CURRENCY_BY_COUNTRY.items())])
    return F.coalesce(F.try_element_at(table, country), F.lit(DEFAULT_CURRENCY))
