"""Country, state and city of a text, from a gazetteer; Catalyst expressions only.

Names stand alone in the text, in any case. There is no entity recogniser here: with
``earliest`` the names of the gazetteer stand in for its entities (the earliest city counts and
settles the country), without it the longest city name counts and a country that is named itself
goes first. A city that is in no gazetteer is therefore never found."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import places
from quillon.functions.lexicon import let, prefix_pattern


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())]), key)


def _names(names: list[str]) -> str:
    """Names that stand alone; where one begins with another, the longer counts."""
    return rf"\b({prefix_pattern(n.lower() for n in names)})\b"


def location(text: Column, earliest: bool = False, cities: dict[str, list[str]] = places.CITIES, states: dict[str, str] = places.STATES, state_names: list[str] = places.STATE_NAMES) -> Column:
    """struct(country, state, city, confidence). Words of a state's name that the text holds are no
    cities; a name in two countries belongs to the first. Null text: nulls and confidence 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    country_of: dict[str, str] = {}
    spelled: dict[str, str] = {}
    for country, names in cities.items():
        for name in names:
            country_of.setdefault(name.lower(), country)
            spelled.setdefault(name.lower(), name)
    state = F.coalesce(*[F.when(F.contains(low, F.lit(s.lower())), s) for s in state_names])
    hits = F.regexp_extract_all(low, F.lit(_names(list(spelled))), F.lit(1))
    named = F.nullif(F.regexp_extract(low, _names(list(cities)), 1), F.lit(""))

    def resolve(x: Column) -> Column:
        usable = F.filter(x["hits"], lambda h: ~F.array_contains(F.split(F.lower(F.coalesce(x["state"], F.lit(""))), " "), h))
        ordered = usable if earliest else F.array_sort(usable, lambda a, b: F.length(b) - F.length(a))
        return F.struct(F.get(ordered, F.lit(0)).alias("city"), x["state"].alias("state"), _lookup({c.lower(): c for c in cities}, x["named"]).alias("named"))

    def finish(x: Column) -> Column:
        home = _lookup(country_of, x["city"])
        country = F.coalesce(home, x["named"]) if earliest else F.coalesce(x["named"], home)
        sure = F.when(x["city"].isNotNull(), 1.0).when(x["named"].isNotNull(), 0.7).otherwise(0.0)
        return F.struct(country.alias("country"), F.coalesce(_lookup(states, x["city"]), x["state"]).alias("state"), _lookup(spelled, x["city"]).alias("city"), sure.alias("confidence"))

    return let(let(F.struct(hits.alias("hits"), state.alias("state"), named.alias("named")), resolve), finish)
