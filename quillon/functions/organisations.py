"""Who did it and whom it hit: names of a text by known lists and by the words around them.

There is no entity recogniser here; a function that returns names may stand in for one
(``entities``), and only those that overlap a known name count."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import places
from quillon.functions.lexicon import prefix_pattern

# Known groups, forces and aid organisations.
GROUPS = [
    "Islamic State", "ISIS", "ISIL", "Daesh", "Islamic State Khorasan Province", "Al-Qaeda", "Al Qaeda", "al-Qa'ida", "Taliban", "Lashkar-e-Taiba", "LeT", "Jaish-e-Mohammed", "JeM", "Boko Haram", "Al-Shabaab", "al Shabaab",
    "Hamas", "Hezbollah", "Hizbullah", "Hizbul Mujahideen", "LTTE", "Tamil Tigers", "PKK", "ETA", "IRA", "Provisional IRA", "Tehrik-i-Taliban Pakistan", "TTP", "Jamaat-ul-Ahrar", "Jundallah", "Houthi", "Ansar Allah", "Abu Sayyaf",
    "Jemaah Islamiyah", "AQAP", "Al-Qaeda in the Arabian Peninsula", "AQIM", "Al-Qaeda in the Islamic Maghreb", "National Thowheed Jamath", "NTJ", "Indian Mujahideen", "Bangladesh Rifles", "Naxalites", "Maoists",
]
FORCES = [
    "CRPF", "BSF", "ITBP", "CISF", "Indian Army", "Indian Navy", "Indian Air Force", "Jammu and Kashmir Police", "J&K Police", "Delhi Police", "Punjab Police", "Afghan National Police", "Pakistan Rangers", "Airport Security Force",
    "NIA", "NDRF", "National Directorate of Security", "Border Security Force",
]
GENERIC_FORCES = ["Police", "Army", "Navy", "Air Force", "Security Forces", "Armed Forces"]
FACTIONS = {"Tehrik-i-Taliban Pakistan": ["Jamaat-ul-Ahrar", "Jundallah"]}
AID = ["Medecins Sans Frontieres", "MSF", "Doctors Without Borders", "Red Cross", "Red Crescent", "ICRC", "United Nations", "UNICEF", "UNHCR", "WHO"]
# Words of venues, of sentence fragments, and words that are no name.
VENUES = [
    "hotel", "church", "temple", "mosque", "shrine", "cathedral", "school", "college", "university", "academy", "airport", "station", "terminal", "port", "hospital", "clinic", "centre", "center", "cafe", "bakery", "restaurant", "market",
    "park", "garden", "stadium", "arena", "compound", "building", "tower", "plaza", "house", "quarter", "gate", "consulate", "embassy", "highway", "road",
]
FRAGMENTS = ["stormed", "attacked", "fired", "siege", "killed", "injured", "wounded", "including", "militants", "officers and", "three ", "two ", "the bus"]
JUNK = ["local", "some", "many", "armed", "suspected", "citizens", "people", "crowds", "civilians", "muslims", "hindus", "christians", "buddhists", "residents", "spectators", "families", "nationals", "others", "including"]
# Patterns around a name.
_NAME = r"([A-Z][\w\-']+(?:\s+[\w\-']+){0,5}?)(?:\s+(?:in|on|near|at|from|during|who|which|that|and|or)\b|[,.\;]|\s*$)"
_BEFORE = r"([A-Z][\w\s\-']{2,40}?)\s+"
_AFTER = r"\s+(?:the\s+)?" + _NAME
BY_GROUP = [
    _BEFORE + r"claimed\s+responsibility", r"responsibility\s+was\s+claimed\s+by" + _AFTER, r"carried\s+out\s+by" + _AFTER, r"perpetrated\s+by" + _AFTER, r"attributed\s+to" + _AFTER, _BEFORE + r"(?:has\s+)?taken\s+credit", r"linked\s+to" + _AFTER,
    r"blamed\s+on" + _AFTER, r"militants\s+from" + _AFTER, r"terrorists\s+from" + _AFTER, r"insurgents\s+from" + _AFTER, r"attack\s+by" + _AFTER, r"bombing\s+by" + _AFTER, r"affiliated\s+with" + _AFTER,
]
ON_TARGET = [_BEFORE + r"personnel\s+were\s+(?:killed|injured|wounded)", r"convoy\s+of" + _AFTER, _BEFORE + r"(?:soldiers|troops|police|jawans|cadets|officers)", r"targeted\s+(?!by\b)(?:the\s+)?" + _NAME, r"victims\s+included" + _AFTER]



def _guarded(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """What must be in a text for a match, and the pattern. A pattern that begins with a name tries
    every place of a text, so the words after the name are looked for first."""
    return re.compile(pattern.removeprefix(_BEFORE), re.IGNORECASE), re.compile(pattern, re.IGNORECASE)


_BY_GROUP = [_guarded(p) for p in BY_GROUP]
_ON_TARGET = [_guarded(p) for p in ON_TARGET]
_CITIES = {c.lower() for names in places.CITIES.values() for c in names}


def is_venue(name: str) -> bool:
    return any(v in name.lower() for v in VENUES)


def is_city(name: str) -> bool:
    """A city, or at most two words with a city among them."""
    words = name.lower().split()
    return name.lower() in _CITIES or (len(words) <= 2 and not _CITIES.isdisjoint(words))


def is_fragment(name: str) -> bool:
    return (len(name) > 4 and name[0].islower()) or any(f in name.lower() for f in FRAGMENTS)


def is_name(name: str) -> bool:
    return len(name) >= 3 and name.lower() not in JUNK and not (is_venue(name) or is_city(name) or is_fragment(name))


def _overlaps(name: str, known: Iterable[str]) -> bool:
    return any(k.lower() in name.lower() or name.lower() in k.lower() for k in known)


def _ready(known: list[str]) -> list[tuple[str, re.Pattern | None, str]]:
    """Names with what finds them: short ones stand alone and as spelled, others anywhere in any case."""
    return [(k, re.compile(rf"\b{re.escape(k)}\b") if len(k) <= 4 else None, k.lower()) for k in known]


_GROUPS, _FORCES = _ready(GROUPS), _ready(FORCES)


def _written(known: list[tuple[str, re.Pattern | None, str]], text: str, low: str) -> list[str]:
    """Known names in a text."""
    return [k for k, pattern, small in known if small in low and (pattern is None or pattern.search(text))]


def _collect(names: Iterable[str], wanted: Callable[[str], bool]) -> dict[str, str]:
    kept: dict[str, str] = {}
    for name in names:
        name = name.strip()
        name = name[4:] if name.lower().startswith("the ") else name
        if wanted(name):
            kept.setdefault(name.lower(), name)
    return kept


def _most_telling(names: Iterable[str], known: list[str]) -> list[str]:
    """Longest first: no phrase around a known name, no part of a name that is there."""
    low = [k.lower() for k in known]
    kept: list[str] = []
    for name in sorted(names, key=lambda n: (-len(n), n)):
        n = name.lower()
        around = n not in low and any(k in n for k in low)
        if not around and not any(n in other.lower() for other in kept):
            kept.append(name)
    return sorted(kept)


# Words one of which stands in every match of the patterns around a name.
CUES = [
    "responsib", "carried", "perpetrated", "attributed", "credit", "linked", "blamed", "militants", "terrorists", "insurgents", "attack", "bombing", "affiliated", "personnel", "convoy", "soldiers", "troops", "police", "jawans", "cadets",
    "officers", "targeted", "victims",
]
#: Texts without a cue or a known name have no names. Looked for in the JVM, so that they never get here.
_SOME = prefix_pattern({w.lower() for w in CUES + GROUPS + FORCES})
_CUE = re.compile(_SOME)


def organisations_of(text: str, entities: Callable[[str], list[str]] | None = None) -> tuple[list[str], list[str]]:
    """(responsible groups, target organisations) of a text, each sorted."""
    context = lambda patterns: [m[1] for guard, p in patterns if guard.search(text) for m in p.finditer(text)]
    low = text.lower()
    if not entities and not _CUE.search(low):
        return [], []
    other = entities(text) if entities else []
    forces = [n for n in other if _overlaps(n, FORCES)]
    groups = _collect(_written(_GROUPS, text, low) + context(_BY_GROUP) + [n for n in other if n not in forces and _overlaps(n, GROUPS)], lambda n: is_name(n) and not _overlaps(n, AID))
    targets = _collect(_written(_FORCES, text, low) + context(_ON_TARGET) + forces, is_name)
    for parent, children in FACTIONS.items():
        if any(c.lower() in groups for c in children):
            groups.pop(parent.lower(), None)
    return _most_telling(groups.values(), GROUPS), _most_telling(targets.values(), FORCES + GENERIC_FORCES)


def organisations(text: Column) -> Column:
    """struct(groups, targets), arrays of names; empty for null."""

    @F.arrow_udf("groups array<string>, targets array<string>")
    def run(texts: pa.Array) -> pa.Array:
        found = [([], []) if t is None else organisations_of(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1)], ["groups", "targets"])

    return run(F.when(F.lower(text).rlike(_SOME), text))
