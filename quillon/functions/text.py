"""Column functions over report texts. All are Catalyst expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import lexicon, vocab
from quillon.functions.lexicon import escaped, let

ANCHORS = vocab.ATTACK_ANCHORS + vocab.OPERATION_ANCHORS + vocab.OTHER_ANCHORS
_CATEGORIES = [terms for v in (vocab.ATTACK, vocab.WEAPON, vocab.TARGET) for terms in v.values()]
_EVENT = [*(terms for _, terms in vocab.EVENT_TERMS), vocab.CORE_VERBS]
_ADMIN = [terms for _, terms in vocab.ADMIN_TERMS]
#: What the detector looks for, with the attack categories, and everything at once.
DETECTOR = lexicon.of_lists(_EVENT + _ADMIN, cased=vocab.ADMIN_CASED[1])
DETECTOR_AND_ATTACKS = lexicon.of_lists(_EVENT + _ADMIN + list(vocab.ATTACK.values()), cased=vocab.ADMIN_CASED[1])
EVERYTHING = lexicon.of_lists(_CATEGORIES + _EVENT + _ADMIN, alone=ANCHORS, anywhere=vocab.BOUNDARIES, cased=vocab.ADMIN_CASED[1])


def alternation(terms: list[str], phrases_anywhere: bool = True) -> str:
    """One pattern for a list: single words stand alone, phrases match anywhere in a text."""
    single = [escaped(t) for t in terms if " " not in t or not phrases_anywhere]
    phrase = [escaped(t) for t in terms if " " in t and phrases_anywhere]
    return "|".join(([rf"\b(?:{'|'.join(single)})\b"] if single else []) + phrase)


# --- functions of what a lexicon has found ---


def categories_of(found: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The categories with a term among those found, in vocabulary order."""
    return F.array_compact(F.array(*[F.when(lexicon.holds(found, terms), F.lit(name)) for name, terms in vocabulary.items()]))


def event_score_of(found: Column) -> Column:
    score = sum((w * lexicon.count(found, terms) for w, terms in vocab.EVENT_TERMS), F.lit(0.0))
    return let(score, lambda s: F.when(s > 0, s + vocab.CORE_BONUS * lexicon.count(found, vocab.CORE_VERBS)).otherwise(s))


def admin_score_of(found: Column) -> Column:
    weight, cased = vocab.ADMIN_CASED
    score = sum((w * lexicon.count(found, terms) for w, terms in vocab.ADMIN_TERMS), F.lit(0.0))
    return score + weight * F.size(lexicon.listed(found, "cased", cased))


def detection_of(found: Column) -> Column:
    """struct(event_score, admin_score, class)."""
    scores = F.struct(event_score_of(found).alias("e"), admin_score_of(found).alias("a"))
    return let(scores, lambda x: F.struct(x["e"].alias("event_score"), x["a"].alias("admin_score"), classify_event(x["e"], x["a"]).alias("class")))


def event_triggers_of(found: Column) -> Column:
    """The event terms found, list by list, each once."""
    return F.array_distinct(F.concat(*[lexicon.listed(found, field, own) for terms in _EVENT for field, own in lexicon._split(terms)]))


def admin_triggers_of(found: Column) -> Column:
    return F.array_distinct(F.concat(*[lexicon.listed(found, field, own) for terms in _ADMIN for field, own in lexicon._split(terms)], lexicon.listed(found, "cased", vocab.ADMIN_CASED[1])))


def classify_event(event: Column, admin: Column) -> Column:
    return F.when((admin > 0) & (admin >= event), "REJECT").when((event > 0) & (event > admin), "ACCEPT").otherwise("NEUTRAL")


# --- the same of a text ---


def categories(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The categories with a term in the text, in vocabulary order; none of null."""
    return let(lexicon.of_lists(vocabulary.values()).found(text), lambda f: categories_of(f, vocabulary))


def attack_types(text: Column) -> Column:
    return categories(text, vocab.ATTACK)


def weapon_types(text: Column) -> Column:
    return categories(text, vocab.WEAPON)


def target_types(text: Column) -> Column:
    return categories(text, vocab.TARGET)


def has(text: Column, terms: list[str], words: bool = True) -> Column:
    """Whether a text holds a term, as words of their own or anywhere."""
    low = F.lower(text)
    return low.rlike(alternation(terms, False)) if words else low.rlike("|".join(map(escaped, terms)))


def contains_any(terms: Column, texts: Column) -> Column:
    """Whether any of an array of terms stands in any of an array of texts, in any case of letters."""
    low = lambda items: F.transform(items, F.lower)
    return F.coalesce(F.exists(low(texts), lambda t: F.exists(low(terms), lambda k: F.contains(t, k))), F.lit(False))


def is_anchor(text: Column) -> Column:
    return has(text, ANCHORS)


def has_boundary(text: Column) -> Column:
    return has(text, vocab.BOUNDARIES, words=False)


def event_score(text: Column) -> Column:
    return let(lexicon.of_lists(_EVENT).found(text), event_score_of)


def admin_score(text: Column) -> Column:
    return let(lexicon.of_lists(_ADMIN, cased=vocab.ADMIN_CASED[1]).found(text), admin_score_of)


def detect(text: Column) -> Column:
    """struct(event_score, admin_score, class) of a sentence."""
    return let(DETECTOR.found(text), detection_of)


def detect_with_triggers(text: Column) -> Column:
    """struct(event_score, admin_score, class, event_triggers, admin_triggers, is_event, is_admin, is_neutral)."""

    def whole(f: Column) -> Column:
        return let(detection_of(f), lambda d: F.struct(
            d["event_score"].alias("event_score"), d["admin_score"].alias("admin_score"), d["class"].alias("class"), event_triggers_of(f).alias("event_triggers"), admin_triggers_of(f).alias("admin_triggers"),
            (d["class"] == "ACCEPT").alias("is_event"), (d["class"] == "REJECT").alias("is_admin"), (d["class"] == "NEUTRAL").alias("is_neutral"),
        ))

    return let(DETECTOR.found(text), whole)


def accepted_attacks(text: Column) -> Column:
    """The attack categories of a text that tells of an event; null for other texts."""
    return let(DETECTOR_AND_ATTACKS.found(text), lambda f: F.when(detection_of(f)["class"] == "ACCEPT", categories_of(f, vocab.ATTACK)))


_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December)"


def date_of(text: Column, as_of: Column | None = None) -> Column:
    """The date of a text by pattern priority: ISO, numeric (month first, day first where that
    can't be), day month year, month day year. A match that is no date falls through; a date without
    year takes the year of ``as_of``, else none."""
    return let(text, lambda t: _date_of(t, as_of))


def _date_of(text: Column, as_of: Column | None) -> Column:
    def named(pattern: str, day: int, month: int, year: int) -> Column:
        def read(hit: Column) -> Column:
            part = [F.regexp_extract(hit, pattern, i) for i in (year, month, day)]
            y = F.when(part[0] != "", part[0]) if as_of is None else F.when(part[0] != "", part[0]).otherwise(F.year(as_of).cast("string"))
            return F.when(hit != "", F.try_to_date(F.concat_ws(" ", part[2], F.initcap(part[1]), y), "d MMMM yyyy"))

        return let(F.regexp_extract(text, pattern, 0), read)  # its parts are sought in the match only

    iso = F.try_to_date(F.regexp_extract(text, r"\b(\d{4}-\d{1,2}-\d{1,2})\b", 1), "yyyy-M-d")
    number = F.regexp_replace(F.regexp_extract(text, r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b", 1), "-", "/")
    numeric = let(number, lambda n: F.when(n != "", F.coalesce(F.try_to_date(n, "M/d/yyyy"), F.try_to_date(n, "d/M/yyyy"))))
    # every form has a digit
    return F.when(text.rlike(r"\d"), F.coalesce(
        iso, numeric, named(rf"(?i)\b(\d{{1,2}})\s+{_MONTH}(?:\s+(\d{{4}}))?\b", 1, 2, 3), named(rf"(?i)\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b", 2, 1, 3),
    ))


def jaccard(a: Column, b: Column) -> Column:
    """Word-set Jaccard of two texts; 0 if both are empty."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0))) for t in (a, b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def sentences(text: Column, least: int = 11) -> Column:
    """Sentences of at least ``least`` characters, by ends of sentences followed by white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def csv_encode(items: Column, by: str = ",") -> Column:
    return F.array_join(items, by)


def csv_decode(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def whole_sentence(text: Column) -> Column:
    """A text cut after its last sentence end; unchanged if it has none."""
    cut = F.regexp_extract(text, r"(?s)^(.*[.!?:])", 1)
    return F.when(cut != "", cut).otherwise(text)


def parse_casualty(text: Column) -> Column:
    """A number without its fraction; null for what is no number or fits no int."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 2.0**31), number).cast("int")


def parse_int(text: Column) -> Column:
    """A number without its fraction; 0 for what is none."""
    return F.coalesce(parse_casualty(text), F.lit(0))


def format_date(year: Column, month: Column, day: Column) -> Column:
    def part(c: Column) -> Column:
        return F.lpad(F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c).cast("string"), 2, "0")

    return F.when(F.coalesce(year, F.lit(0)) == 0, "").otherwise(F.concat_ws("-", year.cast("string"), part(month), part(day)))


def clean_list(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).isin("", "Unknown"), F.array().cast("array<string>")).otherwise(F.array(F.trim(text)))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def default(text: Column, value: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(value))


def retrieval_text(r: dict[str, Column]) -> Column:
    """Key: value lines of an incident, as it is embedded; empty fields read Unknown."""
    place = F.concat_ws(", ", *[F.nullif(r[c], F.lit("")) for c in ("city", "state", "country")])
    listed = [("Attack Type", "attack_types"), ("Target Type", "target_types"), ("Weapon Type", "weapon_types"), ("Responsible Group", "responsible_groups")]
    lines = [("Date", r["date"]), ("Location", place)] + [(k, F.array_join(r[c], ", ")) for k, c in listed]
    out = [F.concat(F.lit(f"{k}: "), default(v)) for k, v in lines] + [F.concat(F.lit(f"{k}: "), F.coalesce(r[c], F.lit(0)).cast("string")) for k, c in (("Killed", "killed"), ("Injured", "injured"))]
    summary = F.coalesce(F.trim(r["summary"]), F.lit(""))
    return F.concat_ws("\n", *out, F.when(F.coalesce(r["has_summary"], F.lit(False)) & (summary != ""), F.concat(F.lit("\nSummary:\n"), summary)))


def image_text(caption: Column, ocr: Column) -> Column:
    """What a picture is found by."""
    some = lambda key, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{key}: "), c))
    return default(F.concat_ws("\n", some("Caption", caption), some("OCR", ocr)), "Image with no caption or extracted text.")


def badge(score: Column) -> Column:
    """How a result's score is shown."""
    return F.when(score > 0.8, F.format_string("High Match (%.2f)", score)).otherwise(F.format_string("Match (%.2f)", score))


def list_default(items: Column, value: str = "Unknown") -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ", ")).otherwise(value)


def first_label(query: Column, labels: dict[str, str], plural: bool = False) -> Column:
    low = F.lower(query)
    return F.coalesce(*[F.when(low.rlike(rf"\b{escaped(k)}{'s?' if plural else ''}\b"), v) for k, v in labels.items()])


def query_years(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1)))


def classify_query(query: Column) -> Column:
    low = F.lower(query)
    return F.coalesce(*[F.when(low.rlike(alternation(words, False)), name) for name, words in vocab.QUERY_CLASSES.items()], F.lit("summary"))


def is_broad(query: Column) -> Column:
    return F.lower(query).rlike(alternation(vocab.BROAD, False))


def document_words(query: Column) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in vocab.DOCUMENT_WORDS]), lambda w: F.contains(F.lower(query), w))
