"""Route tokens, names and short sentences built from record text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations states use for their own routes in feeds and road references.
STATE_PREFIXES = ("AK", "AZ", "CA", "CT", "FL", "GA", "IA", "ID", "KY", "LA", "ME", "NC", "NH", "NV", "NY", "OH", "OR", "PA",
                  "RI", "UT", "VT", "WI", "WIS")
# Other spellings of the four kinds of route.
ALIASES = {"IH": "I", "USH": "US", "STH": "SR", "SH": "SR", "CTH": "CR"}
# Postal codes of every state and the capital district.
STATES = ("AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
          "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI",
          "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY")
# Direction words of the feeds.
DIRECTIONS = {"north": "N", "east": "E", "south": "S", "west": "W", "nb": "N", "eb": "E", "sb": "S", "wb": "W",
              "northbound": "N", "eastbound": "E", "southbound": "S", "westbound": "W"}
# Dispatch direction codes spelled out, and words kept small.
SPELLED = {"NB": "northbound", "SB": "southbound", "EB": "eastbound", "WB": "westbound"}
# Designators that keep their capitals.
DESIGNATORS = ("US", "SR", "CR", "I", "NW", "NE", "SW", "SE")
SMALL = ("at", "and", "of", "the", "to", "on", "in", "near", "by", "from")
# Vehicle class nouns.
NOUNS = {"car": ("car", "cars"), "truck": ("truck", "trucks"), "bus": ("bus", "buses"), "motorcycle": ("motorcycle", "motorcycles")}


def mapping(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def leading_route(text: Column) -> Column:
    """The route a camera name opens with, or an empty string."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)^\s*((?:I|IR|US|SR|KY|IA|CA|OH)[\s-]*\d+)\b", 1)


def direction_letter(word: Column) -> Column:
    return F.element_at(mapping(DIRECTIONS), F.lower(F.trim(F.coalesce(word, F.lit("")))))


def host_path(url: Column) -> Column:
    """A URL without its scheme or an explicit :443."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"^(.*?):443/", "$1/")


def stable_id(key: Column, modulus: int) -> Column:
    return F.crc32(key) % modulus


def number(text: Column) -> Column:
    return text.try_cast("double")


def route_tokens(text: Column) -> Column:
    """Set of normal route tokens: "I-39/US 51" gives I39 and US51, "US 12/18" gives US12 and US18."""
    table = {**ALIASES, **{p: "SR" for p in STATE_PREFIXES}}
    prefixes = "|".join(sorted(["I", "IH", "US", "USH", "SR", "SH", "STH", "CR", "CTH", *STATE_PREFIXES], key=len, reverse=True))
    pattern = rf"(?i)\b(?:{prefixes})[\s-]*\d+(?:\s*/\s*\d+)*"
    hits = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ";", " "), F.lit(pattern), F.lit(0))

    def tokens(hit: Column) -> Column:
        prefix = F.upper(F.regexp_extract(hit, r"(?i)^([A-Z]+)", 1))
        prefix = F.coalesce(F.element_at(mapping(table), prefix), prefix)
        numbers = F.regexp_extract_all(hit, F.lit(r"\d+"), F.lit(0))
        return F.transform(numbers, lambda n: F.concat(prefix, n.cast("bigint").cast("string")))

    return F.array_distinct(F.flatten(F.transform(hits, tokens)))


def is_intersection(location: Column) -> Column:
    return F.contains(location, F.lit(" & "))


def camera_tokens(roadway: Column, location: Column) -> Column:
    """Tokens that pull a camera onto its carriageway; intersection cameras get none."""
    return F.when(is_intersection(location), F.array().cast("array<string>")).otherwise(route_tokens(roadway))


def route_label(text: Column) -> Column:
    """The first route in a name as "I-35"; state prefixes count in capitals only. Null without one."""
    t = F.coalesce(text, F.lit(""))
    national, state = r"(?i)\b(I|US|SR)[\s-]*(\d+)", rf"\b({'|'.join(STATES)})[\s-]*(\d+)"
    at_n, at_s = F.regexp_instr(t, F.lit(national)), F.regexp_instr(t, F.lit(state))

    def label(p: str) -> Column:
        return F.concat(F.upper(F.regexp_extract(t, p, 1)), F.lit("-"), F.regexp_extract(t, p, 2).cast("bigint").cast("string"))

    national_first = (at_n > 0) & ((at_s == 0) | (at_n <= at_s))
    return F.when(national_first, label(national)).when(at_s > 0, label(state))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def _words(text: Column) -> Column:
    """The words of a text; a slash is a word of its own."""
    return F.filter(F.split(F.replace(text, F.lit("/"), F.lit(" / ")), r"\s+"), lambda w: w != "")


def _first_up(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def _running(word: Column) -> Column:
    """A shouted word as in running text; what stands inside brackets and commas is replaced in place."""
    inside = F.regexp_replace(word, r"^[(\[]+|[)\],]+$", "")
    low, high = F.lower(inside), F.upper(inside)
    stays_low = low.isin(*SMALL) | inside.rlike(r"(?i)^\d+(st|nd|rd|th)$")
    stays_high = inside.rlike(r"\d") | high.isin(*DESIGNATORS)
    return F.replace(word, inside, F.coalesce(F.element_at(mapping(SPELLED), high), F.when(stays_low, low), F.when(stays_high, high), _first_up(low)))


def running_text(text: Column) -> Column:
    """Text without any small letter is shouted and gets ordinary capitals; other text only even spacing."""
    words = _words(text)
    return F.array_join(F.when(text.rlike("[a-z]"), words).otherwise(F.transform(words, _running)), " ")


def dispatch_place(raw: Column) -> Column:
    """"ROAD DIR x[CROSS]" as "Road northbound at Cross"; text of another form as running text."""
    form = r"(?i)(?:\s+|(?<=\s[NSEW]B))x\[(.+)\]$"  # a direction may stand right before the bracket
    text = F.trim(raw)
    road = _words(F.regexp_replace(text, form, ""))
    heading = F.when(F.size(road) > 1, F.element_at(mapping(SPELLED), F.upper(F.get(road, F.size(road) - 1))))
    named = F.array_join(F.when(heading.isNull(), road).otherwise(F.slice(road, 1, F.size(road) - 1)), " ")
    return F.when(text.rlike(form), F.concat_ws(" ", running_text(named), heading, F.lit("at"), running_text(F.regexp_extract(text, form, 1)))).otherwise(running_text(text))


def without_device_number(raw: Column) -> Column:
    return running_text(F.regexp_replace(raw, r"^\d+\s+", ""))


def sentence_label(raw: Column) -> Column:
    """A shouted record label as the start of a sentence, with W/ written out."""
    written = F.regexp_replace(raw, r"(?i)\bw/", "with ")
    return F.when(raw.rlike("[a-z]"), F.trim(raw)).otherwise(_first_up(F.lower(F.array_join(F.filter(F.split(written, r"\s+"), lambda w: w != ""), " "))))


def inside_sentence(text: Column) -> Column:
    """Text that can stand inside a sentence: no colons, semicolons, dashes or closing stops."""
    spaced = F.array_join(F.filter(F.split(F.translate(text, ":;—", ",,,"), r"\s+"), lambda w: w != ""), " ")
    return F.rtrim(spaced, F.lit(",. "))


def ago(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60.0 + 0.5)
    hours = F.floor(minutes / 60.0 + 0.5)
    return (F.when(seconds < 90, "less than two minutes ago")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
            .when(hours < 36, F.concat(hours.cast("string"), F.lit(" hours ago")))
            .otherwise(F.concat(F.floor(hours / 24.0 + 0.5).cast("string"), F.lit(" days ago"))))


def picture(diff: Column, baseline: Column) -> Column:
    """What the picture is doing against its usual for the hour."""
    ratio = diff / F.when(baseline > 0, baseline)
    return (F.when(diff.isNull(), "no picture yet").when(ratio.isNull(), "changing, with nothing to compare it against yet")
            .when(ratio >= 2, "changing far more than it usually does at this hour").when(ratio >= 1.3, "changing more than usual")
            .when(ratio >= 0.7, "changing about as much as usual").when(ratio >= 0.25, "quieter than usual")
            .otherwise("almost perfectly still, where it is usually moving"))


def vehicle_phrase(by_class: Column) -> Column:
    """Counts by class, most first, with plurals; "no vehicles" when there are none."""
    seen = F.filter(F.map_entries(by_class), lambda e: e["value"] > 0)
    order = F.array_sort(F.transform(seen, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    one = mapping({k: v[0] for k, v in NOUNS.items()})
    many = mapping({k: v[1] for k, v in NOUNS.items()})
    phrase = F.transform(order, lambda e: F.concat((-e["n"]).cast("string"), F.lit(" "), F.when(
        e["n"] == -1, F.coalesce(F.element_at(one, e["k"]), e["k"])).otherwise(F.coalesce(F.element_at(many, e["k"]), e["k"]))))
    return F.when(F.size(phrase) > 0, F.array_join(phrase, ", ")).otherwise("no vehicles")


def distance_km_text(metres: Column) -> Column:
    return F.concat(F.format_number(metres / 1000.0, 1), F.lit(" km"))
