"""Column functions on identifiers, labels and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N.A."


def local_name(iri: Column, marker: str = "vocab/") -> Column:
    """What follows the last marker."""
    return F.regexp_replace(iri, f".*{marker}", "")


def label(name: Column) -> Column:
    """Underscores and %20 as spaces."""
    return F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("%20"), F.lit(" "))


def last_segment(iri: Column) -> Column:
    """After the last # or /."""
    return F.regexp_extract(iri, "[^#/]*$", 0)


def readable_label(iri: Column) -> Column:
    """The last segment, underscores as spaces, a space before each capital, single spaces."""
    spaced = F.regexp_replace(F.replace(last_segment(iri), F.lit("_"), F.lit(" ")), "([A-Z])", " $1")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def property_name(iri: Column) -> Column:
    """After #, else after the last /."""
    return F.coalesce(F.nullif(F.regexp_extract(iri, "#(.*)", 1), F.lit("")), F.regexp_extract(iri, "[^/]*$", 0))


def label_to_iri(text: Column, base: str) -> Column:
    """Trimmed, white space as underscore; null for a blank label."""
    name = F.regexp_replace(F.trim(text), "\\s+", "_")
    return F.when(name != "", F.concat(F.lit(base), name))


def iri_encode(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def analysis_id(iri: Column) -> Column:
    got = F.regexp_extract(iri, "/Analysis_(.+)$", 1)
    return F.when(got != "", got).otherwise("unknown")


def slug(text: Column, keep: str = "") -> Column:
    return F.regexp_replace(text, f"[^a-zA-Z0-9{keep}]", "_")


def escaped(text: Column) -> Column:
    """A literal's text with backslash, quote and line feed escaped; null as the missing mark."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(out, F.lit(MISSING))


def default_missing(text: Column) -> Column:
    """Blank or null as the missing mark."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(MISSING))


def present(text: Column) -> Column:
    """The text, null where it stands for a missing value."""
    return F.when(~F.trim(text).isin("", "NA", MISSING, "N/A"), text)


def is_analysis_id(text: Column) -> Column:
    return text.rlike("(?i)^(A\\d+|Analysis_?\\d+|\\d+)$")


def flexible_id(text: Column) -> Column:
    """One form for ids that differ by an Analysis_ prefix, a decimal comma or a trailing .0."""
    bare = F.replace(F.regexp_replace(F.trim(text), "(?i)^Analysis_", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(bare, "\\.0+$", "")


#: Labels and colours of codes.
GENDER_LABELS = {"Male": "Hommes", "Female": "Femmes", "Mixed": "Mixte"}
RELATION_LABELS = {"+": "Facteur de risque", "-": "Facteur protecteur", "NS": "Relation non significative"}
RELATION_COLOURS = {"+": "#E53E3E", "-": "#38A169", "NS": "#718096"}
OTHER_COLOUR = "#A0AEC0"


def looked_up(code: Column, values: dict[str, str], otherwise: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), otherwise)


def relation_label(code: Column) -> Column:
    return looked_up(code, RELATION_LABELS, code)


def strength_label(r: Column, p: Column) -> Column:
    """r=..., p=... as far as present."""
    out = F.concat_ws(", ", F.concat(F.lit("r="), present(r)), F.concat(F.lit("p="), present(p)))
    return F.when(out == "", "Force inconnue").otherwise(out)


def statistics_line(kinds: list[Column], r: Column, sign: Column, p: Column, beta: Column) -> Column:
    """The kinds that are present joined by |, then r=, p with its sign (= if it has none) and β=, as far as present, joined by commas."""
    signed = F.concat(F.lit("p"), F.coalesce(present(sign), F.lit("=")), present(p))
    numbers = F.concat_ws(", ", F.concat(F.lit("r="), present(r)), signed, F.concat(F.lit("β="), present(beta)))
    return F.concat_ws(" | ", F.nullif(F.concat_ws(" | ", *[present(k) for k in kinds]), F.lit("")), F.nullif(numbers, F.lit("")))


def filters_text(gender: Column, sport: Column, low: Column, high: Column) -> Column:
    """The filters in force: gender, sport and ages, as far as given; an age bound that isn't is a question mark."""
    ages = F.concat(F.coalesce(low.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(high.cast("string"), F.lit("?")))
    return F.concat_ws(", ", F.concat(F.lit("Genre: "), present(gender)), F.concat(F.lit("Sport: "), present(sport)), F.when(low.isNotNull() | high.isNotNull(), F.concat(F.lit("Âge: "), ages)))


def typed_value(value: Column, datatype: Column) -> Column:
    """A literal as its datatype says: number (decimal, double, float), whole (integer, int), truth (boolean), else text; what doesn't parse stays null."""
    has = lambda *words: F.coalesce(datatype.rlike("(?i)" + "|".join(words)), F.lit(False))
    number, whole, truth = has("decimal", "double", "float"), has("int"), has("boolean")
    point = F.replace(value, F.lit(","), F.lit("."))
    return F.struct(
        F.when(number, point.try_cast("double")).alias("number"), F.when(~number & whole, value.try_cast("long")).alias("whole"),
        F.when(~number & ~whole & truth, value == "true").alias("truth"), F.when(~(number | whole | truth), value).alias("text"))


def reference_text(author: Column, year: Column, title: Column, journal: Column, most: int = 50) -> Column:
    """Author (year). Title. Journal. A longer author list is cut and marked."""
    short = F.when(F.char_length(author) > most, F.concat(F.substring(author, 1, most - 3), F.lit("..."))).otherwise(author)
    return F.concat(short, F.lit(" ("), year.cast("string"), F.lit("). "), title, F.lit(". "), journal, F.lit("."))
