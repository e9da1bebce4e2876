"""Scalar functions over strings: tri-state and numeric cells, tags, licences, plates, URLs, masks.

All are Column expressions; unreadable values become NULL and never raise, whatever the session's ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text_or_empty(c), F.lit(V.WHITE_SPACE))


def once(value: Column, use) -> Column:
    """use(value), the value being computed once however often `use` names it: neither projections nor filters that are merged copy it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapsed(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


# --- cells -----------------------------------------------------------------


def parse_bool(c: Column) -> Column:
    """True, false, or NULL if the cell is neither."""
    word = F.lower(stripped(c))
    return F.when(word.isin(*V.TRUE_WORDS), True).when(word.isin(*V.FALSE_WORDS), False)


_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def _double(c: Column) -> Column:
    """A double, which may be infinite, or NULL; each step names the one before it once."""
    shaped = F.regexp_extract(F.replace(stripped(c), F.lit(","), F.lit(".")), NUMBER, 0)
    return F.replace(shaped, F.lit("_"), F.lit("")).try_cast("double")


def parse_number(c: Column) -> Column:
    """A finite double, a decimal comma allowed, or NULL. Digits may be grouped by single underscores."""
    return once(_double(c), lambda v: F.when(F.abs(v) < float("inf"), v))


def numbers(*cells: Column) -> Column:
    """array<double> of all cells, or NULL if one of them is no number."""
    return once(F.array(*(_double(c) for c in cells)), lambda a: F.when(F.forall(a, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), a))


def split_tags(c: Column) -> Column:
    """Lower-cased tags parted by | or comma, blanks dropped, repeats kept."""
    tags = F.transform(F.split(text_or_empty(c), "[|,]"), lambda t: F.lower(stripped(t)))
    return F.filter(tags, lambda t: t != "")


def path_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def forward_slashes(c: Column) -> Column:
    return F.replace(stripped(c), F.lit("\\"), F.lit("/"))


# --- licences --------------------------------------------------------------


def normal_license(c: Column) -> Column:
    steps = [("creative commons", "cc"), ("attribution", "by"), ("international", ""), ("public domain dedication", "public domain")]
    text = reduce(lambda acc, s: F.replace(acc, F.lit(s[0]), F.lit(s[1])), steps, F.lower(stripped(c)))
    return collapsed(F.translate(text, "-_/,()", "      "))


def license_clause(c: Column) -> Column:
    """The clause of the first barred token, or NULL."""
    clauses = lookup(V.BARRED_TOKENS)
    barred = F.filter(F.split(normal_license(c), " "), lambda t: t.isin(*V.BARRED_TOKENS))
    return F.try_element_at(clauses, F.get(barred, F.lit(0)))


def redistributable(c: Column) -> Column:
    return normal_license(c).isin(*V.REDISTRIBUTABLE)


def gate_verdict(c: Column) -> Column:
    return (
        F.when(stripped(c) == "", "UNKNOWN").when(license_clause(c).isNotNull(), "INCOMPATIBLE")
        .when(redistributable(c), "COMPATIBLE").otherwise("UNKNOWN")
    )


def stated_licenses(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), ";"), stripped), lambda p: p != "")


def all_redistributable(c: Column) -> Column:
    """Whether each licence of a ;-parted list is, and there is one."""
    parts = stated_licenses(c)
    return (F.size(parts) > 0) & F.forall(parts, redistributable)


def squeezed_license(c: Column) -> Column:
    """Without separators, aliases folded: for comparing a record with its source."""
    bare = F.regexp_replace(F.lower(stripped(c)), r"(?U)[\s_-]+", "")
    return F.coalesce(F.try_element_at(lookup(V.LICENSE_ALIASES), bare), bare)


# --- plates ----------------------------------------------------------------

LETTER, STANDARD, SHORT = f"[{V.PLATE_LETTERS}]", "type1", "type1b"
PATTERNS = {
    STANDARD: rf"^{LETTER}\p{{Nd}}{{3}}{LETTER}{{2}}(\p{{Nd}}{{2,3}})$",
    SHORT: rf"^{LETTER}{{2}}\p{{Nd}}{{3}}(\p{{Nd}}{{2,3}})$",
}
_L, _D = f"[{V.PLATE_LETTERS}{V.HIDDEN}]", rf"[\p{{Nd}}{V.HIDDEN}]"
MASKED = {STANDARD: rf"^{_L}{_D}{{3}}{_L}{{2}}{_D}{{2,3}}$", SHORT: rf"^{_L}{{2}}{_D}{{3}}{_D}{{2}}$"}
SHAPES = {STANDARD: "[LETTER][3 DIGITS][2 LETTERS][REGION]", SHORT: "[2 LETTERS][3 DIGITS][REGION]"}


def normal_plate(c: Column) -> Column:
    """Upper case, without white space, hyphen or underscore, Cyrillic look-alikes folded."""
    return F.translate(F.upper(F.regexp_replace(text_or_empty(c), r"(?U)[\s_-]", "")), V.CYRILLIC, V.LATIN)


def _region_fault(region: Column) -> Column:
    return F.when(
        (F.length(region) == 3) & ~F.substring(region, 1, 1).isin(*V.LONG_REGION_STARTS),
        F.concat(F.lit("3-digit region '"), region, F.lit("' must start with 1, 2 or 7")),
    ).when(region.rlike("^0+$"), F.concat(F.lit("region '"), region, F.lit("' is not assigned")))


def _format_fault(plate: Column, kind: str) -> Column:
    """Why a plate is not of the kind; NULL if it is."""
    region = F.regexp_extract(plate, PATTERNS[kind], 1)
    fault = F.when(~plate.rlike(PATTERNS[kind]), F.lit(f"does not match {SHAPES[kind]}"))
    if kind == SHORT:
        fault = fault.when(F.length(region) != 2, F.concat(F.lit("type1b region '"), region, F.lit("' must have 2 digits")))
    return fault.otherwise(_region_fault(region))


def _verdict(plate: Column, kind: Column) -> Column:
    standard, short = _format_fault(plate, STANDARD), _format_fault(plate, SHORT)
    chosen = (
        F.when(kind.isin("type1", "type1a"), F.lit(STANDARD)).when(kind == "type1b", F.lit(SHORT))
        .when(plate.rlike(PATTERNS[SHORT]) & ~plate.rlike(PATTERNS[STANDARD]), F.lit(SHORT)).otherwise(F.lit(STANDARD))
    )
    fault = lambda how: F.when(plate == "", F.lit("empty text")).when(how == STANDARD, standard).otherwise(short)
    told = once(chosen, lambda how: F.struct(how.alias("how"), fault(how).alias("fault")))
    return once(told, lambda t: F.struct(
        t["fault"].isNull().alias("is_valid"), plate.alias("normalized"), text_or_empty(t["fault"]).alias("reason"),
        F.when(t["fault"].isNull(), t["how"]).otherwise(F.lit("")).alias("format"),
    ))


def validate_plate(c: Column, plate_type: Column | None = None) -> Column:
    """struct(is_valid, normalized, reason, format). A typed plate must follow its type; else the first structure that fits decides."""
    kind = F.lit(None).cast("string") if plate_type is None else plate_type
    return once(normal_plate(c), lambda plate: _verdict(plate, kind))


def fits_type(plate: Column, plate_type: Column) -> Column:
    """Whether a plate, as written, has the structure of its type; NULL for a type without one."""
    short = _format_fault(plate, SHORT).isNull()
    return F.when(plate_type.isin("type1", "type1a"), _format_fault(plate, STANDARD).isNull()).when(plate_type == "type1b", short)


def trainable(plate: Column, plate_type: Column) -> Column:
    return (text_or_empty(plate) != "") & (F.instr(text_or_empty(plate), V.HIDDEN) == 0) & (plate_type != "other")


def characters(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), ""), lambda x: x != "")


def mask_positions(plate: Column, hidden: Column) -> Column:
    """The plate with # at the hidden positions, counted from 0."""
    return F.array_join(F.transform(characters(plate), lambda x, i: F.when(F.array_contains(hidden, i), V.HIDDEN).otherwise(x)), "")


def mask_unconfident(plate: Column, scores: Column, least: float) -> Column:
    """# where a character's score is below least; NULL if there are not as many scores as characters."""
    masked = F.zip_with(characters(plate), scores, lambda x, s: F.when(s < least, V.HIDDEN).otherwise(x))
    return F.when(F.size(characters(plate)) == F.size(scores), F.array_join(masked, ""))


def encode(plate: Column, alphabet: str, longest: int = 9) -> Column:
    """1-based places in the alphabet; NULL for a character outside it or a plate too long."""
    places = F.transform(characters(plate), lambda x: F.instr(F.lit(alphabet), x))
    return F.when((F.size(places) <= longest) & ~F.array_contains(places, 0), places)


def decode(codes: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(codes, lambda i: F.substring(F.lit(alphabet), i, F.lit(1))), "")


# --- URLs, markup, notes ---------------------------------------------------


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def url_path(url: Column) -> Column:
    return text_or_empty(F.try_parse_url(url, F.lit("PATH")))


def url_title(url: Column) -> Column:
    return F.replace(unquoted(path_name(url_path(url))), F.lit("_"), F.lit(" "))


def url_filename(url: Column) -> Column:
    """The decoded last path part, made safe to write: no separators, drive colons or control characters."""
    name = F.regexp_replace(unquoted(path_name(url_path(url))), r'[<>:"/\\|?*\x00-\x1F]', "_")
    safe = F.btrim(name, F.lit(" ."))
    return F.when(text_or_empty(safe) == "", "download.bin").otherwise(safe)


def strip_markup(c: Column) -> Column:
    """Characters outside angle brackets, brackets nesting by depth; white space collapsed."""
    step = lambda acc, x: (
        F.when(x == "<", F.struct((acc["depth"] + 1).alias("depth"), acc["out"].alias("out")))
        .when(x == ">", F.struct(F.greatest(acc["depth"] - 1, F.lit(0)).alias("depth"), acc["out"].alias("out")))
        .otherwise(F.struct(acc["depth"].alias("depth"), F.when(acc["depth"] == 0, F.concat(acc["out"], x)).otherwise(acc["out"]).alias("out")))
    )
    # Well-nested text, by far the most, needs no fold: its tags hold no further bracket.
    text = text_or_empty(c)
    nested = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda acc: acc["out"])
    flat = F.regexp_replace(text, "<[^<>]*>", "")
    return collapsed(F.when(F.instr(flat, "<") + F.instr(flat, ">") == 0, flat).otherwise(nested))


def preview(c: Column, most: int = 600) -> Column:
    return stripped(F.substring(text_or_empty(c), 1, most))


def machine_notes(*facts: Column) -> Column:
    """Facts joined by commas; semicolons inside them become commas, as the sink's delimiter is one."""
    return F.replace(F.concat_ws(", ", *facts), F.lit(";"), F.lit(","))
