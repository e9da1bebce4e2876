"""Row rules as findings: a rule is a severity, a column, a condition and a message; no rule ever raises.

All rules of a table are one projection: each row makes an array of the
findings that hold, which is exploded. Nothing is shuffled until duplicates are looked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import geometry as G
from ..functions import text as X

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    column: str | None
    when: Column
    message: Column


def _said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), X.text_or_empty(c), F.lit("'"))


def findings(df: DataFrame, rules: list[Rule], row: Column) -> DataFrame:
    """(row, rule_id, severity, column, message): every rule that holds for every row."""
    each = F.array(*(
        F.when(r.when, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.column).cast("string").alias("column"), r.message.alias("message")))
        for r in rules
    ))
    # exploded with its nulls: a filter of the array would be a lambda, and take every rule out of compiled code
    return df.select(row.alias("row"), F.explode(each).alias("f")).filter("f IS NOT NULL").select("row", "f.*")


def problems(rules: list[tuple[Column, Column]]) -> Column:
    """array<string> of the messages whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, m) for c, m in rules)), lambda m: m.isNotNull())


def typed(meta: DataFrame) -> DataFrame:
    """Annotation rows with parsed views: image, flags, box and quad arrays, tags and the background test."""
    boxes = X.numbers(*(F.col(c) for c in V.BBOX_COLUMNS))
    quads = X.numbers(*(F.col(c) for c in V.QUAD_COLUMNS))
    zero = lambda a: F.coalesce(F.forall(a, lambda v: v == 0), F.lit(False))
    df = meta.withColumns({
        "image_path": X.forward_slashes(F.col("image")), "plate": X.stripped(F.col("plate_num")), "kind": X.stripped(F.col("plate_type")),
        "synthetic": X.parse_bool(F.col("is_synthetic")), "bbox": boxes, "quad": quads, "tags": X.split_tags(F.col("conditions")),
        "source_name": X.stripped(F.col("source")), "licence": X.stripped(F.col("license")),
    })
    # Columns of their own, as rules name them more than once.
    df = df.withColumns({"verdict": X.validate_plate(F.col("plate"), F.col("kind")), "licence_clause": X.license_clause(F.col("licence")), "licence_open": X.redistributable(F.col("licence"))})
    df = df.withColumns({"quad_area": G.signed_area(F.col("quad")), "quad_repeated": F.size(F.array_distinct(G.corners(F.col("quad")))) < 4, "quad_off": G.quad_deviation(F.col("quad"), F.col("bbox"))})
    return df.withColumn("is_background", (F.col("kind") == "other") & zero(F.col("bbox")) & zero(F.col("quad")))


def header_findings(columns: list[str]) -> list[tuple[str, str]]:
    """(severity, message) of a header: missing, unknown, repeated, out of order. Row checks need no column missing."""
    out = []
    if missing := [c for c in V.META_COLUMNS if c not in columns]:
        out.append((ERROR, f"missing required column(s): {', '.join(missing)}"))
    if unknown := [c for c in columns if c not in V.META_COLUMNS]:
        out.append((WARNING, f"unrecognised column(s) ignored: {', '.join(unknown)}"))
    if repeated := sorted({c for c in columns if columns.count(c) > 1}):
        out.append((ERROR, f"column(s) declared more than once: {', '.join(repeated)}"))
    if not missing and tuple(columns[: len(V.META_COLUMNS)]) != V.META_COLUMNS:
        out.append((WARNING, "columns are not in the canonical order"))
    return out


def image_rules() -> list[Rule]:
    image, synthetic = F.col("image_path"), F.col("synthetic")
    outside = image.startswith("/") | image.rlike(r"^[A-Za-z]:/") | F.array_contains(F.split(image, "/"), "..")
    real, made = image.startswith(V.REAL_PREFIX), image.startswith(V.SYNTHETIC_PREFIX)
    placed = (image != "") & ~outside
    return [
        Rule("image_empty", ERROR, "image", image == "", F.lit("image path is empty")),
        Rule("image_outside", ERROR, "image", (image != "") & outside, _said("image path ", _quoted(image), " must be relative to the dataset root and stay inside it")),
        Rule("image_prefix", ERROR, "image", placed & ~real & ~made, _said("image path ", _quoted(image), f" must start with '{V.REAL_PREFIX}' or '{V.SYNTHETIC_PREFIX}'")),
        Rule("image_superseded", ERROR, "image", placed & made & X.path_name(image).rlike(r"^syn_\p{Nd}+_\p{Nd}{5}\.jpg$"), _said(_quoted(image), " was written by a superseded generator")),
        Rule("image_real_flag", WARNING, "is_synthetic", placed & real & F.coalesce(synthetic, F.lit(False)), _said(_quoted(image), " is stored as a real image but is_synthetic=true")),
        Rule("image_synthetic_flag", WARNING, "is_synthetic", placed & made & F.coalesce(~synthetic, F.lit(False)), _said(_quoted(image), " is stored as a synthetic image but is_synthetic=false")),
    ]


def plate_rules() -> list[Rule]:
    plate, kind = F.col("plate"), F.col("kind")
    text_type = kind.isin(*V.TEXT_TYPES)
    verdict = F.col("verdict")
    masked = F.instr(plate, V.HIDDEN) > 0
    fits = F.when(kind == "type1b", plate.rlike(X.MASKED["type1b"])).otherwise(plate.rlike(X.MASKED["type1"]))
    generated = F.coalesce(F.col("synthetic"), F.lit(False)) & (plate != "") & text_type
    reason = F.when(masked, F.lit("does not fit the structure even allowing for '#'")).otherwise(verdict["reason"])
    return [
        Rule("type_empty", ERROR, "plate_type", kind == "", F.lit("plate_type is empty")),
        Rule("type_unknown", ERROR, "plate_type", (kind != "") & ~kind.isin(*V.PLATE_TYPES), _said("plate_type ", _quoted(kind), f" is not one of: {', '.join(V.PLATE_TYPES)}")),
        Rule("plate_empty", ERROR, "plate_num", text_type & (plate == ""), _said("plate_num is empty for plate_type ", _quoted(kind))),
        Rule("plate_unreadable", WARNING, "plate_num", plate.rlike("^#+$"), F.lit("every character of plate_num is unreadable")),
        Rule("plate_grammar", ERROR, "plate_num", generated & F.when(masked, ~fits).otherwise(~verdict["is_valid"]), _said("synthetic ", kind, " plate_num ", _quoted(plate), " violates the ", kind, " structure: ", reason)),
    ]


def flag_rules() -> list[Rule]:
    out = []
    for c in V.BOOLEAN_COLUMNS:
        raw = X.stripped(F.col(c))
        out += [
            Rule(f"{c}_empty", ERROR, c, raw == "", F.lit(f"{c} is empty")),
            Rule(f"{c}_unparsable", ERROR, c, (raw != "") & X.parse_bool(raw).isNull(), _said(f"{c}=", _quoted(raw), " is not a boolean")),
        ]
    return out


def tag_rules() -> list[Rule]:
    tags = F.col("tags")
    known = F.array(*(F.lit(c) for c in V.CONDITIONS))
    unknown = F.array_except(tags, known)
    repeated = F.array_sort(F.filter(F.array_distinct(tags), lambda t: F.size(F.filter(tags, lambda u: u == t)) > 1))
    return [
        Rule("tag_unknown", ERROR, "conditions", F.size(unknown) > 0, _said("condition(s) not in the controlled list: ", F.array_join(unknown, ", "))),
        Rule("tag_repeated", WARNING, "conditions", F.size(repeated) > 0, _said("condition(s) repeated: ", F.array_join(repeated, ", "))),
        Rule("tag_day_night", ERROR, "conditions", F.array_contains(tags, "day") & F.array_contains(tags, "night"), F.lit("conditions cannot be both 'day' and 'night'")),
    ]


def provenance_rules(rejected: dict[str, str]) -> list[Rule]:
    """rejected: source to reason."""
    real = ~F.coalesce(F.col("synthetic"), F.lit(False))
    source, licence, clause = F.col("source_name"), F.col("licence"), F.col("licence_clause")
    out = [Rule(f"{c}_blank", WARNING, c, real & (value == ""), F.lit(f"{c} is blank for a real image")) for c, value in zip(V.PROVENANCE_COLUMNS, (source, licence), strict=True)]
    if rejected:
        out.append(Rule("source_rejected", ERROR, "source", real & source.isin(*rejected), _said("source ", _quoted(source), " is rejected: ", F.try_element_at(X.lookup(rejected), source))))
    return [
        *out,
        Rule("license_barred", ERROR, "license", real & (licence != "") & clause.isNotNull(), _said("license ", _quoted(licence), " carries a ", clause, f" clause and cannot be redistributed as part of a {V.DATASET_LICENSE} dataset")),
        Rule("license_unconfirmed", WARNING, "license", real & (licence != "") & clause.isNull() & ~F.col("licence_open"), _said("license ", _quoted(licence), " is not on the confirmed-redistributable list")),
    ]


def geometry_rules() -> list[Rule]:
    """Not for background rows; repeated corners and zero area end the checks of a quad."""
    plate, b, q = ~F.col("is_background"), F.col("bbox"), F.col("quad")
    at = lambda i: F.get(b, F.lit(i))
    repeated, area = F.col("quad_repeated"), F.col("quad_area")
    whole = plate & q.isNotNull() & ~repeated & (area != 0)
    say = lambda v: v.cast("string")
    return [
        Rule("bbox_numeric", ERROR, None, plate & b.isNull(), F.lit(f"bbox columns must all be numeric: {', '.join(V.BBOX_COLUMNS)}")),
        Rule("bbox_origin", ERROR, None, plate & ((at(0) < 0) | (at(1) < 0)), _said("bbox origin (", say(at(0)), ", ", say(at(1)), ") must be non-negative")),
        Rule("bbox_size", ERROR, None, plate & ((at(2) <= 0) | (at(3) <= 0)), _said("bbox size (", say(at(2)), " x ", say(at(3)), ") must be strictly positive")),
        Rule("quad_numeric", ERROR, None, plate & q.isNull(), F.lit(f"quad columns must all be numeric: {', '.join(V.QUAD_COLUMNS)}")),
        Rule("quad_negative", ERROR, None, plate & F.exists(q, lambda v: v < 0), F.lit("quad coordinates must be non-negative")),
        Rule("quad_repeated", ERROR, None, plate & q.isNotNull() & repeated, F.lit("quad has repeated corners")),
        Rule("quad_degenerate", ERROR, None, plate & q.isNotNull() & ~repeated & (area == 0), F.lit("quad is degenerate (zero area)")),
        Rule("quad_counter_clockwise", ERROR, None, whole & (area < 0), F.lit("quad corners are counter-clockwise")),
        Rule("quad_bbox", WARNING, None, whole & (F.col("quad_off") > V.QUAD_TOLERANCE), F.lit("quad extent disagrees with bbox by more than 25% of a side")),
    ]


def width_rule(columns: int) -> Rule:
    return Rule("row_width", ERROR, None, F.col("cell_count") != columns, _said("row has ", F.col("cell_count").cast("string"), f" cell(s), header declares {columns}"))


def meta_rules(rejected: dict[str, str] | None = None) -> list[Rule]:
    return [*image_rules(), *plate_rules(), *flag_rules(), *tag_rules(), *provenance_rules(rejected or {}), *geometry_rules()]


def missing_files(meta: DataFrame, files: DataFrame, line: str = "line") -> DataFrame:
    """Findings for image paths that no file of the listing (path) has."""
    found = meta.filter(F.col("image_path") != "").join(files.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_anti")
    return found.select(F.col(line).alias("row"), F.lit("file_missing").alias("rule_id"), F.lit(ERROR).alias("severity"), F.lit("image").alias("column"), _said("image file ", _quoted(F.col("image_path")), " not found").alias("message"))


def duplicate_findings(meta: DataFrame, line: str = "line") -> DataFrame:
    """Later rows that repeat a row, a plate on one image, or a file name under another path; each told with the first line.

    First places are aggregates of the keys that occur more than once, joined back, so that a blank name or path, however
    common, is one row after each task's own aggregation.
    """
    cells = F.md5(F.concat_ws("\x1f", *(X.stripped(F.col(c)) for c in V.META_COLUMNS)))
    keyed = meta.select(F.col(line).alias("row"), cells.alias("__cells"), "image_path", "plate", X.path_name(F.col("image_path")).alias("__name"))
    several = lambda *by: keyed.groupBy(*by).agg(F.min("row").alias("__first"), F.count("*").alias("__m")).filter("__m > 1").drop("__m")
    paths = keyed.filter("__name <> ''").groupBy("__name").agg(F.min_by("image_path", "row").alias("__path0"), F.min("image_path").alias("__lo"), F.max("image_path").alias("__hi")).filter("__lo <> __hi").drop("__lo", "__hi")
    line_of = F.col("__first").cast("string")
    rule = lambda name, severity, column, when, message: [Rule(name, severity, column, when, message)]
    later = F.col("row") > F.col("__first")
    found = [
        findings(keyed.join(several("__cells"), "__cells"), rule("row_repeated", ERROR, None, later, _said("row is an exact duplicate of line ", line_of)), F.col("row")),
        findings(keyed.join(several("image_path", "plate"), ["image_path", "plate"]), rule("plate_repeated", ERROR, None, later, _said("plate ", _quoted(F.col("plate")), " is annotated twice on ", _quoted(F.col("image_path")), " (first at line ", line_of, ")")), F.col("row")),
        findings(keyed.join(paths, "__name"), rule("name_reused", WARNING, "image", F.col("__path0") != F.col("image_path"), _said("file name ", _quoted(F.col("__name")), " is used by two different paths")), F.col("row")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def ordered(found: DataFrame, severity: str) -> DataFrame:
    """Findings of one severity by row and message; those of no row first."""
    return found.filter(F.col("severity") == severity).orderBy(F.coalesce("row", F.lit(0)), "message")


# --- source records, candidates, live sources -------------------------------


def _cell(name: str) -> Column:
    return X.stripped(F.col(name).cast("string"))


def record_problems(columns: list[str]) -> Column:
    """Everything inconsistent about a source record; columns are those the record table has."""
    have = [c for c in V.RECORD_FIELDS if c in columns]
    cell = lambda n: _cell(n) if n in have else F.lit("")
    decision, privacy, licence = F.upper(cell("decision")), F.lower(cell("privacy_review")), cell("stated_license")
    accepted, clause = decision == V.ACCEPT, X.license_clause(licence)
    gate = f"decision {V.ACCEPT} but "
    out = [(F.lit(n not in have), F.lit(f"missing field '{n}'")) for n in V.RECORD_FIELDS]
    out += [(cell(n) == "", F.lit(f"{n} is empty")) for n in ("source_id", "source_name", "source_reference", "date_checked", "decided_by") if n in have]
    for n in V.PERMISSION_FIELDS:
        value = F.lower(cell(n))
        out += [
            ((value != "") & ~value.isin(*V.PERMISSIONS), _said(f"{n}=", _quoted(value), f" is not one of {', '.join(V.PERMISSIONS)}")),
            (value == "", F.lit(f"{n} is empty; record 'unclear' rather than leaving it blank")),
        ]
    out += [
        (~decision.isin(*V.SOURCE_DECISIONS), _said("decision=", _quoted(decision), f" is not one of {', '.join(V.SOURCE_DECISIONS)}")),
        ((privacy != "") & ~privacy.isin(*V.PRIVACY_STATES), _said("privacy_review=", _quoted(privacy), f" is not one of {', '.join(V.PRIVACY_STATES)}")),
        *((accepted & (F.lower(cell(n)) != "yes"), _said(f"{gate}{n}=", _quoted(cell(n)))) for n in V.PERMISSION_FIELDS),
        (accepted & (licence == ""), F.lit(f"{gate}stated_license is empty")),
        (accepted & clause.isNotNull(), _said(f"{gate}the license is incompatible: ", clause)),
        (accepted & (licence != "") & clause.isNull() & ~X.all_redistributable(licence), _said(f"{gate}license ", _quoted(licence), " is not recognised as redistributable")),
        (accepted & (cell("provenance_evidence") == ""), F.lit(f"{gate}provenance_evidence is empty")),
        (accepted & (cell("license_evidence_url") == ""), F.lit(f"{gate}license_evidence_url is empty")),
        (accepted & (F.lower(cell("attribution_required")) == "yes") & (cell("attribution_text") == ""), F.lit(f"{gate}attribution is required and attribution_text is empty")),
        (accepted & ~privacy.isin("completed", "not_required"), _said(f"{gate}privacy_review=", _quoted(F.when(privacy == "", "empty").otherwise(privacy)))),
        ((decision == "TRAINING_ONLY_IF_LEGAL") & (F.lower(cell("redistribution_allowed")) == "yes"), F.lit("decision TRAINING_ONLY_IF_LEGAL but redistribution is allowed")),
    ]
    return problems(out)


def candidate_problems(columns: list[str]) -> Column:
    """Everything inconsistent about a candidate photograph."""
    have = [c for c in V.CANDIDATE_FIELDS if c in columns]
    cell = lambda n: _cell(n) if n in have else F.lit("")
    decision, provenance, kind, licence = F.upper(cell("decision")), F.upper(cell("provenance_status")), F.upper(cell("plate_class")), cell("license")
    accepted, clause = decision == V.ACCEPT, X.license_clause(licence)
    gate = f"decision {V.ACCEPT} but "
    out = [(F.lit(n not in have), F.lit(f"missing column '{n}'")) for n in V.CANDIDATE_FIELDS]
    out += [(cell(n) == "", F.lit(f"{n} is empty")) for n in ("candidate_id", "source_platform", "file_page_url") if n in have]
    for n in ("redistribution_status", "modification_status", "is_real_photo"):
        value = F.lower(cell(n))
        out += [
            ((value != "") & ~value.isin(*V.PERMISSIONS), _said(f"{n}=", _quoted(value), f" is not one of {', '.join(V.PERMISSIONS)}")),
            (value == "", F.lit(f"{n} is empty; record 'unclear' rather than leaving it blank")),
        ]
    out += [
        ((kind != "") & ~kind.isin(*V.CANDIDATE_CLASSES), _said("plate_class=", _quoted(kind), f" is not one of {', '.join(V.CANDIDATE_CLASSES)}")),
        (~decision.isin(*V.SOURCE_DECISIONS), _said("decision=", _quoted(decision), f" is not one of {', '.join(V.SOURCE_DECISIONS)}")),
        ((provenance != "") & ~provenance.isin(*V.PROVENANCE_STATES), _said("provenance_status=", _quoted(provenance), f" is not one of {', '.join(V.PROVENANCE_STATES)}")),
        (accepted & clause.isNotNull(), _said(f"{gate}the licence ", _quoted(licence), " ", clause)),
        (accepted & (licence == ""), F.lit(f"{gate}license is empty")),
        (accepted & (licence != "") & clause.isNull() & ~X.redistributable(licence), _said(f"{gate}the licence ", _quoted(licence), " is not on the confirmed redistributable list")),
        (accepted & (cell("license_url") == ""), F.lit(f"{gate}license_url is empty")),
        *((accepted & (F.lower(cell(n)) != "yes"), _said(f"{gate}{n}=", _quoted(cell(n)))) for n in ("redistribution_status", "modification_status")),
        (accepted & (F.lower(cell("is_real_photo")) != "yes"), F.lit(f"{gate}is_real_photo is not 'yes'")),
        (accepted & (provenance != "VERIFIED_ON_SOURCE"), _said(f"{gate}provenance_status=", _quoted(provenance))),
        (accepted & ~kind.isin(*V.CONFIRMED_CLASSES), _said(f"{gate}plate_class=", _quoted(kind))),
        (accepted & ~X.normal_license(licence).isin(*V.NO_CREDIT_NEEDED) & (cell("attribution") == ""), F.lit(f"decision {V.ACCEPT} and the licence requires credit, but attribution is empty")),
        (accepted & (cell("source_group") == ""), F.lit(f"{gate}source_group is empty")),
    ]
    return problems(out)


def source_problems(recorded: Column, live: Column) -> Column:
    """Reasons to hold a record back against the live struct (license, mime, restrictions, url); a NULL struct is one reason alone."""
    now, was = X.stripped(live["license"]), X.stripped(recorded)
    changed = X.squeezed_license(was) != X.squeezed_license(now)
    restrictions = X.stripped(live["restrictions"])
    found = problems([
        (now == "", F.lit("the source states no licence now")),
        ((now != "") & changed, _said("licence changed at the source: manifest ", _quoted(was), ", source ", _quoted(now))),
        ((now != "") & ~changed & ~X.redistributable(now), _said("licence ", _quoted(now), " is not redistributable")),
        (~X.text_or_empty(live["mime"]).isin(*V.IMAGE_MEDIA), _said("unexpected media type ", _quoted(live["mime"]))),
        (restrictions != "", _said("the source now records a usage restriction: ", _quoted(restrictions))),
        (X.text_or_empty(live["url"]) == "", F.lit("the source offers no download URL")),
    ])
    return F.when(live.isNull(), F.array(F.lit("not found at the source now (deleted, renamed, or never resolved)"))).otherwise(found)
