"""Catalogue: joins over files and reviews, geometry, sequences, files written and read again; each query with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import geometry as G
from ..functions import hashing as H
from ..functions import sequences as Q
from ..functions import text as X
from ..operators import coverage as C
from ..operators import matching as M
from ..operators import metrics as T
from ..operators import rules as R
from ..operators import splits as S
from ..session import shared_dir
from ..sources import files as FS
from ..sources import sinks as K
from ..sources import tables as TB
from ..streaming import counts as ST
from . import inference as N
from . import inputs as I
from .catalog_a import _edges, _score
from .catalog_b import _CLAUSE, _FINDINGS, _IN, _IOU_FULL, _LIC, _REDIS, _REJECTED, _TYPED, _box, row_findings
from .catalog_c import _from, _sql
from .registry import registry

QUERIES, ORACLES, query = registry()


def _fresh(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- files, labels and reviews -------------------------------------------------------

IMAGES = {"path": "concat('img/', cast(o_custkey as varchar(20)), case when o_orderkey % 9 = 0 then '.png' else '.jpg' end)"}
LABELS = {"path": "concat('labels/', cast(c_custkey as varchar(20)), '.txt')"}
_STEM = lambda c: rf"regexp_replace(string_split({c}, '/')[-1], '\.[^.]*$', '')"
_STEMS = f"i AS (SELECT DISTINCT path, {_STEM('path')} AS stem FROM ({_sql('orders', IMAGES)})), l AS (SELECT path, {_STEM('path')} AS stem FROM ({_sql('customer', LABELS)}))"


def _files(spark, sf):
    return _from(spark, sf, "orders", IMAGES).distinct(), _from(spark, sf, "customer", LABELS)


@query(f"WITH {_STEMS}, o AS (SELECT stem, min(path) AS image FROM i GROUP BY stem HAVING count(*) = 1) SELECT o.stem, o.image, l.path AS label FROM o LEFT JOIN l ON l.stem = o.stem")
def stem_pairs(spark, sf):
    return C.pair_by_stem(*_files(spark, sf))


@query(f"""WITH {_STEMS} SELECT DISTINCT 'image_without_label' AS state, stem FROM i WHERE stem NOT IN (SELECT stem FROM l) UNION ALL SELECT DISTINCT 'label_without_image', stem FROM l WHERE stem NOT IN (SELECT stem FROM i)
UNION ALL SELECT 'ambiguous', stem FROM i GROUP BY stem HAVING count(*) > 1""")
def pairing_states(spark, sf):
    return C.pairing_findings(*_files(spark, sf))


@query("""SELECT (SELECT count(*) FROM labels) AS rows, (SELECT count(*) FROM (SELECT page_id FROM pages INTERSECT SELECT doc_id FROM labels)) AS annotated, (SELECT count(DISTINCT page_id) FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)) AS without_rows,
(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)) AS without_image""")
def annotation_state(spark, sf):
    return C.annotation_state(I.table(spark, sf, "pages").select(F.col("page_id").alias("image")), I.table(spark, sf, "labels").select(F.col("doc_id").alias("image")))


REVIEW = {
    "image": "doc_id", "faces_present": "case quality when 1 then 'yes' else 'no' end", "action": "case when doc_id % 5 = 0 then 'none_needed' when doc_id % 5 = 1 then ' Blurred' when doc_id % 5 = 2 then 'rejected' when doc_id % 5 = 3 then 'hidden' else 'covered' end",
    "reviewer": "case when toxic = 1 then ' ' else 'anna' end",
}


@query(f"""WITH r AS (SELECT *, lower(trim(action)) AS a FROM ({_sql('labels', REVIEW)})) SELECT image, 'action ''' || a || ''' is unknown' AS finding FROM r WHERE a NOT IN {_IN(V.PRIVACY_ACTIONS)}
UNION ALL SELECT image, 'faces are present but no action was taken' FROM r WHERE faces_present = 'yes' AND a = 'none_needed' UNION ALL SELECT image, 'no reviewer is named' FROM r WHERE trim(reviewer) = '' UNION ALL SELECT image, 'rejected' FROM r WHERE a = 'rejected'
UNION ALL SELECT doc_id, 'not reviewed' FROM documents WHERE doc_id NOT IN (SELECT image FROM r)""")
def privacy_findings(spark, sf):
    return C.privacy_findings(I.table(spark, sf, "documents").select(F.col("doc_id").alias("image")), _from(spark, sf, "labels", REVIEW))


@query("SELECT d.doc_id AS image, m.known_as FROM documents d JOIN (SELECT text, max(doc_id) AS known_as FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY text) m ON m.text = d.text WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def known_images(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.sha2("text", 256).alias("sha256"))
    labelled = I.table(spark, sf, "labels").select(F.col("doc_id").alias("image"))
    return C.already_known(docs.join(labelled, "image", "left_semi"), docs.join(labelled, "image", "left_anti"))


APPROVED = {"candidate_id": "doc_id", "file_page_url": "concat('https://files.example/wiki/File:P_', cast(doc_id as varchar(20)), '.jpg')", "license": "case when quality = 1 then 'CC BY 4.0' when toxic = 1 then 'CC BY-SA 3.0' else 'cc-zero' end"}
LIVE = {
    "title": "concat('File:P ', cast(page_id as varchar(20)), '.jpg')", "license": "case when page_id % 5 = 0 then '' when page_id % 5 = 1 then 'CC BY-SA 3.0' else 'cc by  4.0' end", "mime": "case when page_id % 7 = 0 then 'image/tiff' else 'image/jpeg' end",
    "restrictions": "case when page_id % 11 = 0 then 'trademark' else ' ' end", "url": "case when page_id % 13 = 0 then '' else url end",
}
_SQUEEZE = lambda c: f"regexp_replace(lower(trim({c})), '[\\s_-]+', '', 'g')"
_ALIASED = lambda c: f"coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in V.LICENSE_ALIASES.items())}}}[{_SQUEEZE(c)}], {_SQUEEZE(c)})"


@query(f"""WITH a AS (SELECT *, 'File:P ' || candidate_id || '.jpg' AS title FROM ({_sql('labels', APPROVED)})), l AS ({_sql('pages', LIVE)}), j AS (SELECT a.candidate_id, a.title, a.license AS was, l.title IS NULL AS gone, l.license AS now, l.mime, l.restrictions, l.url, {_ALIASED('a.license')} <> {_ALIASED('l.license')} AS changed FROM a LEFT JOIN l ON l.title = a.title),
p AS (SELECT *, CASE WHEN gone THEN ['not found at the source now (deleted, renamed, or never resolved)'] ELSE list_filter([CASE WHEN trim(now) = '' THEN 'the source states no licence now' END,
CASE WHEN trim(now) <> '' AND changed THEN 'licence changed at the source: manifest ''' || trim(was) || ''', source ''' || trim(now) || '''' END, CASE WHEN trim(now) <> '' AND NOT changed AND NOT {_REDIS('now')} THEN 'licence ''' || trim(now) || ''' is not redistributable' END,
CASE WHEN mime NOT IN {_IN(V.IMAGE_MEDIA)} THEN 'unexpected media type ''' || mime || '''' END, CASE WHEN trim(restrictions) <> '' THEN 'the source now records a usage restriction: ''' || trim(restrictions) || '''' END, CASE WHEN url = '' THEN 'the source offers no download URL' END], lambda x: x IS NOT NULL) END AS problems FROM j)
SELECT candidate_id, title, problems, CASE WHEN len(problems) = 0 THEN 'VERIFIED' ELSE 'HELD' END AS status FROM p""")
def live_status(spark, sf):
    return C.live_status(_from(spark, sf, "labels", APPROVED), _from(spark, sf, "pages", LIVE)).select("candidate_id", "title", "problems", "status")


@query(f"SELECT o_orderkey, {_ALIASED('l')} AS squeezed FROM (SELECT o_orderkey, {I.META['license']} AS l FROM orders)")
def squeezed_licences(spark, sf):
    return I.meta(spark, sf).select((F.col("line") - 2).alias("o_orderkey"), X.squeezed_license(F.col("license")).alias("squeezed"))


@query(f"SELECT row, rule_id FROM ({_FINDINGS}) WHERE severity = 'error'")
def error_findings(spark, sf):
    return R.ordered(row_findings(spark, sf).withColumn("message", F.col("rule_id")), R.ERROR).select("row", "rule_id")


@query(f"WITH {_TYPED} SELECT line AS row, image_path AS image FROM t WHERE image_path <> '' AND image_path NOT IN (SELECT 'images/real/' || c_custkey || '.jpg' FROM customer)")
def missing_files(spark, sf):
    listed = I.table(spark, sf, "customer").select(F.concat(F.lit("images/real/"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("path"))
    found = R.missing_files(R.typed(I.meta(spark, sf)), listed)
    return found.select("row", F.regexp_extract("message", "'(.*)'", 1).alias("image"))


@query(f"WITH {_TYPED}, n AS (SELECT DISTINCT image_path, CASE WHEN starts_with(image_path, 'images/real/') THEN 'real:train' ELSE 'synthetic:val' END AS split FROM t WHERE starts_with(image_path, 'images/')) SELECT line, coalesce(n.split, '?:?') AS split FROM t LEFT JOIN n USING (image_path)")
def loaded_samples(spark, sf):
    meta = I.meta(spark, sf)
    images = meta.select(X.forward_slashes(F.col("image")).alias("image")).distinct()
    real = images.filter(F.startswith("image", F.lit(V.REAL_PREFIX))).withColumn("split", F.lit("train"))
    synthetic = images.filter(F.startswith("image", F.lit("images/"))).withColumn("split", F.lit("val"))
    return TB.samples(meta, synthetic, real).select("line", "split")


@query(f"SELECT DISTINCT doc_id AS image FROM documents WHERE {_edges(_score('doc_id', 4))} = 'holdout'")
def holdout_images(spark, sf):
    return S.holdout(I.table(spark, sf, "documents").select(F.col("doc_id").alias("image"), S.group_split(F.col("doc_id"), 4).alias("split")))


# --- records -----------------------------------------------------------------------------

RECORD = {
    **{c: "concat('v', cast(o_custkey % 3 as varchar(5)))" for c in V.RECORD_FIELDS}, "source_id": "case when o_orderkey % 7 = 0 then ' ' else 's' end", "stated_license": I.META["license"],
    "redistribution_allowed": "case cast(o_orderkey % 4 as int) when 0 then 'Yes' when 1 then 'no' when 2 then '' else 'perhaps' end", "modification_allowed": "'yes'", "commercial_use_allowed": "case when o_orderkey % 5 = 0 then 'unclear' else 'yes' end",
    "attribution_required": "'yes'", "attribution_text": "case when o_orderkey % 6 = 0 then '' else 'by me' end", "privacy_review": "case cast(o_orderkey % 3 as int) when 0 then 'completed' when 1 then 'in_progress' else 'odd' end",
    "decision": "case cast(o_orderkey % 5 as int) when 0 then 'ACCEPT_FOR_SUBMISSION' when 1 then 'training_only_if_legal' when 2 then 'REJECT' when 3 then 'accept_for_submission' else 'MAYBE' end",
}
_P = "ACCEPT_FOR_SUBMISSION"
_ASKS = {
    "source_id is empty": "trim(source_id) = ''",
    **{f"{n}=* is not one of yes, no, unclear": f"lower(trim({n})) NOT IN ('', 'yes', 'no', 'unclear')" for n in V.PERMISSION_FIELDS},
    **{f"{n} is empty; record 'unclear' rather than leaving it blank": f"trim({n}) = ''" for n in V.PERMISSION_FIELDS},
    "decision=* is not one of " + ", ".join(V.SOURCE_DECISIONS): f"upper(trim(decision)) NOT IN {_IN(V.SOURCE_DECISIONS)}",
    "privacy_review=* is not one of " + ", ".join(V.PRIVACY_STATES): f"lower(privacy_review) NOT IN {_IN(V.PRIVACY_STATES)}",
    **{f"decision {_P} but {n}=*": f"upper(decision) = '{_P}' AND lower(trim({n})) <> 'yes'" for n in V.PERMISSION_FIELDS},
    f"decision {_P} but stated_license is empty": f"upper(decision) = '{_P}' AND trim(stated_license) = ''",
    f"decision {_P} but the license is incompatible": f"upper(decision) = '{_P}' AND {_CLAUSE('stated_license')} IS NOT NULL",
    f"decision {_P} but license * is not recognised as redistributable": f"upper(decision) = '{_P}' AND trim(stated_license) <> '' AND {_CLAUSE('stated_license')} IS NULL AND NOT {_REDIS('stated_license')}",
    f"decision {_P} but attribution is required and attribution_text is empty": f"upper(decision) = '{_P}' AND attribution_text = ''",
    f"decision {_P} but privacy_review=*": f"upper(decision) = '{_P}' AND privacy_review NOT IN ('completed', 'not_required')",
    "decision TRAINING_ONLY_IF_LEGAL but redistribution is allowed": "upper(decision) = 'TRAINING_ONLY_IF_LEGAL' AND lower(redistribution_allowed) = 'yes'",
}


def _said(problems):
    """Problems with quoted values as * and without what follows a colon."""
    return F.transform(problems, lambda p: F.regexp_replace(F.regexp_replace(p, "(?<!record )'[^']*'", "*"), ":.*", ""))


def _asked(rows: str, asks: dict[str, str]) -> str:
    return f"WITH r AS ({rows}) " + " UNION ALL ".join("SELECT '" + k.replace("'", "''") + f"' AS problem, count(*) AS n FROM r WHERE {w} HAVING count(*) > 0" for k, w in asks.items())


@query(_asked(_sql("orders", RECORD), _ASKS))
def record_problems(spark, sf):
    rows = _from(spark, sf, "orders", RECORD)
    return rows.select(F.explode(_said(R.record_problems(rows.columns))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


CANDIDATE = {
    **{c: "concat('v', cast(o_custkey % 3 as varchar(5)))" for c in V.CANDIDATE_FIELDS}, "candidate_id": "case when o_orderkey % 7 = 0 then '' else 'c' end", "license": I.META["license"],
    "redistribution_status": "case cast(o_orderkey % 4 as int) when 0 then 'yes' when 1 then 'no' when 2 then '' else 'maybe' end", "modification_status": "'yes'", "is_real_photo": "case when o_orderkey % 6 = 0 then 'unclear' else 'yes' end",
    "plate_class": "case cast(o_orderkey % 3 as int) when 0 then 'confirmed_type1' when 1 then 'AMBIGUOUS' else 'TRUCK' end", "provenance_status": "case cast(o_custkey % 3 as int) when 0 then 'VERIFIED_ON_SOURCE' when 1 then 'UNKNOWN' else 'guessed' end",
    "decision": "case cast(o_orderkey % 5 as int) when 0 then 'ACCEPT_FOR_SUBMISSION' when 1 then 'PENDING' when 2 then 'later' else 'accept_for_submission' end", "attribution": "case when o_orderkey % 8 = 0 then '' else 'me' end",
    "source_group": "case when o_orderkey % 9 = 0 then ' ' else 'g' end", "license_url": "case when o_orderkey % 10 = 0 then '' else 'u' end",
}
_YES = f"upper(decision) = '{_P}'"
_CASKS = {
    "candidate_id is empty": "candidate_id = ''",
    **{f"{n}=* is not one of yes, no, unclear": f"lower(trim({n})) NOT IN ('', 'yes', 'no', 'unclear')" for n in ("redistribution_status", "modification_status", "is_real_photo")},
    **{f"{n} is empty; record 'unclear' rather than leaving it blank": f"trim({n}) = ''" for n in ("redistribution_status", "modification_status", "is_real_photo")},
    "plate_class=* is not one of " + ", ".join(V.CANDIDATE_CLASSES): f"upper(plate_class) NOT IN {_IN(V.CANDIDATE_CLASSES)}",
    "decision=* is not one of " + ", ".join(V.SOURCE_DECISIONS): f"upper(decision) NOT IN {_IN(V.SOURCE_DECISIONS)}",
    "provenance_status=* is not one of " + ", ".join(V.PROVENANCE_STATES): f"upper(provenance_status) NOT IN {_IN(V.PROVENANCE_STATES)}",
    f"decision {_P} but the licence *": f"{_YES} AND {_CLAUSE('license')} IS NOT NULL",
    f"decision {_P} but license is empty": f"{_YES} AND license = ''",
    f"decision {_P} but the licence * is not on the confirmed redistributable list": f"{_YES} AND license <> '' AND {_CLAUSE('license')} IS NULL AND NOT {_REDIS('license')}",
    f"decision {_P} but license_url is empty": f"{_YES} AND license_url = ''",
    f"decision {_P} but redistribution_status=*": f"{_YES} AND redistribution_status <> 'yes'",
    f"decision {_P} but is_real_photo is not *": f"{_YES} AND is_real_photo <> 'yes'",
    f"decision {_P} but provenance_status=*": f"{_YES} AND provenance_status <> 'VERIFIED_ON_SOURCE'",
    f"decision {_P} but plate_class=*": f"{_YES} AND upper(plate_class) NOT IN {_IN(V.CONFIRMED_CLASSES)}",
    f"decision {_P} and the licence requires credit, but attribution is empty": f"{_YES} AND {_LIC('license')} NOT IN {_IN(V.NO_CREDIT_NEEDED)} AND attribution = ''",
    f"decision {_P} but source_group is empty": f"{_YES} AND trim(source_group) = ''",
}


@query(_asked(_sql("orders", CANDIDATE), _CASKS))
def candidate_problems(spark, sf):
    rows = _from(spark, sf, "orders", CANDIDATE)
    said = F.transform(_said(R.candidate_problems(rows.columns)), lambda p: F.regexp_replace(p, r"(the licence \*) (?!is not).*", "$1"))
    return rows.select(F.explode(said).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


# --- geometry and sequences -----------------------------------------------------------------

_XY = lambda a, b, c: f"(quad_x{b}_n - quad_x{a}_n) * (quad_y{c}_n - quad_y{b}_n) - (quad_y{b}_n - quad_y{a}_n) * (quad_x{c}_n - quad_x{b}_n)"
_TURNS = [_XY(1, 2, 3), _XY(2, 3, 4), _XY(3, 4, 1), _XY(4, 1, 2)]
_LEN = lambda a, b: f"sqrt((quad_x{b}_n - quad_x{a}_n) ** 2 + (quad_y{b}_n - quad_y{a}_n) ** 2)"
_ASPECT = f"CASE WHEN {_LEN(2, 3)} + {_LEN(4, 1)} > 0 THEN ({_LEN(1, 2)} + {_LEN(3, 4)}) / ({_LEN(2, 3)} + {_LEN(4, 1)}) ELSE 1e300 END"


@query(f"""WITH {_TYPED}, q AS (SELECT *, {_ASPECT} AS ar FROM t WHERE has_quad) SELECT line, ({" AND ".join(f"{x} > 0" for x in _TURNS)}) OR ({" AND ".join(f"{x} < 0" for x in _TURNS)}) AS convex,
least(quad_x1_n, quad_x2_n, quad_x3_n, quad_x4_n) AS x, greatest(quad_y1_n, quad_y2_n, quad_y3_n, quad_y4_n) - least(quad_y1_n, quad_y2_n, quad_y3_n, quad_y4_n) AS h, round(ar, 9) AS aspect, ar < 2.5 AS two_line, CASE WHEN ar >= 3.2 THEN 'one_line' WHEN ar <= 2.4 THEN 'two_line' ELSE 'ambiguous' END AS shape FROM q""")
def quad_shapes(spark, sf):
    rows = R.typed(I.meta(spark, sf)).select("line", "quad").withColumn("a", F.least(G.quad_aspect(F.col("quad")), F.lit(1e300))).withColumn("e", G.quad_extent(F.col("quad"))).withColumn("convex", G.is_convex(F.col("quad")))
    shaped = rows.select("line", "convex", F.col("e.x").alias("x"), F.col("e.h").alias("h"), F.round("a", 9).alias("aspect"), G.is_two_line(F.col("quad")).alias("two_line"), G.shape_flag(F.col("a")).alias("shape"))
    return shaped.filter("x is not null")


_GROWN = "g AS (SELECT image, ordinal, x, y, w, h, greatest(0.0, x - 0.1::double * w) AS cx, greatest(0.0, y - 0.1::double * h) AS cy, least(150.0, x + 1.1::double * w) AS x2, least(90.0, y + 1.1::double * h) AS y2 FROM b)"


@query(f"WITH b AS ({I.BOXES_SQL}), {_GROWN} SELECT image, ordinal, round(x2 - cx, 6) AS w, round(y2 - cy, 6) AS h, round((x - cx) / greatest(x2 - cx, 1e-6), 6) AS u, round((y - cy) / greatest(y2 - cy, 1e-6), 6) AS v, round(x, 6) AS back FROM g")
def crop_boxes(spark, sf):
    rows = I.boxes(spark, sf).withColumn("crop", G.expanded(_box(False), 0.1, F.lit(150.0), F.lit(90.0))).withColumn("inside", G.quad_in_crop(F.array("x", "y"), F.col("crop")))
    back = F.get(G.quad_from_crop(F.col("inside"), F.col("crop")), F.lit(0))
    six = lambda c: F.round(c, 6)
    return rows.select("image", "ordinal", six(F.col("crop.w")).alias("w"), six(F.col("crop.h")).alias("h"), six(F.get("inside", F.lit(0))).alias("u"), six(F.get("inside", F.lit(1))).alias("v"), F.when(F.col("crop.w") > 1e-6, six(back)).otherwise(six(F.col("x"))).alias("back"))


_C, _D = ("p.cx", "p.cy", "p.cw", "p.ch"), ("k.cx", "k.cy", "k.cw", "k.ch")


@query(f"""WITH RECURSIVE b AS ({I.BOXES_SQL}), r0 AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, ordinal) AS rank FROM b WHERE score > 0.2), r AS (SELECT image, ordinal, rank, least(100.0, greatest(0.0, px)) AS cx, least(100.0, greatest(0.0, py)) AS cy,
least(100.0, greatest(0.0, px + w)) - least(100.0, greatest(0.0, px)) AS cw, least(100.0, greatest(0.0, py + h)) - least(100.0, greatest(0.0, py)) AS ch FROM r0 WHERE rank <= 4),
o AS (SELECT p.image, p.rank, list(k.rank) FILTER (k.rank IS NOT NULL) AS worse FROM r p LEFT JOIN r k ON k.image = p.image AND k.rank < p.rank AND CASE WHEN k.cw * k.ch + p.cw * p.ch > 0 THEN {_IOU_FULL(_D, _C)} > 0.3 ELSE FALSE END GROUP BY 1, 2),
w AS (SELECT image, 0 AS rank, FALSE AS kept, []::bigint[] AS held FROM (SELECT DISTINCT image FROM r)
UNION ALL SELECT o.image, o.rank, NOT list_has_any(coalesce(o.worse, []), w.held), CASE WHEN list_has_any(coalesce(o.worse, []), w.held) THEN w.held ELSE list_append(w.held, o.rank) END FROM w JOIN o ON o.image = w.image AND o.rank = w.rank + 1),
k AS (SELECT w.image, r.ordinal, r.cx * 2 AS x, r.ch * 0.5::double AS h, row_number() OVER (PARTITION BY w.image ORDER BY w.rank) AS i FROM w JOIN r ON r.image = w.image AND r.rank = w.rank WHERE w.kept) SELECT image, ordinal, x, h FROM k WHERE i <= 2""")
def postprocessed_boxes(spark, sf):
    boxes = M.grouped_boxes(I.boxes(spark, sf), "image", F.col("ordinal"), _box(True), F.col("score"))
    kept = M.postprocessed(boxes, "image", "boxes", 100.0, F.lit(2.0), F.lit(0.5), score=0.2, overlap=0.3, top=4, most=2)
    return kept.select("image", F.explode("kept").alias("k")).select("image", "k.ordinal", F.col("k.box.x").alias("x"), F.col("k.box.h").alias("h"))


@query("SELECT doc_id, (substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS seed FROM (SELECT doc_id, upper(sha256('7:sample:' || doc_id)) AS h FROM documents)")
def derived_seeds(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.lpad(F.conv(H.derived_seed(F.lit(7), F.lit("sample"), F.col("doc_id")).cast("string"), 10, 16), 16, "0").alias("seed"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v) SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 9)) AS p FROM e")
def softmax_values(spark, sf):
    rows = I.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", F.transform(Q.softmax(F.col("v")), lambda x: F.round(x, 9)).alias("p"))


_STEPS = "SELECT conv_id, turn, (ascii(upper(substr(text, 1, 1))) % 4)::int AS code, (length(text) % 100 / 100.0)::double AS score FROM conversations WHERE text <> ''"


@query(f"""WITH c AS (SELECT *, CASE WHEN code IS DISTINCT FROM lag(code) OVER w THEN 1 ELSE 0 END AS fresh FROM ({_STEPS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
b AS (SELECT conv_id, run, min(code) AS code, max(score) AS score FROM r GROUP BY 1, 2) SELECT conv_id, coalesce(list(code ORDER BY run) FILTER (code <> 0), []) AS codes, coalesce(list(score ORDER BY run) FILTER (code <> 0), []) AS scores FROM b GROUP BY 1""")
def best_paths(spark, sf):
    turns = I.table(spark, sf, "conversations").filter("text <> ''").select("conv_id", "turn", (F.ascii(F.upper(F.substring("text", 1, 1))) % 4).cast("int").alias("code"), (F.length("text") % 100 / F.lit(100.0)).alias("score"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "code", "score"))).alias("s"))
    path = Q.best_path(F.transform("s", lambda s: F.struct(s["code"].alias("code"), s["score"].alias("score"))))
    return rows.withColumn("p", path).select("conv_id", F.col("p.code").alias("codes"), F.col("p.score").alias("scores"))


_ALPHABET = "0123456789" + V.PLATE_LETTERS


@query(f"""WITH p AS (SELECT o_orderkey, {I.PLATE} AS p FROM orders), c AS (SELECT *, list_filter(string_split(p, ''), lambda x: x <> '') AS cs FROM p), e AS (SELECT *, list_transform(cs, lambda x: strpos('{_ALPHABET}', x)::int) AS codes FROM c)
SELECT o_orderkey, CASE WHEN len(codes) <= 9 AND NOT list_contains(codes, 0) THEN codes END AS codes, CASE WHEN len(codes) <= 9 AND NOT list_contains(codes, 0) THEN p END AS decoded,
array_to_string(list_transform(cs, lambda x, i: CASE WHEN (o_orderkey * i % 10) / 10.0::double < 0.35 THEN '#' ELSE x END), '') AS masked FROM e""")
def plate_codes(spark, sf):
    rows = I.table(spark, sf, "orders").selectExpr("o_orderkey", f"{I.PLATE} AS p").withColumn("codes", X.encode(F.col("p"), _ALPHABET))
    scores = F.transform(X.characters(F.col("p")), lambda x, i: F.col("o_orderkey") * (i + 1) % 10 / F.lit(10.0))
    return rows.select("o_orderkey", "codes", X.decode(F.col("codes"), _ALPHABET).alias("decoded"), X.mask_unconfident(F.col("p"), scores, 0.35).alias("masked"))


@query("SELECT p_size, round(CASE WHEN p_size < 5 THEN 0.1::double * (p_size + 1) / 5 ELSE 0.05::double * (1 + cos(pi() * (p_size - 5) / 45)) END, 9) AS rate FROM (SELECT DISTINCT p_size FROM part)")
def learning_rates(spark, sf):
    return I.table(spark, sf, "part").select("p_size").distinct().select("p_size", F.round(T.learning_rate(F.col("p_size"), 0.1, 5, 50), 9).alias("rate"))


@query("SELECT doc_id, replace(array_to_string(list_filter([lang, source, CASE WHEN n_chars > 900 THEN 'long; very' END], lambda x: x IS NOT NULL), ', '), ';', ',') AS notes FROM documents")
def machine_notes(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", X.machine_notes(F.col("lang"), F.col("source"), F.when(F.col("n_chars") > 900, "long; very")).alias("notes"))


# --- streams and runs ---------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS \"start\", date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def windowed_counts(spark, sf):
    return ST.windowed_counts(I.table(spark, sf, "events"), "ts", "event_type")


@query(f"SELECT event_id, {_edges(_score('user_id', 6))} AS split FROM events")
def split_stream(spark, sf):
    return ST.split_stream(I.table(spark, sf, "events").select("event_id", "user_id"), "user_id", 6).select("event_id", "split")


READINGS = {
    "name": "cast(l_orderkey as varchar(20))", "ordinal": "l_linenumber", "detection": "l_discount * 10", "plate_type": "'type1'", "type_confidence": "1 - l_tax", "text_confidence": "0.9",
    "plate_num": "case when l_linenumber % 3 = 0 then '' else concat('A', lpad(cast(l_partkey % 1000 as varchar(9)), 3, '0'), 'BC77') end", "error": "case when l_quantity > 48 then 'ValueError: odd' end",
}


@query(f"""WITH r AS ({_sql('lineitem', READINGS)}) SELECT count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL) AS readings, count(*) FILTER (error IS NULL AND plate_num <> '' AND least(1.0, greatest(0.0, detection * type_confidence * 0.9::double)) >= 0.3) AS records FROM r""")
def run_counters(spark, sf):
    readings = _from(spark, sf, "lineitem", READINGS)
    return N.run_counters(readings, N.records(readings, 0.3))


# --- written and read again ----------------------------------------------------------------------

@query(f"SELECT {', '.join(V.META_COLUMNS)}, 20 AS cell_count FROM ({I.META_SQL})")
def meta_round_trip(spark, sf):
    """Annotation rows as a delimited file of many parts, each with its header."""
    place = _fresh(spark, "meta")
    I.meta(spark, sf).select(*V.META_COLUMNS).write.csv(place, sep=";", header=True, emptyValue="", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return TB.read_meta(spark, place).select(*V.META_COLUMNS, "cell_count")


@query("SELECT 'img/' || c_custkey || '.jpg' AS image, c_mktsegment AS \"group\" FROM customer")
def groups_round_trip(spark, sf):
    place = _fresh(spark, "groups")
    rows = I.table(spark, sf, "customer").select(F.concat(F.lit("img\\"), F.col("c_custkey").cast("string"), F.lit(".jpg ")).alias("image"), F.col("c_mktsegment").alias("group"))
    rows.write.csv(place, sep=";", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return TB.read_groups(spark, place)


@query(f"SELECT doc_id::varchar AS image, coalesce(nullif(source, ''), 'no group') AS \"group\", {_edges(_score('doc_id', 8))} AS split, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(lang, '') END AS source, 'day 1' AS assigned_on, CASE WHEN doc_id % 3 = 0 THEN 'a; \"b\"' ELSE '' END AS note FROM documents")
def manifest_round_trip(spark, sf):
    place = _fresh(spark, "manifest")
    docs = I.table(spark, sf, "documents")
    # blank and missing cells, delimiters and quotes are the sink's to write; the reader refuses a blank group
    group = F.when(F.coalesce("source", F.lit("")) == "", "no group").otherwise(F.col("source"))
    note = F.when(F.col("doc_id") % 3 == 0, 'a; "b"')
    rows = docs.select(F.col("doc_id").cast("string").alias("image"), group.alias("group"), S.group_split(F.col("doc_id"), 8).alias("split"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("source"), F.lit("day 1").alias("assigned_on"), note.alias("note"))
    K.write_manifest(rows, place)
    return TB.read_split_manifest(spark, place).na.fill("")


@query(f"SELECT {', '.join(V.CANDIDATE_FIELDS)} FROM ({_sql('orders', CANDIDATE)})")
def candidates_round_trip(spark, sf):
    place = _fresh(spark, "candidates")
    K.write_candidates(_from(spark, sf, "orders", CANDIDATE), place)
    return TB.read_candidates(spark, place).na.fill("")


@query("SELECT l_orderkey || '.jpg' AS image, 'A' || l_partkey AS plate_num, 'type1' AS plate_type, printf('%.3f', least(1.0, l_discount * 12)) AS confidence FROM lineitem")
def submission_round_trip(spark, sf):
    place = _fresh(spark, "submission")
    text = lambda *p: F.concat(*p)
    rows = I.table(spark, sf, "lineitem").select(text(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("image"), text(F.lit("A"), F.col("l_partkey").cast("string")).alias("plate_num"), F.lit("type1").alias("plate_type"), (F.col("l_discount") * 12).alias("confidence"), F.col("l_linenumber").alias("ordinal"))
    K.write_submission(rows, place)
    return spark.read.csv(place, sep=";", schema="image string, plate_num string, plate_type string, confidence string")


@query("SELECT doc_id::varchar AS image, CASE WHEN doc_id % 5 = 0 THEN coalesce(source, '') WHEN doc_id % 7 = 0 THEN '' ELSE concat_ws(',', lang, source) END AS tags, '' AS human_plate_type FROM documents")
def review_round_trip(spark, sf):
    place = _fresh(spark, "review")
    some = F.col("doc_id") % 7 != 0
    tags = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(None).cast("string"), "source")).when(some, F.array("lang", "source"))
    rows = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("image"), tags.alias("tags"))
    K.write_review(rows, place, ["human_plate_type"])
    return spark.read.csv(place, sep=";", header=True, schema="image string, tags string, human_plate_type string").na.fill("")


@query("""SELECT row_number() OVER (ORDER BY image, l_linenumber, plate_num, confidence) AS line, image || ';' || plate_num || ';type1;' || confidence AS text
FROM (SELECT l_orderkey || '.jpg' AS image, 'A' || l_partkey AS plate_num, l_linenumber, printf('%.3f', least(1.0, l_discount * 12)) AS confidence FROM lineitem)""")
def submission_lines(spark, sf):
    """The lines of the file as they stand in it: its order is compared too."""
    place = _fresh(spark, "submission-lines")
    text = lambda *p: F.concat(*p)
    rows = I.table(spark, sf, "lineitem").select(text(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("image"), text(F.lit("A"), F.col("l_partkey").cast("string")).alias("plate_num"), F.lit("type1").alias("plate_type"), (F.col("l_discount") * 12).alias("confidence"), F.col("l_linenumber").alias("ordinal"))
    K.write_submission(rows, place)
    return TB.lines_in_order(spark, place)


@query("SELECT user_id::varchar AS image, 'hard' AS difficulty, max(value) AS char_height, (count(*) % 3)::int AS hidden FROM events GROUP BY user_id")
def generation_round_trip(spark, sf):
    place = _fresh(spark, "generation")
    per = I.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("image")).agg(F.max("value").alias("v"), F.count("*").alias("n"))
    hidden = F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.col("n") % 3).cast("int"))
    per.select("image", F.lit("hard").alias("difficulty"), F.struct(F.col("v").alias("min_char_height_px")).alias("geometry"), hidden.alias("hidden_positions"), F.lit(1).alias("other")).write.json(place)
    return TB.read_generation(spark, place)


@query("SELECT l_orderkey::varchar AS image, (l_linenumber - 1)::int AS ordinal, l_discount AS confidence, 'P' || l_partkey AS plate_num, l_quantity AS x FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m, count(DISTINCT l_linenumber) OVER (PARTITION BY l_orderkey) AS d FROM lineitem) WHERE n = m AND d = n")
def predictions_round_trip(spark, sf):
    """Predictions of the orders whose lines are numbered without gaps, as one object a file."""
    place = _fresh(spark, "predictions")
    rows = I.table(spark, sf, "lineitem")
    whole = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"), F.countDistinct("l_linenumber").alias("d")).filter("n = m and d = n").select("l_orderkey")
    detection = F.struct(F.col("l_linenumber").alias("k"), F.struct(F.array("l_quantity", F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.col("l_discount").alias("confidence"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("plate_num")).alias("d"))
    images = rows.join(whole, "l_orderkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(detection)), lambda x: x["d"]).alias("detections")).select(F.col("l_orderkey").cast("string").alias("image"), "detections")
    parts = images.groupBy(F.pmod(F.xxhash64("image"), F.lit(8)).alias("p")).agg(F.collect_list(F.struct("image", "detections")).alias("predictions"))
    parts.select("p", F.to_json(F.struct("predictions", F.lit(0.2).alias("operating_confidence"))).alias("value")).write.partitionBy("p").text(place)
    return TB.read_predictions(spark, place).select("image", "ordinal", "confidence", "plate_num", F.get("bbox", F.lit(0)).alias("x"))


_LINES = "case cast(l_linenumber % 7 as int) when 0 then '# note' when 1 then concat('0 0.5 0.5 0.2 ', cast(l_discount as varchar(9))) when 2 then '1 0.9 0.5 0.4 0.1' when 3 then 'x 0.1 0.1 0.1 0.1' when 4 then '2 0.1 0.1 0.5' when 5 then '0 0.1 0.1 0.5 0.5 0.3 0.9' else '3 0.1 0.1 0.2 1.5' end"


@query(f"""WITH l AS (SELECT l_orderkey AS name, l_linenumber AS line, {_LINES} AS v FROM lineitem), f AS (SELECT *, string_split(v, ' ') AS f FROM l WHERE NOT starts_with(v, '#'))
SELECT name, line, TRY_CAST(f[1] AS int) AS class_id, CASE WHEN len(f) < 5 THEN 'fields' WHEN TRY_CAST(f[1] AS int) IS NULL THEN 'class' WHEN len(list_filter(f[2:], lambda x: x::double > 1.000001)) > 0 THEN 'range' WHEN len(f) = 5 AND f[5]::double <= 0 THEN 'size' WHEN len(f) = 5 AND f[2]::double + f[4]::double / 2 > 1.000001 THEN 'beyond' END AS reason FROM f""")
def yolo_parse(spark, sf):
    rows = I.table(spark, sf, "lineitem").selectExpr("l_orderkey AS name", "l_linenumber AS line", f"{_LINES} AS value")
    said = (
        F.when(F.contains("reason", F.lit("fields")), "fields").when(F.contains("reason", F.lit("is not an integer")), "class").when(F.contains("reason", F.lit("normalised")), "range")
        .when(F.contains("reason", F.lit("positive")), "size").when(F.contains("reason", F.lit("beyond")), "beyond")
    )
    return FS.yolo_lines(rows).select("name", "line", "class_id", said.alias("reason"))


@query("SELECT doc_id, trim(substr(text, 1, 40), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS preview FROM documents WHERE text IS NOT NULL")
def previews(spark, sf):
    return I.table(spark, sf, "documents").filter("text is not null").select("doc_id", X.preview(F.col("text"), 40).alias("preview"))


@query("SELECT l_orderkey AS image, count(*) AS lines FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def label_texts(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").cast("string").alias("line"))
    return K.label_lines(rows, "image", "ordinal", F.col("line")).select("image", F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("SELECT o_custkey, max(o_orderkey) AS line FROM orders GROUP BY o_custkey")
def last_lines(spark, sf):
    return TB.last_wins(I.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("line")), "o_custkey")
