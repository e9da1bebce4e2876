"""Catalogue: dataset plans, staged-source audits, keyed manifests, ordered files, crowded images; each query with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import intake as N
from ..operators import matching as M
from ..operators import planning as P
from ..operators import settings as ST
from ..operators import splits as S
from ..streaming import manifest as SM
from . import inputs as I
from .catalog_a import _edges, _score
from .catalog_b import _IOU_FULL
from .catalog_c import _from, _sql
from .catalog_d import REVIEW, _fresh
from .registry import registry

QUERIES, ORACLES, query = registry()

# --- plans ---------------------------------------------------------------------------


def _feistel_sql(index: str, a: int, b: int, keys) -> str:
    """A subquery's worth of nested selects would repeat expressions; each round is a column of its own instead."""
    steps = [f"SELECT *, ({index}) // {b} AS l0, ({index}) % {b} AS r0 FROM {{}}"]
    for k, (factor, addend) in enumerate(keys):
        moved = lambda x: f"((({x}) * {factor} + {addend}) & {(1 << 47) - 1}) >> 16"  # noqa: B023, E731
        left, right = (f"(l{k} + ({moved(f'r{k}')})) % {a}", f"r{k}") if k % 2 == 0 else (f"l{k}", f"(r{k} + ({moved(f'l{k}')})) % {b}")
        steps.append(f"SELECT *, {left} AS l{k + 1}, {right} AS r{k + 1} FROM {{}}")
    return steps, f"l{len(keys)}", f"r{len(keys)}"


def _drawn_sql(rows: str, index: str, structure: str, digits: int, seed: int, keep: str) -> str:
    a, b = P.SPACES[structure, digits]
    steps, left, right = _feistel_sql(index, a, b, P.round_keys(seed, f"{structure}-{digits}"))
    source = f"({rows})"
    for s in steps:
        source = f"({s.format(source)})"
    letter = lambda k: f"substr('{V.PLATE_LETTERS}', (({k}) % {P._L} + 1)::int, 1)"
    pad = lambda k, w: f"lpad(({k})::varchar, {w}, '0')"
    if structure == "type1b":
        text = f"{letter(f'({left} // 99) // {P._L}')} || {letter(f'{left} // 99')} || {pad(f'{right} + 1', 3)} || {pad(f'{left} % 99 + 1', 2)}"
    else:
        letters, region = f"({right} % {P._L**2})", f"({right} // {P._L**2})"
        tail = f"substr('{V.LONG_REGION_STARTS}', ({region} // 100 + 1)::int, 1) || {pad(f'{region} % 100', 2)}" if digits == 3 else pad(f"{region} + 1", 2)
        text = f"{letter(f'{left} % {P._L}')} || {pad(f'{left} // {P._L} + 1', 3)} || {letter(f'{letters} // {P._L}')} || {letter(letters)} || {tail}"
    return f"SELECT {keep}, {text} AS plate_num FROM {source}"


def _identities_sql(rows: str, seed: int, keep: str, repeats: int, share: float = V.LONG_REGION_SHARE) -> str:
    """rows: a query with columns plate_type and i, the number within the structure."""
    parts = round(share * P.MILLION)
    numbered = f"SELECT *, (j * {parts}) // {P.MILLION} AS longs, ((j + 1) * {parts}) // {P.MILLION} > (j * {parts}) // {P.MILLION} AS is_long FROM (SELECT *, (i // {repeats})::bigint AS j FROM ({rows}))"
    return " UNION ALL ".join([
        _drawn_sql(f"SELECT * FROM ({numbered}) WHERE plate_type <> 'type1b' AND is_long", "longs", "type1", 3, seed, keep),
        _drawn_sql(f"SELECT * FROM ({numbered}) WHERE plate_type <> 'type1b' AND NOT is_long", "j - longs", "type1", 2, seed, keep),
        _drawn_sql(f"SELECT * FROM ({numbered}) WHERE plate_type = 'type1b'", "j", "type1b", 2, seed, keep),
    ])


_TYPE = "case cast(o_custkey % 3 as int) when 0 then 'type1' when 1 then 'type1a' else 'type1b' end"


@query(_identities_sql(f"SELECT o_orderkey, {_TYPE} AS plate_type, o_orderkey AS i FROM orders", 20260913, "o_orderkey, plate_type", 2))
def plate_identities(spark, sf):
    rows = I.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_TYPE} as plate_type")
    return rows.withColumn("plate_num", P.identity(F.col("o_orderkey"), F.col("plate_type"), 20260913, repeats=2))


_EFFECTS = list(V.EFFECT_SEVERITY)
_PLAN_SEED = 20260913


def _quota_sql(share: str, weights: dict[str, float], total: str, key: str) -> str:
    """Largest-remainder shares of `total` as rows (key, k, n)."""
    rows = ", ".join(f"({k}, '{name}', {w!r}::double)" for k, (name, w) in enumerate(weights.items()))
    whole = repr(sum(weights.values()))
    return f"""SELECT {share}, k, {key}, (floor(x) + CASE WHEN row_number() OVER (PARTITION BY {share} ORDER BY x - floor(x) DESC, k) <= t - sum(floor(x)) OVER (PARTITION BY {share}) THEN 1 ELSE 0 END)::bigint AS n
FROM (SELECT {share}, t, k, {key}, t * w / {whole}::double AS x FROM ({total}), (VALUES {rows}) v(k, {key}, w))"""


def _plan_sql() -> str:
    draws = lambda purpose: "[" + ", ".join(f"('0x' || substr(sha256(sample_seed || ':{purpose}'), {5 * k + 1}, 5))::bigint / 1048576.0::double" for k in range(len(_EFFECTS))) + "]"
    chances = " ".join(f"WHEN '{level}' THEN [{', '.join(f'{v["chance"][e]!r}::double' for e in _EFFECTS)}]" for level, v in V.EFFECT_LEVELS.items())
    limit = lambda name: "CASE difficulty " + " ".join(f"WHEN '{level}' THEN {v[name]}" for level, v in V.EFFECT_LEVELS.items()) + " END"
    barred = {_EFFECTS.index(b): _EFFECTS.index(a) for a, b in V.EXCLUSIVE_EFFECTS}
    on = " ".join(f"WHEN {k + 1} THEN u[{k + 1}] < c[{k + 1}]" + (f" AND NOT u[{barred[k] + 1}] < c[{barred[k] + 1}]" if k in barred else "") for k in range(len(_EFFECTS)))
    costs = str(list(V.EFFECT_SEVERITY.values()))
    identities = _identities_sql("SELECT *, position - CASE WHEN plate_type = 'type1b' THEN (SELECT min(a) FROM q WHERE kind = 'type1b' AND n > 0) ELSE (SELECT min(a) FROM q WHERE kind <> 'type1b' AND n > 0) END AS i FROM p", _PLAN_SEED, "*", 1)
    return f"""
WITH RECURSIVE t AS (SELECT 1 AS one, count(*) AS t FROM customer), k AS ({_quota_sql('one', V.CLASS_WEIGHTS, 'SELECT one, t FROM t', 'kind')}),
q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ck, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS a FROM (SELECT l.*, k.kind FROM ({_quota_sql('ck', V.LEVEL_WEIGHTS, 'SELECT k AS ck, n AS t FROM k', 'level')}) l JOIN k ON k.k = l.ck)),
o AS (SELECT c_custkey, row_number() OVER (ORDER BY {_score('c_custkey', _PLAN_SEED)}, c_custkey) - 1 AS position FROM customer),
p AS (SELECT c_custkey, position, q.kind AS plate_type, q.level AS difficulty, sha256('{_PLAN_SEED}:sample:' || position) AS h FROM o JOIN q ON position >= a AND position < a + n),
i AS (SELECT c_custkey, position, plate_type, difficulty, plate_num, (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::ubigint)::varchar AS sample_seed FROM ({identities})),
e AS (SELECT *, {draws('effects')} AS u, {draws('order')} AS v, CASE difficulty {chances} END AS c, {limit('most')} AS most, {limit('budget')} AS budget FROM i),
x AS (SELECT c_custkey, most, budget, k, ({costs})[k] AS cost, row_number() OVER (PARTITION BY c_custkey ORDER BY v[k], k) AS r FROM (SELECT *, unnest(range(1, {len(_EFFECTS) + 1})) AS k FROM e) WHERE CASE k {on} END),
f AS (SELECT c_custkey, 0 AS r, [0]::bigint[] AS kept, 0 AS cost FROM e UNION ALL
 SELECT x.c_custkey, x.r::int, CASE WHEN len(f.kept) - 1 < x.most AND f.cost + x.cost <= x.budget THEN list_append(f.kept, x.k) ELSE f.kept END, CASE WHEN len(f.kept) - 1 < x.most AND f.cost + x.cost <= x.budget THEN f.cost + x.cost ELSE f.cost END
 FROM f JOIN x ON x.c_custkey = f.c_custkey AND x.r = f.r + 1),
z AS (SELECT c_custkey, max_by(kept, r) AS kept, max_by(cost, r) AS cost FROM f GROUP BY c_custkey)
SELECT e.c_custkey, e.position, e.sample_seed::decimal(20, 0) AS sample_seed, e.plate_type, e.difficulty, e.plate_num, list_transform(list_sort(z.kept[2:]), lambda k: ({_EFFECTS})[k]) AS effects, z.cost / 100.0::double AS severity FROM e JOIN z USING (c_custkey)"""


@query(_plan_sql())
def dataset_plan(spark, sf):
    return P.plan(I.table(spark, sf, "customer"), "c_custkey", _PLAN_SEED)


# --- staged sources and keyed manifests ---------------------------------------------------

_ACTIONS = ", ".join(f"'{x}'" for x in V.PRIVACY_ACTIONS)
_PRIVACY = f"""SELECT image, 'privacy' AS "check", 'action ''' || a || ''' is unknown' AS detail FROM r WHERE a NOT IN ({_ACTIONS})
UNION ALL SELECT image, 'privacy', 'faces are present but no action was taken' FROM r WHERE faces_present = 'yes' AND a = 'none_needed' UNION ALL SELECT image, 'privacy', 'no reviewer is named' FROM r WHERE trim(reviewer) = '' UNION ALL SELECT image, 'privacy', 'rejected' FROM r WHERE a = 'rejected'"""


@query(f"""
WITH s AS (SELECT doc_id AS image, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), d AS (SELECT text, max(doc_id) AS known FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY text),
a AS (SELECT page_id AS image, page_id % 7 = 0 AS synthetic FROM pages), g AS (SELECT doc_id AS image, source AS grp FROM documents), p AS (SELECT page_id AS image, {_edges(_score('page_id', 4))} AS split FROM pages),
r AS (SELECT *, lower(trim(action)) AS a FROM ({_sql('labels', REVIEW)})), u AS (SELECT text, min(image) AS first, count(*) AS n FROM s GROUP BY text)
SELECT image, 'already_in_dataset' AS "check", known::varchar AS detail FROM s JOIN d USING (text) UNION ALL SELECT s.image, 'duplicate', first::varchar FROM s JOIN u USING (text) WHERE n > 1
UNION ALL SELECT image, 'not_annotated', '' FROM s WHERE image NOT IN (SELECT image FROM a) UNION ALL SELECT DISTINCT image, 'annotation_without_image', '' FROM a WHERE image NOT IN (SELECT image FROM s)
UNION ALL SELECT DISTINCT image, 'synthetic_row', '' FROM a WHERE synthetic AND image IN (SELECT image FROM s) UNION ALL SELECT image, 'not_reviewed', '' FROM s WHERE image NOT IN (SELECT image FROM r)
UNION ALL SELECT image, 'no_group', '' FROM s WHERE image NOT IN (SELECT image FROM g WHERE grp <> '') UNION ALL SELECT image, 'no_split', '' FROM s WHERE image NOT IN (SELECT image FROM p) UNION ALL {_PRIVACY}
UNION ALL SELECT NULL, 'group_spans_splits', grp FROM g JOIN p USING (image) WHERE grp <> '' GROUP BY grp HAVING count(DISTINCT split) > 1""")
def staged_source_audit(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("group"))
    pages = I.table(spark, sf, "pages").select(F.col("page_id").alias("image"))
    review = _from(spark, sf, "labels", REVIEW)
    labelled = review.select("image").distinct()
    splits = pages.withColumn("split", S.group_split(F.col("image"), 4))
    staged, dataset = docs.join(labelled, "image", "left_semi").select("image", "sha256"), docs.join(labelled, "image", "left_anti")
    return N.staged_source_audit(staged, dataset, pages.withColumn("is_synthetic", F.col("image") % 7 == 0), review, docs.select("image", "group"), splits)


@query(f"""
WITH frozen AS (SELECT o_orderkey AS image, o_custkey AS grp, {_edges(_score('o_custkey', 5))} AS split FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT grp, max_by(split, image::varchar) AS gs FROM frozen GROUP BY grp)
SELECT o.o_orderkey::varchar AS image, o.o_custkey::varchar AS "group", coalesce(g.gs, {_edges(_score('o.o_custkey', 23))}) AS split, o.o_orderpriority AS source, 'day 2' AS assigned_on, FALSE AS conflict
FROM orders o LEFT JOIN g ON g.grp = o.o_custkey WHERE o.o_orderkey NOT IN (SELECT image FROM frozen)""")
def keyed_manifest(spark, sf):
    orders = I.table(spark, sf, "orders")
    named = lambda df: df.selectExpr("cast(o_orderkey as string) AS image", "cast(o_custkey as string) AS `group`", "o_orderpriority AS source", "o_orderstatus")
    frozen = named(orders).filter("o_orderstatus = 'F'").withColumn("split", S.group_split(F.col("group"), 5))
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf}/orders.parque[t]")  # a pattern, as a stream of one file has no folder to list
    path = _fresh(spark, "keyed-manifest")
    SM.grow_manifest_files(named(stream), f"{path}/rows", f"{path}/state", 23, frozen=frozen.select("image", "group", "split"), assigned_on="day 2")
    return spark.read.schema(SM.ROWS).parquet(f"{path}/rows").select("image", "group", "split", "source", "assigned_on", "conflict")


# --- crowded images -----------------------------------------------------------------------

#: Four images a supplier, of some 150 boxes each.
CROWDS = {
    "image": "l_suppkey * 4 + l_orderkey % 4", "ordinal": "cast(row_number() over (partition by l_suppkey * 4 + l_orderkey % 4 order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_extendedprice) - 1 as int)",
    "x": "cast(l_partkey * 37 % 2500 as double)", "y": "cast(l_orderkey * 53 % 1900 as double)", "w": "cast(60.0 + l_quantity as double)", "h": "cast(30.0 + l_linenumber * 5 as double)", "score": "round(l_discount * 8 + 0.1, 2)",
}
_A, _B = tuple(f"a.{c}" for c in "xywh"), tuple(f"b.{c}" for c in "xywh")


def _crowds(spark, sf):
    rows = _from(spark, sf, "lineitem", CROWDS)
    return M.grouped_boxes(rows, "image", F.col("ordinal"), F.struct(*"xywh"), F.col("score"), "boxes")


@query(f"WITH c AS ({_sql('lineitem', CROWDS)}) SELECT a.image, a.ordinal AS first, b.ordinal AS second, round({_IOU_FULL(_A, _B)}, 9) AS overlap FROM c a JOIN c b ON a.image = b.image AND a.ordinal < b.ordinal WHERE {_IOU_FULL(_A, _B)} >= 0.4")
def crowded_pairs(spark, sf):
    crowds = _crowds(spark, sf)
    pairs = M.close_pairs(crowds.withColumn("other", F.col("boxes")), "image", "boxes", "other", 0.4)
    return pairs.filter("l.ordinal < r.ordinal").select("image", F.col("l.ordinal").alias("first"), F.col("r.ordinal").alias("second"), F.round("overlap", 9).alias("overlap"))


@query(f"""WITH RECURSIVE c AS ({_sql('lineitem', CROWDS)}), b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, ordinal) AS rank FROM c),
o AS MATERIALIZED (SELECT a.image, a.rank, list(b.rank) FILTER (b.rank IS NOT NULL) AS over FROM b a LEFT JOIN b ON b.image = a.image AND b.rank < a.rank AND {_IOU_FULL(_A, _B)} > 0.3 GROUP BY 1, 2),
w AS (SELECT image, 0 AS rank, FALSE AS kept, []::bigint[] AS held FROM (SELECT DISTINCT image FROM b)
UNION ALL SELECT o.image, o.rank, NOT list_has_any(coalesce(o.over, []), w.held), CASE WHEN list_has_any(coalesce(o.over, []), w.held) THEN w.held ELSE list_append(w.held, o.rank) END FROM w JOIN o ON o.image = w.image AND o.rank = w.rank + 1)
SELECT w.image, b.ordinal FROM w JOIN b ON b.image = w.image AND b.rank = w.rank WHERE w.kept""")
def crowded_nms(spark, sf):
    kept = M.suppressed_crowds(_crowds(spark, sf), "image", "boxes", 0.3)
    return kept.select("image", F.explode("kept").alias("b")).select("image", "b.ordinal")


# --- settings -----------------------------------------------------------------------------

#: Settings a customer, with faults of every kind among them.
_GIVEN = {
    "seed": "cast(c_custkey - 20 as varchar(20))", "count": "case when c_custkey % 7 = 0 then '1.5' else '10' end", "supersample": "case when c_custkey % 11 = 0 then '9' when c_custkey % 13 = 0 then 'four' else '4' end",
    "font": "case when c_custkey % 5 = 0 then '\"serif\"' else '\"stroke\"' end", "class_weights.type1": "case when c_custkey % 3 = 0 then '0' else '0.5' end", "class_weights.type1a": "case when c_custkey % 6 = 0 then '-1' else '0' end",
    "difficulties.easy.px_per_mm": "case when c_custkey % 4 = 0 then '[0.5, 0.2]' when c_custkey % 9 = 0 then '[0.01, 0.2]' when c_custkey % 10 = 0 then '[1]' else '[0.2, 0.5]' end",
    "difficulties.hard.min_plate_contrast": "case when c_custkey % 8 = 0 then '1' else '0.99' end", "difficulties.none.max_effects": "'1'", "three_digit_region_probability": "case when c_custkey % 12 = 0 then '1e1' else '3.5e-1' end",
}


def _settings_sql() -> str:
    rules = ", ".join(f"('{r.name}', '{r.kind}', {'NULL' if r.low is None else repr(float(r.low))}::double, {'NULL' if r.high is None else repr(float(r.high))}::double, {r.below}, {r.required})" for r in ST.generator_rules())
    given = " UNION ALL ".join(f"SELECT c_custkey AS config, '{name}' AS name, {value} AS value FROM customer" for name, value in _GIVEN.items())
    number = f"CASE WHEN regexp_matches(value, '{ST.NUMBER}') THEN try_cast(value AS double) END"
    pair = "list_transform(string_split(regexp_extract(value, '^\\[(.*)\\]$', 1), ','), lambda p: try_cast(trim(p) AS double))"
    out = lambda v: f"coalesce({v} < low OR {v} > high OR (below AND {v} = high), FALSE)"
    return f"""
WITH r(name, kind, low, high, below, required) AS (VALUES {rules}), s AS ({given}), j AS (SELECT s.*, r.kind, low, high, below, {number} AS x, {pair} AS p FROM s LEFT JOIN r USING (name)),
f AS (SELECT config, name, CASE WHEN kind IS NULL THEN 'is unknown' WHEN kind = 'pair' THEN CASE WHEN len(p) <> 2 OR p[1] IS NULL OR p[2] IS NULL THEN 'is no pair of numbers' WHEN p[1] > p[2] THEN 'is out of order' WHEN {out('p[1]')} OR {out('p[2]')} THEN 'is outside its bounds' END
 WHEN kind = 'choice' THEN CASE WHEN value <> '"stroke"' THEN 'is none of its choices' END WHEN x IS NULL THEN 'is no number' WHEN kind = 'whole' AND regexp_matches(value, '[.eE]') THEN 'is no whole number' WHEN {out('x')} THEN 'is outside its bounds' END AS finding FROM j)
SELECT config, name, finding FROM f WHERE finding IS NOT NULL UNION ALL SELECT c.config, r.name, 'is missing' FROM (SELECT DISTINCT config FROM s) c, r WHERE required AND NOT EXISTS (SELECT 1 FROM s WHERE s.config = c.config AND s.name = r.name)
UNION ALL SELECT config, 'class_weights', 'has no weight above 0' FROM j WHERE kind = 'weight' GROUP BY config HAVING sum(greatest(coalesce(x, 0), 0)) <= 0"""


@query(_settings_sql())
def setting_findings(spark, sf):
    customers = I.table(spark, sf, "customer")
    given = F.map_from_arrays(F.lit(list(_GIVEN)), F.array(*(F.expr(v) for v in _GIVEN.values())))
    settings = customers.select(F.col("c_custkey").alias("config"), F.explode(given).alias("name", "value"))
    return ST.setting_findings(settings, ST.rule_table(spark, ST.generator_rules()))
