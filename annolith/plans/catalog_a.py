"""Catalogue: splits, leakage, duplicates, coverage, summaries; each query with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import sequences as Q
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import coverage as C
from ..operators import dedup as D
from ..operators import splits as S
from . import inputs as I

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _score(key: str, seed: int) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || cast({key} as varchar)), 1, 16))::ubigint::double / 18446744073709551616.0)"


def _edges(score: str) -> str:
    a, b = 0.70, 0.70 + 0.15
    return f"case when {score} < {a!r}::double then 'train' when {score} < {b!r}::double then 'val' else 'holdout' end"


_SPLIT_SQL = f"""
WITH s AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {_score('doc_id', 7)}, doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
c AS (SELECT *, least(round_even(n * 0.85::double, 0), n) AS c1 FROM s)
SELECT doc_id, lang, source, CASE WHEN p < c1 THEN 'train' WHEN p < greatest(c1, least(round_even(n * (0.85::double + 0.10::double), 0), n)) THEN 'val' ELSE 'test' END AS split FROM c"""


@query(f"SELECT doc_id, lang, split FROM ({_SPLIT_SQL})")
def stratified_split(spark, sf):
    return S.stratified_split(I.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", ["lang"], 7)


@query(f"SELECT conv_id, {_edges(_score('conv_id', 11))} AS split FROM (SELECT DISTINCT conv_id FROM conversations)")
def group_split(spark, sf):
    groups = I.table(spark, sf, "conversations").select("conv_id").distinct()
    return groups.withColumn("split", S.group_split(F.col("conv_id"), 11))


@query(f"""
WITH frozen AS (SELECT o_orderkey AS image, o_custkey AS grp, {_edges(_score('o_custkey', 5))} AS split FROM orders WHERE o_orderstatus <> 'O'),
g AS (SELECT grp, max(split) AS gs FROM frozen GROUP BY grp)
SELECT o.o_orderkey AS image, o.o_custkey AS "group", coalesce(f.split, g.gs, {_edges(_score('o.o_custkey', 23))}) AS split, f.image IS NOT NULL AS frozen
FROM orders o LEFT JOIN frozen f ON f.image = o.o_orderkey LEFT JOIN g ON g.grp = o.o_custkey""")
def frozen_split_growth(spark, sf):
    orders = I.table(spark, sf, "orders")
    items = orders.select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("group"), F.lit("orders").alias("source"))
    frozen = items.join(orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("image")), "image", "left_semi").select("image", "group", S.group_split(F.col("group"), 5).alias("split"), "source", F.lit("day 1").alias("assigned_on"), F.lit("").alias("note"))
    grown = S.grow_manifest(items, frozen, 23, assigned_on="day 2")
    return grown.select("image", "group", "split", (F.col("assigned_on") == "day 1").alias("frozen"))


@query(f"""
WITH s AS ({_SPLIT_SQL})
SELECT split, 'all' AS dimension, 'all' AS value, count(*) AS n FROM s GROUP BY split
UNION ALL SELECT split, 'lang', lang, count(*) FROM s GROUP BY split, lang
UNION ALL SELECT split, 'source', source, count(*) FROM s GROUP BY split, source""")
def split_crosstab(spark, sf):
    return S.split_crosstab(S.stratified_split(I.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang"], 7), ["lang", "source"])


@query("""SELECT h AS key, count(*) AS n_splits, list_sort(list(source)) AS splits FROM (SELECT DISTINCT sha256(text) AS h, source FROM documents WHERE text IS NOT NULL) GROUP BY h HAVING count(*) > 1""")
def leakage_hash(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), "source")
    return S.spanning(docs, "key", "source")


@query("""SELECT sha256(a.text) AS h, a.doc_id AS first, a.source AS first_split, b.doc_id AS second, b.source AS second_split FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id AND a.source <> b.source""")
def leakage_pairs(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source")
    return S.leaking_pairs(docs, "h", "doc_id", "source")


@query("""SELECT sha256(text) AS h, doc_id AS name, source AS split, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first FROM documents WHERE text IN (SELECT text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1)""")
def leakage_members(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source")
    return S.leaking_members(docs, "h", "doc_id", "source")


@query(f"""WITH s AS (SELECT DISTINCT conv_id, {_edges(_score("conv_id || ':' || turn", 3))} AS split FROM conversations)
SELECT conv_id, count(*) AS n_splits, list_sort(list(split)) AS splits FROM s GROUP BY conv_id HAVING count(*) > 1""")
def leakage_group(spark, sf):
    turns = I.table(spark, sf, "conversations").select("conv_id", S.group_split(F.concat_ws(":", "conv_id", "turn"), 3).alias("split"))
    return S.spanning(turns, "conv_id")


@query("SELECT sha256(text) AS sha256, count(*) AS n, list_sort(list(doc_id)) AS names FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return D.duplicate_groups(I.table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id")


@query("SELECT lang, sha256(string_agg(doc_id || ' ' || sha256(text), chr(10) ORDER BY doc_id || ' ' || sha256(text))) AS digest, count(*) AS n FROM documents GROUP BY lang")
def combined_digest(spark, sf):
    return H.combined_digests(I.table(spark, sf, "documents"), ["lang"], F.concat_ws(" ", "doc_id", F.sha2("text", 256)))


@query("SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id > first")
def first_seen_duplicates(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return D.first_seen(docs, ["h"], "doc_id").select("doc_id", "first")


@query("SELECT d.user_id, d.event_type, max(d.event_id) AS event_id, arg_max(d.value, d.event_id) AS value FROM events d GROUP BY 1, 2")
def keep_last(spark, sf):
    return D.keep_last(I.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT 'unassigned' AS state, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'stale', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_unlabelled(spark, sf):
    return C.coverage(I.table(spark, sf, "documents"), I.table(spark, sf, "labels"), "doc_id")


@query("SELECT 'stale' AS state, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def coverage_orphan(spark, sf):
    docs = I.table(spark, sf, "documents").filter("lang = 'en'")
    return C.coverage(docs, I.table(spark, sf, "labels"), "doc_id").filter("state = 'stale'")


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def coverage_overlap(spark, sf):
    return C.overlap(I.table(spark, sf, "documents").filter("lang = 'en'"), I.table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("""
WITH d AS (SELECT doc_id AS image, lang, source, substr(text, 1, 12) AS plate, sha256(text) AS h, n_chars FROM documents),
syn AS (SELECT image, lang AS split FROM d WHERE image IN (SELECT doc_id FROM labels)), re AS (SELECT image, source AS grp, lang AS split FROM d WHERE image IN (SELECT page_id FROM pages)), m AS (SELECT image, plate, h FROM d WHERE n_chars > 200),
comb AS (SELECT image, 'real:' || split AS split FROM re UNION ALL SELECT image, 'synthetic:' || split FROM syn WHERE image NOT IN (SELECT image FROM re))
SELECT 'in_both' AS "check", count(*) AS n FROM (SELECT image FROM syn INTERSECT SELECT image FROM re)
UNION ALL SELECT 'unassigned', count(*) FROM m WHERE image NOT IN (SELECT image FROM comb)
UNION ALL SELECT 'stale', count(*) FROM comb WHERE image NOT IN (SELECT image FROM m)
UNION ALL SELECT 'plate_spans', count(*) FROM (SELECT trim(plate, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM comb JOIN m USING (image) GROUP BY 1 HAVING count(DISTINCT split) > 1 AND p <> '')
UNION ALL SELECT 'group_spans', count(*) FROM (SELECT grp FROM re WHERE grp IS NOT NULL GROUP BY grp HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'hash_spans', count(*) FROM (SELECT h FROM comb JOIN d USING (image) WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT split) > 1)""")
def split_audit(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("image"), "lang", "source", F.substring("text", 1, 12).alias("plate_num"), F.sha2("text", 256).alias("sha256"), "n_chars")
    named = lambda table, key: I.table(spark, sf, table).select(F.col(key).alias("image")).distinct()
    synthetic = docs.join(named("labels", "doc_id"), "image", "left_semi").select("image", F.col("lang").alias("split"))
    real = docs.join(named("pages", "page_id"), "image", "left_semi").select("image", F.col("source").alias("group"), F.col("lang").alias("split"))
    return C.split_audit(synthetic, real, docs.filter("n_chars > 200").select("image", "plate_num"), docs.select("image", "sha256"))


_Z_SQL = """
WITH e AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) / stddev_pop(v) OVER (PARTITION BY vec_id) AS z FROM e)"""


@query(f"""{_Z_SQL} SELECT a.vec_id AS first, b.vec_id AS second, round(sum(a.z * b.z) / count(*), 6) AS score FROM z a JOIN z b ON a.i = b.i AND a.vec_id < b.vec_id GROUP BY 1, 2 HAVING sum(a.z * b.z) / count(*) >= 0.45""")
def near_duplicates(spark, sf):
    pairs = D.correlated_pairs(I.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.45)
    return pairs.withColumn("score", F.round("score", 6))


@query("SELECT 'i' || p.page_id AS image, p.url, d.source, l.quality FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id LEFT JOIN labels l ON l.doc_id = p.page_id")
def enriched_cards(spark, sf):
    base = I.table(spark, sf, "pages").select(F.concat(F.lit("i"), "page_id").alias("image"), "url")
    docs = I.table(spark, sf, "documents").select(F.concat(F.lit("i"), "doc_id").alias("image"), "source")
    labels = I.table(spark, sf, "labels").select(F.concat(F.lit("i"), "doc_id").alias("image"), "quality")
    return C.enrich(base, docs, labels)


@query("SELECT doc_id AS image FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND doc_id IN (SELECT page_id FROM pages)")
def promotable_images(spark, sf):
    labels, named = I.table(spark, sf, "labels"), lambda d, c: d.select(F.col(c).alias("image"))
    docs = named(I.table(spark, sf, "documents"), "doc_id")
    return C.promotable(docs, named(labels.filter("quality = 1"), "doc_id"), named(labels.filter("toxic = 0"), "doc_id"), named(I.table(spark, sf, "pages"), "page_id"))


@query("SELECT doc_id, FALSE AS clash FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') FROM labels")
def clash_free_union(spark, sf):
    docs = I.table(spark, sf, "documents").filter("lang = 'en'").select("doc_id")
    return C.clash_free_union(docs, I.table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN ['long'] WHEN b.path IS NULL THEN ['english'] ELSE ['english', 'long'] END AS reasons, b.n_chars AS colour
FROM (SELECT doc_id AS path FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id AS path, n_chars FROM documents WHERE n_chars > 3000) b ON a.path = b.path""")
def candidate_merge(spark, sf):
    docs = I.table(spark, sf, "documents")
    shape = docs.filter("lang = 'en'").select(F.col("doc_id").alias("path"), F.array(F.lit("english")).alias("reasons"), F.lit(None).cast("long").alias("colour"))
    colour = docs.filter("n_chars > 3000").select(F.col("doc_id").alias("path"), F.array(F.lit("long")).alias("reasons"), F.col("n_chars").alias("colour"))
    return C.merge_candidates(shape, colour)


@query("SELECT 'documents' AS population, doc_id AS id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'pages', page_id FROM pages")
def manifest_union(spark, sf):
    told = lambda t, c: I.table(spark, sf, t).select(F.lit(t).alias("population"), F.col(c).alias("id"))
    return told("documents", "doc_id").unionByName(told("labels", "doc_id")).unionByName(told("pages", "page_id"))


@query("SELECT doc_id AS image, 'real' AS split FROM labels UNION ALL SELECT doc_id, 'synthetic' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_lookup(spark, sf):
    told = lambda t, s: I.table(spark, sf, t).select(F.col("doc_id").alias("image"), F.lit(s).alias("split"))
    return S.union_lookup(told("labels", "real"), told("documents", "synthetic"), "image")


@query("SELECT 'undeclared' AS state, p_size AS class_id FROM part WHERE p_size > 40 GROUP BY 2 UNION ALL SELECT 'unused', v FROM (SELECT unnest(range(0, 41))::int AS v) WHERE v NOT IN (SELECT p_size FROM part)")
def class_reconciliation(spark, sf):
    declared = spark.range(0, 41).select(F.col("id").cast("int").alias("class_id"))
    return C.reconcile_classes(I.table(spark, sf, "part").select(F.col("p_size").alias("class_id")), declared)


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'root', 'r' || r_regionkey FROM region UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
w AS (SELECT 'root' AS node, 0 AS depth UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node WHERE w.depth < 10) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def url_frontier(spark, sf):
    said = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = (
        I.table(spark, sf, "nation").select(said("r", "n_regionkey").alias("parent"), said("n", "n_nationkey").alias("child"))
        .unionByName(I.table(spark, sf, "region").select(F.lit("root").alias("parent"), said("r", "r_regionkey").alias("child")))
        .unionByName(I.table(spark, sf, "supplier").select(said("n", "s_nationkey").alias("parent"), said("s", "s_suppkey").alias("child")))
    )
    return C.reachable(edges, spark.createDataFrame([("root",)], "node string"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def counts_ordered(spark, sf):
    return A.counted(I.table(spark, sf, "documents"), F.col("source"))


@query("SELECT h AS sha256, doc_id AS name, min(doc_id) OVER (PARTITION BY h) AS first FROM (SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def duplicate_members(spark, sf):
    return D.duplicate_members(I.table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id")


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicates_having(spark, sf):
    return D.duplicate_keys(I.table(spark, sf, "documents").select("text"), "text")


@query("SELECT count(*) AS groups, max(n) AS largest_group FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def largest_group(spark, sf):
    return A.largest_group(I.table(spark, sf, "conversations"), "conv_id")


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS \"column\", min({c}) AS min, quantile_cont({c}, 0.5) AS median, round_even(avg({c}), 1) AS mean, max({c}) AS max FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_discount", "l_tax")))
def dimension_stats(spark, sf):
    return A.numeric_summary(I.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])


@query("WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), s AS (SELECT unnest([0.1, 0.5, 0.9, 0.99]::double[]) AS share) SELECT event_type, share, v[least(n - 1, floor(n * share))::int + 1] AS value FROM v, s")
def nearest_rank_percentiles(spark, sf):
    return A.nearest_rank(I.table(spark, sf, "events"), "value", [0.1, 0.5, 0.9, 0.99], ["event_type"])


@query("WITH v AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m, quantile_cont(value, 0.5) AS md FROM events WHERE value IS NOT NULL) SELECT 'value' AS stage, round(m, 6) AS mean, md AS median, n, v[round_even(0.95 * (n - 1), 0)::int + 1] AS p95 FROM v")
def latency_stats(spark, sf):
    return A.run_stats(I.table(spark, sf, "events"), ["value"]).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, value FROM events WHERE value < 50 ORDER BY value DESC, event_id DESC LIMIT 40")
def topk_below_threshold(spark, sf):
    return A.top_below(I.table(spark, sf, "events").select("event_id", "value"), "value", 50.0, 40, "event_id")


@query("SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def largest_per_group(spark, sf):
    # the SQL takes the first of equal prices as the table has its rows, which are in no order of theirs
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *place)
    return A.largest_per_group(lines, ["l_orderkey"], F.col("l_extendedprice"), "file", "row").drop("file", "row")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents), w AS (SELECT unnest(range(0, 37)) AS i) SELECT doc_id FROM r, w WHERE p = floor(i * (n / 37.0))""")
def strided_subset(spark, sf):
    return S.strided(I.table(spark, sf, "documents").select("doc_id"), "doc_id", 37)


@query(f"SELECT doc_id FROM documents ORDER BY {_score('doc_id', 99)}, doc_id LIMIT 25")
def hash_sample(spark, sf):
    return S.hash_sample(I.table(spark, sf, "documents").select("doc_id"), "doc_id", 25, 99)


@query("""WITH w AS (SELECT event_type, count(*)::double AS weight FROM events GROUP BY 1), e AS (SELECT *, 1000.0 * weight / sum(weight) OVER () AS x FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, event_type) AS rk, 1000 - sum(floor(x)) OVER () AS lft FROM e) SELECT event_type, weight, (floor(x) + CASE WHEN rk <= lft THEN 1 ELSE 0 END)::bigint AS share FROM r""")
def largest_remainder(spark, sf):
    weights = I.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("weight"))
    return S.largest_remainder(weights, "event_type", "weight", 1000)


@query("""WITH c AS (SELECT conv_id, turn, (ascii(upper(substr(text, 1, 1))) % 4)::int AS x FROM conversations WHERE text <> ''), k AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
SELECT conv_id, coalesce(list(x ORDER BY turn) FILTER (x <> 0 AND x IS DISTINCT FROM p), []) AS codes FROM k GROUP BY conv_id""")
def ctc_collapse(spark, sf):
    turns = I.table(spark, sf, "conversations").filter("text <> ''").select("conv_id", "turn", (F.ascii(F.upper(F.substring("text", 1, 1))) % 4).alias("x"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("s")).select("conv_id", F.transform("s", lambda s: s["x"]).alias("xs"))
    return rows.select("conv_id", Q.collapse(F.col("xs")).alias("codes"))


@query("SELECT s_suppkey, array_to_string(list_transform(string_split(s_name, ''), lambda c, i: CASE WHEN i - 1 IN (s_suppkey % 5, s_suppkey % 7) THEN '#' ELSE c END), '') AS masked FROM supplier")
def mask_chars(spark, sf):
    rows = I.table(spark, sf, "supplier")
    return rows.select("s_suppkey", X.mask_positions(F.col("s_name"), F.array((F.col("s_suppkey") % 5).cast("int"), (F.col("s_suppkey") % 7).cast("int"))).alias("masked"))


@query("SELECT user_id, list({'event_id': event_id, 'value': value} ORDER BY event_id) AS samples FROM events GROUP BY user_id")
def samples_per_user(spark, sf):
    return A.samples_per_image(I.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def positions(spark, sf):
    return S.positions(I.table(spark, sf, "documents").select("doc_id"), "doc_id")
