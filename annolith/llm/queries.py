"""One query for each corpus operator, with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    filter_audit,
    license_scan,
    mixing,
    near_dedup,
    pii,
    quality_model,
    quality_rules,
    sharding,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_counts,
)
from .common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(spelling.counted(table(spark, sf_dir, "documents")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_near_dedup, op3_sharding, op4_quality_model, op5_token_counts,
        op6_pii, op7_license_scan, op8_mixing, op9_quality_rules, op10_decontamination, op11_spelling, op12_suffix_dedup, op13_filter_audit,
    )}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
gone AS (SELECT DISTINCT g.doc_id, g.i + k.k AS i FROM g JOIN m USING (s), (SELECT unnest(range(0, 13)) AS k) k WHERE g.doc_id > m.m),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS comp FROM r GROUP BY node),
h AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS h FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, coalesce(c.comp, d.doc_id) = d.doc_id AS kept,
CASE WHEN h.h IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY h.h) END AS class_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id"""

_FOLD = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op7() -> str:
    longest = license_scan.run_lengths(license_scan.TEMPLATES)
    telling = license_scan.telling_words(license_scan.TEMPLATES)
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in sorted(words)) + "]::varchar[]"
    templates = ", ".join(
        "(" + ", ".join([str(k), f"'{label}'", listed(words), str(longest[k]), listed(telling[k][0]), listed(telling[k][1])]) + ")"
        for k, (label, words) in enumerate(license_scan.template_words(license_scan.TEMPLATES))
    )
    phrases = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in license_scan.PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce({_LOWER}, '') AS t FROM documents), t(k, label, words, longest, asked, barred) AS (VALUES {templates}), p(label, words) AS (VALUES {phrases}),
w AS (SELECT doc_id, {_FOLD.format("t")} AS w FROM d),
b AS (SELECT doc_id, i - 1 AS pos, p.label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE list_contains(w, 'license')) x, p WHERE x.w[x.i:x.i + len(p.words) - 1] = p.words),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct({_FOLD.format("line")}) AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT l.doc_id, t.label, len(list_intersect(l.w, t.words))::double / len(t.words) AS share FROM l, t WHERE len(list_intersect(l.w, t.words)) >= {license_scan.CONTAINMENT} * len(t.words) - 1e-9 AND list_has_all(l.w, t.asked) AND NOT list_has_any(l.w, t.barred)),
a AS (SELECT w.doc_id, w.w, t.k FROM w JOIN d USING (doc_id), t WHERE contains(d.t, chr(10)) AND len(list_intersect(list_distinct(w.w), t.words)) >= {license_scan.CONTAINMENT} * len(t.words) - 1e-9),
z AS (SELECT a.doc_id, t.label, len(list_intersect(list_distinct(w[i:i + t.longest - 1]), t.words))::double / len(t.words) AS share FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM a) a JOIN t USING (k) WHERE list_has_all(w[i:i + t.longest - 1], t.asked) AND NOT list_has_any(w[i:i + t.longest - 1], t.barred)),
r AS (SELECT doc_id, label, max(share) AS share FROM z WHERE share >= {license_scan.CONTAINMENT} - 1e-9 GROUP BY 1, 2),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score, count(*) FILTER (whole) AS n FROM (SELECT *, TRUE AS whole FROM m UNION ALL SELECT *, FALSE FROM r) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels, coalesce(met.score, 0) AS score, coalesce(met.n, 0) AS n_blocks_met
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN met ON met.doc_id = w.doc_id"""


OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]|!!')) AS noise, (('0x' || substr(md5(doc_id || ':mix-1'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / (2.0::double - 1.5::double * least(1.0::double, noise::double / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::double AS ss, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS w FROM k GROUP BY source),
v AS (SELECT *, (1.5 * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, ss, CASE WHEN 2 * ss / w <= level THEN 2 * ss ELSE w * max(level) FILTER (2 * ss / w > level) OVER () END AS target FROM v),
c AS (SELECT k.*, t.ss, t.target, CASE WHEN ss > 0 THEN floor(target / ss + 1e-12) ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id) - size AS before FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, ss::bigint AS source_size, round(target, 6) AS target, (epochs * size + greatest(0, least(size, floor(target + 0.5) - epochs * ss - before)))::bigint AS taken, source, key AS draw_key FROM c"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT a.doc_id, b.item_id, n.n AS n_item_shingles, count(*) AS n_shared, round(count(*)::double / n.n, 6) AS containment FROM a JOIN b USING (s) JOIN n USING (item_id) GROUP BY a.doc_id, b.item_id, n.n HAVING count(*) >= 0.75 * n.n - 1e-9"""


OP12 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
c AS (SELECT r, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i <= q + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS q FROM c)),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY r, k),
f AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS before FROM (SELECT r, a, z FROM s UNION ALL SELECT r, n + 1, n + 1 FROM d)),
x AS (SELECT f.r, string_agg(substr(hex(b), 2 * before - 1, 2 * (a - before)), '' ORDER BY a) AS kept, sum(z - a)::bigint AS gone, count(*) - 1 AS spans FROM f JOIN d USING (r) GROUP BY f.r)
SELECT d.doc_id, d.n AS n_bytes, x.gone AS n_removed, x.spans AS n_spans, sha256(unhex(x.kept)) AS kept_sha256 FROM d JOIN x USING (r)"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, len(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS u FROM documents),
m AS (SELECT d.part, (CASE WHEN n < 200 THEN 1 ELSE 0 END) | (CASE WHEN 100 * u < 50 * n THEN 2 ELSE 0 END) | (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END)
  | (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) | (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask, coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::int AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::bigint AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::bigint AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """The others draw hashes, checksums or tokens that SQL does not have: tests hold them against brute force."""
    return {"op1_substring_dedup": OP1, "op2_near_dedup": OP2, "op7_license_scan": _op7(), "op8_mixing": OP8, "op10_decontamination": OP10, "op12_suffix_dedup": OP12, "op13_filter_audit": OP13}
