"""PII: patterns for direct identifiers, and information-theoretic sanitisation of the terms that reveal them.

Base: emails, IP addresses, payment cards and phone numbers by pattern and check, leftmost
and non-overlapping per kind. Each distinct value found is a protected entity.

Secrets, assigned keys, tokens and passwords and keys of well-known shapes, are direct identifiers of the method's own, kind
`secret`: entities and spans like the base ones, but no part of the base digest.

Method: the runs of letters or digits outside emails are terms, of any length and script. Over the
whole corpus, with N documents, n(e) that hold entity e, n(t) that hold term t
and n(t, e) that hold both, a term tells
    PMI(t; e) = log2(N n(t, e) / (n(t) n(e)))
of the entity's information IC(e) = -log2(n(e) / N). A term seen with the entity in
EVIDENCE documents or more that tells DISCLOSURE of IC(e) or more is a span of
its own, kind `term`, wherever it stands in any text outside direct identifiers; sanitised() removes direct
identifiers and generalises such terms. As n(t, e) is n(e) at most, only terms of at
most N^(1 - DISCLOSURE) n(e)^DISCLOSURE documents can tell so much; no others are paired.

All of it is Spark expressions: positions come from the lengths of the pieces
between matches, prefix-summed in blocks.

Edge cases: null and empty texts have no spans and the hash of the empty
string; repeated rows are documents of their own; null doc_ids are kept; an entity found in every document
tells nothing (IC 0); an empty table gives no rows; extra columns are ignored
by find() and kept by sanitised().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, weighed

#: The fixed patterns, in the form that Java matches without backtracking or recursion.
#: An email's local part begins where the last match ended or after a character that it cannot hold, and so do an
#: address' digits: a start inside a run can match only if the run's own start does.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be worth matching.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_NAMED = r"(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)"
#: What the method adds to the fixed kinds.
SECRET = rf"(?i:{_NAMED})[\x22']?\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_.~-]{{8,}}+[\x22']?|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
SECRET_HINT = rf"(?i:{_NAMED})[\x22']?\x20?[=:]|AKIA|gh[pousr]_|PRIVATE KEY"
DIRECT = (*KINDS, "secret")
TERM = r"[\p{L}\p{N}]++"
RUN_END = r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])"

EVIDENCE = 2
DISCLOSURE = 0.9
BLOCK = 256

SPAN = "array<struct<start:int,end:int,value:string>>"


def _prefix_sums(lengths: Column) -> Column:
    """Inclusive sums of an array column that must be materialised; blocks keep the copying linear in practice."""
    block = lambda s: F.aggregate(
        F.slice(lengths, s + 1, BLOCK), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )
    blocks = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK)), block)
    offsets = F.transform(blocks, lambda b: F.element_at(b, -1))
    before = F.aggregate(offsets, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(before) - 1), lambda b, o: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x: x + o)))


def with_spans(df: DataFrame, text: Column, pattern: str | Column, out: str, when: Column) -> DataFrame:
    """df with `out`: the matches of pattern in text with code point places, empty unless `when`."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    hit, lengths, ends = f"__{out}_m", f"__{out}_l", f"__{out}_e"
    none = F.array().cast("array<int>")
    df = df.withColumn(hit, F.when(when, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = F.size(hit) > 0
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hit))
    df = df.withColumn(lengths, F.when(some, F.zip_with(pieces, F.col(hit), lambda p, m: F.length(p) + F.length(m))).otherwise(none))
    df = df.withColumn(ends, F.when(some, _prefix_sums(F.col(lengths))).otherwise(none))
    spans = F.zip_with(F.col(ends), F.col(hit), lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    return df.withColumn(out, F.when(some, spans).otherwise(F.array().cast(SPAN))).drop(hit, lengths, ends)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.element_at(F.array(*(F.lit(k) for k in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digit(i) + 1)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        # leading zeros do not count towards the three digits that a part may have
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).isin(0, 1, 2) | ((F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255")))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15)


def _checker(kind: str):
    return lambda span: _valid(kind, span)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a column of valid spans for each kind, secrets included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = with_spans(docs, text, SECRET, "secret", text.rlike(SECRET_HINT))
    for kind, pattern in KINDS.items():
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        df = with_spans(df, text, pattern, kind, hint)
        df = df.withColumn(kind, F.when(F.size(kind) > 0, F.filter(F.col(kind), _checker(kind))).otherwise(F.col(kind)))
    return df


def _forms() -> Column:
    """The terms of the column text as they are written; those of emails are none."""
    bare = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", KINDS["email"], " ")).otherwise(F.col("text"))
    return F.regexp_extract_all(bare, F.lit(TERM), F.lit(0))


def _terms() -> Column:
    """The distinct terms of the column text, lower-cased."""
    return F.array_distinct(F.transform(_forms(), F.lower))


def _holders() -> list[Column]:
    """The documents of a group in number and as 128 bits that tell one set of them from another. The group has each document once."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64("__row")).alias("s1"), F.bit_xor(F.xxhash64("__row", F.lit(1))).alias("s2")]


def disclosing(base: DataFrame, disclosure: float = DISCLOSURE, evidence: int = EVIDENCE) -> DataFrame:
    """(term, tells): terms that tell `disclosure` or more of some entity's information, and the most that they tell; base has __row, text and the kinds."""
    named = lambda k: lambda s: F.concat(F.lit(k + ":"), s["value"])
    held = base.select("__row", F.explode(F.array_distinct(F.concat(*(F.transform(F.col(k), named(k)) for k in DIRECT)))).alias("entity"))
    # an entity of fewer documents than the evidence asks for has no terms
    of_entity = staged(held.groupBy("entity").agg(*_holders()).filter(F.col("n") >= evidence).toDF("entity", "n_e", "e1", "e2"), "entities")
    most = of_entity.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    held = staged(held.join(weighed(of_entity), "entity").select("__row", "n_e", "e1", "e2").distinct(), "held-entities")
    rows = float(base.count())
    bound = lambda n_e: F.lit(rows ** (1 - disclosure) * (1 + 1e-9)) * F.pow(n_e, F.lit(disclosure))
    of_term = base.select("__row", F.explode(_terms()).alias("term")).groupBy("term").agg(*_holders()).toDF("term", "n_t", "t1", "t2")
    of_term = staged(of_term.filter((F.col("n_t") >= evidence) & (F.col("n_t") <= bound(F.lit(most).cast("double")))), "term-counts")
    holders = staged(held.select("__row").distinct(), "entity-holders")
    seen = base.join(weighed(holders), "__row", "left_semi").select("__row", F.explode(_terms()).alias("term"))
    seen = staged(seen.join(weighed(of_term), "term").select("__row", "n_t", "t1", "t2").distinct(), "rare-terms")
    pairs = seen.join(held, "__row").filter(F.col("n_t") <= bound(F.col("n_e"))).groupBy("e1", "e2", "t1", "t2", "n_e", "n_t").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= evidence)
    pmi = F.log2(F.lit(rows) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    content = -F.log2(F.col("n_e") / F.lit(rows))
    told = pairs.withColumn("tells", F.when(content > 0, pmi / content).otherwise(F.lit(0.0))).filter(F.col("tells") >= disclosure)
    told = staged(told.groupBy("t1", "t2", "n_t").agg(F.max("tells").alias("tells")), "telling-sets")
    return of_term.join(weighed(told), ["t1", "t2", "n_t"]).select("term", "tells")


def _term_spans(base: DataFrame, told: DataFrame) -> DataFrame:
    """(__row, term): the sorted spans of told terms of the texts that have any, outside direct identifiers.

    Every run of such a text is placed once, whatever the number of told terms.
    """
    texts = base.select("__row", F.explode(_terms()).alias("term")).join(weighed(told), "term", "left_semi").select("__row").distinct()
    texts = staged(texts, "told-texts")
    # a text is cut behind every run, and the lengths of the pieces are summed over the exploded rows
    pieces = base.join(weighed(texts), "__row", "left_semi").select("__row", F.posexplode(F.split(F.coalesce("text", F.lit("")), RUN_END)).alias("k", "piece"))
    sized = pieces.select("__row", "k", F.length("piece").alias("length"), F.regexp_extract("piece", f"{TERM}$", 0).alias("run"))
    placed = sized.withColumn("end", F.sum("length").over(W.partitionBy("__row").orderBy("k").rowsBetween(W.unboundedPreceding, 0)).cast("int")).filter("run <> ''")
    runs = placed.select("__row", (F.col("end") - F.length("run")).alias("start"), "end", F.lower("run").alias("term"))
    runs = runs.join(weighed(told), "term", "left_semi").select("__row", "start", "end", F.col("term").alias("value"))
    direct = base.join(weighed(texts), "__row", "left_semi").select("__row", F.explode(F.concat(*DIRECT)).alias("s")).select("__row", "s.start", "s.end", F.lit(None).cast("string").alias("value"))
    # in order of places, a run meets a direct identifier if one that began before ends after its start, or the next one begins before its end
    is_direct = F.col("value").isNull()
    on, back = W.partitionBy("__row").orderBy("start", is_direct.desc()), W.partitionBy("__row").orderBy(F.col("start").desc(), is_direct)
    placed = runs.unionByName(direct).select("*", F.max(F.when(is_direct, F.col("end"))).over(on.rowsBetween(W.unboundedPreceding, 0)).alias("reach"), F.last(F.when(is_direct, F.col("start")), True).over(back.rowsBetween(W.unboundedPreceding, 0)).alias("next"))
    free = placed.filter(~is_direct & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    return free.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("term"))


def _all_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """__row, doc_id, the direct kinds and `term`, a sorted array of spans that disclose; `keep` names columns to carry."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    base = staged(base_spans(plain).withColumn("__row", F.monotonically_increasing_id()), "direct-identifiers")
    told = staged(disclosing(base).select("term"), "disclosing-terms")
    terms = staged(_term_spans(base, told), "term-spans")
    return base.join(weighed(terms), "__row", "left").withColumn("term", F.coalesce("term", F.array().cast(SPAN)))


def _told(kinds: tuple[str, ...]) -> Column:
    named = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))
    parts = F.concat(*(F.transform(F.col(k), named(k)) for k in kinds))
    return F.array_join(parts, ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans, n_term, n_secret, and n_direct of all kinds but terms."""
    df = _all_spans(docs)
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in KINDS)
    return df.select(
        "doc_id", *counts, F.sha2(_told(tuple(KINDS)), 256).alias("base_sha256"), _told((*DIRECT, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"),
        F.size("secret").cast("long").alias("n_secret"), sum((F.size(k) for k in DIRECT), F.lit(0)).cast("long").alias("n_direct"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with direct identifiers replaced by their kind and disclosing terms by <TERM>, in place."""
    names = docs.columns
    inner = docs.select("doc_id", "text", F.struct(*(F.col(c) for c in names)).alias("__all"))
    df = _all_spans(inner, keep=("__all",))
    marked = lambda k: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(f"<{k.upper()}>").alias("as"))
    spans = F.array_sort(F.concat(*(F.transform(F.col(k), marked(k)) for k in (*DIRECT, "term"))))
    df = df.withColumn("__spans", spans).withColumn("__text", F.col("__keep___all")["text"])
    # Overlapping spans merge into the first one.
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], -s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"]), s["as"]).alias("out"), (-s["end"]).alias("at"))
    )
    folded = F.aggregate("__spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, F.length("__text"))))
    clean = F.when(F.size("__spans") > 0, folded).otherwise(F.col("__text"))
    return df.withColumn("__clean", clean).select(*(F.col("__clean").alias("text") if c == "text" else F.col("__keep___all")[c].alias(c) for c in names))
