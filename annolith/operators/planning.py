"""Plans of generated datasets: identities by keyed permutation, quotas dealt by rank, and effects drawn under a budget.

Nothing is remembered between rows. A row's identity follows from its number
alone, its random values from its seed and the purpose they serve, so that any
partitioning, retry or growth of the table gives the same plan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.hashing import derived_seed, hash_score
from ..functions.text import once
from .splits import positions

ROUNDS = 6
#: Steps that a number outside the wanted range may walk; above 256 numbers one in sixteen is outside at most, so more are never seen.
WALK = 24


def round_keys(seed: int, name: str) -> list[tuple[int, int]]:
    """An odd multiplier below 2**31 and an addend below 2**46 for each round."""
    digests = [hashlib.sha256(f"{seed}:{name}:{r}".encode()).digest() for r in range(ROUNDS)]
    return [(int.from_bytes(d[:4], "big") >> 1 | 1, int.from_bytes(d[8:14], "big") >> 2) for d in digests]


def feistel(index: Column, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    """A permutation of the numbers 0 to a * b - 1: two digits, each in turn moved by a keyed product of the other."""
    if max(a, b) >= 1 << 26:
        raise ValueError(f"{a} x {b} numbers are too many for products of 64 bits")
    start = F.struct(F.floor(index / b).cast("long").alias("l"), (index % b).cast("long").alias("r"))
    rounds = F.array(*(F.struct(F.lit(factor).cast("long").alias("f"), F.lit(addend).cast("long").alias("c"), F.lit(r % 2 == 0).alias("left")) for r, (factor, addend) in enumerate(keys)))

    # a fold binds what a round has made; as nested columns every round would be written out twice in the next
    def turn(at: Column, k: Column) -> Column:
        moved = F.shiftright((F.when(k["left"], at["r"]).otherwise(at["l"]) * k["f"] + k["c"]).bitwiseAND((1 << 47) - 1), 16)
        return F.struct(F.when(k["left"], (at["l"] + moved) % a).otherwise(at["l"]).alias("l"), F.when(k["left"], at["r"]).otherwise((at["r"] + moved) % b).alias("r"))

    return F.aggregate(rounds, start, turn, lambda at: at["l"] * b + at["r"])


def permuted(index: Column, size: int, seed: int, name: str = "permutation") -> Column:
    """Where a keyed permutation puts index among the numbers 0 to size - 1, by cycle walking: what falls outside is permuted again until it is inside."""
    a = max(1, int(size**0.5))
    a += a * a < size
    b, keys = -(-size // a), round_keys(seed, name)
    first = feistel(index, a, b, keys)
    if a * b == size:
        return first
    walked = F.aggregate(F.array_repeat(F.lit(0), WALK), first, lambda at, _: F.when(at < size, at).otherwise(feistel(at, a, b, keys)))
    return once(walked, lambda at: F.when(at < size, at).otherwise(F.raise_error(F.lit(f"no number below {size} within {WALK} steps")).cast("long")))


# --- identities ----------------------------------------------------------------

#: Structure and region digits: the two digits of the permutation, each a product of the parts in the order in which they are read off.
_L = len(V.PLATE_LETTERS)
SPACES = {
    ("type1", 2): (_L * 999, _L * _L * 99),
    ("type1", 3): (_L * 999, _L * _L * 100 * len(V.LONG_REGION_STARTS)),
    ("type1b", 2): (_L * _L * 99, 999),
}
MILLION = 1_000_000


def _letter(k: Column) -> Column:
    return F.substr(F.lit(V.PLATE_LETTERS), (k % _L + 1).cast("int"), F.lit(1))


def _padded(k: Column, width: int) -> Column:
    return F.lpad(k.cast("string"), width, "0")


def _div(x: Column, y: int) -> Column:
    return F.floor(x / y).cast("long")


def plate_text(code: Column, structure: str, digits: int) -> Column:
    """The plate of a number below the size of its space: every number is another plate, every plate has a number."""
    return once(code, lambda at: _plate_text(at, structure, digits))


def _plate_text(code: Column, structure: str, digits: int) -> Column:
    b = SPACES[structure, digits][1]
    left, right = _div(code, b), code % b
    if structure == "type1b":
        region, series = left % 99 + 1, _div(left, 99)
        return F.concat(_letter(_div(series, _L)), _letter(series), _padded(right + 1, 3), _padded(region, 2))
    number, series = _div(left, _L) + 1, left % _L
    letters = right % (_L * _L)
    region = _div(right, _L * _L)
    long = F.concat(F.substr(F.lit(V.LONG_REGION_STARTS), (_div(region, 100) + 1).cast("int"), F.lit(1)), _padded(region % 100, 2))
    return F.concat(_letter(series), _padded(number, 3), _letter(_div(letters, _L)), _letter(letters), long if digits == 3 else _padded(region + 1, 2))


def identity(index: Column, plate_type: Column, seed: int, long_share: float = V.LONG_REGION_SHARE, repeats: int = 1) -> Column:
    """The index-th plate of its type, each held by `repeats` numbers in a row.

    Numbers of type1 and type1a share one structure and must be numbered together. Of the first n identities of that
    structure floor(n * long_share) have a region of three digits, so that short and long ones are
    numbered without gaps each, and distinct numbers are distinct plates. A number beyond the space is an error, not a repeat.
    """
    share = round(long_share * MILLION)
    j = _div(index, repeats)
    # j * share is exact below 2**53 / share identities, far beyond the space
    longs = lambda k: _div(k * share, MILLION)

    def drawn(k: Column, structure: str, digits: int) -> Column:
        a, b = SPACES[structure, digits]
        inside = F.when((k >= 0) & (k < a * b), k).otherwise(F.raise_error(F.concat(F.lit("no unused plate left at number "), k.cast("string"))).cast("long"))
        return plate_text(feistel(inside, a, b, round_keys(seed, f"{structure}-{digits}")), structure, digits)

    standard = lambda k: F.when(longs(k + 1) > longs(k), drawn(longs(k), "type1", 3)).otherwise(drawn(k - longs(k), "type1", 2))
    return once(j, lambda k: F.when(plate_type.isin("type1", "type1a"), standard(k)).when(plate_type == "type1b", drawn(k, "type1b", 2)))


# --- effects -------------------------------------------------------------------


def stream(seed: Column, purpose: str, n: int) -> list[Column]:
    """n values in [0, 1) of 20 bits for one purpose, 12 at most: what one purpose draws shifts no other's values."""
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), F.lit(purpose)), 256)
    return [F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("long") / F.lit(float(1 << 20)) for k in range(n)]


def drawn_effects(df: DataFrame, seed: str, level: str, levels: dict[str, dict] | None = None, exclusive: tuple[tuple[str, str], ...] = V.EXCLUSIVE_EFFECTS) -> DataFrame:
    """df with `effects`, in pipeline order, and `severity`, their sum.

    Every effect has a draw of its own; of an exclusive pair that is drawn the first stays. They are
    admitted in a random order while the level's number of effects and its budget last: one fold over a row's own list.
    """
    levels = levels or V.EFFECT_LEVELS
    names = list(V.EFFECT_SEVERITY)
    by_level = lambda value: F.create_map(*(x for k, v in levels.items() for x in (F.lit(k), value(v))))[F.col(level)]
    chance = by_level(lambda v: F.array(*(F.lit(float(v["chance"][n])) for n in names)))
    most, budget = by_level(lambda v: F.lit(v["most"])), by_level(lambda v: F.lit(v["budget"]))
    n = len(names)
    df = df.withColumns({"__u": F.array(*stream(F.col(seed), "effects", n)), "__v": F.array(*stream(F.col(seed), "order", n)), "__chance": chance, "__most": most, "__budget": budget})
    hit = lambda k: F.col("__u")[k] < F.col("__chance")[k]
    barred = {names.index(b): names.index(a) for a, b in exclusive}
    on = [hit(k) & ~hit(barred[k]) if k in barred else hit(k) for k in range(n)]
    costs = list(V.EFFECT_SEVERITY.values())
    listed = F.array(*(F.when(on[k], F.struct(F.col("__v")[k].alias("v"), F.lit(k).alias("k"), F.lit(costs[k]).alias("cost"))) for k in range(n)))
    order = F.array_sort(F.filter(listed, lambda s: s.isNotNull()))
    df = df.withColumn("__order", order)
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("cost"))

    def admit(acc: Column, s: Column) -> Column:
        fits = (F.size(acc["kept"]) < F.col("__most")) & (acc["cost"] + s["cost"] <= F.col("__budget"))
        return F.when(fits, F.struct(F.concat(acc["kept"], F.array(s["k"])).alias("kept"), (acc["cost"] + s["cost"]).alias("cost"))).otherwise(acc)

    df = df.withColumn("__kept", F.aggregate("__order", start, admit))
    # without elements there is nothing to take an item from, and the fold's start stands
    named = F.transform(F.array_sort(F.col("__kept.kept")), lambda k: F.get(F.lit(names), k))
    return df.withColumns({"effects": named, "severity": F.col("__kept.cost") / 100}).drop("__u", "__v", "__chance", "__most", "__budget", "__order", "__kept")


# --- the plan ------------------------------------------------------------------


def apportioned(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole shares of total by weight: the rest goes to the largest fractions, ties by the order of the weights."""
    whole = sum(weights.values())
    if whole <= 0 or min(weights.values()) < 0:
        raise ValueError(f"no shares by {weights}")
    exact = {k: total * w / whole for k, w in weights.items()}
    shares = {k: int(x) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: -(exact[k] - shares[k]))[: total - sum(shares.values())]:
        shares[k] += 1
    return shares


def quotas(total: int, classes: dict[str, float], levels: dict[str, float]) -> list[tuple[str, str, int, int]]:
    """(class, level, first, end) of the places that each class and level holds, in order; exact for every class and within it for every level."""
    out, at = [], 0
    for kind, n in apportioned(total, classes).items():
        for level, m in apportioned(n, levels).items():
            out.append((kind, level, at, at + m))
            at += m
    return out


def plan(rows: DataFrame, key: str, seed: int, classes: dict[str, float] | None = None, levels: dict[str, float] | None = None, long_share: float = V.LONG_REGION_SHARE, repeats: int = 1) -> DataFrame:
    """(key, position, sample_seed, plate_type, difficulty, plate_num, effects, severity): what every row of a dataset to be made shall be.

    Rows stand in the order of their hash scores; places in that order are dealt to classes and levels by exact
    quotas and numbered within a structure, so that identities are distinct but for `repeats`. Keys must be unique; a null key counts as one of them.
    """
    placed = positions(rows.select(key).withColumn("__score", F.struct(hash_score(F.coalesce(F.col(key).cast("string"), F.lit("")), seed), key)), "__score").drop("__score")
    held = quotas(rows.count(), classes or V.CLASS_WEIGHTS, levels or V.LEVEL_WEIGHTS)
    place = F.col("position")
    within = lambda value: F.coalesce(*(F.when((place >= a) & (place < z), F.lit(value(kind, level))) for kind, level, a, z in held if z > a), F.lit(None))
    # type1 and type1a stand side by side and are numbered as one structure
    first = {k: min((a for kind, _, a, z in held if (kind == "type1b") == (k == "type1b") and z > a), default=0) for k, *_ in held}
    df = placed.withColumns({"plate_type": within(lambda k, _: k), "difficulty": within(lambda _, level: level), "__first": within(lambda k, _: first[k])})
    df = df.withColumn("sample_seed", derived_seed(F.lit(seed), F.lit("sample"), place))
    df = df.withColumn("plate_num", identity(place - F.col("__first"), F.col("plate_type"), seed, long_share, repeats)).drop("__first")
    return drawn_effects(df, "sample_seed", "difficulty").select(key, "position", "sample_seed", "plate_type", "difficulty", "plate_num", "effects", "severity")


def placements(planned: DataFrame, seed: str = "sample_seed", level: str = "difficulty", kind: str = "plate_type", sizes: tuple[tuple[int, int], ...] = V.IMAGE_SIZES, margin: float = 4.0) -> DataFrame:
    """planned with `width`, `height`, `scale` and `quad`: where a plate of its kind lies in its image, turned and as far away as its level allows.

    Every value has a draw of its own. The middle of three draws falls towards the middle, as Beta(2, 2) does. A plate that is too large for its image is scaled to fit it.
    """
    from ..functions import projective as J

    by_level = lambda name, k: F.create_map(*(x for n, v in V.LEVEL_VIEWS.items() for x in (F.lit(n), F.lit(float(v[name][k])))))[F.col(level)]
    by_kind = lambda k: F.create_map(*(x for n, v in V.PLATE_SIZES.items() for x in (F.lit(n), F.lit(float(v[k])))))[F.col(kind)]
    u = F.array(*stream(F.col(seed), "view", 12))
    between = lambda name, k: by_level(name, 0) + (by_level(name, 1) - by_level(name, 0)) * F.col("__u")[k]
    df = planned.withColumn("__u", u)
    size = F.get(F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for w, h in sizes)), F.floor(F.col("__u")[0] * len(sizes)).cast("int"))
    df = df.withColumns({"__size": size, "__turned": J.seen_corners(by_kind(0), by_kind(1), between("yaw", 1), between("pitch", 2), between("roll", 3), between("px_per_mm", 4), between("distance_ratio", 5))})
    df = df.withColumn("scale", J.fitting_scale(F.col("__turned"), F.col("__size.w"), F.col("__size.h"), margin))
    df = df.withColumn("__fitted", F.transform("__turned", lambda p: p * F.col("scale")))
    middle = lambda k: F.get(F.array_sort(F.slice("__u", k, 3)), F.lit(1))
    placed = J.placed_quad(F.col("__fitted"), F.col("__size.w"), F.col("__size.h"), middle(7), middle(10), margin)
    return df.withColumns({"width": F.col("__size.w").cast("int"), "height": F.col("__size.h").cast("int"), "quad": placed}).drop("__u", "__size", "__turned", "__fitted")
