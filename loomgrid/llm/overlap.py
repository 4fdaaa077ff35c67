"""Same or nearly the same records on both sides of a split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.sources.staging import release, stage

PER_TASK = 50_000  # rows of one key that a task takes


@dataclass(frozen=True)
class Nearness:
    """Vectors are near if at least ``common`` fields are numbers in both, and ``num / den`` of those differ by at most ``tolerance``."""

    common: int = 15
    num: int = 4
    den: int = 5
    tolerance: float = 0.05
    width: float = 0.2  # of a cell; at least twice the tolerance, so that a neighbourhood meets at most two cells

    def needed(self, k: int) -> int:
        return -(-self.num * k // self.den)

    def needed_col(self, k: Column) -> Column:
        return F.floor((k * self.num + (self.den - 1)) / F.lit(self.den)).cast("int")


@dataclass(frozen=True)
class Tier:
    """Pairs that lack ``low..high`` fields together are found by shingles of ``size`` fields."""

    size: int
    low: int
    high: int


def tiers(fields: int, near: Nearness) -> list[Tier]:
    """The largest shingles by which no near pair can be missed.

    A pair that lacks M fields, counted for each of the two, has at least
    fields - M in common (and at least ``near.common``, else it is not near), so
    a bounded number of fields does not agree.  Cut into more disjoint shingles
    than that, one shingle agrees as a whole.
    """
    out, low, last = [], 0, 2 * (fields - near.common)
    for size in (4, 3, 2, 1):
        high = low - 1
        while high < last and fields - near.needed(max(near.common, fields - high - 1)) < fields // size:
            high += 1
        if high >= low:
            out.append(Tier(size, low, high))
            low = high + 1
    return out


def _cell(v: Column, near: Nearness, by: float = 0.0) -> Column:
    # values far out share a cell, which only adds candidates
    inside = F.greatest(F.lit(-1e12), F.least(F.lit(1e12), v))
    return F.when(v.isNotNull(), F.floor((inside + by) / near.width))


def _bits(cells: Column, start: int) -> Column:
    """Four bits a field for 16 fields from ``start``: the one of the cell modulo 4, none for NULL."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i * 4 + F.pmod(F.get(cells, i + start), F.lit(4))).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.coalesce(one(i), F.lit(0).cast("long"))))


def _prepared(vectors: DataFrame, fields: int, near: Nearness) -> DataFrame:
    """Numbers lacking, the cell of each value, the first and last cell that a near value may be in, and signatures.

    The signature of an indexed vector has one bit a field, that of a probe a
    bit for each cell that a near value may be in; the bits that both share
    bound the number of fields that agree.
    """
    slack = near.tolerance + 1e-5
    out = vectors.select(
        "vec_id", "vals",
        F.size(F.filter("vals", lambda v: v.isNull())).alias("lacks"),
        F.transform("vals", lambda v: _cell(v, near)).alias("cells"),
        F.transform("vals", lambda v: _cell(v, near, -slack)).alias("first"),
        F.transform("vals", lambda v: _cell(v, near, slack)).alias("last"),
    ).filter(F.col("lacks") <= fields - near.common)
    words = range(0, fields, 16)
    held = [_bits(F.col("cells"), w).alias(f"sig{k}") for k, w in enumerate(words)]
    asked = [_bits(F.col("first"), w).bitwiseOR(_bits(F.col("last"), w)).alias(f"ask{k}") for k, w in enumerate(words)]
    return out.select("*", *held, *asked)


def _shingles(fields: int, size: int, probe: bool) -> Column:
    """Keys of the vector's shingles of ``size`` neighbouring fields; one with a missing field is none.

    An indexed vector has one key a shingle, a probe one for each combination of cells.
    """
    places = F.sequence(F.lit(0), F.lit(fields // size - 1))
    inner = F.sequence(F.lit(0), F.lit(size - 1))

    def key(place: Column, cells: Column) -> Column:
        return F.xxhash64(F.lit(size), place, cells)

    def keys(place: Column) -> Column:
        whole = ~F.exists(F.slice("cells", place * size + 1, size), lambda c: c.isNull())
        if not probe:
            return F.when(whole, F.array(key(place, F.slice("cells", place * size + 1, size))))
        choice = lambda m: F.transform(inner, lambda j: F.when(F.call_function("getbit", m, j) == 1, F.get("last", place * size + j)).otherwise(F.get("first", place * size + j)))
        return F.when(whole, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2**size - 1)), lambda m: key(place, choice(m)))))

    return F.flatten(F.array_compact(F.transform(places, keys)))


def near_pairs(index: DataFrame, probes: DataFrame, fields: int, near: Nearness = Nearness()) -> DataFrame:
    """``index_id, probe_id`` of all near vectors, exactly.

    Both tables have ``vec_id`` (distinct vectors: copies are to be collapsed
    before) and ``vals``, an array of ``fields`` numbers or NULLs.  Vectors with
    fewer than ``near.common`` numbers are near to none.  The index keeps, of
    each vector, its rarest shingles only, as many as could be spoilt and one
    more; probes are filtered by the length of both (numbers they lack), by the
    shingle's position in the order of rarity, and by signature.  What is left
    is verified on all fields.  No partner or candidate is cut off.
    """
    g = fields
    held, asked = stage(_prepared(index, g, near), "held"), stage(_prepared(probes, g, near), "asked")
    n_words = len(range(0, g, 16))
    found: list[DataFrame] = []
    for tier in tiers(g, near):
        heavy = -(-tier.low // 2)  # of two vectors that lack tier.low fields, one lacks half
        sides = [(F.lit(True), F.lit(True))] if tier.low == 0 else [(F.col("lacks") >= heavy, F.lit(True)), (F.col("lacks") < heavy, F.col("lacks") >= heavy)]
        for of_index, of_probes in sides:
            fits = F.col("lacks") <= tier.high
            # with no vector on the side that must lack many fields the tier has no pairs
            if tier.low and (held.filter(of_index & fits).isEmpty() or asked.filter(of_probes & fits).isEmpty()):
                continue
            left = held.filter(of_index & fits).select("vec_id", "lacks", *[f"sig{k}" for k in range(n_words)], F.explode(_shingles(g, tier.size, False)).alias("key"))
            right = asked.filter(of_probes & fits).select("vec_id", "lacks", *[f"ask{k}" for k in range(n_words)], F.explode(_shingles(g, tier.size, True)).alias("key"))
            # written tier by tier, which keeps each plan small
            found.append(stage(_probe(left, right, tier, g, n_words, near).distinct(), "hits"))
    candidates = found[0]
    for hits in found[1:]:
        candidates = candidates.unionByName(hits)
    candidates = candidates.distinct()
    a = held.select(F.col("vec_id").alias("index_id"), F.col("vals").alias("a"))
    b = asked.select(F.col("vec_id").alias("probe_id"), F.col("vals").alias("b"))
    both = candidates.join(a, "index_id").join(b, "probe_id")
    apart = F.filter(F.zip_with("a", "b", lambda x, y: F.round(F.abs(x - y), 5)), lambda x: x.isNotNull())
    both = both.select("index_id", "probe_id", apart.alias("apart"))
    k, agree = F.size("apart"), F.size(F.filter("apart", lambda x: x <= near.tolerance))
    pairs = stage(both.filter((k >= near.common) & (agree * near.den >= k * near.num)).select("index_id", "probe_id"), "near")
    for done in (held, asked, *found):
        release(done)
    return pairs


def split_by_load(left: DataFrame, right: DataFrame, key: str, spread: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_task``, to be joined on key and task: a key of many right rows is shared out over tasks.

    The right rows of such a key are dealt by the hash of ``spread`` and the
    left ones are repeated for each task; other keys have one task.
    """
    heavy = right.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > PER_TASK).select(key, F.ceil(F.col("_n") / PER_TASK).cast("int").alias("_tasks"))
    tasks = F.coalesce("_tasks", F.lit(1))
    left = left.join(heavy, key, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    right = right.join(heavy, key, "left").withColumn("_task", F.pmod(F.xxhash64(spread), tasks).cast("int")).drop("_tasks")
    return left, right


def _probe(left: DataFrame, right: DataFrame, tier: Tier, g: int, n_words: int, near: Nearness) -> DataFrame:
    """Pairs of one tier that pass all filters; a pair may come more than once."""
    # rarity of a shingle is how often it is probed; an index key that no probe has finds nothing
    rarity = right.groupBy("key").agg(F.count("*").alias("often"))
    order = W.partitionBy("vec_id").orderBy("often", "key")
    spoilt = g - near.needed(max(near.common, g - tier.high))
    left = left.join(rarity, "key", "left").withColumn("position", F.row_number().over(order)).filter((F.col("position") <= F.lit(spoilt + 1) - F.col("lacks")) & F.col("often").isNotNull())
    # probes come by key once, for the count and for the join; a key of too many is split by the adaptive skew join
    i, p = left.alias("i"), right.alias("p")
    lack = F.col("i.lacks") + F.col("p.lacks")
    least = near.needed_col(F.greatest(F.lit(near.common), F.lit(g) - lack))
    shared = sum((F.bit_count(F.col(f"i.sig{k}").bitwiseAND(F.col(f"p.ask{k}"))) for k in range(n_words)), F.lit(0))
    on = (F.col("i.key") == F.col("p.key")) & lack.between(tier.low, tier.high) & (F.col("i.position") <= F.lit(g) - least - F.col("i.lacks") + 1) & (shared >= least)
    return i.join(p, on).select(F.col("i.vec_id").alias("index_id"), F.col("p.vec_id").alias("probe_id"))


def split_sides(assignments: DataFrame, entity: str, split: str) -> DataFrame:
    """``entity, side, split`` (distinct): side ``train`` or ``eval``; case and blanks of the split do not matter.

    Every row counts, so an entity may be on both sides; NULL ids and other splits are on none.
    """
    name = F.lower(F.regexp_replace(split, r"\s", ""))
    side = F.when(name == "train", "train").when(name.isin("val", "test"), "eval")
    return assignments.select(F.col(entity).alias("entity"), side.alias("side"), name.alias("split")).filter("entity is not null and side is not null").distinct()


def _ordered(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(F.lit(kind).alias("overlap"), F.least("e", "t").alias("a"), F.greatest("e", "t").alias("b")).distinct()


def cross_split_overlaps(sides: DataFrame, groups: DataFrame, vectors: DataFrame, names: list[str], near: Nearness = Nearness()) -> DataFrame:
    """``overlap, a, b`` with a <= b: ``same`` entity, entities of one ``group``, or near ``vector``.

    ``sides`` as :func:`split_sides` gives them; ``groups`` has ``entity,
    group_entity``; ``vectors`` has ``entity`` and the fields ``names``, several
    rows an entity, NULL entities ignored.  Equal vectors are joined as one and
    only the result lists their entities.
    """
    train = sides.filter("side = 'train'").select("entity").distinct()
    held = sides.filter("side = 'eval'").select("entity").distinct()
    same = held.join(train, "entity").select(F.col("entity").alias("e"), F.col("entity").alias("t"))

    ties = groups.select("entity", "group_entity")
    e, t = held.join(ties, "entity").select(F.col("entity").alias("e"), "group_entity"), train.join(ties, "entity").select(F.col("entity").alias("t"), "group_entity")
    e, t = split_by_load(e, t, "group_entity", "t")
    tied = e.join(t, ["group_entity", "_task"]).filter("e <> t")

    numbers = [F.when(~F.isnan(F.col(n)), F.col(n)).cast("double") for n in names]
    rows = vectors.filter(F.col("entity").isNotNull()).select("entity", F.array(*numbers).alias("vals"))
    rows = rows.join(sides.select("entity").distinct(), "entity", "left_semi")
    text = F.array_join(F.transform("vals", lambda v: v.cast("string")), "|", "")
    rows = stage(rows.withColumn("vec_id", F.sha2(text, 256)), "vectors")
    owners = rows.select("vec_id", "entity").distinct()

    def side(who: DataFrame) -> DataFrame:
        return rows.join(who, "entity", "left_semi").groupBy("vec_id").agg(F.first("vals").alias("vals"))

    pairs = near_pairs(side(held), side(train), len(names), near)
    e = owners.join(held, "entity", "left_semi").select(F.col("vec_id").alias("index_id"), F.col("entity").alias("e"))
    t = owners.join(train, "entity", "left_semi").select(F.col("vec_id").alias("probe_id"), F.col("entity").alias("t"))
    alike = pairs.join(e, "index_id").join(t, "probe_id").filter("e <> t")
    return _ordered(same, "same").unionByName(_ordered(tied, "group")).unionByName(_ordered(alike, "vector"))
