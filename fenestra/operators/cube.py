"""The closed cube over severity, component and role; its collapse to a budget; borders between two windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CUBE_BUDGET, ERROR, KEYS
from ..sources.shared import materialise

DIMS = ["level", "component", "role"]


def base(events: DataFrame) -> DataFrame:
    """The joint count of (level, component, role); a null component is an unlocated event."""
    return events.groupBy(*KEYS, *DIMS).agg(F.count("*").alias("count"))


def cells(joint: DataFrame, keys: list[str] = KEYS, dims: list[str] = DIMS) -> DataFrame:
    """Every generalisation of the joint: starred dimensions are null, ``pinned`` has a bit per pinned one, ``closed``
    tells whether no starred dimension has a single value. An absent value is a star already and is not starred again."""
    sets = joint.select(*keys, *dims, "count", F.explode(F.sequence(F.lit(0), F.lit((1 << len(dims)) - 1))).alias("pinned"))
    keep = reduce(lambda a, b: a & b, [((F.col("pinned").bitwiseAND(1 << i)) == 0) | F.col(d).isNotNull() for i, d in enumerate(dims)])
    star = {d: F.when(F.col("pinned").bitwiseAND(1 << i) != 0, F.col(d)) for i, d in enumerate(dims)}
    spread = sets.where(keep).withColumns({f"_{d}": F.col(d) for d in dims}).withColumns(star)
    aggs = [F.sum("count").alias("count"), F.count("*").alias("_rows")]
    for d in dims:
        aggs += [F.count(f"_{d}").alias(f"_n_{d}"), F.min(f"_{d}").alias(f"_lo_{d}"), F.max(f"_{d}").alias(f"_hi_{d}")]
    got = spread.groupBy(*keys, "pinned", *dims).agg(*aggs)
    single = [(F.col("pinned").bitwiseAND(1 << i) == 0) & (F.col(f"_n_{d}") == F.col("_rows")) & (F.col(f"_lo_{d}") == F.col(f"_hi_{d}")) for i, d in enumerate(dims)]
    return got.withColumn("closed", ~reduce(lambda a, b: a | b, single)).select(*keys, "pinned", *dims, "count", "closed")


def closed(joint: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return cells(joint, keys).where("closed").drop("closed")


def coarsen(joint: DataFrame, band: Column, depth: Column, keys: list[str] = KEYS) -> DataFrame:
    """Levels below ``band`` fold into the one under it; at ``depth`` 0 components are dropped."""
    level = F.when(F.col("level") < band, band - 1).otherwise(F.col("level")).cast("int")
    return joint.select(*keys, level.alias("level"), F.when(depth > 0, F.col("component")).alias("component"), "role", "count").groupBy(*keys, *DIMS).agg(F.sum("count").alias("count"))


def _bit() -> Column:
    """A level and a role as one of 64 bits: eight for each level, the eighth of each kind for an absent value."""
    place = lambda d: F.when(F.col(d).isNull(), 7).when(F.col(d).between(0, 6), F.col(d)).otherwise(F.raise_error(F.concat(F.lit(f"cube: no {d} "), F.col(d).cast("string"))).cast("int")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place("level") * 8 + place("role"))


def _closed_of(bits: Column, band: int) -> Column:
    """Closed cells that name one component, from the bits of its levels and roles, with levels below ``band`` folded."""
    by_level = [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)]
    *named, absent = [reduce(lambda a, b: a.bitwiseOR(b), by_level[: max(1, band)]), *by_level[max(1, band) :]]
    present, several = (lambda x: F.bit_count(x.bitwiseAND(F.lit(127).cast("long")))), (lambda x: (F.bit_count(x) > 1) | (x > 127))
    once, twice = named[0], F.lit(0).cast("long")
    for x in named[1:]:
        once, twice = once.bitwiseOR(x), twice.bitwiseOR(once.bitwiseAND(x))
    once, twice = once.bitwiseOR(absent), twice.bitwiseOR(absent)
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    levels = add([(x > 0).cast("int") for x in named])
    return add([present(x) for x in named]) + add([several(x).cast("int") for x in named]) + present(twice) + (((levels > 1) | (absent > 0)) & several(once)).cast("int")


def _state_counts(joint: DataFrame, options: list[tuple[int, int]]) -> DataFrame:
    """(window, _b, _d, n): closed cells of each window at each coarsening.

    Cells that name a component need its levels and roles alone, which are bits of one number; components with the same
    bits count together. For the others two components of a level and role tell whether there is a single one."""
    per = joint.groupBy(*KEYS, "component").agg(F.bit_or(_bit()).alias("_bits"))
    alike = per.groupBy(*KEYS, F.col("component").isNotNull().alias("_located"), "_bits").agg(F.count("*").alias("_n"))
    bands = sorted({b for b, _ in options})
    named = alike.where("_located").groupBy(*KEYS).agg(*[F.sum(F.col("_n") * _closed_of(F.col("_bits"), b)).alias(f"_n{b}") for b in bands])
    named = named.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(b).alias("_b"), F.lit(1).alias("_d"), F.col(f"_n{b}").alias("n")) for b in bands])).alias("x")).select(*KEYS, "x.*")
    held = F.expr("filter(sequence(0, 63), i -> getbit(_bits, i) = 1)")
    pairs = alike.select(*KEYS, "_located", "_bits", "_n", F.explode(held).alias("_i")).groupBy(*KEYS, "_i").agg(
        F.min(F.when(F.col("_located"), F.col("_bits"))).alias("_lo"), F.max(F.when(F.col("_located"), F.col("_bits"))).alias("_hi"), F.max(F.col("_located") & (F.col("_n") > 1)).alias("_more"), F.max(~F.col("_located")).alias("_unlocated"))
    value = lambda i: F.when(i != 7, i).cast("int")
    stand_in = F.array_distinct(F.array_compact(F.array(F.col("_lo").cast("string"), F.col("_hi").cast("string"), F.when(F.col("_more"), F.lit("more")))))
    stand_in = F.concat(stand_in, F.when(F.col("_unlocated"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    small = pairs.select(*KEYS, value(F.expr("_i div 8")).alias("level"), value(F.expr("_i % 8")).alias("role"), F.lit(1).cast("long").alias("count"), F.explode(stand_in).alias("component"))
    trial = small.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(d).alias("d")) for b, d in options])))
    keyed = trial.select(*KEYS, F.col("_s.b").alias("_b"), F.col("_s.d").alias("_d"), *DIMS, "count")
    keys = [*KEYS, "_b", "_d"]
    rest = closed(coarsen(keyed, F.col("_b"), F.col("_d"), keys), keys).where((F.col("pinned").bitwiseAND(1 << DIMS.index("component"))) == 0)
    return named.unionByName(rest.groupBy(*keys).agg(F.count("*").alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))


def collapse_states(joint: DataFrame, budget: int = CUBE_BUDGET) -> DataFrame:
    """(window, band_floor, floor_depth): each window's coarsening that keeps its closed cells within ``budget``.

    The cells of all eight states are counted without being made; the search for the best step (cells saved over cost, a
    level band before dropping components on a tie) runs on these counts."""
    options = [(b, d) for d in (1, 0) for b in (0, 2, 3, ERROR)]
    counts = _state_counts(joint, options)
    wide = counts.groupBy(*KEYS).agg(*[F.max(F.when((F.col("_b") == b) & (F.col("_d") == d), F.col("n"))).alias(f"n{b}_{d}") for b, d in options])
    state = wide.withColumns({"band_floor": F.lit(0), "floor_depth": F.lit(1)})
    pick = lambda b, d: reduce(lambda acc, o: acc.when((b == o[0]) & (d == o[1]), F.col(f"n{o[0]}_{o[1]}")), options, F.when(F.lit(False), F.lit(None).cast("long")))
    for _ in range(4):
        b, d = F.col("band_floor"), F.col("floor_depth")
        next_b = F.when(b == 0, 2).otherwise(b + 1)
        now = pick(b, d)
        by_band = F.when(b < ERROR, now - pick(next_b, d))
        by_where = F.when(d > 0, now - pick(b, d - 1))
        over = now > budget
        band_ok, where_ok = over & (F.coalesce(by_band, F.lit(0)) > 0), over & (F.coalesce(by_where, F.lit(0)) > 0)
        take_where = where_ok & (~band_ok | (by_where * next_b > by_band * 100))
        step = state.withColumns({"_w": F.coalesce(take_where, F.lit(False)), "_k": F.coalesce(band_ok, F.lit(False)), "_nb": next_b})
        state = step.withColumns({"band_floor": F.when(~F.col("_w") & F.col("_k"), F.col("_nb")).otherwise(F.col("band_floor")), "floor_depth": F.when(F.col("_w"), F.col("floor_depth") - 1).otherwise(F.col("floor_depth"))})
    return state.select(*KEYS, F.col("band_floor").cast("int").alias("band_floor"), F.col("floor_depth").cast("int").alias("floor_depth"))


def bounded(joint: DataFrame, budget: int = CUBE_BUDGET) -> DataFrame:
    """Closed cells of each window at its collapse state."""
    states = materialise(collapse_states(joint, budget), "states")  # as a table, so that the join knows how small it is
    kept = joint.join(states, KEYS)
    small = coarsen(kept, F.col("band_floor"), F.col("floor_depth"), [*KEYS, "band_floor", "floor_depth"])
    return closed(small, [*KEYS, "band_floor", "floor_depth"])


def cardinality(closed_cells: DataFrame) -> DataFrame:
    """Distinct values per axis and the number of closed cells."""
    return closed_cells.groupBy(*KEYS).agg(*[F.countDistinct(d).alias(f"{d}_cardinality") for d in DIMS], F.count("*").alias("closed_cells"))


def collapse_note(states: DataFrame) -> DataFrame:
    """A sentence on what was coarsened; null where nothing was."""
    band = F.when(F.col("band_floor") > 0, F.concat(F.lit("levels below "), F.col("band_floor").cast("string"), F.lit(" folded")))
    where = F.when(F.col("floor_depth") == 0, F.lit("components dropped"))
    return states.withColumn("note", F.nullif(F.concat_ws("; ", band, where), F.lit("")))


def border(previous: DataFrame, current: DataFrame, keys: list[str], dims: list[str] = DIMS, mono: str = "current") -> DataFrame:
    """Cells populated now and absent before (``keys`` pair the two joints): side is upper where no one-dimension
    generalisation emerges too, lower where no specialisation does. ``mono`` names the side that must have the cells."""
    there, here = (previous, current) if mono == "current" else (current, previous)
    now, was = cells(here, keys, dims), cells(there, keys, dims)
    same = [*keys, "pinned", *dims]
    new = now.join(was.select(*[F.col(c).alias(f"_{c}") for c in same]), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]), "left_anti").select(*same, "count")
    new = materialise(new, "emergent")
    parents = None
    for i, d in enumerate(dims):
        up = new.where(F.col("pinned").bitwiseAND(1 << i) != 0).select(*[F.col(c).alias(f"k_{c}") for c in same], *keys, (F.col("pinned") - (1 << i)).alias("pinned"), *[F.lit(None).cast(new.schema[c].dataType).alias(c) if c == d else F.col(c) for c in dims])
        parents = up if parents is None else parents.unionAll(up)
    on = lambda left, right, prefix: reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in same])
    found = new.select(*[F.col(c).alias(f"p_{c}") for c in same])
    hits = parents.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in same]))
    hits = materialise(hits.select(*[f"k_{c}" for c in same], *[f"p_{c}" for c in same]), "generalisations")
    child, parent = hits.select(*[f"k_{c}" for c in same]).distinct(), hits.select(*[f"p_{c}" for c in same]).distinct()
    upper = new.join(child, on(new, child, "k_"), "left_anti").withColumn("side", F.lit("upper"))
    lower = new.join(parent, on(new, parent, "p_"), "left_anti").withColumn("side", F.lit("lower"))
    return upper.unionByName(lower)


def acquisition(events: DataFrame, closed_cells: DataFrame) -> DataFrame:
    """Located records and distinct values by axis, beside the number of closed cells."""
    seen = events.groupBy(*KEYS).agg(F.count("component").alias("located_records"), F.countDistinct("component").alias("components"), F.countDistinct("level").alias("levels"), F.countDistinct("role").alias("roles"), F.count_if("is_span").alias("spans"))
    return seen.join(closed_cells.groupBy(*KEYS).agg(F.count("*").alias("closed_cells")), KEYS, "left")


def recover_base(closed_cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The joint behind a closed cube that was read back: located events are its fully pinned cells, as nothing is starred
    in them; unlocated ones are what a cell with only its component starred has beyond them."""
    full = closed_cells.where("pinned = 7").select(*keys, *DIMS, "count")
    located = full.groupBy(*keys, "level", "role").agg(F.sum("count").alias("_located"))
    starred = closed_cells.where("pinned = 5").select(*keys, "level", "role", "count").join(located, [*keys, "level", "role"], "left")
    rest = starred.withColumn("count", F.col("count") - F.coalesce("_located", F.lit(0))).where("count > 0")
    return full.unionByName(rest.select(*keys, "level", F.lit(None).cast("string").alias("component"), "role", "count"))


def counts_in(closed_cells: DataFrame, wanted: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts of any cells of a closed cube: the largest among the closed cells that a wanted one covers; 0 if it covers
    none."""
    asked = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(d).alias(f"_{d}") for d in DIMS]).distinct()
    covers = reduce(lambda a, b: a & b, [F.col(f"_{d}").isNull() | F.col(f"_{d}").eqNullSafe(F.col(d)) for d in DIMS])
    same = reduce(lambda a, b: a & b, [F.col(f"_{k}") == F.col(k) for k in keys])
    hit = asked.join(closed_cells, same & covers, "left").groupBy(*[f"_{k}" for k in keys], *[f"_{d}" for d in DIMS]).agg(F.coalesce(F.max("count"), F.lit(0)).alias("count"))
    return hit.select(*[F.col(f"_{c}").alias(c) for c in (*keys, *DIMS)], "count")


def tree_conflicts(paths: DataFrame) -> DataFrame:
    """Values of WHERE paths (column path, an array from the root down) that have two parents at one depth; a chain of depth
    one has none."""
    steps = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    at = steps.select("depth", F.element_at("path", F.col("depth")).alias("value"), F.when(F.col("depth") > 1, F.element_at("path", F.col("depth") - 1)).alias("parent"))
    return at.groupBy("depth", "value").agg(F.countDistinct(F.coalesce("parent", F.lit(""))).alias("parents")).where("parents > 1")
