"""Joins of visibilities, gains, components and antennas.

Visibility pairs join on their key. Gains join on (antenna, channel, interval number): the interval condition becomes
an equality by numbering intervals, so a gain table of any size can be shuffled and a small one is broadcast by size.
Sky positions join through cells of the sky, each row looking at its own and the neighbouring cells, so matching has
no all-pairs step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfringe.functions import complexmath as cx
from skyfringe.functions.coordinates import separation, sky_to_lmn

from .components import component_visibilities
from .tables import materialize
from .visibility import KEY


def subtract(vis: DataFrame, model: DataFrame) -> DataFrame:
    """vis less the model (m_re, m_im) at the same key."""
    return vis.join(model, KEY).withColumns({"vis_re": F.col("vis_re") - F.col("m_re"), "vis_im": F.col("vis_im") - F.col("m_im")}).drop("m_re", "m_im")


def divide(vis: DataFrame, model: DataFrame) -> DataFrame:
    """V / M with weight |M| ** 2 * weight; both 0 where that is not positive."""
    joined = vis.join(model, KEY)
    m = cx.pair("m")
    weight = cx.abs2(m) * F.col("weight")
    re, im = cx.div(cx.pair("vis"), m)
    keep = lambda c: F.when(weight > 0, c).otherwise(F.lit(0.0))
    return joined.withColumns({"vis_re": keep(re), "vis_im": keep(im), "weight": keep(weight)}).drop("m_re", "m_im")


def divide_matrix(vis: DataFrame, model: DataFrame) -> DataFrame:
    """The 2 x 2 form: the four products of a sample as a matrix, inverse(M) V; 0 where M is singular."""
    keys = ["time", "a1", "a2", "chan"]
    part = lambda c, k: F.max(F.when(F.col("pol") == k, F.col(c)))
    names = [f"{n}{k}_{x}" for n in ("v", "m") for k in range(4) for x in ("re", "im")]
    wide = vis.join(model, KEY).groupBy(*keys).agg(*(part(("vis_" if n[0] == "v" else "m_") + n[3:], int(n[1])).alias(n) for n in names))
    v, m = ([cx.pair(f"{n}{k}") for k in range(4)] for n in ("v", "m"))
    det = cx.sub(cx.mul(m[0], m[3]), cx.mul(m[1], m[2]))
    minus = lambda a: (-a[0], -a[1])
    # Determinant, inverse and products are columns one after the other, so that none is written out within the next.
    wide = wide.withColumns({"d_re": det[0], "d_im": det[1]})
    inverse = [cx.div(x, cx.pair("d")) for x in (m[3], minus(m[1]), minus(m[2]), m[0])]
    wide = wide.withColumns({f"i{k}_{x}": c for k, i in enumerate(inverse) for x, c in zip(("re", "im"), i, strict=True)})
    inv = [cx.pair(f"i{k}") for k in range(4)]
    out = [cx.add(cx.mul(inv[2 * r], v[c]), cx.mul(inv[2 * r + 1], v[2 + c])) for r in (0, 1) for c in (0, 1)]
    rows = F.array(*(F.struct(F.lit(k).alias("pol"), F.coalesce(x[0], F.lit(0.0)).alias("vis_re"), F.coalesce(x[1], F.lit(0.0)).alias("vis_im")) for k, x in enumerate(out)))
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def product_feeds(pol: Column, cross: bool) -> tuple[Column, Column]:
    """The feeds of a product's two antennas: pol // 2 and pol % 2 of four products, pol itself of two parallel ones."""
    return (F.floor(pol / 2), pol % 2) if cross else (pol, pol)


def gains_of(gains: DataFrame, vis: DataFrame) -> DataFrame:
    """The gains of antennas that ``vis`` has; those of a long table's other antennas would be sent and sorted for nothing."""
    return gains.join(vis.select(F.explode(F.array("a1", "a2")).alias("ant")).distinct(), "ant", "left_semi")


def apply_gains(vis: DataFrame, gains: DataFrame, *, interval: float, first: float, inverse: bool = False, cross: bool = True, keys: list[str] | None = None) -> DataFrame:
    """V g1 conj(g2), or V / (g1 conj(g2)) where that isn't 0, with the gains of the interval that holds the time.

    Intervals have one length and centres first, first + interval, ...; a row whose time is in none is left out.
    V and weight are 0 where an antenna's gain has no weight. Gains with a ``feed`` join the feeds of the product, in a
    frame with cross products or without (``cross=False``); gains without one hold for all products. ``keys`` are further
    columns, such as model_id, that both have and must be equal.
    """
    keys = keys or []
    by_feed = "feed" in gains.columns
    number = lambda t: F.round((F.col(t) - first) / interval).cast("long")
    table = gains.withColumn("__k", number("time")).select(*keys, "__k", "ant", "chan", *(["feed"] if by_feed else []), "g_re", "g_im", F.col("weight").alias("gw"))
    feed = lambda n: [F.col("feed").alias(f"__f{n}")] if by_feed else []
    side = lambda n: table.select(*keys, "__k", "chan", *feed(n), F.col("ant").alias(f"a{n}"), F.col("g_re").alias(f"g{n}_re"), F.col("g_im").alias(f"g{n}_im"), F.col("gw").alias(f"gw{n}"))
    rows = vis.withColumn("__k", number("time")).where(F.abs(F.col("time") - (F.col("__k") * interval + first)) < interval / 2)
    rows = rows.withColumns(dict(zip(("__f1", "__f2"), product_feeds(F.col("pol"), cross), strict=True))) if by_feed else rows
    on = lambda n: [*keys, "__k", "chan", f"a{n}", *([f"__f{n}"] if by_feed else [])]
    rows = rows.join(side(1), on(1)).join(side(2), on(2))
    g = cx.mul(cx.pair("g1"), cx.conj(cx.pair("g2")))
    re, im = cx.div(cx.pair("vis"), g) if inverse else cx.mul(cx.pair("vis"), g)
    if inverse:
        known = cx.abs2(g) > 0
        re, im = F.when(known, re).otherwise(F.col("vis_re")), F.when(known, im).otherwise(F.col("vis_im"))
    good = (F.col("gw1") > 0) & (F.col("gw2") > 0)
    keep = lambda c: F.when(good, c).otherwise(F.lit(0.0))
    return rows.withColumns({"vis_re": keep(re), "vis_im": keep(im), "weight": keep(F.col("weight"))}).select(*vis.columns)


def _met(deal: Callable[[int], DataFrame], others: DataFrame, n: int, m: int, least: int, task_pairs: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """``n`` rows, dealt by ``deal`` to tasks of about ``task_pairs`` pairs, and the ``m`` others that they meet there: broadcast
    up to ``broadcast_rows``, or dealt in blocks."""
    across = 1 if m <= broadcast_rows else -(-m // broadcast_rows)
    dealt = deal(min(max(least, -(-n * m // task_pairs // across)), 20_000))
    return dealt, F.broadcast(others) if m <= broadcast_rows else others.repartition(across)


def all_pairs(rows: DataFrame, others: DataFrame, key: str, *, task_pairs: int = 20_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """Every row with every other one, an output of the product of both by definition.

    ``rows`` are dealt by ``key`` to tasks of about ``task_pairs`` pairs, however few files they come from, so no pair is
    sent or sorted. Up to ``broadcast_rows`` others, by count, are broadcast; more meet block by block.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, met = _met(lambda tasks: rows.repartition(tasks, key), others, rows.count(), others.count(), least, task_pairs, broadcast_rows)
    return dealt.crossJoin(met)


def _arrays(df: DataFrame, order: list[str], length: int, name: str) -> DataFrame:
    """The rows of ``df`` sorted by ``order``, in arrays of at most ``length`` neighbours, there in the order of its columns."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__k", F.expr(f"monotonically_increasing_id() DIV {length}"))
    return materialize(sorted_rows.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).select(name))


def tiled_pairs(rows: DataFrame, others: DataFrame, order: list[str], other_order: list[str], on: Column | None = None, *, tile: int = 64, task_pairs: int = 20_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """``all_pairs`` (where ``on`` holds) for pairs that are written. Both sides are sorted, and pairs come tile by tile of ``tile`` by
    ``tile`` neighbours: ids come again within a tile, and so does what is worked out of equal rows, which the dictionaries, run
    lengths and windows of a file's columns hold at a fraction of pairs in any order. Pairs themselves are neither sent nor sorted."""
    mine, theirs = _arrays(rows, order, tile, "__r"), _arrays(others, other_order, tile, "__o")
    n, m = (t.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0] for t, c in ((mine, "__r"), (theirs, "__o")))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, met = _met(mine.repartition, theirs, n, m, least, task_pairs, broadcast_rows)
    pairs = dealt.crossJoin(met).select(F.explode("__o").alias("__o"), "__r").select("__o", F.explode("__r").alias("__r")).select("__r.*", "__o.*")
    return pairs if on is None else pairs.where(on)


def baselines(antennas: DataFrame) -> DataFrame:
    """Pairs a2 > a1 with the difference of their positions; antennas are a small dimension, pairs their square."""
    a = antennas.select(F.col("ant").alias("a1"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    b = antennas.select(*(F.col(c).alias(f"{c}2") for c in "xyz"), F.col("ant").alias("a2"))
    pairs = tiled_pairs(a, b, ["x1", "y1", "z1", "a1"], ["x2", "y2", "z2", "a2"], F.col("a2") > F.col("a1"))
    return pairs.select("a1", "a2", *((F.col(f"{c}2") - F.col(f"{c}1")).alias(f"d{c}") for c in "xyz"))


def separations(first: DataFrame, second: DataFrame) -> DataFrame:
    """The matrix of separations of two lists of components, all pairs by definition. The second list should be the longer one:
    it is dealt to tasks, and the first is met there."""
    side = lambda df, n: df.select(F.col("ra").alias(f"ra{n}"), F.col("dec").alias(f"dec{n}"), F.cos("dec").alias(f"cos{n}"), F.col("comp_id").alias(f"id{n}"))
    pairs = tiled_pairs(side(second, 2), side(first, 1), ["ra2", "dec2", "id2"], ["ra1", "dec1", "id1"])
    # The haversine formula with the cosines of each side's rows; a square is a product.
    up, along = F.sin((F.col("dec2") - F.col("dec1")) / 2), F.sin((F.col("ra2") - F.col("ra1")) / 2)
    met = pairs.select("id1", "id2", up.alias("up"), along.alias("along"), (F.col("cos1") * F.col("cos2")).alias("cc"))
    h = F.col("up") * F.col("up") + F.col("cc") * (F.col("along") * F.col("along"))
    return met.select("id1", "id2", (2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).alias("separation"))


def places(components: DataFrame) -> DataFrame:
    """One row (comp_id, ra, dec) a place, with the smallest id there: what is near or nearest is the same for all components of a
    place, and of those at one place the smallest id comes first."""
    return components.groupBy("ra", "dec").agg(F.min("comp_id").alias("comp_id"))


def of_components(found: DataFrame, at: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """What was found for the places ``at``, for each component there; ``name`` is the id's column."""
    each = components.select(F.col("comp_id").alias("__id"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec"))
    rows = at.join(found, at["comp_id"] == found[name]).select("ra", "dec", *(found[c] for c in found.columns if c != name))
    same = F.col("ra").eqNullSafe(F.col("__ra")) & F.col("dec").eqNullSafe(F.col("__dec"))
    return each.join(rows, same).select(F.col("__id").alias(name), *(c for c in found.columns if c != name))


def near_pairs(first: DataFrame, second: DataFrame, distance: float) -> DataFrame:
    """(id1, id2, separation) of all pairs nearer than ``distance`` (radians, below a quarter turn).

    Rows meet in cells of the unit sphere's space, cubes of that side, each row of the first looking at its own and the
    26 around it. Cubes have no poles and no seam, so a crowded band of the sky is still many cells.
    """

    def cells(df: DataFrame, n: int) -> DataFrame:
        x, y, z = F.cos("dec") * F.cos("ra"), F.cos("dec") * F.sin("ra"), F.sin("dec")
        cell = lambda c: F.floor(c / distance).cast("long")
        return df.select(F.col("comp_id").alias(f"id{n}"), F.col("ra").alias(f"ra{n}"), F.col("dec").alias(f"dec{n}"), cell(x).alias("cx"), cell(y).alias("cy"), cell(z).alias("cz"))

    around = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip((i, j, k), "abc", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    a = cells(first, 1).withColumn("o", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b"), "cz": F.col("cz") + F.col("o.c")}).drop("o")
    met = a.join(cells(second, 2), ["cx", "cy", "cz"])
    return met.select("id1", "id2", separation(*(F.col(c) for c in ("ra1", "dec1", "ra2", "dec2"))).alias("separation")).where(F.col("separation") < distance)


def matches(tests: DataFrame, references: DataFrame, tolerance: float) -> DataFrame:
    """For each test component the nearest reference nearer than ``tolerance``: (id1, id2, separation). Ties go to the
    smaller id. Places are matched, so crowds at one place don't multiply."""
    at = places(tests)
    best = near_pairs(at, places(references), tolerance).groupBy("id1").agg(F.min(F.struct("separation", "id2")).alias("m")).select("id1", "m.id2", "m.separation")
    return of_components(best, at, tests, "id1")


def nearest(components: DataFrame, targets: DataFrame, *, array_rows: int = 1_000) -> DataFrame:
    """Every component with its nearest target, ties to the smaller id. Places of components look among places of targets."""
    at = materialize(places(components))
    return of_components(nearest_places(at, materialize(places(targets)), array_rows), at, components, "comp_id")


def nearest_places(components: DataFrame, targets: DataFrame, array_rows: int) -> DataFrame:
    """``nearest`` of components and targets that are few at one place.

    Up to ``array_rows`` targets, by count, go as one array with every row. More are found by a tree of cubes of the unit
    sphere's space, each level a quarter as wide as the one before: a component keeps the cubes with targets that could be as
    near as the farthest corner of the nearest one, and meets their children by equality. Below, where cubes hold few targets,
    the targets themselves are met. The first level has at most 125 cubes, so no step pairs all with all.
    """
    t = targets.select(F.col("comp_id").alias("target_id"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec"))
    n = targets.count()
    if n <= array_rows:
        every = t.agg(F.collect_list(F.struct("target_id", "__ra", "__dec")).alias("__t"))
        at = F.transform("__t", lambda x: F.struct(separation(F.col("ra"), F.col("dec"), x["__ra"], x["__dec"]).alias("separation"), x["target_id"].alias("target_id")))
        rows = components.crossJoin(F.broadcast(every)).select("comp_id", F.array_min(at).alias("m")).where("m IS NOT NULL")
        return rows.select("comp_id", "m.target_id", "m.separation")
    place = lambda ra, dec: {"x": F.cos(dec) * F.cos(ra), "y": F.cos(dec) * F.sin(ra), "z": F.sin(dec)}
    cell = lambda side: F.concat_ws(",", *(F.floor(F.col(c) / side).cast("long") for c in "xyz"))
    middle = lambda side: {f"__{c}": (F.floor(F.col(c) / side) + 0.5) * side for c in "xyz"}
    targets_at = t.withColumns(place(F.col("__ra"), F.col("__dec")))
    asked = components.select("comp_id", "ra", "dec").withColumns(place(F.col("ra"), F.col("dec")))
    side, kept = 0.5, None
    while True:
        cubes = targets_at.select(*((cell(side * 4) if kept is not None else F.lit("")).alias("parent"), cell(side).alias("cube")), *(v.alias(k) for k, v in middle(side).items()))
        cubes = cubes.groupBy("parent", "cube").agg(*(F.first(f"__{c}").alias(f"__{c}") for c in "xyz"), F.count(F.lit(1)).alias("__n"))
        most = cubes.agg(F.max("__n")).first()[0]
        met = asked.crossJoin(F.broadcast(cubes)) if kept is None else asked.join(kept, "comp_id").join(cubes, "parent")
        away = F.sqrt(sum((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in "xyz"))
        reach = side * 3**0.5 / 2
        bounded = met.select("comp_id", "cube", F.greatest(away - reach, F.lit(0.0)).alias("low"), (away + reach).alias("high"))
        least = F.min("high").over(Window.partitionBy("comp_id"))
        kept = materialize(bounded.withColumn("least", least).where(F.col("low") <= F.col("least") + 1e-9).select("comp_id", F.col("cube").alias("parent")))
        if most <= 64 or side < 1e-9:
            break
        side /= 4
    near = asked.join(kept, "comp_id").join(targets_at.withColumn("parent", cell(side)).select("parent", "target_id", "__ra", "__dec"), "parent")
    best = near.groupBy("comp_id").agg(F.min(F.struct(separation(F.col("ra"), F.col("dec"), F.col("__ra"), F.col("__dec")).alias("separation"), F.col("target_id"))).alias("m"))
    return best.select("comp_id", "m.target_id", "m.separation")


def nearest_to(components: DataFrame, ra: float, dec: float) -> DataFrame:
    """(comp_id, separation) of the component nearest to a direction, ties to the smaller id; one row, none of an empty
    list."""
    s = separation(F.lit(float(ra)), F.lit(float(dec)), F.col("ra"), F.col("dec"))
    best = components.select(F.struct(s.alias("separation"), F.col("comp_id")).alias("m")).agg(F.min("m").alias("m"))
    return best.where("m IS NOT NULL").select("m.comp_id", "m.separation")


def predict_components(vis: DataFrame, components: DataFrame, ra0: float, dec0: float, spectrum: Column, *, array_rows: int = 20_000) -> DataFrame:
    """Key, m_re, m_im: the sum over components of flux0 * spectrum * exp(-2 pi i (u l + v m + w n)); ``spectrum`` may use
    the row's columns."""
    l, m, n = sky_to_lmn(F.col("ra"), F.col("dec"), F.lit(ra0), F.lit(dec0))  # noqa: E741
    listed = components.select(F.lit(0).alias("model_id"), "comp_id", l.alias("l"), m.alias("m"), n.alias("n"), F.col("flux0").alias("flux"))
    return component_visibilities(vis, listed, spectrum, array_rows=array_rows).drop("model_id")


def cross_subtract(models: DataFrame, observed: DataFrame) -> DataFrame:
    """For each model p: observed less all other models, (model_id, key, vis_re, vis_im)."""
    over = Window.partitionBy(*KEY)
    rest = models.withColumns({f"__{x}": F.sum(f"m_{x}").over(over) - F.col(f"m_{x}") for x in ("re", "im")})
    joined = rest.join(observed.select(*KEY, "vis_re", "vis_im"), KEY)
    return joined.select("model_id", *KEY, (F.col("vis_re") - F.col("__re")).alias("vis_re"), (F.col("vis_im") - F.col("__im")).alias("vis_im"))


def apply_beam(components: DataFrame, beam: DataFrame, npixel: int, cellsize: float) -> DataFrame:
    """Components (chan, pol, l, m, flux) with the flux times the beam at their nearest pixel; those outside go."""
    place = components.withColumns({"x": F.floor(npixel // 2 - F.col("l") / cellsize + 0.5), "y": F.floor(npixel // 2 + F.col("m") / cellsize + 0.5)})
    joined = place.join(beam.select("chan", "pol", "y", "x", F.col("value").alias("__b")), ["chan", "pol", "y", "x"])
    return joined.withColumn("flux", F.col("flux") * F.col("__b")).drop("__b")
