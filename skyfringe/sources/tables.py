"""Readers and writers: measurement-set tables kept as Parquet, antenna text and catalogues.

A measurement set is a folder of Parquet tables MAIN, FIELD, SPECTRAL_WINDOW, POLARIZATION, DATA_DESCRIPTION and
ANTENNA. MAIN has one row for each time and baseline with arrays over channels and products.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfringe.functions.coordinates import geocentric, separation, xyz_at_latitude
from skyfringe.operators.spectra import interpolate_spectra
from skyfringe.operators.visibility import coalesce_visibility, limit_radius

C = 299792458.0
# Correlation codes and the frame that a set of four (or fewer) stands for.
FRAME_OF_CODES = {(1, 2, 3, 4): "stokesIQUV", (1,): "stokesI", (5, 6, 7, 8): "circular", (5, 8): "circularnp", (9, 10, 11, 12): "linear", (9, 12): "linearnp"}
# Latitude (degrees) and dish diameter (metres) of named sites.
SITES = {"LOW": (-26.82472208, 35.0), "MID": (-30.712925, 15.0), "VLA": (34.07874917, 25.0), "LOFAR": (52.7, 35.0)}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def list_fields(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(distinct field names, distinct data_desc_id) of the main table."""
    main = _table(spark, path, "MAIN")
    names = main.select("field_id").distinct().join(_table(spark, path, "FIELD"), "field_id").select("name").distinct()
    return names, main.select("data_desc_id").distinct()


def read_measurement_set(spark: SparkSession, path: str, *, fields: list[str] | None = None, data_descs: list[int] | None = None, channels: tuple[int, int] | None = None) -> DataFrame:
    """Long visibilities of chosen fields, data descriptions and channels [first, last].

    Field and description filters reach the scan; uvw is negated and turned into wavelengths; time is the start of the
    integration; ``integration`` numbers the runs of rows whose times are no more than an interval apart.
    """
    main, field, desc, spw = (_table(spark, path, n) for n in ("MAIN", "FIELD", "DATA_DESCRIPTION", "SPECTRAL_WINDOW"))
    if data_descs is not None:
        main = main.where(F.col("data_desc_id").isin(data_descs))
    if fields is not None:
        field = field.where(F.col("name").isin(fields))
    rows = main.join(field.select("field_id", F.col("name").alias("field")), "field_id").join(desc, "data_desc_id").join(spw, "spectral_window_id")
    by_time = Window.partitionBy("field_id", "data_desc_id").orderBy("start")
    times = rows.select("field_id", "data_desc_id", (F.col("time") - F.col("interval") / 2).alias("start"), "interval").distinct()
    gap = (F.col("start") - F.lag("start").over(by_time)) > F.col("interval")
    times = times.withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("integration", F.sum("__new").over(by_time) - 1).select("field_id", "data_desc_id", "start", "integration")
    rows = rows.withColumn("start", F.col("time") - F.col("interval") / 2).join(times.dropDuplicates(["field_id", "data_desc_id", "start"]), ["field_id", "data_desc_id", "start"])
    each = rows.select("field", "data_desc_id", "integration", F.col("start").alias("time"), F.col("interval").alias("integration_time"), "a1", "a2", "u", "v", "w", F.posexplode(F.arrays_zip("chan_freq", "chan_width", "data", "weight")).alias("chan", "c"))
    if channels is not None:
        each = each.where(F.col("chan").between(*channels))
    products = each.select("*", F.posexplode(F.arrays_zip(F.col("c.data").alias("data"), F.col("c.weight").alias("weight"))).alias("pol", "p"))
    wave = lambda x: (-F.col(x) * F.col("c.chan_freq") / C).alias(x)
    return products.select(
        "field", "data_desc_id", "integration", "time", "integration_time", "a1", "a2", "chan", F.col("c.chan_freq").alias("frequency"), F.col("c.chan_width").alias("channel_bandwidth"),
        "pol", wave("u"), wave("v"), wave("w"), F.col("p.data.re").alias("vis_re"), F.col("p.data.im").alias("vis_im"), F.col("p.weight").alias("weight"), F.col("p.weight").alias("imaging_weight"),
    )


def read_visibility(spark: SparkSession, path: str, *, time_factor: float = 1.0, most_times: int = 10, chan_factor: float = 1.0, most_chans: int = 10, **selection: object) -> DataFrame:
    """A measurement set as averaged rows: those of ``read_measurement_set``, each baseline's averaged over time and channels
    by its length."""
    return coalesce_visibility(read_measurement_set(spark, path, **selection), time_factor, most_times, chan_factor, most_chans)


def write_visibilities(vis: DataFrame, path: str) -> None:
    """Long visibilities, by channel and clustered by time: frequency windows read alone."""
    vis.repartition("chan").sortWithinPartitions("chan", "time", "a1", "a2", "pol").write.partitionBy("chan").parquet(path)


def write_measurement_set(vis: DataFrame, path: str, *, frame: str = "linear") -> None:
    """Long visibilities as the tables of a measurement set that ``read_measurement_set`` reads back.

    A row of MAIN is a time and baseline of a ``field`` and ``data_desc_id`` (one of each where there is none) with arrays over all channels and
    products of its description; samples that aren't there have no weight. u, v and w are metres, negated, from the row's first
    channel; the time is the middle of the integration. Channels of a description are one spectral window.
    """
    rows = vis.withColumns({c: F.lit(d) for c, d in (("field", "FIELD"), ("data_desc_id", 0)) if c not in vis.columns})
    fields = rows.select("field").distinct()
    names = fields.select(F.xxhash64("field").alias("field_id"), F.col("field").alias("name"))
    names.write.parquet(f"{path}/FIELD")
    chans = rows.groupBy("data_desc_id", "chan").agg(F.max("frequency").alias("f"), F.max("channel_bandwidth").alias("b"))
    windows = chans.groupBy("data_desc_id").agg(F.sort_array(F.collect_list(F.struct("chan", "f", "b"))).alias("c"))
    windows.select(F.col("data_desc_id").alias("spectral_window_id"), F.col("c.f").alias("chan_freq"), F.col("c.b").alias("chan_width")).write.parquet(f"{path}/SPECTRAL_WINDOW")
    windows.select("data_desc_id", F.col("data_desc_id").alias("spectral_window_id")).write.parquet(f"{path}/DATA_DESCRIPTION")
    codes = next(c for c, f in FRAME_OF_CODES.items() if f == frame)
    vis.sparkSession.createDataFrame([(0, list(codes))], "polarization_id long, corr_type array<long>").write.parquet(f"{path}/POLARIZATION")
    products = len(codes)
    # A place in the arrays for every channel of the description and every product, filled from the samples there are.
    places = windows.select("data_desc_id", F.col("c.chan").alias("chans"))
    key = ["field", "data_desc_id", "time", "a1", "a2"]
    cells = rows.where(F.col("pol") < products).groupBy(*key).agg(
        F.max("integration_time").alias("interval"), F.map_from_entries(F.collect_list(F.struct(F.col("chan").cast("long") * products + F.col("pol"), F.struct("vis_re", "vis_im", "weight")))).alias("m"),
        F.min(F.struct("chan", "pol", "frequency", "u", "v", "w")).alias("first"),
    )
    whole = cells.join(F.broadcast(places), "data_desc_id")
    at = lambda c, p: F.try_element_at(F.col("m"), c.cast("long") * products + p)
    zero = F.lit(0.0)
    pols = F.sequence(F.lit(0), F.lit(products - 1))
    data = F.transform("chans", lambda c: F.transform(pols, lambda p: F.struct(F.coalesce(at(c, p)["vis_re"], zero).alias("re"), F.coalesce(at(c, p)["vis_im"], zero).alias("im"))))
    weight = F.transform("chans", lambda c: F.transform(pols, lambda p: F.coalesce(at(c, p)["weight"], zero)))
    metres = lambda c: (-F.col(f"first.{c}") * C / F.col("first.frequency")).alias(c)
    main = whole.select(
        F.xxhash64("field").alias("field_id"), "data_desc_id", (F.col("time") + F.col("interval") / 2).alias("time"), "interval", "a1", "a2", metres("u"), metres("v"), metres("w"), data.alias("data"), weight.alias("weight")
    )
    main.write.partitionBy("field_id", "data_desc_id").parquet(f"{path}/MAIN")


def read_antennas(spark: SparkSession, path: str, *, site: str | None = None, latitude: float | None = None, most: float | None = None, kind: str = "local") -> DataFrame:
    """(ant, name, x, y, z, diameter) from text; those further than ``most`` from the mean position are left out.

    ``local``: comma-separated x, y, z (east, north, up), turned to celestial axes at the site's latitude. ``geographic``: diameter, longitude and
    latitude (degrees) by tabs, to geocentric positions at height 0. ``named``: name, x, y, z by commas after two header
    lines, taken as they are.
    """
    lat, diameter = SITES[site] if site else (latitude or 0.0, 35.0)
    number = (F.row_number().over(Window.orderBy("__k")) - 1).cast("long").alias("ant")
    lines = spark.read.text(path).withColumn("__k", F.monotonically_increasing_id()).where("trim(value) <> '' AND NOT startswith(value, '#')")
    part = lambda k, sep: F.trim(F.split("value", sep)[k])
    if kind == "geographic":
        raw = lines.select("__k", *(part(k, "\t").cast("double").alias(n) for k, n in enumerate(("diameter", "lon", "lat"))))
        x, y, z = geocentric(F.radians("lon"), F.radians("lat"))
        out = raw.select(number, F.lit(None).cast("string").alias("name"), x.alias("x"), y.alias("y"), z.alias("z"), "diameter")
    elif kind == "named":
        raw = lines.withColumn("__n", F.row_number().over(Window.orderBy("__k"))).where("__n > 2")
        out = raw.select(number, part(0, ",").alias("name"), *(part(k + 1, ",").cast("double").alias(n) for k, n in enumerate("xyz")), F.lit(diameter).alias("diameter"))
    else:
        raw = lines.select("__k", *(part(k, ",").cast("double").alias(n) for k, n in enumerate("xyz")))
        x, y, z = xyz_at_latitude(F.col("x"), F.col("y"), F.col("z"), math.radians(lat))
        out = raw.select(number, F.lit(None).cast("string").alias("name"), x.alias("x"), y.alias("y"), z.alias("z"), F.lit(diameter).alias("diameter"))
    return out if most is None else limit_radius(out, most)


def read_offset_catalogue(spark: SparkSession, path: str, ra0: float, dec0: float, *, flux_limit: float, radius: float, frequency: float = 1.51e8) -> DataFrame:
    """Components of a catalogue of offsets (degrees) and logarithmic fluxes at 151 and 610 MHz: (comp_id, name, ra, dec,
    index, flux) above the flux limit at ``frequency`` and within the radius."""
    raw = spark.read.schema("name string, c1 double, c2 double, c3 double, dra double, ddec double, c6 double, c7 double, c8 double, f151 double, f610 double").csv(path, comment="#")
    index = (F.col("f610") - F.col("f151")) / math.log10(610 / 151)
    ra = ra0 + F.radians("dra") / math.cos(dec0)
    rows = raw.select("name", ra.alias("ra"), (dec0 + F.radians("ddec")).alias("dec"), index.alias("index"), (F.pow(F.lit(10.0), "f151") * F.pow(F.lit(frequency / 1.51e8), index)).alias("flux"))
    near = separation(F.lit(ra0), F.lit(dec0), F.col("ra"), F.col("dec")) < radius
    return rows.where((F.col("flux") > flux_limit) & near).select(F.xxhash64("name").alias("comp_id"), "*")


def read_band_catalogue(df: DataFrame, bands: list[int], requested: list[float], *, flux_limit: float, ra0: float, dec0: float, radius: float, kind: str = "cubic") -> DataFrame:
    """(name, ra, dec, frequency, flux): fluxes int_flux_<band> (MHz) interpolated to the requested frequencies, by cubic
    spline or straight lines; sources under the wide-band limit, outside the radius or with a missing band are left out."""
    ra, dec = F.radians("RAJ2000"), F.radians("DEJ2000")
    near = separation(F.lit(ra0), F.lit(dec0), ra, dec) < radius
    rows = df.where(F.col("peak_flux_wide") > flux_limit).where(near).na.drop(subset=[f"int_flux_{b:03d}" for b in bands])
    points = F.array(*(F.struct(F.lit(b * 1e6).alias("frequency"), F.col(f"int_flux_{b:03d}").alias("flux")) for b in bands))
    each = rows.select(F.col("Name").alias("name"), ra.alias("ra"), dec.alias("dec"), F.explode(points).alias("p")).select("name", "ra", "dec", "p.*")
    return interpolate_spectra(each, ["name", "ra", "dec"], requested, kind=kind, value="flux")
