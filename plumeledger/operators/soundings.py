"""A second sensor: soundings (orbit, lat, lon, xch4, qa) around sites (site, lat, lon), and which orbit an observation takes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions.running import order_statistics
from plumeledger.sources.scratch import kept

#: Degrees and least numbers of the two methods.
NEAREST, INNER, OUTER, LEAST_RING = 0.15, 0.25, 1.0, 10
BOX, LEVELS, RADII, LEAST_BOX, VALIDATED_PPB = 1.0, (0.5, 0.3, 0.0), (0.3, 0.5, 0.75), 3, 10.0
DAY_HOURS = (11, 14)


#: Edge of a tile in reaches: a sounding goes to (1 + 2 / TILE) ** 2 tiles on the mean.
TILE = 4
_EDGE = 1e-6
MOST_TILES = 100_000


def around_sites(soundings: DataFrame, sites: DataFrame, pairs: DataFrame, figures, names: list[str], reach: float = 1.0) -> DataFrame:
    """(orbit, site, <names>) of the asked pairs (orbit, site) that have soundings within reach degrees in both directions, across 180 degrees too.

    figures(dlat, dlon, xch4, qa) gives the named numbers, NaN for none, of such soundings as arrays. A site goes to the tile of `TILE` reaches that it is in, a
    sounding to all tiles that it can reach, and an orbit's tile is worked through place by place: pairs of sounding and site are never rows, and
    sites at one place share their figures. Rows without a place meet nothing; one degree of longitude counts the same at every latitude.
    Of several places of a site the least counts, as often as it is listed.
    """
    spark, size = soundings.sparkSession, TILE * reach
    columns = max(1, int(360 // size))
    row = lambda lat: F.floor((lat + 90) / size).cast("int")
    column = lambda lon: F.pmod(F.floor((lon + 180) / (360.0 / columns)), F.lit(columns)).cast("int")
    lat, lon = (F.col(c).cast("double") for c in ("lat", "lon"))
    placed = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    kind = soundings.schema["orbit"].dataType
    kind = kind if kind == pairs.schema["orbit"].dataType else "string"
    s = sites.where(placed).groupBy(F.col("site").alias("_site"), lat.alias("lat"), lon.alias("lon")).agg(F.count("*").alias("times"))
    s = s.groupBy("_site").agg(F.min(F.struct("lat", "lon", "times")).alias("x")).select("_site", "x.*")
    asked = pairs.where("orbit is not null").select(F.col("orbit").cast(kind).alias("orbit"), "site").distinct().join(s.hint("merge"), F.col("site") == F.col("_site")).drop("_site")
    asked = kept(asked.withColumns({"r": row(F.col("lat")), "c": column(F.col("lon"))}), "asked-sites")
    tiles = kept(asked.select("orbit", "r", "c").distinct(), "asked-tiles")

    p = soundings.where(placed & F.col("orbit").isNotNull()).select(F.col("orbit").cast(kind).alias("orbit"), lat.alias("lat"), lon.alias("lon"), F.col("xch4").cast("double").alias("xch4"), F.col("qa").cast("double").alias("qa"))
    far = reach + _EDGE
    p = p.withColumns({"r1": row(F.col("lat") - far), "r2": row(F.col("lat") + far), "c1": column(F.col("lon") - far), "c2": column(F.col("lon") + far)})
    at = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    up, out = F.col("r1") != F.col("r2"), F.col("c1") != F.col("c2")
    reached = F.array_compact(F.array(at("r1", "c1"), F.when(up, at("r2", "c1")), F.when(out, at("r1", "c2")), F.when(up & out, at("r2", "c2"))))
    p = p.select("orbit", "lat", "lon", "xch4", "qa", F.explode(reached).alias("t")).select("orbit", "t.r", "t.c", "lat", "lon", "xch4", "qa")
    p = p.join(tiles.hint("broadcast" if tiles.count() <= MOST_TILES else "merge"), ["orbit", "r", "c"], "left_semi")  # counted
    types = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = f"orbit {types['orbit']}, site {types['site']}, " + ", ".join(f"{n} double" for n in names)
    return asked.groupBy("orbit", "r", "c").cogroup(p.groupBy("orbit", "r", "c")).applyInArrow(_by_place(figures, names, reach), schema)


def _by_place(figures, names: list[str], reach: float):
    def of(asked: pa.Table, soundings: pa.Table) -> pa.Table:
        lat, lon, xch4, qa = (soundings[c].to_numpy() for c in ("lat", "lon", "xch4", "qa"))
        order = np.argsort(lat)
        lat, lon, xch4, qa = lat[order], lon[order], xch4[order], qa[order]
        places, of_row = np.unique(np.stack([asked[c].to_numpy().astype(float) for c in ("lat", "lon", "times")], 1), axis=0, return_inverse=True)
        far, got = reach + _EDGE, np.full((len(places), len(names)), np.nan)
        found = np.zeros(len(places), bool)
        turned = np.mod(lon + 180, 360)
        for i, (slat, slon, times) in enumerate(places):
            a, b = np.searchsorted(lat, slat - far), np.searchsorted(lat, slat + far, "right")
            away = np.abs(turned[a:b] - (slon + 180) % 360)
            k = a + np.flatnonzero((away <= far) | (away >= 360 - far))
            # rounded to a thousandth of a metre, so that a distance at the edge of a window does not hang on the last bit
            dlat, dlon = np.round(lat[k] - slat, 9), np.round(np.mod(lon[k] - slon + 180, 360) - 180, 9)
            near = (np.abs(dlat) <= reach) & (np.abs(dlon) <= reach)
            if near.any():
                found[i] = True
                got[i] = figures(*[np.repeat(v[near], int(times)) for v in (dlat, dlon, xch4[k], qa[k])])
        rows = np.flatnonzero(found[of_row.ravel()])
        values = got[of_row.ravel()[rows]]
        ids = [asked[c].combine_chunks().take(pa.array(rows)) for c in ("orbit", "site")]
        return pa.Table.from_arrays([*ids, *[pa.array(values[:, j], from_pandas=True) for j in range(len(names))]], names=["orbit", "site", *names])

    return of


def _percentile(values: np.ndarray, share: float) -> float:
    """Between two neighbours linearly; NaN without values."""
    if not len(values):
        return np.nan
    at = share * (len(values) - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    low, high = np.partition(values, [lo, hi])[[lo, hi]]
    return low if low == high else (hi - at) * low + (at - lo) * high


def _asked(pairs: DataFrame, found: DataFrame) -> DataFrame:
    f = found.withColumnsRenamed({"orbit": "_orbit", "site": "_site"})
    return pairs.select("orbit", "site").distinct().join(f.hint("merge"), (F.col("orbit") == F.col("_orbit")) & (F.col("site") == F.col("_site")), "left").drop("_orbit", "_site")


def _ring(dlat, dlon, xch4, qa):
    d = np.sqrt(dlat * dlat + dlon * dlon)
    first = np.flatnonzero(d == d.min())
    first = first[np.lexsort((xch4[first], dlon[first], dlat[first]))[0]]
    ring = (d >= INNER) & (d <= OUTER)
    return d[first], xch4[first], ring.sum(), _percentile(xch4[ring], 0.2)


def annulus_enhancement(soundings: DataFrame, sites: DataFrame, pairs: DataFrame, least_qa: float = 0.5) -> DataFrame:
    """(orbit, site, site_xch4, bg_xch4, enhancement, n_bg, error) of each asked (orbit, site).

    The nearest valid sounding, at most 0.15 degrees away, less the 20th percentile (linear) of valid ones at 0.25 to 1 degree. Valid: qa
    from least_qa on, with a value. error: swath_miss without a near sounding, few_background with fewer than 10 in the ring; figures
    are null then. Of equally near soundings the one further south, then west counts; repeated rows count each.
    """
    valid = soundings.where((F.col("qa") >= least_qa) & F.col("xch4").isNotNull() & ~F.isnan("xch4"))
    g = around_sites(valid, sites, pairs, _ring, ["d", "x", "n_bg", "bg"])
    j = _asked(pairs, g)
    error = F.when(F.col("d").isNull() | (F.col("d") > NEAREST), "swath_miss").when(F.col("n_bg") < LEAST_RING, "few_background")
    ok = error.isNull()
    return j.select("orbit", "site", *[F.when(ok, F.round(v, 2)).alias(k) for k, v in (("site_xch4", F.col("x")), ("bg_xch4", F.col("bg")), ("enhancement", F.col("x") - F.col("bg")))], F.coalesce("n_bg", F.lit(0)).cast("long").alias("n_bg"), error.alias("error"))


def _first(conditions: list[Column], values: list[Column], otherwise: Column) -> Column:
    out = F.when(conditions[0], values[0])
    for c, v in zip(conditions[1:], values[1:]):
        out = out.when(c, v)
    return out.otherwise(otherwise)


def _box(dlat, dlon, xch4, qa):
    away, known = np.maximum(np.abs(dlat), np.abs(dlon)), ~np.isnan(xch4)
    enough = [i for i, q in enumerate(LEVELS) if np.count_nonzero(qa >= q) >= LEAST_BOX]
    level = enough[0] if enough else len(LEVELS) - 1
    good = qa >= LEVELS[level]
    near = [good & (away <= r) for r in RADII]
    means = [xch4[n & known].mean() if (n & known).any() else np.nan for n in near]
    rated = qa[~np.isnan(qa)]
    return rated.max() if len(rated) else np.nan, level, good.sum(), _percentile(xch4[good & known], 0.5), *[n.sum() for n in near], *means


def box_enhancement(soundings: DataFrame, sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """(orbit, site, background, near_mean, enhancement, n_box, n_near, radius, qa_level, validated, error) of each asked (orbit, site).

    The quality asked for relaxes from 0.5 over 0.3 to 0 until the box of 1 degree has three soundings; the near field widens from
    0.3 over 0.5 to 0.75 degrees until it has one. Background is the median of the box, from 10 ppb above it on a site is validated. error: orbit_miss (empty box),
    cloudy (no quality of 0.01), no_near_pixels. Soundings without a value count in the numbers, not in the figures.
    """
    # NaN is the best quality, as in Spark's order; unknown quality reaches no level
    s = soundings.withColumn("qa", F.when(F.isnan("qa"), float("inf")).otherwise(F.col("qa")))
    names = ["top", "level", "n_box", "background", *[f"{c}_{k}" for c in "nm" for k in range(len(RADII))]]
    j = _asked(pairs, around_sites(s, sites, pairs, _box, names, BOX))
    j = j.withColumns({"qa_level": F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("level", F.lit(2)).cast("int") + 1), "n_box": F.coalesce("n_box", F.lit(0)).cast("long")})
    has = [F.col(f"n_{k}") >= 1 for k in range(len(RADII))]
    pick = lambda values: _first(has, values, F.lit(None))
    j = j.withColumns({"radius": pick([F.lit(r) for r in RADII]), "n_near": pick([F.col(f"n_{k}") for k in range(3)]), "near_mean": pick([F.col(f"m_{k}") for k in range(3)])})
    error = F.when(F.col("n_box") == 0, "orbit_miss").when(F.col("top") < 0.01, "cloudy").when(F.col("radius").isNull(), "no_near_pixels")
    ok = error.isNull()
    rise = F.col("near_mean") - F.col("background")
    shown = F.when(F.coalesce(error, F.lit("")).isin("orbit_miss", "cloudy"), None)
    return j.select(
        "orbit", "site", shown.otherwise(F.round("background", 2)).alias("background"), F.when(ok, F.round("near_mean", 2)).alias("near_mean"), F.when(ok, F.round(rise, 2)).alias("enhancement"), "n_box",
        F.when(ok, F.col("n_near")).otherwise(0).cast("long").alias("n_near"), F.when(ok, F.col("radius")).alias("radius"), F.when(ok, F.col("qa_level")).alias("qa_level"), F.when(ok, rise >= VALIDATED_PPB).alias("validated"), error.alias("error"),
    )


def orbit_candidates(obs: DataFrame, orbits: DataFrame, days: int = 2) -> DataFrame:
    """(id, site, orbit, night, seconds): orbits (orbit, start) that begin within `days` days of an observation (id, site, date).

    An observation meets the orbits of each of its 2 x days + 1 days by equality. Candidates are ordered by night (a start
    outside of 11 to 14 h UTC), then by seconds from 12:30 of the observation's day.
    """
    o = obs.where("date is not null").select("id", "site", "date", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("day"))
    b = orbits.where("start is not null").select("orbit", "start", F.to_date("start").alias("day"))
    j = o.join(b.hint("merge"), "day")
    seconds = F.abs(F.unix_timestamp("start") - F.unix_timestamp(F.col("date").cast("timestamp")) - 45_000)
    night = ~((F.hour("start") >= DAY_HOURS[0]) & (F.hour("start") < DAY_HOURS[1]))
    return j.select("id", "site", "orbit", night.alias("night"), seconds.alias("seconds"))


def orbit_colocation(obs: DataFrame, orbits: DataFrame, soundings: DataFrame, sites: DataFrame, days: int = 2) -> DataFrame:
    """(id, orbit, n_tried, enhancement, error) of every observation: its first candidate orbit that has a result.

    Candidates are tried in order; one whose swath misses the site gives way to the next, any other error ends the search with it. If
    all miss, the last one's error stays; without candidates the error is no_orbit. Equally good candidates go by orbit.
    The orbits of an observation (some 15 a day) are one sorted aggregate; repeated observations count each.
    """
    c = orbit_candidates(obs, orbits, days)
    got = annulus_enhancement(soundings, sites, c.select("orbit", "site"))
    got = got.select(F.col("orbit").alias("o"), F.col("site").alias("s"), "enhancement", "error")
    j = c.distinct().join(got.hint("merge"), (F.col("orbit") == F.col("o")) & (F.col("site") == F.col("s")))
    tried = F.array_sort(F.collect_list(F.struct("night", "seconds", "orbit", "enhancement", "error")))
    g = j.groupBy(F.col("id").alias("of")).agg(tried.alias("t"))
    stop = F.array_position(F.transform("t", lambda x: F.coalesce(x["error"], F.lit("")) != "swath_miss"), True)
    n = F.when(stop > 0, stop).otherwise(F.size("t")).cast("int")
    g = g.withColumn("n", n).withColumn("x", F.element_at("t", F.col("n")))
    out = obs.select("id").join(g.hint("merge"), F.col("id") == F.col("of"), "left")
    return out.select("id", "x.orbit", F.coalesce("n", F.lit(0)).cast("long").alias("n_tried"), "x.enhancement", F.when(F.col("n").isNull(), "no_orbit").otherwise(F.col("x.error")).alias("error"))


def dual_sensor_pairs(scores: DataFrame, second: DataFrame) -> DataFrame:
    """scores (site, date, ...) with second_enhancement and has_second from second (site, date, enhancement); of several of one site and day the greatest."""
    t = second.groupBy(F.col("site").alias("_site"), F.col("date").alias("_date")).agg(F.max("enhancement").alias("second_enhancement"))
    j = scores.join(t.hint("merge"), (F.col("site") == F.col("_site")) & (F.col("date") == F.col("_date")), "left").drop("_site", "_date")
    return j.withColumn("has_second", F.col("second_enhancement").isNotNull())


def region_contrast(soundings: DataFrame, a: tuple[float, float, float, float], b: tuple[float, float, float, float], qa_min: float = 0.5) -> DataFrame:
    """A row for each orbit: exact statistics of valid soundings in the boxes a and b (west, south, east, north, edges included), their difference, ratio and a verdict.

    Valid: qa at least qa_min and xch4 below 1e10; null and NaN are not. The ratio of the means rounded to two places gives 'validated' from 1.05, 'marginal' from 1.01,
    else 'not_confirmed'; where a mean is missing or 0 the verdict is 'no_data'. A sounding in both boxes counts in both. Orbits without any in a box are in the result.
    """
    ok = F.coalesce((F.col("qa") >= qa_min) & (F.col("xch4") < 1e10), F.lit(False))
    place = lambda box: F.coalesce(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]), F.lit(False))
    where = F.array(*[F.when(ok & place(box), F.lit(k)) for k, box in (("a", a), ("b", b))])
    x = soundings.select("orbit", "xch4", F.explode(F.array_compact(where)).alias("box")).withColumn("g", F.struct("orbit", "box"))
    q = order_statistics(x, "xch4", {"p25": "1 + (n - 1) * 0.25", "median": "1 + (n - 1) * 0.5", "p75": "1 + (n - 1) * 0.75"}, "g")
    m = x.groupBy("g").agg(F.avg("xch4").alias("mean"), F.stddev_pop("xch4").alias("std"), F.min("xch4").alias("least"), F.max("xch4").alias("greatest"))
    m = m.withColumnRenamed("g", "g_m")
    names = ["mean", "median", "std", "p25", "p75", "least", "greatest"]
    s = q.join(m.hint("merge"), F.col("g") == F.col("g_m")).select(F.col("g.orbit").alias("o"), F.col("g.box").alias("box"), "n", *names)
    pick = lambda k, c: F.max(F.when(F.col("box") == k, F.col(c)))
    s = s.groupBy("o").agg(*[F.coalesce(pick(k, "n"), F.lit(0)).alias(f"n_{k}") for k in "ab"], *[F.round(pick(k, c), 2).alias(f"{c}_{k}") for k in "ab" for c in names])
    j = soundings.select("orbit").distinct().join(s.hint("merge"), F.col("orbit") == F.col("o"), "left").drop("o").fillna(0, ["n_a", "n_b"])
    both = (F.col("mean_a") != 0) & (F.col("mean_b") != 0)
    gain, ratio = F.when(both, F.round(F.col("mean_a") - F.col("mean_b"), 2)), F.when(both, F.round(F.col("mean_a") / F.col("mean_b"), 3))
    verdict = F.when(F.col("ratio") >= 1.05, "validated").when(F.col("ratio") >= 1.01, "marginal").when(F.col("ratio").isNotNull(), "not_confirmed").otherwise("no_data")
    j = j.withColumns({"enhancement": gain, "ratio": ratio})
    return j.withColumns({"enhancement_pct": F.round(F.col("enhancement") / F.col("mean_b") * 100, 1), "verdict": verdict})
