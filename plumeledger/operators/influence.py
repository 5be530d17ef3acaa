"""How much results rest on single scenes, months, thresholds and parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import hazard as H
from plumeledger.functions import scalars as S
from plumeledger.functions.running import binned_statistics, bins_of, order_statistics
from plumeledger.operators import risk as R
from plumeledger.operators.validation import roc_curve
from plumeledger.sources.scratch import kept

# What stands around the middle of n ordered values once one of them is taken out.
_MIDDLE = {"m": "(n + 1) / 2.0", "a": "floor(n / 2.0)", "a1": "floor(n / 2.0) + 1", "b": "ceil(n / 2.0)", "b1": "ceil(n / 2.0) + 1"}


def _influence(full: Column, left: Column) -> Column:
    """|full - left| over |full|; null where either is unknown or full is 0."""
    return F.when(full != 0, F.abs(full - left) / F.abs(full))


def leave_one_out(df: DataFrame, by: str, score: str, hit: str) -> DataFrame:
    """df's hits (rows with a score and the flag `hit`), each with the group's rate, mean and median of hits without it.

    Added: n (rows with a score), k (hits), rate, loo_rate, delta_rate, loo_mean, loo_median, influence_rate, influence_mean. An
    influence is the relative change. Without other hits the rate is 0 and mean and median are null. Null scores do not count; null flags
    are no hits; repeated rows count one by one; null groups are a group. The median without a value needs
    four of the group's ordered values only: where the next value is no greater than the one taken out, that place keeps its value, else
    the next one moves down. They are ranked by ranges, so a hot group is no window of one task.
    """
    used = df.where(F.col(score).isNotNull())
    flag = F.coalesce(F.col(hit), F.lit(False))
    g = used.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"), F.sum(F.when(flag, F.col(score))).alias("_sum"))
    mid = order_statistics(used.where(flag), score, _MIDDLE, by).drop("n").withColumnsRenamed({by: "_mid", **{c: f"_{c}" for c in _MIDDLE}})
    g = g.join(mid.hint("merge"), F.col("_by").eqNullSafe(F.col("_mid")))
    j = used.where(flag).join(g.hint("merge"), F.col(by).eqNullSafe(F.col("_by")))
    x, n, k, total = F.col(score), F.col("n"), F.col("k"), F.col("_sum")
    without = lambda at, after: F.when(F.col(after) <= x, F.col(at)).otherwise(F.col(after))
    others = k > 1
    rate, mean = k / n, total / k
    loo_rate = F.when(others, (k - 1) / (n - 1)).otherwise(0.0)
    loo_mean = F.when(others, (total - x) / (k - 1))
    out = j.withColumns({
        "rate": rate, "loo_rate": loo_rate, "delta_rate": loo_rate - rate, "loo_mean": loo_mean,
        "loo_median": F.when(others, (without("_a", "_a1") + without("_b", "_b1")) / 2),
        "influence_rate": _influence(rate, loo_rate), "influence_mean": _influence(mean, loo_mean),
    })
    return out.drop("_by", "_mid", "_sum", *[f"_{c}" for c in _MIDDLE])


def leave_month_out(df: DataFrame, by: str, day: str, score: str, hit: str) -> DataFrame:
    """(by, month, n_scenes, top, ...): leave_one_out() over months. A month is a hit if one of its scenes is, with the greatest score of those and their number; months without any score are left out."""
    flag = F.coalesce(F.col(hit), F.lit(False))
    x = F.when(flag, F.col(score))
    m = df.where(F.col(score).isNotNull()).groupBy(by, F.trunc(day, "month").alias("month")).agg(F.count(x).alias("n_scenes"), F.max(x).alias("top"), F.bool_or(flag).alias("hit"))
    return leave_one_out(m.withColumn("_score", F.coalesce("top", F.lit(0.0))), by, "_score", "hit").drop("hit", "_score")


def roc_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """roc_curve() with precision and f1, and with the thresholds 0 and greatest score + 1 where no score is such.

    Rows without score or with another label than 0 and 1 are left out. At a threshold, scores at or above it are positive. f1 and rates without a divisor are 0.
    """
    d = df.where(F.col(score).isNotNull() & F.col(y).isin(0, 1))
    c = roc_curve(d, y, score)
    z = d.agg(F.max(score).alias("top"), *[F.count_if((F.col(y) == v) & w).alias(f"{n}{v}") for v in (0, 1) for n, w in (("all", F.lit(True)), ("up", F.col(score) >= 0))], F.count_if(F.col(score) == 0).alias("zero"))
    whole = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    point = lambda t, tp, fp, tpr, fpr: F.struct(t.cast("double").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all1") - tp).alias("fn"), (F.col("all0") - fp).alias("tn"), tpr.alias("tpr"), fpr.alias("fpr"))
    ends = z.where("top is not null").select(F.inline(F.array(
        point(F.col("top") + 1, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)),
        F.when(F.col("zero") == 0, point(F.lit(0), F.col("up1"), F.col("up0"), whole("up1", "all1"), whole("up0", "all0"))),
    ))).where("threshold is not null")
    names = ["threshold", "tp", "fp", "fn", "tn", "tpr", "fpr"]
    p = c.select(F.col("threshold").cast("double").alias("threshold"), *names[1:]).unionByName(ends)
    right = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    both = F.when(F.col("precision") + F.col("tpr") > 0, 2 * F.col("precision") * F.col("tpr") / (F.col("precision") + F.col("tpr"))).otherwise(0.0)
    return p.withColumn("precision", right).withColumn("f1", both)


def sensor_sensitivity(df: DataFrame, score_steps: list[float], second_steps: list[float], score_base: float = 1.15, second_base: float = 5.0) -> DataFrame:
    """(parameter, base, value, n_base, n, change_pct) of detections (score) and of those the second sensor confirms (score, enhancement).

    Each threshold is moved by its steps with the other at its base; a value at the threshold is above it. The change is of at least one base detection. One pass.
    """
    s, e = F.col("score"), F.col("enhancement")
    tests = [("score", score_base, score_base + d, s >= score_base, s >= score_base + d) for d in score_steps]
    tests += [("enhancement", second_base, second_base + d, (s >= score_base) & (e >= second_base), (s >= score_base) & (e >= second_base + d)) for d in second_steps]
    g = df.agg(*[F.count_if(c).alias(f"{k}{i}") for i, t in enumerate(tests) for k, c in (("b", t[3]), ("n", t[4]))])
    rows = [F.struct(F.lit(t[0]).alias("parameter"), F.lit(float(t[1])).alias("base"), F.lit(float(t[2])).alias("value"), F.col(f"b{i}").alias("n_base"), F.col(f"n{i}").alias("n")) for i, t in enumerate(tests)]
    r = g.select(F.inline(F.array(*rows)))
    return r.withColumn("change_pct", F.round((F.col("n") - F.col("n_base")) / F.greatest(F.col("n_base"), F.lit(1)) * 100, 1))


def release_table(df: DataFrame, half80: float = 0.30, half95: float = 0.46) -> DataFrame:
    """A row over all (regime null) and a row a known regime: errors of the estimates and how often their intervals hold the truth.

    df: regime, status, quantified, detected, truth, estimate, and optionally lo80, hi80, lo95, hi95; without these the intervals are the
    estimate times 1 less and plus the halves. Only rows of status ok, quantified, with truth and estimate are measured; the detection
    rate is of all rows. Regimes without a measured row are left out, as is the regime null but for the total.
    """
    for name, half, sign in (("lo80", half80, -1), ("hi80", half80, 1), ("lo95", half95, -1), ("hi95", half95, 1)):
        if name not in df.columns:
            df = df.withColumn(name, F.col("estimate") * (1 + sign * half))
    ok = (F.col("status") == "ok") & F.col("quantified") & F.col("truth").isNotNull() & F.col("estimate").isNotNull()
    e = F.when(ok, F.col("estimate") - F.col("truth"))
    inside = lambda c: F.count_if(ok & F.col("truth").between(F.col(f"lo{c}"), F.col(f"hi{c}")))
    g = df.rollup("regime").agg(
        F.grouping("regime").alias("_all"), F.count("*").alias("n_scenes"), F.count(e).alias("n_quantified"), F.count_if(F.col("detected")).alias("n_detected"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), inside(80).alias("_80"), inside(95).alias("_95"),
    ).where("n_quantified > 0 and (_all = 1 or regime is not null)")
    share = lambda a, b: F.round(F.col(a) / F.col(b), 3)
    return g.select("regime", "n_scenes", "n_quantified", "n_detected", share("n_detected", "n_scenes").alias("rate"), *[F.round(c, 3).alias(c) for c in ("rmse", "bias", "mae")], share("_80", "n_quantified").alias("ci80"), share("_95", "n_quantified").alias("ci95"))


def calibration_state(df: DataFrame, stored: DataFrame) -> DataFrame:
    """(section, value, n): rows in all, ok, valid (ok with a score), without a score and failed; valid ones by ecoregion; and how many more are valid than the stored threshold was made of.

    df: status, sc_cfar, ecoregion (null: unknown). stored: a table of threshold records with column n; the greatest counts, and without
    one all valid rows are new. The section stale has 0 where the threshold is up to date.
    """
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    valid = ok & F.col("sc_cfar").isNotNull()
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in (("all", F.lit(True)), ("ok", ok), ("valid", valid), ("no_score", ok & F.col("sc_cfar").isNull()), ("failed", ~ok))])
    known = stored.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("_n"))
    both = counts.crossJoin(F.broadcast(known))  # one row each
    row = lambda s, v, n: F.struct(F.lit(s).alias("section"), F.lit(v).alias("value"), n.alias("n"))
    rows = [row("state", n, F.col(n)) for n in ("all", "ok", "valid", "no_score", "failed")] + [row("stale", "new_scores", F.greatest(F.lit(0).cast("long"), F.col("valid") - F.col("_n")))]
    regions = df.where(valid).groupBy(F.coalesce("ecoregion", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("ecoregion").alias("section"), "value", "n")
    return both.select(F.inline(F.array(*rows))).unionByName(regions)


#: Parameters of the portfolio tornado: name, base, low and high value.
PARAMETERS = [
    ("sensitivity", 4e-7, 3.2e-7, 4.8e-7), ("wind", 1.0, 0.7, 1.3), ("plume_length", 1.0, 0.8, 1.2), ("cfar_k", 3.0, 2.5, 3.5), ("sc_threshold", 1.15, 1.1, 1.2),
    ("uncertainty_pct", 30.0, 25.0, 35.0), ("price_eur", 65.0, 50.0, 80.0), ("gwp100", 29.8, 27.8, 31.8), ("discount_rate", 0.03, 0.02, 0.04), ("multiplier", 1.0, 0.8, 1.2),
]
#: Draws, by site and path, of a task.
TASK_DRAWS = 1_000_000
#: Power with which a parameter enters a site's cost; the others enter otherwise.
_POWERS = {"sensitivity": -1, "wind": 1, "plume_length": -1, "price_eur": 1, "gwp100": 1, "multiplier": 1}


def _detections(scores: DataFrame, rules: list[tuple[float, float]]) -> DataFrame:
    """(rule, site, p, p_lo, p_hi, flow) of each detection rule (threshold, k): a score is a detection above threshold + k * cv. One pass over the scores."""
    ok = (F.col("status") == "ok") & F.col("sc_cfar").isNotNull() & F.col("cv").isNotNull()
    hits = [ok & (F.col("sc_cfar") > t + k * F.col("cv")) for t, k in rules]
    g = scores.groupBy("site").agg(F.count_if(ok).alias("n"), *[a for i, h in enumerate(hits) for a in (F.count_if(h).alias(f"k{i}"), F.avg(F.when(h, F.col("sc_cfar"))).alias(f"m{i}"))])
    r = g.select("site", "n", F.inline(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"k{i}").alias("k"), F.col(f"m{i}").alias("m")) for i in range(len(rules))])))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    flow = F.greatest(F.lit(0.0), F.coalesce("m", F.lit(1.0)) - 1) * 25
    return r.select("rule", "site", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("p"), lo.alias("p_lo"), hi.alias("p_hi"), flow.alias("flow"))


class _Draws:
    """A path's tonnes of each site and kind, worked out as arrays in a task. held: (site, kind, a, b, mu) ordered by site and kind; a group is a site's place and a kind."""

    def __init__(self, held: list[tuple], kinds: list[tuple[int, float]], n_rates: int, scale: float):
        self.held, self.kinds, self.n_rates, self.scale = held, kinds, n_rates, scale

    def _blocks(self, batches):
        """The columns of some R.DRAWS paths at a time."""
        some, n = [], 0
        for b in batches:
            some, n = some + [b], n + b.num_rows
            if n >= R.DRAWS:
                yield self._columns(some)
                some, n = [], 0
        if n:
            yield self._columns(some)

    @staticmethod
    def _columns(some):
        return [c.to_numpy() for c in pa.Table.from_batches(some).columns]

    def _tonnes(self, path):
        """(group, tonnes) of the paths, one group after the other; what kinds of a site share is worked out once."""
        kinds = len(self.kinds)
        for i in range(0, len(self.held), kinds):
            u1, y1, z2 = R.site_draws(path, self.held[i][0])
            shares = {}
            for g, (_, kind, a, b, mu) in enumerate(self.held[i : i + kinds], i):
                rule, sd = self.kinds[kind]
                if rule not in shares:
                    shares[rule] = R.beta_points(u1, y1, a, b)
                yield g, shares[rule] * (0.0 if mu is None else np.exp(mu + sd * z2)) * self.scale

    def counted(self, batches):
        """For mapInArrow: (g, b, c) of the last year's costs by group and bin, with the sums of the discounted costs in a group's first row."""
        for path, last, *npv in self._blocks(batches):
            for g, t in self._tonnes(path):
                b = bins_of(t * last)
                low = int(b.min())
                c = np.bincount(b - low)
                at = np.flatnonzero(c)
                rest = [None] * (len(at) - 1)
                sums = [pa.array([float((t * x).sum()), *rest], pa.float64()) for x in npv]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array((at + low).astype(np.int32)), pa.array(c[at]), *sums], names=["g", "b", "c", *[f"npv{i}" for i in range(self.n_rates)]])

    def of_bins(self, bins: list[tuple[int, int]]):
        """For mapInArrow: (g, b, v), the last year's costs that lie in one of the bins (g, b)."""
        wanted = {}
        for g, b in bins:
            wanted.setdefault(g, []).append(b)

        def of(batches):
            for path, last, *_ in self._blocks(batches):
                for g, t in self._tonnes(path):
                    v = t * last
                    b = bins_of(v)
                    at = np.flatnonzero(np.isin(b, wanted.get(g, [])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(b[at]), pa.array(v[at])], names=["g", "b", "v"])

        return of


def portfolio_tornado(paths: DataFrame, scores: DataFrame, scenario: str = "orderly", years: int = 10, first: int = 2024, parameters: list[tuple] = PARAMETERS) -> DataFrame:
    """(parameter, level, value, var95, npv, delta_var95, delta_npv, place): the portfolio's last-year 95th percentile and mean discounted cost with each parameter at its low and high value.

    Sums of the sites' figures, as in portfolio_stress(). Thresholds work on the scores anew, the uncertainty on the spread of the flows, the rate on the
    discounting; the others scale a site's cost, by which its percentile and mean scale too, so that only runs of
    another rule or spread are drawn (seven, not twenty-one). place: 1 for the parameter whose greater change of var95 is the
    greatest; equal changes have equal places. Draws are of the path and site numbers alone, so all runs share them. Percentiles are ranked by ranges.
    Paths, or scores, without rows give no rows.
    """
    base = {n: b for n, b, _, _ in parameters}
    get = lambda run, n: run.get(n, base.get(n, next(p[1] for p in PARAMETERS if p[0] == n)))
    runs = [("base", "base", {})] + [(n, tag, {n: v}) for n, _, low, high in parameters for tag, v in (("low", low), ("high", high))]
    rules = sorted({(get(r, "sc_threshold"), get(r, "cfar_k")) for _, _, r in runs})
    rates = sorted({get(r, "discount_rate") for _, _, r in runs})
    kinds = sorted({(rules.index((get(r, "sc_threshold"), get(r, "cfar_k"))), get(r, "uncertainty_pct") / 100) for _, _, r in runs})
    of_kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(rule).alias("rule"), F.lit(float(sd)).alias("sd")) for i, (rule, sd) in enumerate(kinds)])
    a, b = H.beta_moments(F.col("p"), F.col("p_lo"), F.col("p_hi"))
    sites = _detections(scores, rules).where("site is not null").select(F.col("site").cast("long").alias("site"), a.alias("a"), b.alias("b"), "flow", F.inline(F.filter(of_kinds, lambda k: k["rule"] == F.col("rule"))))
    sites = sites.select("site", "kind", "a", "b", F.when(F.col("flow") > 0, F.log("flow") - F.col("sd") * F.col("sd") / 2).alias("mu"))
    # Every site meets every path, which is what is asked for; the few sites go to the tasks through the driver.
    held = sites.orderBy("site", "kind").take(R.MOST_SITES * len(kinds) + 1)
    if len(held) > R.MOST_SITES * len(kinds):
        raise ValueError(f"more than {R.MOST_SITES} sites: run them in parts")
    # A path's last price and discounted prices, with the multipliers of the years.
    cost = [F.col(f"price_{i}") * float(R.interpolated(R.SCENARIOS[scenario]["multiplier"], first + i)) for i in range(years)]
    npv = [sum((c / (1 + r) ** (i + 1) for i, c in enumerate(cost)), F.lit(0.0)) for r in rates]
    # One small file would be one task, and tasks of few draws take longer to start than to run.
    known = paths.where("path is not null").select(F.col("path").cast("long").alias("path"))
    dealt = known.repartition(known.count() * (len(held) // len(kinds)) // TASK_DRAWS + 1)
    folded = R.priced(dealt, scenario, years, first).select("path", cost[-1].alias("last"), *[v.alias(f"npv{i}") for i, v in enumerate(npv)])
    draws = _Draws([tuple(r) for r in held], kinds, len(rates), 8760 * 0.85 / 1000 * base.get("gwp100", 29.8))
    # Drawn twice, since that takes less than to write a number for each path, site and kind: to count and add up, and to fetch the values of a few bins.
    counted = folded.mapInArrow(draws.counted, "g long, b int, c long, " + ", ".join(f"npv{i} double" for i in range(len(rates))))
    bins = kept(counted.groupBy("g", "b").agg(*[F.sum(c).alias(c) for c in counted.columns[2:]]), "tornado-bins")
    rows_of = lambda some: folded.mapInArrow(draws.of_bins([tuple(r) for r in some.select("g1", "b1").collect()]), "g long, b int, v double")  # two bins a group at most
    tail = binned_statistics(bins.select("g", "b", "c"), rows_of, {"var95": "1 + (n - 1) * 0.95D"}, "group")
    mean = bins.groupBy(F.col("g").alias("_of")).agg(*[F.sum(f"npv{i}").alias(f"npv{i}") for i in range(len(rates))])
    per = tail.join(mean.hint("merge"), F.col("group") == F.col("_of")).groupBy((F.col("group") % len(kinds)).cast("int").alias("kind")).agg(F.sum("var95").alias("var95"), *[F.sum(F.col(f"npv{i}") / F.col("n")).alias(f"npv{i}") for i in range(len(rates))])
    per = kept(per, "tornado-kinds")  # few rows from here on: one a kind, then one a run
    rows = []
    for name, level, run in runs:
        kind = kinds.index((rules.index((get(run, "sc_threshold"), get(run, "cfar_k"))), get(run, "uncertainty_pct") / 100))
        scale = 1.0
        for n, power in _POWERS.items():
            scale *= (get(run, n) / get({}, n)) ** power
        rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("parameter"), F.lit(level).alias("level"), F.lit(float(run.get(name, 0.0))).alias("value"), F.lit(float(scale)).alias("scale"), F.lit(rates.index(get(run, "discount_rate"))).alias("rate")))
    got = per.select("*", F.filter(F.array(*rows), lambda r: r["kind"] == F.col("kind")).alias("runs"))
    npv = F.element_at(F.array(*[F.col(f"npv{i}") for i in range(len(rates))]), F.col("r.rate") + 1)
    got = got.withColumn("r", F.explode("runs")).select("r.parameter", "r.level", "r.value", (F.col("var95") * F.col("r.scale")).alias("var95"), (npv * F.col("r.scale")).alias("npv"))
    zero = got.where("parameter = 'base'").select(F.col("var95").alias("_v"), F.col("npv").alias("_n"))
    got = got.where("parameter <> 'base'").crossJoin(F.broadcast(zero)).withColumns({"delta_var95": F.col("var95") - F.col("_v"), "delta_npv": F.col("npv") - F.col("_n")})  # one row
    most = got.groupBy("parameter").agg(F.round(F.max(F.abs("delta_var95")), 2).alias("_most"))
    order = most.agg(F.array_sort(F.collect_list("_most")).alias("_all"))  # a number a parameter
    place = most.crossJoin(F.broadcast(order)).select(F.col("parameter").alias("_p"), (F.size(F.filter("_all", lambda v: v > F.col("_most"))) + 1).alias("place"))
    out = got.join(F.broadcast(place), F.col("parameter") == F.col("_p"))
    return out.select("parameter", "level", "value", *[F.round(c, 2).alias(c) for c in ("var95", "npv", "delta_var95", "delta_npv")], "place")
