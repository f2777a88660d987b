"""Layer 4: cost distributions of three quota policies, expected costs, stochastic dominance of the second order.

The resampled distribution of a pair's monthly demand tends to its empirical one, so that the exact mode weighs each
month alike and needs no draws. The seeded mode draws by a hash of pair, policy and replica, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .panel import PAIR

POLICIES = ("atual", "conservadora", "buffer")
#: (result column, policy A, policy B)
COMPARED = (("dom_conserv_vs_atual", "conservadora", "atual"), ("dom_buffer_vs_atual", "buffer", "atual"), ("dom_buffer_vs_conserv", "buffer", "conservadora"))


def quotas(policies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Whole quotas of the material pairs: today's is rounded, the others rounded up, none below 0."""
    up = lambda x: F.greatest(F.ceil(x).cast("double"), F.lit(0.0))
    return policies.where(F.col("consumo_medio_mensal") >= settings.least_mean).select(
        *PAIR, F.greatest(F.rint("consumo_reg_medio"), F.lit(0.0)).alias("q_atual"), up(F.col("cota_conservadora")).alias("q_conservadora"), up(F.col("cota_buffer")).alias("q_buffer")
    )


def cost(demand: Column, quota: Column, settings: Settings = Settings()) -> Column:
    """What is short costs more than what is left over."""
    zero = F.lit(0.0)
    return settings.shortage_cost * F.greatest(zero, demand - quota) + settings.excess_cost * F.greatest(zero, quota - demand)


def series(panel: DataFrame) -> DataFrame:
    """(unidade, produto, s): monthly demand in order of months; pairs that never ask for anything are left out."""
    rows = panel.groupBy("unidade", "produto").agg(F.sort_array(F.collect_list(F.struct("mes", F.col("consumo_total").alias("v")))).alias("s"))
    rows = rows.select("unidade", "produto", F.transform("s", lambda x: x["v"]).alias("s"))
    return rows.where(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) != 0)


def costs(panel: DataFrame, policies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Quotas with c_<policy>, the cost of each month as an array."""
    return costs_of(series(panel), policies, settings)


def costs_of(demand: DataFrame, policies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """costs() over demand(unidade, produto, s), any equally likely demands of a pair."""
    rows = quotas(policies, settings).join(demand, ["unidade", "produto"])
    of = lambda quota: F.transform("s", lambda d: cost(d, F.col(quota), settings))
    return rows.withColumns({f"c_{p}": of(f"q_{p}") for p in POLICIES})


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def expected(rows: DataFrame) -> DataFrame:
    """Adds the expected cost of each policy and the cheapest; of equal ones the first."""
    out = rows.withColumns({f"custo_esp_{p}": _mean(F.col(f"c_{p}")) for p in POLICIES})
    a, b, c = (F.round(F.col(f"custo_esp_{p}"), 9) for p in POLICIES)
    return out.withColumn("politica_preferida", F.when((a <= b) & (a <= c), "atual").when(b <= c, "conservadora").otherwise("com_buffer"))


def grid_point(low: Column, high: Column, i: Column, points: int) -> Column:
    """Point i of equally spaced ones from low to high; the last is high itself."""
    return F.when(i == points - 1, high).otherwise(i * ((high - low) / (points - 1)) + low)


def grid_places(x: Column, low: Column, high: Column, points: int) -> Column:
    """Of each cost the first grid point that is not below it: by the step's width, then checked on the grid itself."""

    def place(v: Column) -> Column:
        near = F.ceil(F.try_divide(v - low, (high - low) / (points - 1)))  # null where all costs are one
        reached = lambda i: (i >= 0) & (grid_point(low, high, i, points) >= v)
        return F.least(F.when(reached(near - 1), near - 1).when(reached(near), near).otherwise(near + 1), F.lit(points - 1)).cast("int")

    return F.transform(x, place)


def _levels(a: Column, b: Column, points: int) -> Column:
    """The grid points before a count grows, and the last: between them cumulated counts grow linearly."""
    return F.filter(F.array_union(F.transform(F.array_union(a, b), lambda i: i - 1), F.array(F.lit(points - 1))), lambda i: i >= 0)


def place_gaps(a: Column, b: Column, points: int) -> Column:
    """By how much the cumulated counts of a exceed those of b, at the points that decide for the whole grid."""
    total = lambda x, i: F.aggregate(x, F.lit(0), lambda s, k: s + F.greatest(i - k + 1, F.lit(0)))
    return F.transform(_levels(a, b, points), lambda i: total(a, i) - total(b, i))


def weighted_gaps(a: Column, wa: Column, b: Column, wb: Column, points: int) -> Column:
    """place_gaps() where each place of a counts as often as wa says, and of b as wb says."""
    part = lambda x, w, i: F.zip_with(x, w, lambda k, n: n * F.greatest(i - k + 1, F.lit(0)))
    total = lambda x, w, i: F.aggregate(part(x, w, i), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(_levels(a, b, points), lambda i: total(a, wa, i) - total(b, wb, i))


def winner(gaps: Column) -> Column:
    less, more = F.exists(gaps, lambda d: d < 0), F.exists(gaps, lambda d: d > 0)
    return F.when(less & ~more, "A").when(more & ~less, "B").otherwise("nenhuma")


def dominance(a: Column, b: Column, points: int = 200) -> Column:
    """A if the cumulated distribution of costs a never exceeds that of b and once is less; B the other way; else nenhuma.

    Cumulated on a grid by counts, so that there are no rounding ties. Larger costs have the smaller distribution:
    this orientation marks the policy with the larger costs; cheaper() is the right way round.
    """
    low, high = F.least(F.array_min(a), F.array_min(b)), F.greatest(F.array_max(a), F.array_max(b))
    return F.when(low == high, "nenhuma").otherwise(winner(place_gaps(grid_places(a, low, high, points), grid_places(b, low, high, points), points)))


def cheaper(a: Column, b: Column) -> Column:
    """A if the mean cost beyond every level is never more for a than for b and once is less; B the other way.

    The mean excess is piecewise linear, so the costs themselves, as levels, decide exactly.
    """
    levels = F.array_union(a, b)
    excess = lambda x, z: F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.greatest(v - z, F.lit(0.0))), 9)
    less = F.exists(levels, lambda z: excess(a, z) < excess(b, z))
    more = F.exists(levels, lambda z: excess(a, z) > excess(b, z))
    return F.when(less & ~more, "A").when(more & ~less, "B").otherwise("nenhuma")


def dominated(rows: DataFrame, settings: Settings = Settings(), mode: str = "reference") -> DataFrame:
    """Adds the three comparisons of policies; mode is 'reference' (dominance) or 'cost' (cheaper)."""
    if mode != "reference":
        return rows.withColumns({name: cheaper(F.col(f"c_{a}"), F.col(f"c_{b}")) for name, a, b in COMPARED})
    c, points, each = F.col, settings.grid, range(len(COMPARED))
    # bounds, places and gaps are columns of their own, so that each is computed once
    out, sides = rows, [(f"c_{a}", f"c_{b}") for _, a, b in COMPARED]
    out = out.withColumns({f"__lo{k}": F.least(*(F.array_min(x) for x in sides[k])) for k in each} | {f"__hi{k}": F.greatest(*(F.array_max(x) for x in sides[k])) for k in each})
    out = out.withColumns({f"__{s}{k}": grid_places(c(x), c(f"__lo{k}"), c(f"__hi{k}"), points) for k in each for s, x in zip("ab", sides[k], strict=True)})
    out = out.withColumns({f"__gaps{k}": place_gaps(c(f"__a{k}"), c(f"__b{k}"), points) for k in each})
    found = {name: F.when(c(f"__lo{k}") == c(f"__hi{k}"), "nenhuma").otherwise(winner(c(f"__gaps{k}"))) for k, (name, _, _) in enumerate(COMPARED)}
    return out.withColumns(found).select(*rows.columns, *found)


def cdf_grid(rows: DataFrame, a: str = "conservadora", b: str = "atual", points: int = 200) -> DataFrame:
    """The grid itself as rows: point, share of both costs up to it."""
    low = F.least(F.array_min(f"c_{a}"), F.array_min(f"c_{b}"))
    high = F.greatest(F.array_max(f"c_{a}"), F.array_max(f"c_{b}"))
    out = rows.where(low < high).withColumns({"lo": low, "hi": high}).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = out.withColumn("z", grid_point(F.col("lo"), F.col("hi"), F.col("i"), points))
    share = lambda p: F.size(F.filter(f"c_{p}", lambda v: v <= F.col("z"))) / F.size(f"c_{p}")
    return out.select(*PAIR, "i", "z", share(a).alias("f_a"), share(b).alias("f_b"))


def draw(pair: list[str], policy: Column, replica: Column, size: Column, seed: int) -> Column:
    """A place below size, from the hash of pair, policy, replica and seed."""
    text = F.concat_ws("|", *(F.col(x) for x in pair), policy, replica.cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size).cast("int")


def _draws(rows: DataFrame, settings: Settings) -> DataFrame:
    """(pair, politica, q, s, i): settings.replicas independent draws i of a month for each pair and policy."""
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *PAIR)  # few rows, which become many
    each = rows.withColumn("p", F.explode(F.array(*(F.struct(F.lit(p).alias("name"), F.col(f"q_{p}").alias("q")) for p in POLICIES))))
    each = each.select(*PAIR, "s", F.col("p.name").alias("politica"), F.col("p.q").alias("q")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(settings.replicas - 1))))
    return each.select(*PAIR, "politica", "q", "s", draw(PAIR, F.col("politica"), F.col("r"), F.size("s"), settings.seed).alias("i"))


def seeded_costs(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Expected costs of resampled demand."""
    demand = F.get("s", F.col("i"))
    each = _draws(rows, settings).select(*PAIR, "politica", F.greatest(demand - F.col("q"), F.lit(0.0)).alias("short"), F.greatest(F.col("q") - demand, F.lit(0.0)).alias("over"))
    total = settings.shortage_cost * F.sum("short") + settings.excess_cost * F.sum("over")
    return each.groupBy(*PAIR, "politica").agg((total / F.count("*")).alias("custo_esperado"))


def drawn(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """costs() rows with h_<policy>: how often each month's cost was drawn, for the months that were.

    The draws of a policy are a histogram over the months, counted before anything is shuffled; they are never kept
    one by one. c_<policy> then has the costs of the drawn months alone, in the order of h_<policy>.
    """
    counts = _draws(rows.select(*PAIR, "s", *(f"q_{p}" for p in POLICIES)), settings).groupBy(*PAIR, "politica", "i").agg(F.count("*").alias("n"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("politica") == p, F.struct("i", "n")))).alias(f"d_{p}") for p in POLICIES]  # a row for each month
    out = rows.join(counts.groupBy(*PAIR).agg(*lists), PAIR)
    cost_of = lambda p: F.transform(f"d_{p}", lambda x: F.get(F.col(f"c_{p}"), x["i"]))
    made = {f"c_{p}": cost_of(p) for p in POLICIES}
    return out.withColumns(made | {f"h_{p}": F.transform(f"d_{p}", lambda x: x["n"]) for p in POLICIES}).select(*rows.columns, *(f"h_{p}" for p in POLICIES))


def _weighted_sum(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda v, n: v * n), F.lit(0.0), lambda a, v: a + v)


def drawn_dominance(rows: DataFrame, settings: Settings = Settings(), mode: str = "reference") -> DataFrame:
    """drawn() rows with the expected cost of each policy, the cheapest one and the three comparisons over weighted counts.

    mode is as in dominated(). The cumulated counts of the draws are whole numbers, so that no rounding decides.
    """
    c, points = F.col, settings.grid
    out = rows.withColumns({f"custo_esp_{p}": _weighted_sum(c(f"c_{p}"), c(f"h_{p}")) / settings.replicas for p in POLICIES})
    x, y, z = (F.round(c(f"custo_esp_{p}"), 9) for p in POLICIES)
    out = out.withColumn("politica_preferida", F.when((x <= y) & (x <= z), "atual").when(y <= z, "conservadora").otherwise("com_buffer"))
    own, found = out.columns, {}
    for k, (name, a, b) in enumerate(COMPARED):
        ca, wa, cb, wb = c(f"c_{a}"), c(f"h_{a}"), c(f"c_{b}"), c(f"h_{b}")
        if mode == "reference":
            # bounds, places and gaps are columns of their own, so that each is computed once
            out = out.withColumns({f"lo{k}": F.least(F.array_min(ca), F.array_min(cb)), f"hi{k}": F.greatest(F.array_max(ca), F.array_max(cb))})
            out = out.withColumns({f"a{k}": grid_places(ca, c(f"lo{k}"), c(f"hi{k}"), points), f"b{k}": grid_places(cb, c(f"lo{k}"), c(f"hi{k}"), points)})
            out = out.withColumn(f"gaps{k}", weighted_gaps(c(f"a{k}"), wa, c(f"b{k}"), wb, points))
            found[name] = F.when(c(f"lo{k}") == c(f"hi{k}"), "nenhuma").otherwise(winner(c(f"gaps{k}")))
        else:
            beyond = lambda x, w, level: F.round(F.aggregate(F.zip_with(x, w, lambda v, n: n * F.greatest(v - level, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v), 6)
            out = out.withColumn(f"gaps{k}", F.transform(F.array_union(ca, cb), lambda level: beyond(ca, wa, level) - beyond(cb, wb, level)))
            found[name] = winner(c(f"gaps{k}"))
    return out.withColumns(found).select(*own, *found)
