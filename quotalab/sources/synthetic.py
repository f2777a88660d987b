"""A synthetic ledger with the shape of real ones, and its calibration report. Draws hang on hashes, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SEED
from ..functions.numbers import first_match

# fixed values: shape of the generated network
UNITS, CATEGORIES = 15, (("CATEGORIA_A", 40), ("CATEGORIA_B", 45), ("CATEGORIA_C", 25))
PROFILES = (("X", 197), ("Y", 238), ("Z", 165))
MONTHS = (
    ("2026-01", "2026-01-03", 29, 0.65, "Janeiro/2026"), ("2026-02", "2026-02-01", 28, 1.0, "Fevereiro/2026"), ("2026-03", "2026-03-01", 31, 1.0, "Março/2026"),
    ("2026-04", "2026-04-01", 30, 1.0, "Abril/2026"), ("2026-05", "2026-05-02", 11, 0.35, "Maio/2026"),
)
COMPLETE = 4  # months before the partial one
FACTOR, RATE = (0.35, 2.6), (3.0, 20.0)
X_LEAST, Y_RANGE, Z_RANGE, BURST = 40.0, (4.0, 6.0), (3.0, 9.0), (3.0, 5.0)
QUOTA_SHARE = 0.79
NO_RECEIPT = 0.09
STATUSES = ("Finalizado",) * 7 + ("Recebimento Confirmado",) * 2 + ("Enviada",) * 2 + ("Pendente", "Aprovado", "Aguardando Gerente")
#: Calibration: shares of extra orders and of classes, each within TOLERANCE, and the number of material pairs.
TARGET_EXTRA, TARGET_X, TARGET_Z, TOLERANCE, PAIRS_RANGE = 0.21, 0.40, 0.30, 0.05, (580, 640)


def uniform(*parts: object, seed: int = SEED) -> Column:
    """A number between 0 and 1 by the MD5 of the parts."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)


def between(bounds: tuple[float, float], *parts: object, seed: int = SEED) -> Column:
    return bounds[0] + (bounds[1] - bounds[0]) * uniform(*parts, seed=seed)


def poisson(mean: Column, u: Column, most: int = 200) -> Column:
    """The Poisson quantile of u: the sum of the probabilities is walked up to it."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0.0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        on = acc["c"] < u
        return F.struct(F.when(on, p).otherwise(acc["p"]).alias("p"), F.when(on, acc["c"] + p).otherwise(acc["c"]).alias("c"), F.when(on, acc["k"] + 1.0).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc["k"])


def units(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """(unidade, fator): the largest factor has the first name. As many rows as units."""
    drawn = spark.range(1, UNITS + 1).select(between(FACTOR, "unit", F.col("id"), seed=seed).alias("fator"))
    return drawn.select(F.format_string("Unidade_%02d", F.row_number().over(Window.orderBy(F.desc("fator")))).alias("unidade"), "fator")


def products(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """(produto, categoria, taxa)."""
    edges = [sum(n for _, n in CATEGORIES[: k + 1]) for k in range(len(CATEGORIES))]
    kind = first_match(CATEGORIES[-1][0], *((F.col("id") <= e, name) for (name, _), e in zip(CATEGORIES, edges, strict=True)))
    return spark.range(1, edges[-1] + 1).select(F.format_string("Produto_%03d", "id").alias("produto"), kind.alias("categoria"), between(RATE, "product", F.col("id"), seed=seed).alias("taxa"))


def pairs(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """A sample of pairs of units and products, with profiles in the order of their draws."""
    rows = units(spark, seed).crossJoin(products(spark, seed))  # as many rows as the network has pairs
    rank = F.row_number().over(Window.orderBy(uniform("pair", F.col("unidade"), F.col("produto"), seed=seed), "unidade", "produto"))
    first, second = PROFILES[0][1], PROFILES[0][1] + PROFILES[1][1]
    rows = rows.withColumn("n", rank).where(F.col("n") <= sum(n for _, n in PROFILES))
    return rows.withColumn("perfil", first_match("Z", (F.col("n") <= first, "X"), (F.col("n") <= second, "Y"))).drop("n")


def synthetic_ledger(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """Orders of four months and a part of the fifth, in the input's columns."""
    c = F.col
    months = spark.createDataFrame([(*m, k) for k, m in enumerate(MONTHS)], "mes string, de string, dias int, peso double, mes_ref string, k int")
    draw = lambda *name: uniform(*name, c("unidade"), c("produto"), c("k"), seed=seed)
    clip = lambda x, bounds: F.least(F.greatest(x, F.lit(bounds[0])), F.lit(bounds[1]))
    rate = c("taxa") * c("fator")
    usual = first_match(clip(rate, Z_RANGE), (c("perfil") == "X", F.greatest(rate, F.lit(X_LEAST))), (c("perfil") == "Y", clip(rate, Y_RANGE)))
    rows = pairs(spark, seed).withColumn("usual", usual).crossJoin(F.broadcast(months))
    burst = F.when(c("perfil") == "Z", BURST[0] + (BURST[1] - BURST[0]) * draw("burst")).otherwise(1.0)
    rows = rows.withColumn("media", F.greatest(c("usual") * burst * c("peso"), F.lit(0.5))).withColumn("u", draw("demand"))
    # an erratic pair asks for nothing in two or three of the complete months; the partial month is drawn by itself
    complete = c("k") < COMPLETE
    zeros = F.when(uniform("zeros", c("unidade"), c("produto"), complete, seed=seed) < 0.5, 2).otherwise(3)
    order = F.row_number().over(Window.partitionBy("unidade", "produto", complete).orderBy(draw("zero"), "k"))
    none = F.when(complete, order <= zeros).otherwise(draw("zero") < zeros / float(COMPLETE))
    drawn = poisson(c("media"), c("u"))
    rows = rows.withColumn("demanda", first_match(F.greatest(drawn, F.lit(2.0)), (c("perfil") != "Z", drawn), (none, 0.0)))
    expected = c("usual") * F.when(c("perfil") == "Z", sum(BURST) / 2).otherwise(1.0)
    rows = rows.withColumn("cota", F.floor(expected * QUOTA_SHARE).cast("double"))
    regular, extra = F.when(c("cota") > 0, F.least("cota", "demanda")).otherwise(c("demanda")), F.greatest(c("demanda") - c("cota"), F.lit(0.0))
    rows = rows.withColumn("o", F.explode(F.array(F.struct(F.lit("Não").alias("extra"), regular.alias("q")), F.struct(F.lit("Sim").alias("extra"), extra.alias("q"))))).where("o.q > 0")
    own = lambda name: uniform(name, c("unidade"), c("produto"), c("k"), c("o.extra"), seed=seed)
    status = F.element_at(F.array(*(F.lit(s) for s in STATUSES)), (F.floor(own("status") * len(STATUSES)) + 1).cast("int"))
    rows = rows.withColumn("status", status)
    done = c("status").isin("Finalizado", "Recebimento Confirmado")
    sent = F.when(done | (c("status") == "Enviada"), c("o.q")).otherwise(0.0)
    received = F.when(done & (own("receipt") >= NO_RECEIPT), c("o.q")).otherwise(0.0)
    day = F.date_add(F.to_date("de"), F.floor(own("day") * c("dias")).cast("int"))
    whole = lambda x: x.cast("long").cast("string")
    return rows.select(
        "unidade", F.date_format(day, "yyyy-MM-dd").alias("data_solic"), "produto", "categoria", whole(c("o.q")).alias("qtd_solic"), whole(sent).alias("qtd_env"),
        whole(received).alias("qtd_rec"), "status", c("o.extra").alias("pedido_extra"), "mes_ref",
    )


def write_synthetic(spark: SparkSession, path: str, seed: int = SEED) -> None:
    """The ledger as one CSV file in the folder path, sorted by date, unit and product."""
    synthetic_ledger(spark, seed).orderBy("data_solic", "unidade", "produto", "pedido_extra").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def calibration(orders: DataFrame, months: tuple[str, ...] = tuple(m for m, *_ in MONTHS[:COMPLETE])) -> DataFrame:
    """One row on normalised orders of the complete months: orders, units, products, the share of extra orders, material
    pairs, shares of classes among them by the sample deviation of what was asked for, and whether all is on target."""
    c = F.col
    rows = orders.where(c("mes").isin(*months))
    sums = rows.groupBy("unidade", "produto", "mes").agg(F.sum("qtd_solic").alias("q")).groupBy("unidade", "produto").agg(F.sum("q").alias("s"), F.sum(c("q") * c("q")).alias("ss"))
    t = len(months)  # months without orders count as 0
    stats = sums.select((c("s") / t).alias("media"), F.sqrt(F.greatest(c("ss") - c("s") * c("s") / t, F.lit(0.0)) / (t - 1)).alias("desvio"))
    kind = first_match("Z", (c("media") < 1.0, "baixa_rot"), (c("desvio") / c("media") < 0.30, "X"), (c("desvio") / c("media") < 0.70, "Y"))
    kinds = stats.where(c("media") >= 0.5).select(kind.alias("c"))
    share = lambda v: (F.count_if(c("c") == v) / F.count("*")).alias(f"pct_{v.lower()}")
    classes = kinds.agg(F.count("*").alias("pares_materiais"), share("X"), share("Y"), share("Z"))
    extra = F.sum(F.when(c("pedido_extra"), c("qtd_solic")).otherwise(0.0)) / F.sum("qtd_solic")
    whole = orders.agg(F.count("*").alias("n_pedidos"), F.countDistinct("unidade").alias("n_unidades"), F.countDistinct("produto").alias("n_produtos"))
    out = whole.crossJoin(rows.agg(extra.alias("pct_extra"))).crossJoin(classes)  # one row each
    near = lambda x, target: F.abs(c(x) - target) <= TOLERANCE
    good = near("pct_extra", TARGET_EXTRA) & c("pares_materiais").between(*PAIRS_RANGE) & near("pct_x", TARGET_X) & near("pct_z", TARGET_Z)
    return out.withColumn("no_alvo", good)
