"""Registered queries over the allocation ledger derived from the warehouse tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.numbers import ratio, round_even
from .functions.shared import checkpointed, new_folder
from .functions.text import month, next_month
from .operators import dominance as D
from .operators import features as X
from .operators import history as H
from .operators import orders as O
from .operators import panel as P
from .operators import policy as Q
from .operators import rules as R
from .operators.intervals import seeded_interval
from .oracles import ORACLES as ORACLES
from .plans import linear as L
from .plans.allocation import layers
from .plans.estimator import PanelRidge
from .plans.forecast import feature_table
from .plans.models import MODELS
from .sources.html_source import read_tables, write_tables
from .sources.ledger import COLUMNS
from .sources.synthetic import calibration, pairs, synthetic_ledger
from .sources.warehouse import MONTHS, ledger
from .streaming.drift import drift_of, follow_errors

SETTINGS = Settings(months=MONTHS)
CATEGORIES = ["CATEGORIA_A", "CATEGORIA_B", "CATEGORIA_C"]

#: Rows of a history that a task of a model takes in each pass.
ROWS_OF_A_PART = 10_000

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Every double rounded, so that the last bits of sums do not show."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _orders(spark: SparkSession, folder: str, months: tuple[str, ...] | None = None) -> DataFrame:
    return O.consolidated(O.flagged(ledger(spark, folder, months), SETTINGS), SETTINGS)


def _monthly(spark: SparkSession, folder: str, months: tuple[str, ...] | None = None) -> DataFrame:
    """The months of each pair, written once: history and panel come from them, and are read several times."""
    return checkpointed(P.monthly(_orders(spark, folder, months)))


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    return P.balanced(_monthly(spark, folder, MONTHS), MONTHS)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return P.metrics(_panel(spark, folder), MONTHS, SETTINGS)


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    return Q.policies(_metrics(spark, folder), SETTINGS)


def _costs_of(panel: DataFrame) -> DataFrame:
    return D.costs(panel, Q.policies(P.metrics(panel, MONTHS, SETTINGS), SETTINGS), SETTINGS)


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    return _costs_of(_panel(spark, folder))


def _history(spark: SparkSession, folder: str, months: tuple[str, ...] | None = None, made: DataFrame | None = None) -> DataFrame:
    """Months in which a pair has orders, as the history keeps them; from the table of months where it is made already."""
    totals = {"consumo_total": F.col("consumo_reg") + F.col("consumo_extra"), "demanda_total": F.col("demanda_reg") + F.col("demanda_extra")}
    return (_monthly(spark, folder, months) if made is None else made).withColumns(totals).select(*H.HISTORY)


def ledger_normalize(spark, folder):
    rows = ledger(spark, folder)
    return rows.groupBy("categoria", "status", "mes", "pedido_extra").agg(F.count("*").alias("n"), *(F.sum(q).alias(q) for q in ("qtd_solic", "qtd_env", "qtd_rec")))


def ledger_flags(spark, folder):
    flags = ["flag_env_maior_solic", "flag_rec_maior_env", "flag_fin_sem_rec", "flag_qualquer_erro"]
    return O.flagged(ledger(spark, folder), SETTINGS).groupBy("unidade", "produto", "status").agg(*(F.count_if(f).alias(f) for f in flags))


def ledger_consumption(spark, folder):
    return _orders(spark, folder).groupBy("unidade", "produto", "status").agg(F.sum("qtd_consumo").alias("qtd_consumo"), F.max("qtd_consumo").alias("maior"))


def ledger_demand(spark, folder):
    return _orders(spark, folder).groupBy("unidade", "mes").agg(F.sum("qtd_demanda").alias("qtd_demanda"))


def unit_anonymize_rank(spark, folder):
    return O.unit_aliases(ledger(spark, folder))


def anonymized_totals(spark, folder):
    return O.anonymised(ledger(spark, folder)).groupBy("unidade").agg(F.count("*").alias("n"), F.sum("qtd_solic").alias("qtd_solic"))


def flag_error_rates(spark, folder):
    return O.error_rates(O.flagged(ledger(spark, folder), SETTINGS))


def monthly_pivot(spark, folder):
    return P.monthly(_orders(spark, folder, MONTHS))


def pair_metrics(spark, folder):
    return rounded(_metrics(spark, folder).drop("proj_ponderada", "desvio_padrao", "cv", "classe_xyz"))


def pair_dispersion(spark, folder):
    return rounded(_metrics(spark, folder).select(*P.PAIR, "desvio_padrao", "cv"))


def xyz_class(spark, folder):
    return _metrics(spark, folder).select(*P.PAIR, "classe_xyz")


def xyz_distribution(spark, folder):
    return P.counts_by(_metrics(spark, folder), "classe_xyz")


def wma_projection(spark, folder):
    return rounded(_metrics(spark, folder).select(*P.PAIR, "proj_ponderada"))


def k_buffer(spark, folder):
    return _policies(spark, folder).select(*P.PAIR, "k")


def quota_policies(spark, folder):
    return rounded(_policies(spark, folder).select(*P.PAIR, "cota_conservadora", "cota_buffer"))


def marginal_need(spark, folder):
    return rounded(_policies(spark, folder).select(*P.PAIR, "necessidade_marginal_conserv", "necessidade_marginal_buffer"))


def suggested_action(spark, folder):
    return rounded(_policies(spark, folder).select(*P.PAIR, "consumo_medio_mensal", "classe_xyz", "k", "cota_conservadora", "cota_buffer", "acao_sugerida"))


def action_distribution(spark, folder):
    return P.counts_by(_policies(spark, folder), "acao_sugerida")


def policy_costs(spark, folder):
    rows = _costs(spark, folder)
    sums = {f"custo_{p}": F.aggregate(f"c_{p}", F.lit(0.0), lambda a, x: a + x) for p in D.POLICIES}
    return rounded(rows.select(*P.PAIR, *(f"q_{p}" for p in D.POLICIES), *(x.alias(name) for name, x in sums.items())))


def expected_cost(spark, folder):
    return rounded(D.expected(_costs(spark, folder)).select(*P.PAIR, *(f"custo_esp_{p}" for p in D.POLICIES)))


def preferred_policy(spark, folder):
    return D.expected(_costs(spark, folder)).select(*P.PAIR, "politica_preferida")


def preferred_distribution(spark, folder):
    return P.counts_by(D.expected(_costs(spark, folder)), "politica_preferida")


def cost_cdf_grid(spark, folder):
    return rounded(D.cdf_grid(_costs(spark, folder), points=SETTINGS.grid))


def _compared(spark, folder, mode):
    return D.dominated(_costs(spark, folder), SETTINGS, mode).select(*P.PAIR, *(name for name, _, _ in D.COMPARED))


def ssd_reference(spark, folder):
    return _compared(spark, folder, "reference")


def ssd_cost_mode(spark, folder):
    return _compared(spark, folder, "cost")


def bootstrap_seeded_costs(spark, folder):
    return rounded(D.seeded_costs(_costs(spark, folder), SETTINGS))


def _drawn(spark, folder, mode):
    rows = checkpointed(_costs(spark, folder))  # read twice
    out = D.drawn_dominance(D.drawn(rows, SETTINGS), SETTINGS, mode)
    return rounded(out.select(*P.PAIR, *(f"custo_esp_{p}" for p in D.POLICIES), "politica_preferida", *(name for name, _, _ in D.COMPARED)))


def ssd_seeded(spark, folder):
    """Costs, preference and dominance of 5,000 draws for each pair and policy."""
    return _drawn(spark, folder, "reference")


def ssd_seeded_cost_mode(spark, folder):
    """The same, by the mean cost beyond every level."""
    return _drawn(spark, folder, "cost")


def month_gate(spark, folder):
    return X.gate_table(_history(spark, folder))


def feat_lags(spark, folder):
    names = [f"lag_{i}{s}" for i in range(1, 5) for s in ("", "_disp")]
    return X.temporal(_history(spark, folder)).select(*X.KEY, "mes", *names)


def feat_rolling(spark, folder):
    return rounded(X.temporal(_history(spark, folder)).select(*X.KEY, "mes", "media_3m", "std_3m"))


def feat_trend_month(spark, folder):
    return X.temporal(_history(spark, folder)).select(*X.KEY, "mes", "trend_idx", "mes_num")


def feat_regime(spark, folder):
    rows = X.with_regimes(_history(spark, folder), _metrics(spark, folder))
    return rounded(rows.select(*X.KEY, "mes", "consumo_medio_hist", "cv_hist", *(f"regime_{r}" for r in X.REGIMES)))


def feat_onehot(spark, folder):
    rows = X.one_hot(_history(spark, folder).withColumn("mes_num", F.month(F.to_date("mes", "yyyy-MM"))), "categoria", "cat", CATEGORIES)
    return X.one_hot(rows, "mes_num", "mes", list(range(1, 13))).select(*X.KEY, "mes", *(f"cat_{c}" for c in CATEGORIES), *(f"mes_{m}" for m in range(1, 13)))


def feat_next_period(spark, folder):
    rows = X.temporal(X.with_next_month(_history(spark, folder))).where("is_future")
    return rounded(rows.select(*X.KEY, "categoria", "mes", "lag_1", "lag_2", "media_3m", "std_3m", "trend_idx"))


def _future(spark, folder):
    return X.temporal(X.with_next_month(_history(spark, folder)))


def forecast_baseline(spark, folder):
    return rounded(_future(spark, folder).where("is_future").select(*X.KEY, F.col("mes").alias("mes_previsao"), X.baseline().alias("previsao")))


def forecast_interval_exact(spark, folder):
    return rounded(X.forecast(_future(spark, folder)))


def forecast_interval_seeded(spark, folder):
    """The interval from 500 residuals for each pair, drawn from the pool of the whole history."""
    made = checkpointed(_future(spark, folder).withColumn("previsao", X.baseline()))
    pool = made.where(~F.col("is_future")).select((F.col("consumo_total") - F.col("previsao")).alias("residuo"))
    out = seeded_interval(made.where("is_future").select(*X.KEY, "categoria", F.col("mes").alias("mes_previsao"), "previsao"), pool)
    return rounded(out)


def history_upsert(spark, folder):
    """Old: history but its last month, as known; new: the last months, with one more unit of consumption."""
    past = _history(spark, folder)
    new = past.where(F.col("mes") >= "2001-06").withColumn("consumo_total", F.col("consumo_total") + 1.0)
    return H.upserted(past.where(F.col("mes") < "2001-08"), new)


def walk_forward_baseline(spark, folder):
    return rounded(H.walk_forward(_history(spark, folder)))


def backtest_metrics(spark, folder):
    return rounded(H.error_metrics(H.walk_forward(_history(spark, folder)), "fold", "mes_test"))


def drift_zscore_rows(spark, folder):
    """The errors of the newest fold, ordered by pair."""
    return rounded(H.drift(H.newest_fold(H.walk_forward(_history(spark, folder))), ["unidade", "produto"]))


def drift_zscore_months(spark, folder):
    months = H.error_metrics(H.walk_forward(_history(spark, folder)), "mes_test")
    return rounded(H.drift(months, ["mes_test"], value="mae"))


def drift_streamed(spark, folder):
    """The errors of three model names, streamed fold by fold into drift states, a third of the months at a time."""
    past = _history(spark, folder)
    errors = H.walk_forward(past).select(F.lit("baseline_mmp").alias("modelo"), "fold", "unidade", "produto", "abs_error")
    other = H.walk_forward(past, short_history="mean").select(F.lit("baseline_media").alias("modelo"), "fold", "unidade", "produto", "abs_error")
    source, path, checkpoint = (new_folder(spark, name) for name in ("errors", "drift", "drift-log"))
    rows = checkpointed(errors.unionByName(other))
    for k in range(3):  # folds come out of order
        rows.where(F.col("fold") % 3 == k).write.parquet(f"{source}/f{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{source}/*")
    follow_errors(stream, path, checkpoint).awaitTermination()
    return rounded(drift_of(spark, path))


def ridge_estimator(spark, folder):
    """The next month by a pipeline of one feature and one penalty, fitted, saved, loaded and applied."""
    rows = checkpointed(_future(spark, folder).withColumn("label", F.greatest("consumo_total", F.lit(0.0))))
    stages = [VectorAssembler(inputCols=["lag_1"], outputCol="features"), PanelRidge(alphas=[10.0], predictionCol="previsao")]
    path = new_folder(spark, "pipeline-model")
    Pipeline(stages=stages).fit(rows.where(~F.col("is_future"))).write().save(path)
    made = PipelineModel.load(path).transform(rows.where("is_future"))
    return rounded(made.select(*X.KEY, F.col("mes").alias("mes_previsao"), "previsao"))


def registry_promotion(spark, folder):
    """Each month of the backtest as a challenger against the month before as baseline and the best so far as champion."""
    months = H.error_metrics(H.walk_forward(_history(spark, folder)), "fold")
    from pyspark.sql import Window

    by = Window.orderBy("fold")  # as many rows as months
    rows = months.withColumns({"base": F.lag("mae").over(by), "campeao": F.min("mae").over(by.rowsBetween(Window.unboundedPreceding, -2)), "versao": H.version(F.row_number().over(by))})
    return rounded(rows.select("fold", "versao", "mae", H.promotes(F.col("mae"), F.col("base"), F.col("campeao")).alias("promovido")))


def close_cycle(spark, folder):
    """Forecasts of all pairs are active unless the gate finds the months of the history too few."""
    months = _monthly(spark, folder)
    past = _history(spark, folder, None, months)
    trusted = X.gate(past.agg(F.countDistinct("mes")).first()[0])
    flags = {"previsao_substitui_c4": F.lit(trusted != "insuficiente"), "confiabilidade": F.lit(trusted), "modelo_usado": F.lit("baseline_mmp")}
    made = X.forecast(X.temporal(X.with_next_month(past))).withColumns(flags)
    out = H.closed_loop(D.expected(_costs_of(P.balanced(months, MONTHS))).select(*P.PAIR, "politica_preferida"), made)
    return rounded(out.select(*P.PAIR, "politica_preferida", "demanda_prevista", "fonte_demanda", "confiabilidade_ml", "modelo_ml"))


def _decided_again(spark, folder, mode):
    months = _monthly(spark, folder)
    panel, past = P.balanced(months, MONTHS), _history(spark, folder, None, months)
    policies = checkpointed(Q.policies(P.metrics(panel, MONTHS, SETTINGS), SETTINGS))
    empirical = D.dominated(D.expected(D.costs(panel, policies, SETTINGS)), SETTINGS, mode)
    trusted = X.gate_table(past).select("confiabilidade")
    made = checkpointed(X.temporal(X.with_next_month(past)).withColumn("previsao", X.baseline()))
    residuals = made.where(~F.col("is_future")).select((F.col("consumo_total") - F.col("previsao")).alias("residuo"))
    active = made.where("is_future").crossJoin(F.broadcast(trusted)).withColumn("previsao_substitui_c4", F.col("confiabilidade") != "insuficiente")  # one row
    out = H.decided_again(empirical, active, residuals, policies, SETTINGS, mode)
    return rounded(out.select(*P.PAIR, *(f"custo_esp_{p}" for p in D.POLICIES), "politica_preferida", "politica_empirica", "politica_mudou", "fonte_demanda", *(n for n, _, _ in D.COMPARED)))


def close_cycle_decided(spark, folder):
    """Costs, preference and dominance of all pairs with the predicted demand instead of the observed one."""
    return _decided_again(spark, folder, "reference")


def close_cycle_decided_cost_mode(spark, folder):
    """The same, by the mean cost beyond every level."""
    return _decided_again(spark, folder, "cost")


def ledger_from_html(spark, folder):
    """The ledger written as HTML tables and read back through the data source, as orders."""
    rows = ledger(spark, folder)
    spelt = rows.select(
        "unidade", F.date_format("data_solic", "yyyy-MM-dd").alias("data_solic"), "produto", "categoria", *(F.col(q).cast("long").cast("string").alias(q) for q in ("qtd_solic", "qtd_env", "qtd_rec")),
        "status", F.when(F.col("pedido_extra"), "Sim").otherwise("Não").alias("pedido_extra"), F.lit(None).cast("string").alias("mes_ref"),
    )
    path = new_folder(spark, "tables")
    write_tables(spelt, path, compression="gzip")
    orders = O.normalised(read_tables(spark, path).select(COLUMNS))
    return orders.groupBy("unidade", "categoria", "mes", "status").agg(F.count("*").alias("n"), *(F.sum(q).alias(q) for q in ("qtd_solic", "qtd_env", "qtd_rec")), F.count_if("pedido_extra").alias("n_extra"))


def ledger_rules(spark, folder):
    """The ledger's declared constraints, a row for each."""
    return R.judged(ledger(spark, folder), R.order_rules(SETTINGS))


def ledger_offending(spark, folder):
    """Of the orders that break a constraint how many break which, by unit."""
    return R.offending(ledger(spark, folder), R.order_rules(SETTINGS), "unidade", "qtd_solic")


def pareto_units(spark, folder):
    """Units by orders, most first, with the running share."""
    from pyspark.sql import Window

    rows = O.unit_aliases(ledger(spark, folder))
    by = Window.orderBy(F.desc("n_pedidos"), "unidade")  # as many rows as units
    share = F.sum("n_pedidos").over(by) / F.sum("n_pedidos").over(Window.partitionBy(F.lit(1)))
    return rounded(rows.select("unidade", "n_pedidos", F.row_number().over(by).alias("ordem"), share.alias("acumulado")))


def _learnt_from(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """History and metrics from one pass over the orders; models read them again and again."""
    months = _monthly(spark, folder)
    return _history(spark, folder, None, months), checkpointed(P.metrics(P.balanced(months, MONTHS), MONTHS, SETTINGS))


def walk_forward_ridge(spark, folder):
    """The errors of ridge regression in every month, all months trained in one pass."""
    return rounded(L.walk_forward_ridge(*_learnt_from(spark, folder)), 4)


def walk_forward_ridge_as_of(spark, folder):
    """The same with the metrics that were known before each month."""
    return rounded(L.walk_forward_ridge(*_learnt_from(spark, folder), as_of=SETTINGS), 4)


def ridge_normal_equations(spark, folder):
    """What each month's ridge model says of its training rows, as the left sides of its normal equations."""
    return rounded(L.normal_equations(*_learnt_from(spark, folder)), 3)


def metrics_as_of(spark, folder):
    """Mean, variation and class of each pair from the months before each month."""
    return rounded(L.metrics_as_of(_history(spark, folder), SETTINGS))


def forecast_ridge(spark, folder):
    """The next month of each pair by ridge regression on the whole history, units without columns of their own."""
    _, made = L.next_month_ridge(*_learnt_from(spark, folder))
    return made.select(*X.KEY, "categoria", F.col("mes").alias("mes_previsao"), round_even(F.col("previsao"), 4).alias("previsao"), F.lit("ridge").alias("modelo_usado"))


def _modelled(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        past, metrics = _learnt_from(spark, folder)
        # as many values as units, categories and months
        units, categories, months = past.agg(F.sort_array(F.collect_set("unidade")), F.sort_array(F.collect_set("categoria")), F.countDistinct("mes")).first()
        rows = feature_table(past, metrics, seasonal=X.gate(months) == "operacional", units=units, categories=categories)
        columns = X.feature_columns(rows.columns)
        rows = checkpointed(rows)
        # each of some hundred passes has a task for each part: parts go by rows, not by the shuffles behind them
        rows = rows.repartition(math.ceil(rows.count() / ROWS_OF_A_PART) or 1, *X.KEY).persist()
        made = MODELS[name]().fit(rows.where(~F.col("is_future")), columns).predict(rows.where("is_future"))
        made = checkpointed(made.select(*X.KEY, "categoria", F.col("mes").alias("mes_previsao"), round_even(F.col("previsao"), 4).alias("previsao"), F.lit(name).alias("modelo_usado")))
        rows.unpersist()
        return made

    return query


def ledger_from_text(spark, folder):
    """The ledger as ten string columns, some of them malformed, read as orders."""
    c = F.col
    rows = ledger(spark, folder)
    n = F.pmod(c("qtd_solic").cast("long"), F.lit(7))  # which of the odd spellings a row has
    spelt = rows.select(
        "unidade", F.date_format("data_solic", "yyyy-MM-dd").alias("data_solic"), "produto",
        F.when(n == 0, F.concat(F.lit(" "), F.lower("categoria"), F.lit("\t"))).when(n == 1, F.regexp_replace("categoria", "CATEGORIA", "CATEGÓRIA")).otherwise(c("categoria")).alias("categoria"),
        F.when(n == 2, "x").otherwise(c("qtd_solic").cast("long").cast("string")).alias("qtd_solic"), F.when(n == 3, "").otherwise(c("qtd_env").cast("long").cast("string")).alias("qtd_env"),
        F.when(n == 4, "NaN").otherwise(c("qtd_rec").cast("long").cast("string")).alias("qtd_rec"), "status",
        F.when(n == 5, "talvez").when(c("pedido_extra"), "Sim").otherwise("Não").alias("pedido_extra"), F.lit(None).cast("string").alias("mes_ref"),
    )
    orders = O.normalised(spelt)
    return orders.groupBy("unidade", "categoria", "mes", "pedido_extra").agg(F.count("*").alias("n"), *(F.sum(q).alias(q) for q in ("qtd_solic", "qtd_env", "qtd_rec")), F.max("data_solic").alias("ate"))


def ledger_summary(spark, folder):
    """One row: what the log tells of the ledger."""
    rows = _orders(spark, folder)
    flags = ("flag_env_maior_solic", "flag_rec_maior_env", "flag_fin_sem_rec", "flag_qualquer_erro")
    # by pair first, with the least and greatest date: of months, which are strings, all rows would be sorted
    pairs = rows.groupBy("unidade", "produto").agg(
        F.count("*").alias("linhas"), F.min("data_solic").alias("de"), F.max("data_solic").alias("ate"), F.sum("qtd_consumo").alias("consumo"),
        *(F.count_if(f).alias(f"n_{f[5:]}") for f in flags), F.count(flags[-1]).alias("julgadas"),
    )
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    out = pairs.agg(
        total("linhas").alias("linhas"), F.countDistinct("unidade").alias("unidades"), F.countDistinct("produto").alias("produtos"), month(F.min("de")).alias("de"), month(F.max("ate")).alias("ate"),
        F.sum("consumo").alias("consumo"), *(total(f"n_{f[5:]}").alias(f"n_{f[5:]}") for f in flags), ratio(F.sum(f"n_{flags[-1][5:]}"), F.sum("julgadas")).alias("taxa"),
    )
    return rounded(out)


def audit_counts(spark, folder):
    """Rows in and out of each layer, as the audit trail records them."""
    made = layers(_orders(spark, folder, MONTHS), SETTINGS)
    names = [("2.1_agregacao_mensal", "consolidado", "painel"), ("2.2_metricas_por_par", "painel", "metricas"), ("3_politica_cota", "metricas", "politicas"), ("4_dominancia_estocastica", "politicas", "dominancia")]
    out = None
    for step, before, after in names:
        n, m = (getattr(made, x).agg(F.count("*").alias("n")) for x in (before, after))
        row = n.withColumnRenamed("n", "linhas_entrada").crossJoin(m.withColumnRenamed("n", "linhas_saida"))  # one row each
        row = row.select(F.lit(step).alias("etapa"), "linhas_entrada", "linhas_saida", (F.col("linhas_saida") - F.col("linhas_entrada")).alias("delta"))
        out = row if out is None else out.unionByName(row)
    return out


def history_months(spark, folder):
    """The months of the history in order, with their places and the month after the last."""
    from pyspark.sql import Window

    months = _history(spark, folder).select("mes").distinct()
    return months.withColumn("ordem", F.row_number().over(Window.orderBy("mes"))).withColumn("proximo", next_month(F.max("mes").over(Window.partitionBy(F.lit(0)))))  # as many rows as months


def forecast_reliability(spark, folder):
    """Forecast rows as layer 5 returns them: rounded, with the gate's word and whether they are active."""
    past = _history(spark, folder)
    trusted = X.gate_table(past).select("confiabilidade")
    out = X.forecast(_future(spark, folder)).crossJoin(F.broadcast(trusted))  # one row
    money = [round_even(F.col(x), 2).alias(x) for x in ("previsao", "intervalo_inferior_90", "intervalo_superior_90")]
    return out.select(*X.KEY, "categoria", "mes_previsao", *money, "confiabilidade", F.lit("baseline_mmp").alias("modelo_usado"), (F.col("confiabilidade") != "insuficiente").alias("previsao_substitui_c4"))


def champion_row(spark, folder):
    """The last promoted version of the backtest's registry."""
    return registry_promotion(spark, folder).where("promovido").orderBy(F.desc("versao")).limit(1)


def backtest_union(spark, folder):
    """Errors of the baseline and of its variant for short histories, one under the other, by model and month."""
    past = _history(spark, folder)
    whole = H.walk_forward(past).withColumn("modelo", F.lit("baseline_mmp"))
    other = H.walk_forward(past, short_history="mean").withColumn("modelo", F.lit("baseline_media"))
    return rounded(H.error_metrics(whole.unionByName(other), "modelo", "mes_test"))


def synthetic_network(spark, folder):
    """The sampled pairs of the synthetic network with their factors, rates and profiles."""
    return rounded(pairs(spark))


def synthetic_orders(spark, folder):
    """All orders of the synthetic ledger, in its order."""
    return synthetic_ledger(spark).orderBy("data_solic", "unidade", "produto", "pedido_extra")


def calibration_report(spark, folder):
    """Whether the synthetic ledger has the wanted shape."""
    return rounded(calibration(O.normalised(synthetic_ledger(spark))))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        ledger_normalize, ledger_flags, ledger_consumption, ledger_demand, unit_anonymize_rank, anonymized_totals, flag_error_rates, monthly_pivot,
        pair_metrics, pair_dispersion, xyz_class, xyz_distribution, wma_projection, k_buffer, quota_policies, marginal_need, suggested_action, action_distribution,
        policy_costs, expected_cost, preferred_policy, preferred_distribution, cost_cdf_grid, ssd_reference, ssd_cost_mode, bootstrap_seeded_costs,
        ssd_seeded, ssd_seeded_cost_mode, forecast_interval_seeded, walk_forward_ridge, walk_forward_ridge_as_of, ridge_normal_equations, metrics_as_of, forecast_ridge,
        close_cycle_decided, close_cycle_decided_cost_mode, ledger_rules, ledger_offending, ledger_from_html, drift_streamed, ridge_estimator,
        month_gate, feat_lags, feat_rolling, feat_trend_month, feat_regime, feat_onehot, feat_next_period, forecast_baseline, forecast_interval_exact,
        history_upsert, walk_forward_baseline, backtest_metrics, drift_zscore_rows, drift_zscore_months, registry_promotion, close_cycle, pareto_units, calibration_report,
        ledger_from_text, ledger_summary, audit_counts, history_months, forecast_reliability, champion_row, backtest_union, synthetic_network, synthetic_orders,
    )
}
QUERIES |= {"balanced_panel": _panel, "forecast_poisson": _modelled("poisson"), "forecast_gbt": _modelled("lgbm")}
