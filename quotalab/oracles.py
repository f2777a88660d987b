"""DuckDB SQL of the queries: the same definitions, written as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

_LEDGER = """
    pedidos as (
        select n_name as unidade, o_orderdate as data_solic, p_brand as produto,
            case cast(regexp_extract(p_brand, '(\\d+)', 1) as int) % 3 when 0 then 'CATEGORIA_A' when 1 then 'CATEGORIA_B' else 'CATEGORIA_C' end as categoria,
            l_quantity as qtd_solic, st as status, env as qtd_env,
            case when st not in ('Finalizado', 'Recebimento Confirmado') then 0.0::double when l_partkey % 11 = 0 then 0.0::double when l_suppkey % 13 = 0 then env + 1.0::double else env end as qtd_rec,
            o_orderpriority = '1-URGENT' as pedido_extra, strftime(o_orderdate, '%Y-%m') as mes
        from (
            select *, case when st in ('Rejeitado', 'Pendente', 'Aprovado', 'Aguardando Gerente') then 0.0::double when l_linenumber = 7 then l_quantity + 2.0::double
                when l_linenumber = 6 then floor(l_quantity * 0.8::double) else l_quantity end as env
            from (
                select *, case when o_orderpriority = '5-LOW' and l_returnflag = 'R' then 'Rejeitado' when o_orderstatus = 'F' then 'Finalizado'
                    when o_orderstatus = 'P' and l_linestatus = 'F' then 'Enviada' when o_orderstatus = 'P' then 'Recebimento Confirmado'
                    when l_returnflag = 'N' then 'Pendente' when l_returnflag = 'A' then 'Aprovado' else 'Aguardando Gerente' end as st
                from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey))),
    marcados as (
        select *, qtd_env > qtd_solic as f1, qtd_rec > qtd_env as f2, status in ('Finalizado', 'Recebimento Confirmado') and qtd_rec = 0 as f3 from pedidos),
    consolidado as (
        select *, case when status = 'Rejeitado' then 0.0::double when qtd_rec > 0 then case when qtd_env > 0 then least(qtd_rec, qtd_env) else qtd_rec end
                when qtd_env > 0 then case when qtd_solic > 0 then least(qtd_env, qtd_solic) else qtd_env end
                when status in ('Pendente', 'Aprovado', 'Aguardando Gerente') then qtd_solic else 0.0::double end as qtd_consumo,
            case when status = 'Rejeitado' then 0.0::double else qtd_solic end as qtd_demanda
        from marcados)"""

_M = {"solic": "qtd_solic", "env": "qtd_env", "rec": "qtd_rec", "consumo": "qtd_consumo", "demanda": "qtd_demanda"}
_SUMS = ", ".join(f"coalesce(sum({q}) filter (where {t}), 0.0::double) as {m}_{s}" for m, q in _M.items() for s, t in (("reg", "not pedido_extra"), ("extra", "pedido_extra")))
_COUNTS = "(count(*) filter (where not pedido_extra))::double as n_pedidos_reg, (count(*) filter (where pedido_extra))::double as n_pedidos_extra"
_SPLITS = [f"{m}_{s}" for m in (*_M, "n_pedidos") for s in ("reg", "extra")]
_MONTHLY = f"{_LEDGER},\n    mensal as (select unidade, produto, categoria, mes, {_SUMS}, {_COUNTS} from consolidado group by all)"
_PANEL = f"""{_MONTHLY},
    ref as (select * from mensal where mes between '2001-04' and '2001-07'),
    meses(mes, peso) as (values ('2001-04', 0.1::double), ('2001-05', 0.2::double), ('2001-06', 0.3::double), ('2001-07', 0.4::double)),
    painel0 as (
        select unidade, produto, categoria, mes, peso, {", ".join(f"coalesce({x}, 0.0::double) as {x}" for x in _SPLITS)}
        from (select distinct unidade, produto, categoria from ref) cross join meses left join ref using (unidade, produto, categoria, mes)),
    painel as (
        select *, solic_reg + solic_extra as solic_total, consumo_reg + consumo_extra as consumo_total, demanda_reg + demanda_extra as demanda_total,
            demanda_reg + demanda_extra - (consumo_reg + consumo_extra) as gap_atendimento
        from painel0)"""
_METRICS = f"""{_PANEL},
    met0 as (
        select unidade, produto, categoria, avg(consumo_total) as consumo_medio_mensal, avg(demanda_total) as demanda_media_mensal, avg(env_reg + env_extra) as env_medio_mensal,
            avg(rec_reg + rec_extra) as rec_medio_mensal, avg(consumo_reg) as consumo_reg_medio, avg(consumo_extra) as consumo_extra_medio,
            avg(demanda_reg) as demanda_reg_media, avg(demanda_extra) as demanda_extra_media, avg(gap_atendimento) as gap_medio_mensal, stddev_pop(consumo_total) as desvio_padrao,
            count(*) filter (where consumo_total > 0) as meses_com_pedido, count(*) filter (where consumo_extra > 0) as meses_com_extra,
            case when sum(demanda_total) > 0 then sum(consumo_total) / sum(demanda_total) end as taxa_atendimento,
            case when sum(consumo_reg) > 0 then sum(consumo_extra) / sum(consumo_reg) end as razao_extra_regular,
            case when sum(consumo_total) > 0 then sum(consumo_extra) / sum(consumo_total) end as pct_extra_no_consumo,
            sum(consumo_total * peso) as proj_ponderada
        from painel group by all),
    met1 as (select *, case when consumo_medio_mensal > 0 then desvio_padrao / consumo_medio_mensal end as cv from met0),
    metricas as (
        select *, case when cv is null then 'sem_consumo' when consumo_medio_mensal < 1.0::double then 'baixa_rotatividade' when cv < 0.3::double then 'X_regular'
            when cv < 0.7::double then 'Y_moderado' else 'Z_erratico' end as classe_xyz
        from met1)"""
_POLICY = f"""{_METRICS},
    pol0 as (
        select *, case when cv is null or consumo_medio_mensal < 1.0::double then 0.5::double when cv < 0.3::double then 0.5::double when cv < 0.7::double then 1.0::double
            when cv < 1.2::double then 1.25::double else 1.5::double end as k
        from metricas),
    pol1 as (select *, round_even(proj_ponderada * 100.0::double, 0) / 100.0::double as cota_conservadora, round_even((proj_ponderada + k * desvio_padrao) * 100.0::double, 0) / 100.0::double as cota_buffer from pol0),
    politicas as (
        select *, round_even((cota_conservadora - consumo_reg_medio) * 100.0::double, 0) / 100.0::double as necessidade_marginal_conserv,
            round_even((cota_buffer - consumo_reg_medio) * 100.0::double, 0) / 100.0::double as necessidade_marginal_buffer,
            case when consumo_medio_mensal < 0.5::double then 'baixa_materialidade'
                when pct_extra_no_consumo >= 0.4::double and ceil(cota_conservadora) > round_even(consumo_reg_medio, 0) then 'reforcar'
                when ceil(cota_conservadora) > round_even(consumo_reg_medio, 0) + 1 then 'aumentar'
                when ceil(cota_conservadora) < round_even(consumo_reg_medio, 0) - 1 then 'reduzir' else 'manter' end as acao_sugerida
        from pol1)"""
_COST = lambda q: f"(1.0::double * greatest(0.0::double, v - {q}) + 0.3::double * greatest(0.0::double, {q} - v))"
_COSTS = f"""{_POLICY},
    quotas as (
        select unidade, produto, categoria, greatest(round_even(consumo_reg_medio, 0), 0.0::double) as q_atual, greatest(ceil(cota_conservadora), 0.0::double) as q_conservadora,
            greatest(ceil(cota_buffer), 0.0::double) as q_buffer
        from politicas where consumo_medio_mensal >= 0.5::double),
    custos as (
        select q.*, mes, v, {", ".join(f"{_COST('q_' + p)} as c_{p}" for p in ("atual", "conservadora", "buffer"))}
        from quotas q join (select unidade, produto, mes, consumo_total as v from painel) using (unidade, produto)
        where (unidade, produto) in (select (unidade, produto) from painel group by unidade, produto having sum(consumo_total) <> 0)),
    esperados as (
        select unidade, produto, categoria, avg(c_atual) as custo_esp_atual, avg(c_conservadora) as custo_esp_conservadora, avg(c_buffer) as custo_esp_buffer from custos group by all),
    preferidas as (
        select *, case when round(custo_esp_atual, 9) <= round(custo_esp_conservadora, 9) and round(custo_esp_atual, 9) <= round(custo_esp_buffer, 9) then 'atual'
            when round(custo_esp_conservadora, 9) <= round(custo_esp_buffer, 9) then 'conservadora' else 'com_buffer' end as politica_preferida
        from esperados)"""
_PAIRS = (("dom_conserv_vs_atual", "conservadora", "atual"), ("dom_buffer_vs_atual", "buffer", "atual"), ("dom_buffer_vs_conserv", "buffer", "conservadora"))
_COMPARE = " union all ".join(f"select unidade, produto, categoria, '{n}' as par, c_{a} as a, c_{b} as b from custos" for n, a, b in _PAIRS)
_GRID = f"""{_COSTS},
    ab as ({_COMPARE}),
    lim as (select unidade, produto, categoria, par, least(min(a), min(b)) as lo, greatest(max(a), max(b)) as hi from ab group by all),
    grade as (select lim.*, i::int as i, case when i = 199 then hi else i * ((hi - lo) / 199) + lo end as z from lim cross join range(200) g(i)),
    freq as (
        select unidade, produto, categoria, par, lo, hi, i, z, count(*) filter (where a <= z) as na, count(*) filter (where b <= z) as nb, count(*) as n
        from grade join ab using (unidade, produto, categoria, par) group by all)"""
_WIDE = ", ".join(f"max(r) filter (where par = '{n}') as {n}" for n, _, _ in _PAIRS)
_SSD = f"""{_GRID},
    acum as (
        select unidade, produto, categoria, par, lo, hi, sum(na) over w as ca, sum(nb) over w as cb from freq
        window w as (partition by unidade, produto, categoria, par order by i rows unbounded preceding)),
    res as (
        select unidade, produto, categoria, par, case when lo = hi then 'nenhuma' when bool_or(ca < cb) and not bool_or(ca > cb) then 'A'
            when bool_or(ca > cb) and not bool_or(ca < cb) then 'B' else 'nenhuma' end as r
        from acum group by unidade, produto, categoria, par, lo, hi)
    select unidade, produto, categoria, {_WIDE} from res group by all"""
_CHEAPER = f"""{_COSTS},
    ab as ({_COMPARE}),
    z as (select distinct unidade, produto, categoria, par, a as z from ab union select distinct unidade, produto, categoria, par, b from ab),
    exc as (
        select unidade, produto, categoria, par, z, round(sum(greatest(a - z, 0.0::double)), 9) as ea, round(sum(greatest(b - z, 0.0::double)), 9) as eb
        from z join ab using (unidade, produto, categoria, par) group by all),
    res as (
        select unidade, produto, categoria, par, case when bool_or(ea < eb) and not bool_or(ea > eb) then 'A' when bool_or(ea > eb) and not bool_or(ea < eb) then 'B' else 'nenhuma' end as r
        from exc group by unidade, produto, categoria, par)
    select unidade, produto, categoria, {_WIDE} from res group by all"""
_HISTORY = f"""{_MONTHLY},
    historico as (
        select unidade, produto, categoria, mes, consumo_reg + consumo_extra as consumo_total, consumo_reg, consumo_extra, demanda_reg + demanda_extra as demanda_total from mensal)"""
_TEMPORAL = """
    {out} as (
        select *, {lags}, coalesce(avg(consumo_total) over w3, 0.0::double) as media_3m, coalesce(stddev_pop(consumo_total) over w3, 0.0::double) as std_3m,
            (row_number() over w - 1)::int as trend_idx, month(strptime(mes, '%Y-%m'))::int as mes_num
        from {src} window w as (partition by unidade, produto order by mes, categoria), w3 as (partition by unidade, produto order by mes, categoria rows between 3 preceding and 1 preceding))"""
_LAGS = ", ".join(f"coalesce(lag(consumo_total, {i}) over w, 0.0::double) as lag_{i}, (lag(consumo_total, {i}) over w is not null)::int as lag_{i}_disp" for i in range(1, 5))
_TEMP = f"{_HISTORY},{_TEMPORAL.format(out='temporal', src='historico', lags=_LAGS)}"
_NEXT = f"""{_HISTORY},
    proximo as (select strftime(strptime(max(mes), '%Y-%m') + interval 1 month, '%Y-%m') as mes from historico),
    ambos as (
        select *, false as is_future from historico union all
        select unidade, produto, categoria, mes, null, null, null, null, true from (select distinct unidade, produto, categoria from historico) cross join proximo),
    {_TEMPORAL.format(out="futuro", src="ambos", lags=_LAGS)},
    previstos as (select *, greatest(0.1::double * lag_4 + 0.2::double * lag_3 + 0.3::double * lag_2 + 0.4::double * lag_1, 0.0::double) as previsao from futuro)"""
_WALK = f"""{_TEMP},
    dobras as (select mes, (dense_rank() over (order by mes) - 1)::int as fold from (select distinct mes from historico)),
    erros as (
        select fold, mes as mes_test, unidade, produto, consumo_total as actual, greatest(0.1::double * lag_4 + 0.2::double * lag_3 + 0.3::double * lag_2 + 0.4::double * lag_1, 0.0::double) as predicted
        from temporal join dobras using (mes) where fold >= 3 and trend_idx >= 1),
    backtest as (
        select *, abs(actual - predicted) as abs_error, (actual - predicted) * (actual - predicted) as sq_error, case when actual > 0 then abs(actual - predicted) / actual end as pct_error from erros)"""
_DRIFT = """
    ultimos as (select v from e order by {order} limit 3),
    juntos as (
        select (select count(*) from e) as n_erros, (select avg(v) from ultimos) as media_recente, (select sum(v) from ultimos) as s, (select sum(v * v) from ultimos) as q, (select count(*) from ultimos) as k,
            (select sum(v) from e) as ws, (select sum(v * v) from e) as wq),
    antes as (select *, case when n_erros > k then (ws - s) / (n_erros - k) end as media_anterior from juntos),
    zs as (
        select *, case when n_erros >= 5 then (media_recente - media_anterior)
            / (case when n_erros - k > 1 then sqrt(greatest((wq - q) / (n_erros - k) - media_anterior * media_anterior, 0.0::double)) else 1.0::double end + 1e-9::double) end as z
        from antes)
    select n_erros, round(media_recente, 6) as media_recente, round(media_anterior, 6) as media_anterior, round(z, 6) as z, coalesce(abs(z) > 2.0::double, false) as recalibrar from zs"""
_KEY = "unidade, produto, categoria"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


_MEANS = (
    "consumo_medio_mensal", "demanda_media_mensal", "env_medio_mensal", "rec_medio_mensal", "consumo_reg_medio", "consumo_extra_medio", "demanda_reg_media", "demanda_extra_media",
    "gap_medio_mensal", "taxa_atendimento", "razao_extra_regular", "pct_extra_no_consumo",
)

_BODIES: dict[str, tuple[str, str]] = {
    "ledger_normalize": (_LEDGER, "select categoria, status, mes, pedido_extra, count(*) as n, sum(qtd_solic) as qtd_solic, sum(qtd_env) as qtd_env, sum(qtd_rec) as qtd_rec from pedidos group by all"),
    "ledger_flags": (_LEDGER, "select unidade, produto, status, count(*) filter (where f1) as flag_env_maior_solic, count(*) filter (where f2) as flag_rec_maior_env, count(*) filter (where f3) as flag_fin_sem_rec, count(*) filter (where f1 or f2 or f3) as flag_qualquer_erro from marcados group by all"),
    "ledger_consumption": (_LEDGER, "select unidade, produto, status, sum(qtd_consumo) as qtd_consumo, max(qtd_consumo) as maior from consolidado group by all"),
    "ledger_demand": (_LEDGER, "select unidade, mes, sum(qtd_demanda) as qtd_demanda from consolidado group by all"),
    "unit_anonymize_rank": (_LEDGER, "select unidade, count(*) as n_pedidos, printf('Unidade_%02d', row_number() over (order by count(*) desc, unidade)) as alias from pedidos group by unidade"),
    "anonymized_totals": (_LEDGER, "select printf('Unidade_%02d', row_number() over (order by count(*) desc, unidade)) as unidade, count(*) as n, sum(qtd_solic) as qtd_solic from pedidos group by pedidos.unidade"),
    "flag_error_rates": (_LEDGER, "select count(*) as n_pedidos, count(*) filter (where f1) as n_env_maior_solic, count(*) filter (where f2) as n_rec_maior_env, count(*) filter (where f3) as n_fin_sem_rec, count(*) filter (where f1 or f2 or f3) as n_qualquer_erro, round_even(count(*) filter (where f1 or f2 or f3)::double / count(*)::double * 1000000.0::double, 0) / 1000000.0::double as taxa_erro from marcados"),
    "monthly_pivot": (_PANEL, "select * from ref"),
    "balanced_panel": (_PANEL, "select * exclude (peso) from painel"),
    "pair_metrics": (_METRICS, f"select {_KEY}, {_round(*_MEANS)}, meses_com_pedido, meses_com_extra from metricas"),
    "pair_dispersion": (_METRICS, f"select {_KEY}, {_round('desvio_padrao', 'cv')} from metricas"),
    "xyz_class": (_METRICS, f"select {_KEY}, classe_xyz from metricas"),
    "xyz_distribution": (_METRICS, "select classe_xyz, count(*) as n from metricas group by all"),
    "wma_projection": (_METRICS, f"select {_KEY}, {_round('proj_ponderada')} from metricas"),
    "k_buffer": (_POLICY, f"select {_KEY}, k from politicas"),
    "quota_policies": (_POLICY, f"select {_KEY}, {_round('cota_conservadora', 'cota_buffer')} from politicas"),
    "marginal_need": (_POLICY, f"select {_KEY}, {_round('necessidade_marginal_conserv', 'necessidade_marginal_buffer')} from politicas"),
    "suggested_action": (_POLICY, f"select {_KEY}, {_round('consumo_medio_mensal')}, classe_xyz, k, {_round('cota_conservadora', 'cota_buffer')}, acao_sugerida from politicas"),
    "action_distribution": (_POLICY, "select acao_sugerida, count(*) as n from politicas group by all"),
    "policy_costs": (_COSTS, f"select {_KEY}, q_atual, q_conservadora, q_buffer, round(sum(c_atual), 6) as custo_atual, round(sum(c_conservadora), 6) as custo_conservadora, round(sum(c_buffer), 6) as custo_buffer from custos group by all"),
    "expected_cost": (_COSTS, f"select {_KEY}, {_round('custo_esp_atual', 'custo_esp_conservadora', 'custo_esp_buffer')} from esperados"),
    "preferred_policy": (_COSTS, f"select {_KEY}, politica_preferida from preferidas"),
    "preferred_distribution": (_COSTS, "select politica_preferida, count(*) as n from preferidas group by all"),
    "cost_cdf_grid": (_GRID, f"select {_KEY}, i, round(z, 6) as z, round(na::double / n::double, 6) as f_a, round(nb::double / n::double, 6) as f_b from freq where par = 'dom_conserv_vs_atual' and lo < hi"),
    "ssd_reference": (_SSD, ""),
    "ssd_cost_mode": (_CHEAPER, ""),
    "bootstrap_seeded_costs": (
        f"""{_COSTS},
    s as (select {_KEY}, q_atual, q_conservadora, q_buffer, list(v order by mes) as s from custos group by all),
    p as (select {_KEY}, s, 'atual' as politica, q_atual as q from s union all select {_KEY}, s, 'conservadora', q_conservadora from s union all select {_KEY}, s, 'buffer', q_buffer from s),
    d as (
        select {_KEY}, politica, q, s[1 + (('0x' || substr(md5(concat_ws('|', unidade, produto, categoria, politica, r::varchar, '20260501')), 1, 8))::bigint % len(s))] as v
        from p cross join range(5000) t(r))""",
        f"select {_KEY}, politica, round((1.0::double * sum(greatest(v - q, 0.0::double)) + 0.3::double * sum(greatest(q - v, 0.0::double))) / count(*)::double, 6) as custo_esperado from d group by all",
    ),
    "month_gate": (_HISTORY, "select n_meses, case when n_meses < 8 then 'insuficiente' when n_meses < 18 then 'preliminar' else 'operacional' end as confiabilidade from (select count(distinct mes) as n_meses from historico)"),
    "feat_lags": (_TEMP, f"select unidade, produto, mes, {', '.join(f'lag_{i}, lag_{i}_disp' for i in range(1, 5))} from temporal"),
    "feat_rolling": (_TEMP, f"select unidade, produto, mes, {_round('media_3m', 'std_3m')} from temporal"),
    "feat_trend_month": (_TEMP, "select unidade, produto, mes, trend_idx, mes_num from temporal"),
    "feat_regime": (
        f"{_METRICS},\n    historico as (select unidade, produto, categoria, mes from mensal)",
        "select h.unidade, h.produto, mes, round(coalesce(consumo_medio_mensal, 0.0::double), 6) as consumo_medio_hist, round(coalesce(cv, 0.0::double), 6) as cv_hist, "
        + ", ".join(f"coalesce((classe_xyz = '{r}')::int, 0) as regime_{r}" for r in ("X_regular", "Y_moderado", "Z_erratico", "baixa_rotatividade"))
        + " from historico h left join metricas m on h.unidade = m.unidade and h.produto = m.produto",
    ),
    "feat_onehot": (_HISTORY, "select unidade, produto, mes, " + ", ".join(f"(categoria = '{c}')::int as cat_{c}" for c in ("CATEGORIA_A", "CATEGORIA_B", "CATEGORIA_C")) + ", " + ", ".join(f"(month(strptime(mes, '%Y-%m')) = {m})::int as mes_{m}" for m in range(1, 13)) + " from historico"),
    "feat_next_period": (_NEXT, f"select {_KEY}, mes, {_round('lag_1', 'lag_2', 'media_3m', 'std_3m')}, trend_idx from futuro where is_future"),
    "forecast_baseline": (_NEXT, f"select unidade, produto, mes as mes_previsao, {_round('previsao')} from previstos where is_future"),
    "forecast_interval_exact": (
        f"{_NEXT},\n    r as (select quantile_cont(consumo_total - previsao, 0.05) as lo, quantile_cont(consumo_total - previsao, 0.95) as hi from previstos where not is_future)",
        f"select {_KEY}, mes as mes_previsao, {_round('previsao')}, round(greatest(previsao + lo, 0.0::double), 6) as intervalo_inferior_90, round(greatest(previsao + hi, 0.0::double), 6) as intervalo_superior_90 from previstos cross join r where is_future",
    ),
    "history_upsert": (
        f"{_HISTORY},\n    novo as (select * replace (consumo_total + 1.0::double as consumo_total) from historico where mes >= '2001-06')",
        "select * from novo union all select * from historico h where mes < '2001-08' and not exists (select 1 from novo n where n.unidade = h.unidade and n.produto = h.produto and n.mes = h.mes)",
    ),
    "walk_forward_baseline": (_WALK, f"select fold, mes_test, unidade, produto, {_round('actual', 'predicted', 'abs_error', 'sq_error', 'pct_error')} from backtest"),
    "backtest_metrics": (_WALK, "select fold, mes_test, round(avg(abs_error), 6) as mae, round(sqrt(avg(sq_error)), 6) as rmse, round(avg(pct_error), 6) as mape, count(*) as n_obs from backtest group by all"),
    "drift_zscore_rows": (f"{_WALK},\n    e as (select abs_error as v, unidade, produto from backtest where fold = (select max(fold) from backtest)),{_DRIFT.format(order='unidade desc, produto desc')}", ""),
    "drift_zscore_months": (f"{_WALK},\n    e as (select avg(abs_error) as v, mes_test from backtest group by mes_test),{_DRIFT.format(order='mes_test desc')}", ""),
    "registry_promotion": (
        f"""{_WALK},
    m as (select fold, avg(abs_error) as mae from backtest group by fold),
    w as (select fold, mae, lag(mae) over (order by fold) as base, min(mae) over (order by fold rows between unbounded preceding and 2 preceding) as campeao, printf('v%04d', row_number() over (order by fold)) as versao from m)""",
        "select fold, versao, round(mae, 6) as mae, case when mae is null or base is null then false when mae >= base then false when campeao is not null and mae >= campeao then false else true end as promovido from w",
    ),
    "close_cycle": (
        f"{_COSTS},{_NEXT.removeprefix(_MONTHLY + ',')}",
        """select p.unidade, p.produto, p.categoria, politica_preferida, round(f.previsao, 6) as demanda_prevista, case when f.previsao is not null then 'ml_prevista' else 'empirica' end as fonte_demanda,
            coalesce(f.conf, 'insuficiente') as confiabilidade_ml, f.modelo as modelo_ml
        from preferidas p left join (
            select *, case when (select count(distinct mes) from historico) < 18 then 'preliminar' else 'operacional' end as conf, 'baseline_mmp' as modelo from previstos
            where is_future and (select count(distinct mes) from historico) >= 8) f on p.unidade = f.unidade and p.produto = f.produto""",
    ),
    "pareto_units": (_LEDGER, "select unidade, n_pedidos, (row_number() over w)::int as ordem, round(sum(n_pedidos) over w / sum(n_pedidos) over (), 6) as acumulado from (select unidade, count(*) as n_pedidos from pedidos group by unidade) window w as (order by n_pedidos desc, unidade)"),
    "ledger_from_text": (
        f"""{_LEDGER},
    n as (select *, qtd_solic::bigint % 7 as n from pedidos),
    t as (
        select unidade, mes, data_solic, trim(replace(upper(case n when 0 then ' ' || lower(categoria) || ' ' when 1 then replace(categoria, 'CATEGORIA', 'CATEGÓRIA') else categoria end), 'Ó', 'O')) as categoria,
            case when n = 2 then 0.0::double else qtd_solic end as qtd_solic, case when n = 3 then 0.0::double else trunc(qtd_env) end as qtd_env, case when n = 4 then 0.0::double else trunc(qtd_rec) end as qtd_rec,
            case when n = 5 then null else pedido_extra end as pedido_extra
        from n)""",
        "select unidade, categoria, mes, pedido_extra, count(*) as n, sum(qtd_solic) as qtd_solic, sum(qtd_env) as qtd_env, sum(qtd_rec) as qtd_rec, date_trunc('day', max(data_solic))::timestamp as ate from t group by unidade, categoria, mes, pedido_extra",
    ),
    "ledger_summary": (
        _LEDGER,
        "select count(*) as linhas, count(distinct unidade) as unidades, count(distinct produto) as produtos, min(mes) as de, max(mes) as ate, round(sum(qtd_consumo), 6) as consumo, count(*) filter (where f1) as n_env_maior_solic, "
        "count(*) filter (where f2) as n_rec_maior_env, count(*) filter (where f3) as n_fin_sem_rec, count(*) filter (where f1 or f2 or f3) as n_qualquer_erro, round(avg((f1 or f2 or f3)::int::double), 6) as taxa from consolidado",
    ),
    "audit_counts": (
        f"""{_COSTS},
    k as (
        select (select count(*) from consolidado where mes between '2001-04' and '2001-07') as a, (select count(*) from painel) as b, (select count(*) from metricas) as c, (select count(*) from politicas) as d,
            (select count(*) from esperados) as e)""",
        "select etapa, i as linhas_entrada, o as linhas_saida, o - i as delta from (select unnest(['2.1_agregacao_mensal', '2.2_metricas_por_par', '3_politica_cota', '4_dominancia_estocastica']) as etapa, unnest([a, b, c, d]) as i, unnest([b, c, d, e]) as o from k)",
    ),
    "history_months": (_HISTORY, "select mes, (row_number() over (order by mes))::int as ordem, strftime(strptime(max(mes) over (), '%Y-%m') + interval 1 month, '%Y-%m') as proximo from (select distinct mes from historico)"),
    "forecast_reliability": (
        f"{_NEXT},\n    r as (select quantile_cont(consumo_total - previsao, 0.05) as lo, quantile_cont(consumo_total - previsao, 0.95) as hi from previstos where not is_future),\n    g as (select count(distinct mes) as t from historico)",
        f"""select {_KEY}, mes as mes_previsao, {", ".join(f"round_even(({x}) * 100.0::double, 0) / 100.0::double as {name}" for name, x in (("previsao", "previsao"), ("intervalo_inferior_90", "greatest(previsao + lo, 0.0::double)"), ("intervalo_superior_90", "greatest(previsao + hi, 0.0::double)")))},
            case when t < 8 then 'insuficiente' when t < 18 then 'preliminar' else 'operacional' end as confiabilidade, 'baseline_mmp' as modelo_usado, t >= 8 as previsao_substitui_c4
        from previstos cross join r cross join g where is_future""",
    ),
    "backtest_union": (
        f"""{_TEMP},
    dobras as (select mes, (dense_rank() over (order by mes) - 1)::int as fold from (select distinct mes from historico)),
    soma as (
        select *, 0.1::double * lag_4 + 0.2::double * lag_3 + 0.3::double * lag_2 + 0.4::double * lag_1 as s,
            0.1::double * lag_4_disp + 0.2::double * lag_3_disp + 0.3::double * lag_2_disp + 0.4::double * lag_1_disp as parte
        from temporal join dobras using (mes) where fold >= 3 and trend_idx >= 1),
    ambos as (
        select 'baseline_mmp' as modelo, mes, consumo_total as v, greatest(s, 0.0::double) as p from soma union all
        select 'baseline_media', mes, consumo_total, greatest(case when parte > 0 then s / parte else 0.0::double end, 0.0::double) from soma)""",
        "select modelo, mes as mes_test, round(avg(abs(v - p)), 6) as mae, round(sqrt(avg((v - p) * (v - p))), 6) as rmse, round(avg(case when v > 0 then abs(v - p) / v end), 6) as mape, count(*) as n_obs from ambos group by modelo, mes",
    ),
}


_DRAWN = f"""{_BODIES["bootstrap_seeded_costs"][0]},
    w as (select {_KEY}, politica, {_COST("q")} as c, count(*) as n from d group by {_KEY}, politica, {_COST("q")}),
    esp as (select {_KEY}, politica, sum(c * n) / 5000.0::double as custo from w group by {_KEY}, politica),
    largo as (
        select {_KEY}, max(custo) filter (where politica = 'atual') as ca, max(custo) filter (where politica = 'conservadora') as cc, max(custo) filter (where politica = 'buffer') as cb
        from esp group by {_KEY}),
    pref as (
        select {_KEY}, {", ".join(f"round({x}, 6) as custo_esp_{p}" for x, p in (("ca", "atual"), ("cc", "conservadora"), ("cb", "buffer")))},
            case when round(ca, 9) <= round(cc, 9) and round(ca, 9) <= round(cb, 9) then 'atual' when round(cc, 9) <= round(cb, 9) then 'conservadora' else 'com_buffer' end as politica_preferida
        from largo),
    ab as ({" union all ".join(f"select {_KEY}, '{n}' as par, politica = '{a}' as is_a, c, n from w where politica in ('{a}', '{b}')" for n, a, b in _PAIRS)})"""
_DRAWN_SSD = """
    lim as (select unidade, produto, categoria, par, min(c) as lo, max(c) as hi from ab group by all),
    grade as (select lim.*, i::int as i, case when i = 199 then hi else i * ((hi - lo) / 199) + lo end as z from lim cross join range(200) g(i)),
    freq as (
        select unidade, produto, categoria, par, lo, hi, i, coalesce(sum(n) filter (where c <= z and is_a), 0) as na, coalesce(sum(n) filter (where c <= z and not is_a), 0) as nb
        from grade join ab using (unidade, produto, categoria, par) group by all),
    acum as (
        select *, sum(na) over w as sa, sum(nb) over w as sb from freq window w as (partition by unidade, produto, categoria, par order by i rows unbounded preceding)),
    res as (
        select unidade, produto, categoria, par, case when lo = hi then 'nenhuma' when bool_or(sa < sb) and not bool_or(sa > sb) then 'A' when bool_or(sa > sb) and not bool_or(sa < sb) then 'B' else 'nenhuma' end as r
        from acum group by unidade, produto, categoria, par, lo, hi)"""
_DRAWN_CHEAPER = """
    niveis as (select distinct unidade, produto, categoria, par, c as z from ab),
    exc as (
        select unidade, produto, categoria, par, z, round(coalesce(sum(n * greatest(c - z, 0.0::double)) filter (where is_a), 0), 6) as ea, round(coalesce(sum(n * greatest(c - z, 0.0::double)) filter (where not is_a), 0), 6) as eb
        from niveis join ab using (unidade, produto, categoria, par) group by all),
    res as (
        select unidade, produto, categoria, par, case when bool_or(ea < eb) and not bool_or(ea > eb) then 'A' when bool_or(ea > eb) and not bool_or(ea < eb) then 'B' else 'nenhuma' end as r
        from exc group by unidade, produto, categoria, par)"""
_DRAWN_OUT = f"select * from pref join (select {_KEY}, {_WIDE} from res group by {_KEY}) using ({_KEY})"
_BODIES |= {
    "ssd_seeded": (f"{_DRAWN},{_DRAWN_SSD}", _DRAWN_OUT),
    "ssd_seeded_cost_mode": (f"{_DRAWN},{_DRAWN_CHEAPER}", _DRAWN_OUT),
    "forecast_interval_seeded": (
        f"""{_NEXT},
    pool as (select consumo_total - previsao as residuo, row_number() over (order by consumo_total - previsao) - 1 as rank, count(*) over () as n from previstos where not is_future),
    draws as (
        select unidade, produto, previsao, ('0x' || substr(md5(concat_ws('|', unidade, produto, r::varchar, '20260501')), 1, 15))::bigint % (select max(n) from pool) as rank
        from previstos cross join range(500) t(r) where is_future),
    amostra as (select unidade, produto, greatest(previsao + residuo, 0.0::double) as v from draws join pool using (rank)),
    limites as (select unidade, produto, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from amostra group by all)""",
        f"select {_KEY}, mes as mes_previsao, {_round('previsao')}, round(lo, 6) as intervalo_inferior_90, round(hi, 6) as intervalo_superior_90 from previstos join limites using (unidade, produto) where is_future",
    ),
}


_ML = f"""{_COSTS},{_NEXT.removeprefix(_MONTHLY + ",")},
    degraus as (select quantile_cont(consumo_total - previsao, [{', '.join(str((k + 0.5) / 40) for k in range(40))}]) as r from previstos where not is_future),
    ativos as (
        select unidade, produto, list_transform(r, lambda x: greatest(previsao + x, 0.0::double)) as s from previstos cross join degraus
        where is_future and (select count(distinct mes) from historico) >= 8),
    custos_ml as (
        select q.*, {", ".join(f"{_COST('q_' + p)} as c_{p}" for p in ("atual", "conservadora", "buffer"))}
        from quotas q join (select unidade, produto, unnest(s) as v from ativos where list_max(s) > 0) using (unidade, produto))"""


def _wide_ssd(source: str, to: str) -> str:
    """Tables that end in the one named to: the three comparisons of the costs in source, cumulated on a grid."""
    both = " union all ".join(f"select unidade, produto, categoria, '{n}' as par, c_{a} as a, c_{b} as b from {source}" for n, a, b in _PAIRS)
    return f"""
    {to}_ab as ({both}),
    {to}_lim as (select unidade, produto, categoria, par, least(min(a), min(b)) as lo, greatest(max(a), max(b)) as hi from {to}_ab group by all),
    {to}_grade as (select l.*, i::int as i, case when i = 199 then hi else i * ((hi - lo) / 199) + lo end as z from {to}_lim l cross join range(200) g(i)),
    {to}_freq as (
        select unidade, produto, categoria, par, lo, hi, i, count(*) filter (where a <= z) as na, count(*) filter (where b <= z) as nb from {to}_grade join {to}_ab using (unidade, produto, categoria, par) group by all),
    {to}_acum as (select *, sum(na) over w as ca, sum(nb) over w as cb from {to}_freq window w as (partition by unidade, produto, categoria, par order by i rows unbounded preceding)),
    {to}_res as (
        select unidade, produto, categoria, par, case when lo = hi then 'nenhuma' when bool_or(ca < cb) and not bool_or(ca > cb) then 'A' when bool_or(ca > cb) and not bool_or(ca < cb) then 'B' else 'nenhuma' end as r
        from {to}_acum group by unidade, produto, categoria, par, lo, hi),
    {to} as (select unidade, produto, categoria, {_WIDE} from {to}_res group by all)"""


def _wide_cheaper(source: str, to: str) -> str:
    """The same by the mean cost beyond every level."""
    both = " union all ".join(f"select unidade, produto, categoria, '{n}' as par, c_{a} as a, c_{b} as b from {source}" for n, a, b in _PAIRS)
    return f"""
    {to}_ab as ({both}),
    {to}_z as (select distinct unidade, produto, categoria, par, a as z from {to}_ab union select distinct unidade, produto, categoria, par, b from {to}_ab),
    {to}_exc as (
        select unidade, produto, categoria, par, z, round(sum(greatest(a - z, 0.0::double)), 9) as ea, round(sum(greatest(b - z, 0.0::double)), 9) as eb
        from {to}_z join {to}_ab using (unidade, produto, categoria, par) group by all),
    {to}_res as (
        select unidade, produto, categoria, par, case when bool_or(ea < eb) and not bool_or(ea > eb) then 'A' when bool_or(ea > eb) and not bool_or(ea < eb) then 'B' else 'nenhuma' end as r
        from {to}_exc group by unidade, produto, categoria, par),
    {to} as (select unidade, produto, categoria, {_WIDE} from {to}_res group by all)"""


def _decided(wide: Callable[[str, str], str]) -> tuple[str, str]:
    """The observed costs' comparison and the predicted ones', which replaces it."""
    pref = "case when round(ca, 9) <= round(cc, 9) and round(ca, 9) <= round(cb, 9) then 'atual' when round(cc, 9) <= round(cb, 9) then 'conservadora' else 'com_buffer' end"
    means = "select unidade, produto, avg(c_atual) as ca, avg(c_conservadora) as cc, avg(c_buffer) as cb from custos_ml group by all"
    names = ", ".join(f"coalesce(n.{x}, o.{x}) as {x}" for x, _, _ in _PAIRS)
    costs = ", ".join(f"round(coalesce(e.{a}, p.custo_esp_{b}), 6) as custo_esp_{b}" for a, b in (("ca", "atual"), ("cc", "conservadora"), ("cb", "buffer")))
    body = f"""select p.unidade, p.produto, p.categoria, {costs}, coalesce(e.pref, p.politica_preferida) as politica_preferida, p.politica_preferida as politica_empirica,
            coalesce(e.pref, p.politica_preferida) <> p.politica_preferida as politica_mudou, case when e.unidade is not null then 'ml_prevista' else 'empirica' end as fonte_demanda, {names}
        from preferidas p join observado o using (unidade, produto, categoria) left join esp_ml e on p.unidade = e.unidade and p.produto = e.produto
            left join previsto n on p.unidade = n.unidade and p.produto = n.produto"""
    return f"{_ML},{wide('custos', 'observado')},{wide('custos_ml', 'previsto')},\n    esp_ml as (select *, {pref} as pref from ({means}))", body


_STREAMED = """
    e as (
        select 'baseline_mmp' as modelo, fold, unidade, produto, abs(v - greatest(s, 0.0::double)) as v from soma union all
        select 'baseline_media', fold, unidade, produto, abs(v - greatest(case when parte > 0 then s / parte else 0.0::double end, 0.0::double)) from soma),
    o as (select *, row_number() over (partition by modelo order by fold desc, unidade desc, produto desc) as ordem from e),
    j as (
        select modelo, count(*) as n_erros, avg(v) filter (where ordem <= 3) as media_recente, avg(v) filter (where ordem > 3) as media_anterior, stddev_pop(v) filter (where ordem > 3) as desvio from o group by modelo),
    z as (select *, (media_recente - media_anterior) / (desvio + 1e-9::double) as z from j)"""
_BODIES |= {
    "drift_streamed": (
        _BODIES["backtest_union"][0].partition("    ambos as")[0].replace("select *, 0.1", "select *, consumo_total as v, 0.1").rstrip() + _STREAMED,
        f"select modelo, n_erros, {_round('media_recente', 'media_anterior', 'z')}, abs(z) > 2.0::double as recalibrar from z",
    ),
    # one standardised feature: the coefficient is its covariance with the target times n over n + penalty
    "ridge_estimator": (
        f"""{_NEXT},
    t as (
        select avg(lag_1) as x, stddev_pop(lag_1) as d, avg(greatest(consumo_total, 0.0::double)) as y, covar_pop(lag_1, greatest(consumo_total, 0.0::double)) as c, count(*)::double as n
        from futuro where not is_future)""",
        "select unidade, produto, mes as mes_previsao, round(greatest(y + c / d * n / (n + 10.0::double) * (lag_1 - x) / d, 0.0::double), 6) as previsao from futuro cross join t where is_future",
    ),
}
_RULES = {
    "chave_completa": "unidade is null or produto is null or data_solic is null", "status_conhecido": "status not in ('Pendente', 'Aprovado', 'Aguardando Gerente', 'Finalizado', 'Recebimento Confirmado', 'Rejeitado', 'Enviada')",
    "categoria_conhecida": "not regexp_full_match(categoria, 'CATEGORIA_[A-Z]')", "qtd_solic_nao_negativa": "qtd_solic < 0", "qtd_env_nao_negativa": "qtd_env < 0", "qtd_rec_nao_negativa": "qtd_rec < 0",
    "envio_ate_solicitado": "qtd_env > qtd_solic", "pedido_unico": "count(*) over (partition by unidade, produto, data_solic, pedido_extra, status) > 1",
    "uma_categoria_por_produto": "min(categoria) over (partition by produto) <> max(categoria) over (partition by produto)",
    "um_status_por_dia": "min(status) over (partition by unidade, produto, data_solic) <> max(status) over (partition by unidade, produto, data_solic)",
}
_BROKEN = f"""{_LEDGER},
    quebras as (select unidade, qtd_solic, unnest([{", ".join(f"{{'regra': '{name}', 'quebra': {test}}}" for name, test in _RULES.items())}], recursive := true) from pedidos)"""
_BODIES |= {
    "close_cycle_decided": _decided(_wide_ssd),
    "close_cycle_decided_cost_mode": _decided(_wide_cheaper),
    "ledger_from_html": (
        _LEDGER,
        "select unidade, categoria, mes, status, count(*) as n, sum(qtd_solic) as qtd_solic, sum(trunc(qtd_env)) as qtd_env, sum(trunc(qtd_rec)) as qtd_rec, count(*) filter (where pedido_extra) as n_extra from pedidos group by all",
    ),
    "ledger_rules": (_BROKEN, "select regra, count(*) as n_linhas, count(*) filter (where quebra) as n_violacoes, count(*) filter (where quebra) = 0 as valida from quebras group by regra"),
    "ledger_offending": (_BROKEN, "select unidade, regra, count(*) as n, sum(qtd_solic) as qtd_solic from quebras where quebra group by unidade, regra"),
}
_FEATURES = [
    *(f"lag_{i}" for i in range(1, 5)), "media_3m", "std_3m", "trend_idx", "mes_num", *(f"cat_CATEGORIA_{c}" for c in "ABC"), *(f"mes_{m}" for m in range(1, 13)),
    "consumo_medio_hist", "cv_hist", *(f"regime_{r}" for r in ("X_regular", "Y_moderado", "Z_erratico", "baixa_rotatividade")),
]


def _feature(name: str) -> str:
    kind, _, value = name.partition("_")
    if kind == "cat":
        return f"(categoria = '{value}')::int"
    if kind == "mes" and value != "num":
        return f"(mes_num = {value})::int"
    if kind == "regime":
        return f"coalesce((classe_xyz = '{value}')::int, 0)"
    return {"consumo_medio_hist": "coalesce(consumo_medio_mensal, 0.0::double)", "cv_hist": "coalesce(cv, 0.0::double)"}.get(name, name)


_BODIES |= {
    "metrics_as_of": (
        f"""{_HISTORY},
    grade as (select unidade, produto, mes, consumo_total as v from (select distinct unidade, produto from historico) cross join (select distinct mes from historico) left join historico using (unidade, produto, mes)),
    antes as (
        select unidade, produto, mes, count(v) over w as n_meses, avg(v) over w as m, avg(v * v) over w as q from grade
        window w as (partition by unidade, produto order by mes rows between unbounded preceding and 1 preceding)),
    medidas as (select *, case when m > 0 then round(sqrt(greatest(q - m * m, 0.0::double)) / m, 12) end as cv from antes where n_meses > 0)""",
        """select unidade, produto, mes, n_meses, round(m, 6) as consumo_medio_hist, round(coalesce(cv, 0.0::double), 6) as cv_hist, case when cv is null then 'sem_consumo' when m < 1.0::double then 'baixa_rotatividade'
            when cv < 0.3::double then 'X_regular' when cv < 0.7::double then 'Y_moderado' else 'Z_erratico' end as classe_xyz from medidas""",
    ),
    # the right sides of the normal equations: they depend on the data alone
    "ridge_normal_equations": (
        f"""{_METRICS},{_TEMP.removeprefix(_MONTHLY + ",")},
    dobras as (select mes, (dense_rank() over (order by mes) - 1)::int as t from (select distinct mes from historico)),
    linhas as (
        select d.t, greatest(h.consumo_total, 0.0::double) as y, unnest([{", ".join(f"{{'k': '{n}', 'v': ({_feature(n)})::double}}" for n in _FEATURES)}], recursive := true)
        from (select h.*, classe_xyz, consumo_medio_mensal, cv from temporal h left join metricas m on h.unidade = m.unidade and h.produto = m.produto) h join dobras d using (mes)),
    somas as (select t, k, count(*) as n, sum(v) as v, sum(v * v) as vv, sum(y) as y, sum(v * y) as vy from linhas group by t, k),
    acum as (
        select fold, k, sum(n)::bigint as n, sum(v) / sum(n) as v, sum(vv) / sum(n) as vv, sum(y) / sum(n) as y, sum(vy) / sum(n) as vy
        from somas join (select t as fold from dobras where t >= 3) on t < fold group by fold, k)""",
        """select fold, k as feature, n, round((vy - v * y) / sqrt(vv - v * v), 3) as value from acum where vv - v * v > 1e-9::double * vv and (fold >= 18 or k = 'mes_num' or not starts_with(k, 'mes_'))
        union all select fold, '1', n, round(y, 3) from acum where k = 'lag_1'""",
    ),
}


def _uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '20260501')), 1, 10))::bigint + 0.5::double) / 1099511627776.0::double)"


_DRAW = lambda name: _uniform(f"'{name}'", "unidade", "produto", "k")
_OWN = lambda name: _uniform(f"'{name}'", "unidade", "produto", "k", "extra")
_NETWORK = f"""
    unidades as (
        select printf('Unidade_%02d', row_number() over (order by fator desc)) as unidade, fator from (select 0.35::double + (2.6::double - 0.35::double) * {_uniform("'unit'", "i")} as fator from range(1, 16) t(i))),
    produtos as (
        select printf('Produto_%03d', i) as produto, case when i <= 40 then 'CATEGORIA_A' when i <= 85 then 'CATEGORIA_B' else 'CATEGORIA_C' end as categoria, 3.0::double + (20.0::double - 3.0::double) * {_uniform("'product'", "i")} as taxa
        from range(1, 111) t(i)),
    pares as (
        select unidade, fator, produto, categoria, taxa, case when n <= 197 then 'X' when n <= 435 then 'Y' else 'Z' end as perfil
        from (select *, row_number() over (order by {_uniform("'pair'", "unidade", "produto")}, unidade, produto) as n from unidades cross join produtos) where n <= 600)"""
_SYNTHETIC = f"""{_NETWORK},
    meses_s(mes, de, dias, peso, mes_ref, k) as (values
        ('2026-01', date '2026-01-03', 29, 0.65::double, 'Janeiro/2026', 0), ('2026-02', date '2026-02-01', 28, 1.0::double, 'Fevereiro/2026', 1), ('2026-03', date '2026-03-01', 31, 1.0::double, 'Março/2026', 2),
        ('2026-04', date '2026-04-01', 30, 1.0::double, 'Abril/2026', 3), ('2026-05', date '2026-05-02', 11, 0.35::double, 'Maio/2026', 4)),
    usual as (
        select *, case perfil when 'X' then greatest(taxa * fator, 40.0::double) when 'Y' then least(greatest(taxa * fator, 4.0::double), 6.0::double) else least(greatest(taxa * fator, 3.0::double), 9.0::double) end as usual
        from pares cross join meses_s),
    medias as (
        select *, greatest(usual * case when perfil = 'Z' then 3.0::double + 2.0::double * {_DRAW("burst")} else 1.0::double end * peso, 0.5::double) as media, {_DRAW("demand")} as u, {_DRAW("zero")} as z,
            case when {_uniform("'zeros'", "unidade", "produto", "case when k < 4 then 'true' else 'false' end")} < 0.5 then 2 else 3 end as zeros
        from usual),
    passos as (
        with recursive p(unidade, produto, k, media, u, i, p, c) as (
            select unidade, produto, k, media, u, 0, exp(-media), exp(-media) from medias union all
            select unidade, produto, k, media, u, i + 1, p * media / (i + 1), c + p * media / (i + 1) from p where c < u and i < 200)
        select unidade, produto, k, max(i)::double as q from p group by all),
    demanda as (
        select m.*, case when perfil <> 'Z' then q when case when m.k < 4 then row_number() over (partition by m.unidade, m.produto, m.k < 4 order by z, m.k) <= zeros else z < zeros / 4.0::double end then 0.0::double else greatest(q, 2.0::double) end as demanda,
            floor(usual * case when perfil = 'Z' then 4.0::double else 1.0::double end * 0.79::double) as cota
        from medias m join passos using (unidade, produto, k)),
    ordens as (
        select *, 'Não' as extra, case when cota > 0 then least(cota, demanda) else demanda end as q from demanda union all select *, 'Sim', greatest(demanda - cota, 0.0::double) from demanda),
    sorteio as (
        select *, ['Finalizado', 'Finalizado', 'Finalizado', 'Finalizado', 'Finalizado', 'Finalizado', 'Finalizado', 'Recebimento Confirmado', 'Recebimento Confirmado', 'Enviada', 'Enviada', 'Pendente', 'Aprovado', 'Aguardando Gerente'][1 + floor({_OWN("status")} * 14)::int] as status
        from ordens where q > 0),
    sintetico as (
        select unidade, strftime(de + floor({_OWN("day")} * dias)::int, '%Y-%m-%d') as data_solic, produto, categoria, q, status, extra, mes_ref,
            case when status in ('Finalizado', 'Recebimento Confirmado', 'Enviada') then q else 0.0::double end as env,
            case when status in ('Finalizado', 'Recebimento Confirmado') and {_OWN("receipt")} >= 0.09::double then q else 0.0::double end as rec
        from sorteio)"""
_BODIES |= {
    "synthetic_network": (_NETWORK, "select unidade, round(fator, 6) as fator, produto, categoria, round(taxa, 6) as taxa, perfil from pares"),
    "synthetic_orders": (_SYNTHETIC, "select unidade, data_solic, produto, categoria, q::bigint::varchar as qtd_solic, env::bigint::varchar as qtd_env, rec::bigint::varchar as qtd_rec, status, extra as pedido_extra, mes_ref from sintetico"),
    "calibration_report": (
        f"""{_SYNTHETIC},
    completos as (select *, substr(data_solic, 1, 7) as mes from sintetico where data_solic < '2026-05'),
    grade as (select unidade, produto, mes from (select distinct unidade, produto from completos) cross join (select distinct mes from completos)),
    somas as (select unidade, produto, mes, coalesce(sum(q), 0.0::double) as s from grade left join completos using (unidade, produto, mes) group by all),
    medidas as (select avg(s) as m, stddev_samp(s) as d from somas group by unidade, produto),
    classes as (select case when m < 1 then 'baixa_rot' when d / m < 0.3::double then 'X' when d / m < 0.7::double then 'Y' else 'Z' end as c from medidas where m >= 0.5::double),
    r as (
        select (select count(*) from sintetico) as n_pedidos, (select count(distinct unidade) from sintetico) as n_unidades, (select count(distinct produto) from sintetico) as n_produtos,
            (select sum(q) filter (where extra = 'Sim') / sum(q) from completos) as pct_extra, (select count(*) from classes) as pares_materiais,
            (select avg((c = 'X')::int) from classes) as pct_x, (select avg((c = 'Y')::int) from classes) as pct_y, (select avg((c = 'Z')::int) from classes) as pct_z)""",
        f"""select n_pedidos, n_unidades, n_produtos, {_round("pct_extra")}, pares_materiais, {_round("pct_x", "pct_y", "pct_z")},
            abs(pct_extra - 0.21::double) <= 0.05::double and pares_materiais between 580 and 640 and abs(pct_x - 0.4::double) <= 0.05::double and abs(pct_z - 0.3::double) <= 0.05::double as no_alvo
        from r""",
    ),
    "champion_row": (_BODIES["registry_promotion"][0], f"select * from ({_BODIES['registry_promotion'][1]}) where promovido order by versao desc limit 1"),
}

ORACLES: dict[str, str] = {name: f"with {ctes}\n{body}" for name, (ctes, body) in _BODIES.items()}
