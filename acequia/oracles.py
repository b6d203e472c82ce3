"""The same results as plain SQL over the driver tables, for comparison.

Written for DuckDB, without sharing any code with the Spark side: common table
expressions derive the climate table, its calendar grid, the interpolated
series and the irrigation columns; each query selects from those.
"""

from __future__ import annotations

VARS = ("pressure_hpa", "rh_min", "wind_ms", "temp_c", "rad_j", "precip_mm", "rh")
ROBUST = ("wind_ms", "pressure_hpa", "precip_mm")
IRRIGATION = ("ET0", "ETc", "Pe", "NN", "NB", "ETc_RDC", "NN_RDC", "NB_RDC")

CLIMATE = """climate as (
  select cast(l_suppkey as bigint) as station, cast(l_shipdate as date) as day,
    900e0 + 10e0 * (cast(sum(l_linenumber) as double) / count(*)) as pressure_hpa,
    20e0 + 0.2e0 * (cast(sum(l_partkey % 100) as double) / count(*)) as rh_min,
    0.5e0 + 0.5e0 * (cast(sum(case when l_returnflag <> 'R'
        then cast(round(l_tax * 100) as bigint) end) as double)
      / nullif(count(case when l_returnflag <> 'R' then 1 end), 0)) as wind_ms,
    5e0 + 0.5e0 * (cast(sum(cast(l_quantity as bigint)) as double) / count(*)) as temp_c,
    5e6 + 3e0 * (cast(sum(case when l_returnflag <> 'N'
        then cast(round(l_extendedprice * 100) as bigint) end) as double)
      / nullif(count(case when l_returnflag <> 'N' then 1 end), 0)) as rad_j,
    case when min(l_quantity) <= 10 then 0.5e0 * min(l_quantity) else 0e0 end as precip_mm,
    40e0 + 5e0 * (cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*)) as rh
  from lineitem group by 1, 2)"""

GRID = """span as (select station, min(day) as a, max(day) as b from climate group by station),
days as (select station, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day
  from span),
grid as (select station, day, {vars} from days left join climate using (station, day))""".format(
    vars=", ".join(VARS)
)


def _around() -> str:
    past = "over (partition by station order by day rows between unbounded preceding and current row)"
    ahead = "over (partition by station order by day rows between current row and unbounded following)"
    parts = []
    for v in VARS:
        d = f"case when {v} is not null then day end"
        parts += [
            f"last_value({v} ignore nulls) {past} as pv_{v}",
            f"last_value({d} ignore nulls) {past} as pd_{v}",
            f"first_value({v} ignore nulls) {ahead} as nv_{v}",
            f"first_value({d} ignore nulls) {ahead} as nd_{v}",
        ]
    return ", ".join(parts)


def _line(v: str) -> str:
    return (
        f"case when {v} is not null then {v} when nv_{v} is null then pv_{v} "
        f"else pv_{v} + ((nv_{v} - pv_{v}) / (nd_{v} - pd_{v})) * (day - pd_{v}) end as {v}"
    )


FILLED = f"""around as (select station, day, {", ".join(VARS)}, {_around()} from grid),
filled as (select station, day, {", ".join(_line(v) for v in VARS)} from around)"""

WHOLE = "whole as (select * from filled where {})".format(
    " and ".join(f"{v} is not null" for v in VARS)
)

KC = """case when {d} <= 15 then 0.4e0
  when {d} <= 65 then 0.4e0 + ({d} - 15) / 50e0 * (0.9e0 - 0.4e0)
  when {d} <= 163 then 0.9e0
  when {d} <= 194 then 0.9e0 + ({d} - 163) / 31e0 * (0.65e0 - 0.9e0)
  else 0.65e0 end"""

TERMS = """terms0 as (select *, pressure_hpa * 0.1e0 as p_kpa, rad_j / 1e6 as rs_mj,
    0.6108e0 * exp(17.27e0 * temp_c / (temp_c + 237.3e0)) as es from {source}),
terms1 as (select *, es * rh / 100e0 as ea,
    4098e0 * es / ((temp_c + 237.3e0) * (temp_c + 237.3e0)) as slope,
    0.000665e0 * p_kpa as gamma, 0.77e0 * rs_mj as rn from terms0),
terms as (select *, (0.408e0 * slope * rn + gamma * (900e0 / (temp_c + 273e0)) * wind_ms * (es - ea))
    / (slope + gamma * (1e0 + 0.34e0 * wind_ms)) as et0 from terms1)"""

IRR = """crop as (select *, et0 as "ET0", dayofyear(day) as dia,
    {kc} * et0 as "ETc",
    case when precip_mm > 3 then precip_mm * 0.75e0 else 0e0 end as "Pe" from terms),
net as (select *, case when "ETc" - "Pe" < 0 then 0e0 else "ETc" - "Pe" end as "NN",
    "ETc" * 0.2e0 as "ETc_RDC" from crop),
deficit as (select *, "NN" / 0.95e0 as "NB",
    case when "ETc_RDC" - "Pe" < 0 then 0e0 else "ETc_RDC" - "Pe" end as "NN_RDC" from net),
irr as (select *, "NN_RDC" / 0.95e0 as "NB_RDC" from deficit)""".format(
    kc=KC.format(d="dayofyear(day)")
)

AGRO = TERMS.format(source="filled") + ",\n" + IRR


def _q(name: str) -> str:
    return f'"{name}"'


def _with(body: str, *ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def _natural(v: str, expr: str | None = None) -> str:
    expr = expr or v
    return f"({expr}) / 1e6" if v == "rad_j" else expr


def _single(expr: str) -> str:
    return f"cast(cast({expr} as float) as double)"


def _round(columns=VARS, digits: int | None = None) -> str:
    if digits is None:
        return ", ".join(f"{_single(_natural(c, _q(c)))} as {_q(c)}" for c in columns)
    return ", ".join(f"round({_natural(c, _q(c))}, {digits}) as {_q(c)}" for c in columns)


def _on_climate(body: str) -> str:
    return _with(body, CLIMATE)


def _on_filled(body: str, *more: str) -> str:
    return _with(body, CLIMATE, GRID, FILLED, *more)


def _on_irrigation(body: str) -> str:
    return _with(body, CLIMATE, GRID, FILLED, AGRO)


def _long(source: str, columns=VARS, keep: str = "station, day") -> str:
    return " union all ".join(
        f"select {keep}, '{v}' as variable, {v} as value from {source}" for v in columns
    )


def _scales(source: str) -> str:
    parts = []
    for v in VARS:
        if v in ROBUST:
            center = f"quantile_cont({v}, 0.5)"
            width = f"quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)"
        else:
            center, width = f"avg({v})", f"stddev_pop({v})"
        parts.append(f"{center} as c_{v}, case when ({width}) = 0 then 1e0 else {width} end as s_{v}")
    return f"scales as (select station, {', '.join(parts)} from {source} group by station)"


def _fit_scaler(kind: str) -> str:
    forms = {
        "standard": ("avg({v})", "stddev_pop({v})"),
        "robust": ("quantile_cont({v}, 0.5)", "quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)"),
        "minmax": ("min({v})", "max({v}) - min({v})"),
    }
    center, width = forms[kind]
    selects = []
    for v in VARS:
        c, w = center.format(v=v), width.format(v=v)
        selects.append(
            f"select station, '{v}' as variable, '{kind}' as kind, {_single(_natural(v, c))} as center, "
            f"{_single(f'case when ({w}) = 0 then 1e0 else {_natural(v, w)} end')} as scale "
            f"from climate group by station"
        )
    return _on_climate(" union all ".join(selects))


def _export_sql() -> str:
    return _on_irrigation(
        f"""select 'SARIMA_' || year(day) as sheet, 'sarima_' || year(day) as model, station, day,
        {_round(IRRIGATION)} from irr"""
    )


# first-order models: regression of each difference on the one before
AR = f"""steps as (select station, day, {", ".join(
    f"{v}, {v} - lag({v}) over w as w_{v}" for v in VARS)} from whole
  window w as (partition by station order by day)),
pairs as (select station, day, {", ".join(
    f"{v}, w_{v}, lag(w_{v}) over w as b_{v}" for v in VARS)} from steps
  window w as (partition by station order by day)),
long as ({" union all ".join(
    f"select station, '{v}' as variable, day, {v} as level, w_{v} as w, b_{v} as b from pairs"
    for v in VARS)}),
ar as (select station, variable, coalesce(regr_slope(w, b), 0e0) as phi,
    coalesce(regr_intercept(w, b), avg(case when b is not null then w end)) as intercept,
    cast(regr_count(w, b) as bigint) as n, arg_max(w, day) as last_w,
    arg_max(level, day) as last_level, max(day) as last_day
  from long group by station, variable)"""

BY_UNIT = "case when variable = 'rad_j' then ({x}) / 1e6 else {x} end"

REGISTRY = _on_filled(
    f"""select 'sarima' as model_type, 'sarima_' || variable as name, station, variable as target,
    n, round({BY_UNIT.format(x='intercept')}, 6) as intercept, round(phi, 6) as phi from ar""",
    WHOLE,
    AR,
)

NAMES = """names as (select p_partkey, case p_size % 6 when 0 then 'sarima_' when 1 then 'SARIMAX_'
    when 2 then 'var_' when 3 then 'lstm_' when 4 then 'prophet_' else 'sarimax_' end || replace(p_name, ' ', '_') || '_model'
  as name from part)"""

HEADINGS = (
    ("Presión atmosférica", "pressure_hpa", "robust"),
    ("Humedad relativa mínima", "rh_min", "standard"),
    ("Velocidad del viento", "wind_ms", "robust"),
    ("Temperatura", "temp_c", "standard"),
    ("Radiación solar", "rad_j", "standard"),
    ("Precipitaciones", "precip_mm", "robust"),
    ("Humedad relativa", "rh", "standard"),
)

GRAM_LAGS = 15
GRAM_TERMS = ["const"] + [f"{v}_lag{i}" for i in range(GRAM_LAGS + 1) for v in VARS]


def _gram() -> str:
    scaled = "scaled as (select w.station, w.day, {} from whole w join scales s using (station))".format(
        ", ".join(f"({v} - c_{v}) / s_{v} as {v}" for v in VARS)
    )
    lagged = "lagged as (select station, day, 1e0 as const, {} from scaled window w as (partition by station order by day))".format(
        ", ".join(f"lag({v}, {i}) over w as {v}_lag{i}" for i in range(GRAM_LAGS + 1) for v in VARS)
    )
    pairs = [(a, b) for i, a in enumerate(GRAM_TERMS[: 1 + len(VARS)]) for b in GRAM_TERMS[i:]]
    sums = ", ".join(f"sum({a} * {b}) as g{k}" for k, (a, b) in enumerate(pairs))
    gram = (
        f"gram as (select station, count(*) as n, {sums} from lagged "
        f"where rh_lag{GRAM_LAGS} is not null group by station)"
    )
    items = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'v': g{k}}}" for k, (a, b) in enumerate(pairs))
    return _on_filled(
        f"""select station, x.a as term_a, x.b as term_b, n, round(x.v / n + 3.3e-7, 6) as value
  from (select station, n, unnest([{items}]) as x from gram)""",
        WHOLE,
        _scales("whole"),
        scaled,
        lagged,
        gram,
    )


def _head_tail(source: str, k: int, select: str) -> str:
    return f"""select {select} from (
  select *, 'head' as part, row_number() over (partition by station order by day) as pos from {source}
  union all
  select *, 'tail' as part, row_number() over (partition by station order by day desc) as pos
  from {source}) where pos <= {k}"""


def _record() -> str:
    items = [
        f"""'"{v}":' || coalesce(cast(cast(round({v} * 1000) as bigint) as varchar), 'null')"""
        for v in VARS
    ]
    return "'{' || " + " || ',' || ".join(items) + " || '}'"


def _exog(policy: str, horizon: int = 45) -> str:
    columns = ("pressure_hpa", "rh_min", "wind_ms")
    pick = "e.rn = e.n" if policy == "hold" else "e.rn = case when e.n >= {h} then s.step else e.n end"
    return _on_filled(
        f"""select e.station, cast(s.step as bigint) as step, {_round(columns)}
  from (select *, row_number() over (partition by station order by day) as rn,
      count(*) over (partition by station) as n from whole) e
  join (select unnest(generate_series(1, {horizon})) as step) s on {pick.format(h=horizon)}""",
        WHOLE,
    )


def _ar_forecast() -> str:
    return _on_filled(
        f"""select station, variable, last_day + cast(step as integer) as day,
    cast(step as bigint) as step, round({BY_UNIT.format(x='level')}, 4) as value
  from (select *, last_level + sum(mu + power(phi, step) * (last_w - mu)) over
      (partition by station, variable order by step) as level
    from (select *, intercept / (1e0 - phi) as mu from ar)
    cross join (select unnest(generate_series(1, 45)) as step))""",
        WHOLE,
        AR,
    )


def _difference(v: str) -> str:
    return f"(({v} - lag({v}, 30) over w) - lag({v}, 1) over w) + lag({v}, 31) over w"


def _normal_equations() -> str:
    regressors = ["const"] + [f"{v}_lag{i}" for i in (1, 2) for v in VARS]
    equations = ", ".join(f"('{v}')" for v in VARS)
    names = ", ".join(f"('{x}')" for x in regressors)
    return _on_filled(
        f"""select s.station, e.equation, r.regressor, 0e0 as product
  from (select distinct station from whole) s,
    (values {equations}) e(equation), (values {names}) r(regressor)""",
        WHOLE,
    )


def _lagged(v: str, lag: int) -> str:
    return _single(_natural(v, f"lag({v}, {lag}) over w"))


def _sequences() -> str:
    lags = ", ".join(f"{_lagged(v, 31 - i)} as {v}_{i}" for v in VARS for i in range(1, 31))
    targets = ", ".join(f"{_single(_natural(v))} as target_{v}" for v in VARS)
    return _on_filled(
        f"""select * exclude (rn) from (select station, day, cast(30 as bigint) as length,
    row_number() over w as rn, {targets}, {lags}
    from whole window w as (partition by station order by day))
  where rn > 30""",
        WHOLE,
    )


LOG = """log as (select *, date_trunc('minute', ts) as a, (event_id * 37) % 54000 as seconds,
    case when event_type = 'error' then -value else value end as water from events),
log2 as (select *, date_trunc('minute', a + to_seconds(seconds)) as b from log)"""



def _closed_path(model: str, source: str) -> str:
    """Rows of mean + slope^step * (last - mean) from (station, last_day, last, slope, mean)."""
    return f"""select '{model}' as model, station, 'temp_c' as variable,
    last_day + cast(step as integer) as day, cast(step as bigint) as step,
    round(mean + power(slope, step) * (last - mean), 4) as value
  from {source} cross join (select unnest(generate_series(1, 45)) as step)"""


# one variable: its own series, gap-free from its first reading on
SINGLE = """single as (select station, day, temp_c as y,
    lag(temp_c) over (partition by station order by day) as x from filled where temp_c is not null),
scaled as (select s.station, s.day, (y - m) / w as y, (x - m) / w as x from single s
  join (select station, avg(y) as m, stddev_pop(y) as w from single group by station)
  using (station)),
one as (select station, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
    regr_count(y, x) as t, var_pop(case when x is not null then y end) as v0,
    var_pop(case when x is not null then y end) * (1e0 - regr_r2(y, x)) as v1
  from scaled group by station),
scores as (select station, p, t, p + 1 as free, ln(case p when 0 then v0 else v1 end) as ld
  from one cross join (select unnest([0, 1]) as p)),
best as (select station, arg_min(p, ld + 2e0 / t * free) as best from scores group by station)"""

VAR_PATH = """plain as (select station, regr_slope(y, x) as b, regr_intercept(y, x) as a,
    avg(y) as level, arg_max(y, day) as last, max(day) as last_day from single group by station),
path as (select station, last_day, last, case when best = 1 then b else 0e0 end as slope,
    case when best = 1 then a / (1e0 - b) else level end as mean
  from plain join best using (station))"""

RIDGE_PATH = """bounds as (select station, min(y) as lo, max(y) - min(y) as wide from single group by station),
unit as (select s.station, day, (y - lo) / wide as y, (x - lo) / wide as x from single s
  join bounds using (station)),
fit as (select station, covar_pop(y, x) * regr_count(y, x) / (regr_sxx(y, x) + 1e0) as b,
    avg(case when x is not null then y end) as my, avg(x) as mx,
    arg_max(y, day) as last, max(day) as last_day from unit group by station),
path as (select station, last_day, last * wide + lo as last, b as slope,
    (my - b * mx) / (1e0 - b) * wide + lo as mean from fit join bounds using (station))"""

PAIR = """two as (select station, day, temp_c, rh from filled
  where temp_c is not null and rh is not null),
moves as (select station, day, temp_c, rh, temp_c - lag(temp_c) over w as dt, rh - lag(rh) over w as dr
  from two window w as (partition by station order by day))"""

PAIR_SCORES = """couple as (select station, temp_c as y1, rh as y2, lag(temp_c) over w as x1, lag(rh) over w as x2
  from two window w as (partition by station order by day)),
sizes as (select station, stddev_pop(temp_c) * stddev_pop(rh) as wide from two group by station),
cov as (select station, count(*) as t, var_pop(y1) as a11, covar_pop(y1, y2) as a12, var_pop(y2) as a22,
    var_pop(x1) as b11, covar_pop(x1, x2) as b12, var_pop(x2) as b22, covar_pop(x1, y1) as c11,
    covar_pop(x1, y2) as c12, covar_pop(x2, y1) as c21, covar_pop(x2, y2) as c22
  from couple where x1 is not null group by station),
explained as (select *, b11 * b22 - b12 * b12 as b,
    c11 * (b22 * c11 - b12 * c21) + c21 * (b11 * c21 - b12 * c11) as m11,
    c11 * (b22 * c12 - b12 * c22) + c21 * (b11 * c22 - b12 * c12) as m12,
    c12 * (b22 * c12 - b12 * c22) + c22 * (b11 * c22 - b12 * c12) as m22 from cov),
dets as (select station, t, (a11 * a22 - a12 * a12) / (wide * wide) as d0,
    ((a11 - m11 / b) * (a22 - m22 / b) - (a12 - m12 / b) * (a12 - m12 / b)) / (wide * wide) as d1
  from explained join sizes using (station)),
pair_scores as (select station, p, t, 4 * p + 2 as free, 2 * p + 1 as width,
    ln(case p when 0 then d0 else d1 end) as ld from dets cross join (select unnest([0, 1]) as p)),
pair_best as (select station, arg_min(p, ld + 2e0 / t * free) as best from pair_scores group by station)"""


def _sums(terms: list[str], name: str = "g") -> str:
    """All products of two terms, summed; ``name_i_j`` for i <= j."""
    return ", ".join(
        f"sum({x} * {y}) as {name}_{i}_{j}"
        for i, x in enumerate(terms)
        for j, y in enumerate(terms)
        if i <= j
    )


def _eliminate(name: str, source: str, keys: str, size: int, pivots: int) -> str:
    """Gaussian elimination of the first ``pivots`` terms, a table for each.

    ``name{k}`` has what terms 0..k-1 leave of the products of the rest.
    """
    out, before = [], source
    for k in range(pivots):
        cells = []
        for i in range(size):
            for j in range(i, size):
                left = f"g_{i}_{j} - g_{k}_{i} * g_{k}_{j} / g_{k}_{k}" if i > k else f"g_{i}_{j}"
                cells.append(f"{left} as g_{i}_{j}")
        out.append(f"{name}{k + 1} as (select {keys}, {', '.join(cells)} from {before})")
        before = f"{name}{k + 1}"
    return ",\n".join(out)


def _weights(name: str, source: str, keys: str, terms: int) -> str:
    """Least-squares weights b0.. of the last term on the others, by substituting back."""
    out, before = [], source
    for k in reversed(range(terms)):
        rest = "".join(f" - g_{k}_{j} * b{j}" for j in range(k + 1, terms))
        out.append(f"{name}{k} as (select *, (g_{k}_{terms}{rest}) / g_{k}_{k} as b{k} from {before})")
        before = f"{name}{k}"
    return ",\n".join(out)


def _start_values() -> str:
    """Two regressions: on a sparse set of lags, then on lags of the series and of its residuals."""
    long_lags = [1, 2, 3, 30, 31, 32, 60, 61, 62]
    own = "over (partition by station, variable order by day)"
    terms = ["1e0", *[f"l{i}" for i in long_lags], "w"]
    lags = ", ".join(f"lag(w, {i}) {own} as l{i}" for i in long_lags)
    known = " - ".join(["w - b0", *[f"b{k + 1} * l{i}" for k, i in enumerate(long_lags)]])
    back = ", ".join(f"lag(e, {i}) {own} as e{i}" for i in (1, 30, 31))
    short = ["1e0", "l1", "l30", "l31", "e1", "e30", "e31", "w"]
    keys = "station, variable"
    return _on_filled(
        """select station, variable, round(b1 + 3.3e-6, 5) as phi, round(b4 + 3.3e-6, 5) as theta,
    round(b2 + 3.3e-6, 5) as sphi, round(b5 + 3.3e-6, 5) as stheta from second0""",
        WHOLE,
        "steps30 as (select station, day, {} from whole window w as (partition by station order by day))".format(
            ", ".join(f"{_natural(v, _difference(v))} as {v}" for v in VARS)
        ),
        f"series as (select * from ({_long('steps30')}) where value is not null)",
        f"lagged as (select station, variable, day, value as w, {lags.replace('lag(w,', 'lag(value,')} from series)",
        f"sums1 as (select {keys}, {_sums(terms)} from lagged where l62 is not null group by {keys})",
        _eliminate("first_", "sums1", keys, len(terms), len(terms) - 1),
        _weights("first", f"first_{len(terms) - 1}", keys, len(terms) - 1),
        f"errors as (select l.*, {known} as e from lagged l join first0 using ({keys}) where l62 is not null)",
        f"pairs as (select *, {back} from errors)",
        f"sums2 as (select {keys}, {_sums(short)} from pairs where e31 is not null group by {keys})",
        _eliminate("second_", "sums2", keys, len(short), len(short) - 1),
        _weights("second", f"second_{len(short) - 1}", keys, len(short) - 1),
    )


def _nested_selection() -> str:
    """Orders 0 to 3 of two variables: what the constant and each further lag leave of today's products."""
    own = "over (partition by station order by day)"
    terms = ["1e0", *[f"{v}{i}" for i in (1, 2, 3) for v in ("a", "b")], "a0", "b0"]
    lagged = ", ".join(f"lag({v}, {i}) {own} as {v}{i}" for i in (1, 2, 3) for v in ("a", "b"))
    det = "g_7_7 * g_8_8 - g_7_8 * g_7_8"
    scores = " union all ".join(
        f"select station, {p} as p, t, {4 * p + 2} as free, {2 * p + 1} as width, "
        f"ln(({det}) / (cast(t as double) * t)) as ld from left_{2 * p + 1} join many using (station)"
        for p in range(4)
    )
    return _on_filled(
        """select station, cast(p as bigint) as p, round(ld + 2e0 / t * free + 3.3e-6, 5) as aic,
    round(ld + ln(t) / t * free + 3.3e-6, 5) as bic, round(ld + 2e0 * ln(ln(t)) / t * free + 3.3e-6, 5) as hqic,
    round(power((t + width) / cast(t - width as double), 2) * exp(ld) + 3.3e-6, 5) as fpe, p = best as chosen
  from scores join (select station, arg_min(p, ld + 2e0 / t * free) as best from scores group by station)
    using (station)""",
        """two as (select station, day, (temp_c - avg(temp_c) over s) / stddev_pop(temp_c) over s as a,
    (rh - avg(rh) over s) / stddev_pop(rh) over s as b
  from filled where temp_c is not null and rh is not null window s as (partition by station))""",
        f"couple as (select station, a as a0, b as b0, {lagged} from two)",
        f"sums as (select station, {_sums(terms)} from couple where a3 is not null group by station)",
        "many as (select station, count(*) as t from couple where a3 is not null group by station)",
        _eliminate("left_", "sums", "station", len(terms), 7),
        f"scores as ({scores})",
    )


def _seasonal_fixed(model: str, policy: str = "hold") -> str:
    """Errors of the whole history day by day, then 45 days ahead, at orders (1,1,1)(1,1,1,30)."""
    phi, theta, sphi, stheta = 0.4, -0.5, 0.2, -0.6
    exog = model == "sarimax"
    const = 0.0 if exog else 0.01

    def level(v: str, source: str = "") -> str:
        """Scaled level of a target, less its regressors' share."""
        z = f"({source}{v} - c_{v}) / s_{v}"
        if not exog:
            return z
        others = [o for o in VARS if o != v]
        share = " - ".join(f"{0.1 * (j + 1)!r}e0 * ({source}{o} - c_{o}) / s_{o}" for j, o in enumerate(others))
        return f"{z} - {share}"

    def shift(v: str) -> str:
        """What the regressors add on a day ahead."""
        others = [o for o in VARS if o != v]
        return " + ".join(f"{0.1 * (j + 1)!r}e0 * (f.{o} - c_{o}) / s_{o}" for j, o in enumerate(others))

    levels = " union all ".join(
        f"select station, day, '{v}' as variable, {level(v)} as value from whole join scales using (station)" for v in VARS
    )
    own = "over (partition by station, variable order by day)"
    w = f"value - lag(value, 1) {own} - lag(value, 30) {own} + lag(value, 31) {own}"
    auto = f"w - {const}e0 - {phi}e0 * lag(w, 1) {own} - {sphi}e0 * lag(w, 30) {own} + {phi * sphi!r}e0 * lag(w, 31) {own}"
    # State lists are oldest first: place 31 is yesterday, 2 a season ago, 1 the day before that.
    error = f"x[1] - {theta}e0 * e[31] - {stheta}e0 * e[2] - {theta * stheta!r}e0 * e[1]"
    ahead = (
        f"{const}e0 + {phi}e0 * w[31] + {sphi}e0 * w[2] - {phi * sphi!r}e0 * w[1]"
        f" + {theta}e0 * e[31] + {stheta}e0 * e[2] + {theta * stheta!r}e0 * e[1]"
    )
    future = (
        "select station, unnest(range(1, 46)) as step, * exclude (station) from (select * from whole "
        "qualify row_number() over (partition by station order by day desc) = 1)"
    )
    if policy == "head":
        future = (
            "select row_number() over (partition by station order by day) as step, * from whole "
            "qualify step <= 45"
        )
    parts = []
    for v in VARS:
        value = f"(y[31] + {shift(v)}) * s_{v} + c_{v}" if exog else f"y[31] * s_{v} + c_{v}"
        joined = " join future f using (station, step)" if exog else ""
        parts.append(
            f"select p.station, p.variable, p.step, p.last_day, {_natural(v, value)} as value "
            f"from path p join scales using (station){joined} where p.variable = '{v}' and p.step > 0"
        )
    return _on_filled(
        f"""select '{model}' as model, station, variable, last_day + cast(step as integer) as day,
    cast(step as bigint) as step, round(value + 3.3e-5, 4) as value, cast(null as varchar) as error
  from ({" union all ".join(parts)})""",
        WHOLE,
        _scales("whole"),
        f"levels as ({levels})",
        f"steps as (select *, {w} as w from levels)",
        f"known as (select *, {auto} as a from steps where w is not null)",
        f"""ends as (select station, variable, max(day) as last_day,
    list_reduce(list_prepend(list_resize(cast([] as double[]), 31, 0e0), list([a] order by day) filter (a is not null)),
      lambda e, x: list_append(e[2:], {error})) as e,
    list(w order by day)[-31:] as w from known group by station, variable)""",
        "tails as (select station, variable, list(value order by day)[-31:] as y from levels group by station, variable)",
        f"future as ({future})",
        f"""path as (select 0 as step, station, variable, last_day, e, w, y from ends join tails using (station, variable)
  union all
  select step + 1, station, variable, last_day, list_append(e[2:], 0e0), list_append(w[2:], next),
    list_append(y[2:], next + y[31] + y[2] - y[1])
  from (select *, {ahead} as next from path where step < 45))""",
    ).replace("with ", "with recursive ", 1)


def _fixed(model: str, p: int, scales: str, center: str, width: str) -> str:
    """Every variable's last ``p`` scaled days as a list, fed back 45 times."""
    after = dict(zip(VARS, (*VARS[1:], VARS[0])))
    last = ", ".join(
        f"list((w.{v} - {center.format(v=v)}) / {width.format(v=v)} order by day) as {v}" for v in VARS
    )
    step = ", ".join(
        f"list_append({v}[2:], 0.05e0 + 0.6e0 * {v}[{p}] + 0.2e0 * {v}[1] + 0.1e0 * {after[v]}[{p}]) as {v}"
        for v in VARS
    )
    rows = " union all ".join(
        f"select station, '{v}' as variable, step, last_day, "
        f"{_natural(v, f'{v}[{p}] * {width.format(v=v)} + {center.format(v=v)}')} as value "
        f"from path join scales using (station)"
        for v in VARS
    )
    body = f"""select '{model}' as model, station, variable, last_day + cast(step as integer) as day,
    cast(step as bigint) as step, round(value + 3.3e-5, 4) as value, cast(null as varchar) as error
  from ({rows}) where step > 0"""
    recent = f"""recent as (select station, max(day) as last_day, {last}
  from (select *, row_number() over (partition by station order by day desc) as rn from whole) w
  join scales using (station) where rn <= {p} group by station)"""
    path = f"""path as (select 0 as step, * from recent
  union all select step + 1, station, last_day, {step} from path where step < 45)"""
    return _on_filled(body, WHOLE, scales, recent, path).replace("with ", "with recursive ", 1)


RANGES = "scales as (select station, {} from whole group by station)".format(
    ", ".join(
        f"min({v}) as c_{v}, case when max({v}) = min({v}) then 1e0 else max({v}) - min({v}) end as s_{v}"
        for v in VARS
    )
)

DRIFT = """drift as (select station, variable, last_day + cast(step as integer) as day,
    cast(step as bigint) as step, last_level + step * mean as value
  from (select station, variable, max(day) as last_day, arg_max(level, day) as last_level, avg(w) as mean
    from ({}) group by station, variable)
  cross join (select unnest(generate_series(1, 45)) as step))""".format(
    " union all ".join(
        f"select station, '{v}' as variable, day, {v} as level, "
        f"{v} - lag({v}) over (partition by station order by day) as w from whole"
        for v in VARS
    )
)

ORACLES = {
    "sarima_plain_fit": _on_filled(
        f"""select a.station, a.variable, a.n, round(phi, 4) as phi,
    round({BY_UNIT.format(x='intercept').replace('variable', 'a.variable')}, 4) as intercept,
    round(variance / case when a.variable = 'rad_j' then 1e12 else 1e0 end, 4) as variance
  from ar a join (select station, variable,
      (regr_syy(w, b) - coalesce(regr_sxy(w, b) * regr_slope(w, b), 0e0)) / regr_count(w, b) as variance
    from long group by station, variable) v using (station, variable)""",
        WHOLE,
        AR,
    ),
    "sarima_plain_forecast": _ar_forecast()
    .replace("select station, variable, last_day", "select 'sarima' as model, station, variable, last_day", 1),
    "sarimax_plain_fit": _on_filled(
        """select station, 'temp_c' as variable, count(dt) as n,
    round(sum(dt * dr) / sum(dr * dr), 4) as slope from moves group by station
  union all select station, 'rh', count(dt), round(sum(dt * dr) / sum(dt * dt), 4)
  from moves group by station""",
        PAIR,
    ),
    "sarimax_plain_forecast": _on_filled(
        """select 'sarimax' as model, station, variable, last_day + cast(step as integer) as day,
    cast(step as bigint) as step,
    round(last_y + case when n < 45 then 0e0 else slope * (x - last_x) end, 4) as value
  from ends join ahead using (station, variable)""",
        PAIR,
        """sides as (select station, 'temp_c' as variable, day, temp_c as y, rh as x, dt as dy, dr as dx from moves
  union all select station, 'rh', day, rh, temp_c, dr, dt from moves),
ends as (select station, variable, max(day) as last_day, arg_max(y, day) as last_y,
    arg_max(x, day) as last_x, sum(dy * dx) / sum(dx * dx) as slope, count(*) as n
  from sides group by station, variable),
placed as (select station, variable, x, row_number() over (partition by station, variable order by day) as step
  from sides),
ahead as (select station, variable, step, x from (select distinct station, variable from sides)
  cross join (select unnest(generate_series(1, 45)) as step) left join placed using (station, variable, step))""",
    ),
    "var_single_selection": _on_filled(
        """select station, cast(p as bigint) as p, round(ld + 2e0 / t * free, 5) as aic,
    round(ld + ln(t) / t * free, 5) as bic, round(ld + 2e0 * ln(ln(t)) / t * free, 5) as hqic,
    round((t + free) / cast(t - free as double) * exp(ld), 5) as fpe, p = best as chosen
  from scores join best using (station)""",
        SINGLE,
    ),
    "var_single_forecast": _on_filled(_closed_path("var", "path"), SINGLE, VAR_PATH),
    "window_single_forecast": _on_filled(_closed_path("window", "path"), SINGLE, RIDGE_PATH),
    "csv_roundtrip": _on_climate(f"select station, day, {_round()} from climate"),
    "detect_date_column": _on_climate(
        f"select station, day, 'FECHA_registro' as date_column, {_round()} from climate"
    ),
    "union_years": _on_climate(f"select station, day, {_round()} from climate"),
    "union_mixed_headings": _on_climate(
        f"""select station, day, {_round()}, case when station % 3 = 2
    then cast(cast(temp_c / 2 as float) as double) end as "Humedad del suelo" from climate"""
    ),
    "dataset_profile": _on_climate(
        """select folder, size as has_size, columns, rows, rows > 365 as recommended, message from (
    select 'lower' as folder, true as size, '["station","Fecha","temp_c"]' as columns,
      count(*) filter (station % 2 = 0) as rows, cast(null as varchar) as message from climate
    union all select 'upper', true, '["station","Fecha","temp_c"]', count(*) filter (station % 2 = 1), null from climate
    union all select 'quoted', true, '["station","Fecha","Temperatura, media \\"2 m\\""]', count(*), null from climate
    union all select 'hollow', false, null, 0, 'empty file'
    union all select 'undated', true, '["station","temp_c"]', count(*), 'no date column' from climate)"""
    ),
    "union_tagged": _on_climate(
        """select 'mini_1' as probe, station, day, cast(cast(temp_c as float) as double) as temp_c,
    cast(cast(rh as float) as double) as rh, cast(null as double) as wind_ms from climate
  union all select 'mini_2', station, day, cast(cast(temp_c as float) as double),
    cast(null as double), cast(cast(wind_ms as float) as double) from climate"""
    ),
    "parse_irrigation_log": _with(
        """select cast(user_id % 4 + 1 as bigint) as program,
    'PROGRAMA0' || (user_id % 4 + 1) as program_name, cast(event_id % 6 as bigint) as activation,
    strftime(a, '%Y-%m-%d %H:%M:%S') as started_at, strftime(b, '%Y-%m-%d %H:%M:%S') as ended_at,
    cast(seconds as bigint) as duration_s, water as water_m3,
    value as fertiliser_1_l, 0e0 as fertiliser_2_l, 0e0 as fertiliser_3_l, 0e0 as fertiliser_4_l,
    case when event_type = 'signup' then 'Forzada' else 'Horario' end as kind,
    cast(user_id % 4 + 1 as bigint) as sector, water < 0 as negative_water,
    b < a as ends_before_start, abs(date_diff('second', a, b) - seconds) > 60 as duration_mismatch
  from log2""",
        LOG,
    ),
    "dataset_rows": _on_climate(
        "select 'year=' || year(day) as folder, 'station,Fecha,{}' as columns, count(*) as n_rows "
        "from climate group by 1, 2".format(",".join(h for h, _, _ in HEADINGS))
    ),
    "dataset_recommended": _on_climate(
        "select station, count(*) as n_rows, count(*) > 365 as recommended from climate group by station"
    ),
    "export_json": _export_sql(),
    "export_csv": _export_sql(),
    "export_parquet": _export_sql(),
    "registry_save": REGISTRY,
    "registry_load": REGISTRY,
    "registry_types": _with(
        """select distinct case when lower(name) like 'sarima\\_%' escape '\\' then 'sarima'
    when lower(name) like 'var\\_%' escape '\\' then 'var'
    when lower(name) like 'sarimax\\_%' escape '\\' then 'sarimax' else 'lstm' end as model_type
  from names where lower(name) not like 'prophet%'""",
        NAMES,
    ),
    "unpivot_climate": _on_climate(
        f"select station, day, variable, {_single(BY_UNIT.format(x='value'))} as value "
        f"from ({_long('climate')})"
    ),
    "exog_select": _on_climate(
        "select station, day, {} as target, {}, {} from climate".format(
            _single("temp_c"),
            ", ".join(f"{_single(v)} as first_{v}" for v in VARS[:3]),
            ", ".join(f"{_single(_natural(v))} as all_{v}" for v in VARS if v != "temp_c"),
        )
    ),
    "canonical_names": _on_climate(f"select station, day, {_round()} from climate"),
    "scaler_routing": _on_climate(
        " union all ".join(
            f"select '{h}' as heading, '{kind}' as scaler, count({v}) as n from climate"
            for h, v, kind in HEADINGS
        )
    ),
    "model_family": _with(
        """select p_partkey, replace(name, '_model', '') as bare,
    case when starts_with(name, 'sarima_') then 'sarima'
      when starts_with(name, 'sarimax_') then 'sarimax' else replace(name, '_model', '') end as family,
    upper(substr(name, 1, 31)) as sheet from names""",
        NAMES,
    ),
    "chart_variables": _on_irrigation(
        " union all ".join(
            f"""select station, day, '{p}' as panel, {_single(_q(p))} as value from irr"""
            for p in ("temp_c", "rh", "precip_mm", "ETc")
        )
    ),
    "chart_irrigation": _on_irrigation(f"select station, day, {_round(('NB',))} from irr"),
    "calendar_fields": _on_climate(
        "select station, day, cast(dayofyear(day) as bigint) as dia, "
        "strftime(day, '%Y-%m-%d') as label from climate"
    ),
    "calendar_grid": _with(f"select station, day, {_round()} from grid", CLIMATE, GRID),
    "unify_forecasts": _on_climate(
        f"select 'sarima' as model, station, day, {_round()} from climate "
        "where wind_ms is not null and rad_j is not null"
    ),
    "forecast_gaps": _on_climate(
        """select 'sarima' as model, station, day,
    concat_ws(',', case when wind_ms is null then 'wind_ms' end,
      case when rad_j is null then 'rad_j' end) as missing
  from climate where wind_ms is null or rad_j is null"""
    ),
    "scale_apply": _on_filled(
        "select w.station, w.day, {} from whole w join scales s using (station)".format(
            ", ".join(
                (
                    _single(f"round(({v} - c_{v}) / s_{v}, 9)")
                    if v in ROBUST
                    else f"round(({v} - c_{v}) / s_{v}, 4)"
                )
                + f" as {v}"
                for v in VARS
            )
        ),
        WHOLE,
        _scales("whole"),
    ),
    "scale_inverse": _on_filled(
        "select station, day, {} from whole".format(", ".join(f"0e0 as off_{v}" for v in VARS)),
        WHOLE,
    ),
    "series_summary": _on_climate(
        """select station, count(*) as n_rows, cast(7 as bigint) as n_columns,
    strftime(min(day), '%Y-%m-%d') as first_day, strftime(max(day), '%Y-%m-%d') as last_day,
    'pressure_hpa, rh_min, wind_ms, temp_c, rad_j' as columns from climate group by station"""
    ),
    "fit_standard": _fit_scaler("standard"),
    "fit_robust": _fit_scaler("robust"),
    "fit_minmax": _fit_scaler("minmax"),
    "irrigation_totals": _on_irrigation(
        """select station, count(*) as days, round(sum("NB"), 4) as total_nb,
    round(sum("NB_RDC"), 4) as total_nb_rdc, round(avg("NB_RDC"), 4) as mean_nb_rdc
  from irr group by station"""
    ),
    "var_gram": _gram(),
    "interpolate_time": _on_filled(f"select station, day, {_round()} from filled"),
    "complete_series": _on_filled(f"select station, day, {_round()} from filled"),
    "temporal_split": _on_climate(
        f"""select station, day, case when row_number() over (partition by station order by day desc)
    <= 180 then 'test' else 'train' end as part, {_round()} from climate"""
    ),
    "split_bounds": _on_climate(
        """select station, n, cast(floor(n * 0.2e0 + 0.5e0) as bigint) as default_test,
    cast(floor(n * 0.1e0 + 0.5e0) as bigint) as min_test,
    cast(floor(n * 0.5e0 + 0.5e0) as bigint) as max_test,
    round((n - floor(n * 0.2e0 + 0.5e0)) / n * 100e0, 4) as train_pct
  from (select station, count(*) as n from climate group by station)"""
    ),
    "sliding_sequences": _sequences(),
    "last_k_state": _on_filled(
        f"""select station, last_day, 15 - rn as pos, day, {_round()}
  from (select *, row_number() over (partition by station order by day desc) as rn,
      max(day) over (partition by station) as last_day from whole) where rn <= 15""",
        WHOLE,
    ),
    "window_shift": _on_filled(
        f"""select station, 29 - rn as pos, {", ".join(f"{_single(v)} as {v}" for v in VARS)}
  from (select *, row_number() over (partition by station order by day desc) as rn from whole)
  where rn <= 29
  union all select distinct station, cast(29 as bigint), {", ".join("1.5e0" for _ in VARS)} from whole""",
        WHOLE,
    ),
    "seasonal_difference": _on_filled(
        "select station, day, {} from whole window w as (partition by station order by day)".format(
            ", ".join(f"{_single(_natural(v, _difference(v)))} as {v}" for v in VARS)
        ),
        WHOLE,
    ),
    "lag_matrix": _on_filled(
        "select station, day, {}, {} from whole "
        "window w as (partition by station order by day)".format(
            _round(),
            ", ".join(f"{_lagged(v, i)} as {v}_lag{i}" for v in VARS for i in range(1, 16)),
        ),
        WHOLE,
    ),
    "integrate_forecast": _on_filled(
        "select station, day, {}".format(
            ", ".join(f"{_single(f'round({_natural(v)}, 9)')} as {v}" for v in VARS)
        )
        + """ from (select *, row_number() over (partition by station order by day desc) as rn from whole)
  where rn <= 45""",
        WHOLE,
    ),
    "preview_head_tail": _on_climate(
        _head_tail(
            "climate", 3, f"station, part, pos, strftime(day, '%Y-%m-%d') as label, {_record()} as record"
        )
    ),
    "results_head_tail": _on_irrigation(
        _head_tail("irr", 5, f"station, day, part, pos, {_round(IRRIGATION, 3)}")
    ),
    "et0_terms": _with(
        "select station, day, {} from terms".format(
            _round(("p_kpa", "rs_mj", "es", "ea", "slope", "gamma", "rn", "et0"))
        ),
        CLIMATE,
        TERMS.format(source="climate"),
    ),
    "et0_daily": _on_filled(
        f"select station, day, {_round(('et0',))} from terms", TERMS.format(source="filled")
    ),
    "kc_curve": _on_climate(
        "select station, day, cast(dayofyear(day) as bigint) as dia, {} as kc "
        "from climate".format(_single(KC.format(d="dayofyear(day)")))
    ),
    "etc_daily": _on_irrigation(f"select station, day, {_round(('ETc',))} from irr"),
    "effective_rain": _on_irrigation(f"select station, day, {_round(('precip_mm', 'Pe'))} from irr"),
    "net_need": _on_irrigation(f"select station, day, {_round(('ETc', 'Pe', 'NN'))} from irr"),
    "irrigation_daily": _on_irrigation(
        f"select station, day, cast(dia as bigint) as dia, {_round(IRRIGATION)} from irr"
    ),
    "deficit_irrigation": _on_irrigation(
        f"select station, day, {_round(('ETc_RDC', 'NN_RDC', 'NB_RDC'))} from irr"
    ),
    "exog_future": _exog("hold"),
    "exog_future_head": _exog("head"),
    "future_days": _on_climate(
        """select station, last_day, step, last_day + cast(step as integer) as day
  from (select station, last_day, unnest(generate_series(1, asked)) as step
    from (select station, max(day) as last_day, count(*) as asked from climate group by station))"""
    ),
    "sarima_ar_fit": _on_filled(
        f"select station, variable, round(phi, 6) as phi, "
        f"round({BY_UNIT.format(x='intercept')}, 6) as intercept, n from ar",
        WHOLE,
        AR,
    ),
    "sarima_ar_forecast": _ar_forecast(),
    "exog_regression": _on_filled(
        """select station, regressor, round(regr_slope(temp_c, x), 6) as slope,
    round(regr_intercept(temp_c, x), 6) as intercept, cast(regr_count(temp_c, x) as bigint) as n
  from ({}) group by station, regressor""".format(
            " union all ".join(
                f"select station, '{v}' as regressor, w_temp_c as temp_c, "
                f"{_natural(v, f'w_{v}')} as x from pairs"
                for v in VARS
                if v != "temp_c"
            )
        ),
        WHOLE,
        AR,
    ),
    "var_normal_equations": _normal_equations(),
    "forecast_keys": _on_filled(
        "select 'var' as model, station, variable, last_day + cast(step as integer) as day, step "
        "from (select station, max(day) as last_day from whole group by station) "
        "cross join (values {}) v(variable) "
        "cross join (select unnest(generate_series(1, 45)) as step)".format(
            ", ".join(f"('{v}')" for v in VARS)
        ),
        WHOLE,
    ),
    "var_pair_selection": _on_filled(
        """select station, cast(p as bigint) as p, round(ld + 2e0 / t * free + 3.3e-6, 5) as aic,
    round(ld + ln(t) / t * free + 3.3e-6, 5) as bic, round(ld + 2e0 * ln(ln(t)) / t * free + 3.3e-6, 5) as hqic,
    round(power((t + width) / cast(t - width as double), 2) * exp(ld) + 3.3e-6, 5) as fpe, p = best as chosen
  from pair_scores join pair_best using (station)""",
        PAIR,
        PAIR_SCORES,
    ),
    "var_fixed_forecast": _fixed("var", 2, _scales("whole"), "c_{v}", "s_{v}"),
    "window_fixed_forecast": _fixed("window", 30, RANGES, "c_{v}", "s_{v}"),
    "train_drift": _on_filled(
        """select 'sarima' as model_type, case when station = 1 then 'series too short: at least 3 days needed'
    else '' end as error, 7 * count(*) as models
  from (select distinct station from climate) group by 1, 2""",
    ),
    "predict_drift": _on_filled(
        f"""select 'run' as run_id, 'sarima' as model, station, variable, day, step,
    round({BY_UNIT.format(x='value')} + 3.3e-5, 4) as value, cast(null as varchar) as error from drift""",
        WHOLE,
        DRIFT,
    ),
    "irrigation_drift": _on_filled(
        """select 'run' as run_id, 'sarima' as model, station, count(*) as days, cast(null as varchar) as error,
    round(sum("NB"), 3) as total_nb, round(sum("NB_RDC"), 3) as total_nb_rdc,
    round(avg("NB_RDC"), 3) as mean_nb_rdc from irr group by station""",
        WHOLE,
        DRIFT,
        "paths as (select station, day, {} from drift group by station, day)".format(
            ", ".join(f"max(case when variable = '{v}' then value end) as {v}" for v in VARS)
        ),
        TERMS.format(source="paths") + ",\n" + IRR,
    ),
    "predict_gaps": _on_filled(
        """select 'run' as run_id, 'sarima' as model, station,
    case when station = 1 or stale or late then 'no forecast of ' ||
        case when station = 1 or stale then '{all}' else 'rh' end ||
        case when station = 1 then '; not trained: series too short: at least 3 days needed'
             when stale then '; no history for this station' else '' end
      else '' end as error,
    case when station = 1 or stale or late then cast(0 as bigint) else 45 end as days
  from (select station, max(b) over () - b > 5 as stale, a - min(a) over () > 5 as late from span)""".replace(
            "{all}", ", ".join(VARS)
        ),
    ),
    "sarima_seasonal_ar_fit": _on_filled(
        """select station, variable, count(b) as n, round(regr_slope(w, b), 4) as phi, cast(null as varchar) as error
  from long30 group by station, variable""",
        WHOLE,
        "steps30 as (select station, day, {} from whole window w as (partition by station order by day))".format(
            ", ".join(f"{v} - lag({v}, 30) over w as w_{v}, lag({v}, 30) over w - lag({v}, 60) over w as b_{v}" for v in VARS)
        ),
        "long30 as ({})".format(
            " union all ".join(f"select station, '{v}' as variable, w_{v} as w, b_{v} as b from steps30" for v in VARS)
        ),
    ),
    "sarima_optimal": _on_filled(
        "select station, variable, true as optimal from (select distinct station from whole) "
        "cross join (values {}) v(variable)".format(", ".join(f"('{v}')" for v in VARS)),
        WHOLE,
    ),
    "sarimax_optimal": _on_filled(
        "select station, variable, true as optimal from (select distinct station from whole) "
        "cross join (values {}) v(variable)".format(", ".join(f"('{v}')" for v in VARS)),
        WHOLE,
    ),
    "sarima_start_values": _start_values(),
    "sarima_fixed_forecast": _seasonal_fixed("sarima"),
    "sarimax_fixed_forecast": _seasonal_fixed("sarimax"),
    "sarimax_fixed_forecast_head": _seasonal_fixed("sarimax", "head"),
    "var_nested_selection": _nested_selection(),
    "window_normal_equations": _on_filled(
        """select s.station, cast(place as bigint) as place, equation, 0e0 as product
  from (select distinct station from whole) s, (select unnest(range(0, 211)) as place),
    (values {}) e(equation)""".format(", ".join(f"('{v}')" for v in VARS)),
        WHOLE,
    ),
    "own_family_forecast": _on_filled(
        """select 'phase_mean' as model, station, variable,
    case when station = 1 then '' else strftime(last_day + cast(step as integer), '%Y-%m-%d') end as day,
    case when station = 1 then cast(0 as bigint) else cast(step as bigint) end as step,
    case when station <> 1 then round({x} + 3.3e-5, 4) end as value,
    case when station = 1 then 'not trained: ValueError: series too short: at least 7 days needed' else '' end as error
  from phases join (select unnest(range(1, 46)) as step) on (phase + step) % 7 = 0
  where station <> 1 or step = 1""".replace("{x}", BY_UNIT.format(x="value")),
        WHOLE,
        """numbered as (select *, (row_number() over (partition by station order by day desc) - 1) % 7 as phase,
    max(day) over (partition by station) as last_day from whole)""",
        "phases as (select station, variable, phase, last_day, avg(value) as value from ({}) group by 1, 2, 3, 4)".format(
            _long("numbered", keep="station, phase, last_day")
        ),
    ),
    "registry_saved_types": "select unnest(['sarima', 'var', 'window']) as model_type",
}
