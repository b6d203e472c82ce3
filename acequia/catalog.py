"""Named queries: every operator run over the whole driver tables.

Each takes (spark, sf_dir) and returns a DataFrame. So that another engine can
be compared, values both engines compute alike are cut to single precision
(decimal rounding treats ties differently), and values that depend on the order
of a sum are rounded to some decimals. Radiation is reported in MJ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from acequia.functions import agronomy, naming
from acequia.functions.arrays import difference, shift_append
from acequia.models import ar, family, sarima, var
from acequia.models.batches import chunks
from acequia.operators import calendar, reports, scaling, series
from acequia.operators.packs import observed_pack, observed_series
from acequia.plans.predict import forecast_irrigation, history_pack, predict_all, publish
from acequia.plans.train import beside_pack, spread_pack, train_all, training_pack
from acequia.schema import DAY, KEY, SCALER_KINDS, SPANISH_NAMES, VARIABLES, TrainConfig
from acequia.session import materialize, scratch_path
from acequia.sources import climate_csv, export, irrigation_log, profile, registry
from acequia.sources.tables import climate, irrigation_log_text, table

HORIZON = 45
IRRIGATION = ("ET0", "ETc", "Pe", "NN", "NB", "ETc_RDC", "NN_RDC", "NB_RDC")


def r(c: str | Column, digits: int | None = None) -> Column:
    """Single precision, or rounded to ``digits`` decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("float").cast("double") if digits is None else F.round(c, digits)


def untied(c: Column, digits: int) -> Column:
    """Rounded a third of a unit off, so that values on a tie fall the same way in any engine."""
    return F.round(c + F.lit(float(f"3.3e-{digits + 1}")), digits)


def natural(c: str) -> Column:
    """Radiation in MJ, everything else as it is."""
    return F.col(c) / F.lit(1e6) if c == "rad_j" else F.col(c)


def rounded(df: DataFrame, *keep: str, columns=VARIABLES, digits: int | None = None) -> DataFrame:
    return df.select(*keep, *[r(natural(c), digits).alias(c) for c in columns])


def by_unit(value: str, variable: str = "variable") -> Column:
    return F.when(F.col(variable) == "rad_j", F.col(value) / F.lit(1e6)).otherwise(F.col(value))


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.complete_series(climate(spark, sf_dir))


def gap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.whole_series(climate(spark, sf_dir))


def packed_climate(spark: SparkSession, sf_dir: str, columns=VARIABLES) -> DataFrame:
    """Climate packed once, for training and history alike."""
    return observed_series(climate(spark, sf_dir), columns)


def daily_irrigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agronomy.with_irrigation(completed(spark, sf_dir))


# --- sources and sinks ----------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "climate-csv")
    climate_csv.write_climate_csv(climate(spark, sf_dir), path)
    return rounded(climate_csv.read_climate_csv(spark, path), KEY, DAY)


def detect_date_column(spark, sf_dir):
    path = scratch_path(spark, "dated-csv")
    climate_csv.write_climate_csv(climate(spark, sf_dir), path, "FECHA_registro")
    headings = climate_csv.csv_headings(spark, path)
    rows = climate_csv.read_climate_csv(spark, path, headings)
    return rounded(
        rows.withColumn("date_column", F.lit(naming.date_column(headings))), KEY, DAY, "date_column"
    )


def _year_folders(spark, sf_dir) -> str:
    """Climate written as one folder per year."""
    path = scratch_path(spark, "yearly-csv")
    climate_csv.write_climate_csv(climate(spark, sf_dir), path, year_files=True)
    return path


def union_years(spark, sf_dir):
    return rounded(climate_csv.read_climate_csv(spark, _year_folders(spark, sf_dir)), KEY, DAY)


def union_mixed_headings(spark, sf_dir):
    """Files with columns in other orders, one of them with a column that others lack."""
    rows = naming.spanish_names(climate(spark, sf_dir)).withColumnRenamed(DAY, "Fecha")
    path = scratch_path(spark, "mixed-csv")
    odd = F.col(KEY) % 3
    for part, columns in enumerate(
        (
            rows.columns,
            list(reversed(rows.columns)),
            ["Humedad del suelo", *sorted(rows.columns)],
        )
    ):
        own = rows.filter(odd == part).withColumn("Humedad del suelo", F.col("Temperatura") / 2)
        own.select(*columns).write.option("header", True).csv(f"{path}/part={part}")
    read = climate_csv.read_climate_csv(spark, path)
    return rounded(read, KEY, DAY, columns=(*VARIABLES, "Humedad del suelo"))


def union_tagged(spark, sf_dir):
    """Two soil-probe folders with different columns, each row named by its probe."""
    rows = climate(spark, sf_dir).withColumnRenamed(DAY, "Fecha")
    path = scratch_path(spark, "probes")
    probes = {"mini_1": ("temp_c", "rh"), "mini_2": ("wind_ms", "temp_c")}
    for name, columns in probes.items():
        rows.select(KEY, *columns, "Fecha").write.option("header", True).csv(f"{path}/{name}")
    both = climate_csv.read_probe_folders(spark, {n: f"{path}/{n}" for n in probes})
    return rounded(both, "probe", KEY, DAY, columns=("temp_c", "rh", "wind_ms"))


def parse_irrigation_log(spark, sf_dir):
    path = scratch_path(spark, "irrigation-log")
    text = irrigation_log_text(spark, sf_dir).select(*irrigation_log.LOG_HEADINGS)
    text.write.option("header", True).option("sep", ";").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = irrigation_log.read_irrigation_log(spark, path)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return rows.withColumns(
        {
            "started_at": F.date_format("started_at", stamp),
            "ended_at": F.date_format("ended_at", stamp),
            **{c: F.col(c).cast("bigint") for c in ("program", "activation", "sector")},
        }
    )


def dataset_profile(spark, sf_dir):
    """Folders of files with either spelling of the extension, another extension, quoted headings, no content."""
    rows = climate(spark, sf_dir).select(KEY, DAY, "temp_c").withColumnRenamed(DAY, "Fecha")
    path = scratch_path(spark, "files")

    def save(df, name, extension="csv", header=True):
        writer = df.repartition(4).write.option("header", header).option("extension", extension)
        writer.option("quoteAll", name == "quoted").option("escape", "\"").csv(f"{path}/{name}")

    save(rows.filter(F.col(KEY) % 2 == 0), "lower")
    save(rows.filter(F.col(KEY) % 2 == 1), "upper", "CSV")
    save(rows, "other", "txt")
    save(rows.withColumnRenamed("temp_c", 'Temperatura, media "2 m"'), "quoted")
    save(rows.filter(F.col(KEY).isNull()), "hollow", header=False)
    save(rows.select(KEY, "temp_c"), "undated")
    found = profile.profile_files(spark, path)
    return found.groupBy("folder", F.to_json("columns").alias("columns"), "message").agg(
        F.bool_and(F.col("size") > 0).alias("has_size"),
        F.sum("rows").alias("rows"),
        profile.recommended(F.sum("rows")).alias("recommended"),
    )


def dataset_rows(spark, sf_dir):
    return (
        profile.profile_files(spark, _year_folders(spark, sf_dir))
        .groupBy("folder", F.concat_ws(",", "columns").alias("columns"))
        .agg(F.sum("rows").alias("n_rows"))
    )


def dataset_recommended(spark, sf_dir):
    return (
        climate(spark, sf_dir)
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("recommended", profile.recommended(F.col("n_rows")))
    )


def _export(fmt):
    def run(spark, sf_dir):
        results = daily_irrigation(spark, sf_dir).select(
            F.concat(F.lit("sarima_"), F.year(DAY).cast("string")).alias("model"),
            KEY,
            DAY,
            *IRRIGATION,
        )
        path = scratch_path(spark, f"results-{fmt}")
        export.export_results(results, path, fmt)
        schema = results.withColumn("sheet", F.lit("")).schema
        back = export.read_results(spark, path, schema, fmt)
        return rounded(back, "sheet", "model", KEY, DAY, columns=IRRIGATION)

    return run


def _registry_rows(spark, sf_dir) -> DataFrame:
    """First-order models in registry form, one per station and variable."""
    models = ar.fit(ar.differenced_pairs(gap_free(spark, sf_dir)))
    none = F.lit(None)
    return models.select(
        F.lit("sarima").alias("model_type"),
        F.concat(F.lit("sarima_"), "variable").alias("name"),
        KEY,
        F.col("variable").alias("target"),
        F.create_map(F.lit("p"), F.lit("1"), F.lit("d"), F.lit("1")).alias("params"),
        F.array(by_unit("intercept"), F.col("phi")).alias("coef"),
        none.cast("double").alias("sigma2"),
        "n",
        none.cast("map<string,struct<kind:string,center:double,scale:double>>").alias("scales"),
        none.cast("string").alias("error"),
        F.to_timestamp(F.lit("2024-01-02 00:00:00")).alias("trained_at"),
    )


def _registry_view(models: DataFrame) -> DataFrame:
    return models.select(
        "model_type",
        "name",
        KEY,
        "target",
        "n",
        r(F.col("coef")[0], 6).alias("intercept"),
        r(F.col("coef")[1], 6).alias("phi"),
    )


def registry_save(spark, sf_dir):
    path = scratch_path(spark, "registry")
    registry.save_models(_registry_rows(spark, sf_dir), path)
    return _registry_view(registry.read_registry(spark, path))


def registry_load(spark, sf_dir):
    """Two families, one of them trained twice: only the newest of the asked type load."""
    path = scratch_path(spark, "registry")
    models = materialize(_registry_rows(spark, sf_dir), "models")
    older = models.withColumns(
        {
            "trained_at": F.to_timestamp(F.lit("2024-01-01 00:00:00")),
            "coef": F.array(F.lit(0.0), F.lit(0.0)),
        }
    )
    other = models.withColumn("model_type", F.lit("var"))
    for rows in (older, models, other):
        registry.save_models(rows, path)
    return _registry_view(registry.load_models(spark, path, "sarima"))


def _model_names(spark, sf_dir) -> DataFrame:
    """Saved model names made from part names, of known and unknown types."""
    kinds = ("sarima_", "SARIMAX_", "var_", "lstm_", "prophet_", "sarimax_")
    prefix = F.element_at(
        F.array(*[F.lit(x) for x in kinds]), (F.pmod("p_size", F.lit(6)) + 1).cast("int")
    )
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.concat(prefix, F.translate("p_name", " ", "_"), F.lit("_model")).alias("name"),
    )


def registry_types(spark, sf_dir):
    return registry.available_types(_model_names(spark, sf_dir))


# --- projection and naming ------------------------------------------------


def unpivot_climate(spark, sf_dir):
    rows = reports.unpivot_variables(climate(spark, sf_dir))
    return rows.withColumn("value", r(by_unit("value")))


def exog_select(spark, sf_dir):
    chosen = naming.exog_columns("temp_c", limit=3)
    every = naming.exog_columns("temp_c")
    return climate(spark, sf_dir).select(
        KEY,
        DAY,
        r("temp_c").alias("target"),
        *[r(c).alias(f"first_{c}") for c in chosen],
        *[r(natural(c)).alias(f"all_{c}") for c in every],
    )


def canonical_names(spark, sf_dir):
    spanish = naming.spanish_names(climate(spark, sf_dir))
    shuffled = spanish.select(*reversed(spanish.columns))
    return rounded(naming.canonical_names(shuffled), KEY, DAY)


def scaler_routing(spark, sf_dir):
    spanish = naming.spanish_names(climate(spark, sf_dir))
    rows = reports.unpivot_variables(spanish, list(SPANISH_NAMES), (KEY, DAY), "heading")
    return rows.groupBy("heading", naming.routed_scaler(F.col("heading")).alias("scaler")).agg(
        F.count("value").alias("n")
    )


def model_family(spark, sf_dir):
    names = _model_names(spark, sf_dir)
    return names.select(
        "p_partkey",
        naming.bare_model_name(F.col("name")).alias("bare"),
        naming.model_family(F.col("name")).alias("family"),
        naming.sheet_name(F.col("name")).alias("sheet"),
    )


def chart_variables(spark, sf_dir):
    rows = reports.chart_variables(daily_irrigation(spark, sf_dir))
    return rows.withColumn("value", r("value"))


def chart_irrigation(spark, sf_dir):
    return rounded(reports.chart_irrigation(daily_irrigation(spark, sf_dir)), KEY, DAY, columns=("NB",))


def calendar_fields(spark, sf_dir):
    return climate(spark, sf_dir).select(
        KEY,
        DAY,
        F.dayofyear(DAY).cast("bigint").alias("dia"),
        F.date_format(DAY, "yyyy-MM-dd").alias("label"),
    )


# --- joins ----------------------------------------------------------------


def calendar_grid(spark, sf_dir):
    return rounded(calendar.calendar_grid(climate(spark, sf_dir)), KEY, DAY)


def _observed_forecasts(spark, sf_dir) -> DataFrame:
    """Readings in the shape of per-variable forecasts; missing readings are absent."""
    long = reports.unpivot_variables(climate(spark, sf_dir)).filter(F.col("value").isNotNull())
    return long.withColumn("model", F.lit("sarima"))


def unify_forecasts(spark, sf_dir):
    return rounded(
        reports.unify_forecasts(_observed_forecasts(spark, sf_dir)), "model", KEY, DAY
    )


def forecast_gaps(spark, sf_dir):
    gaps = reports.missing_variables(_observed_forecasts(spark, sf_dir), ("model", KEY, DAY))
    return gaps.withColumn("missing", F.array_join("missing", ","))


def scale_apply(spark, sf_dir):
    rows = gap_free(spark, sf_dir)
    scaled = scaling.fit_and_scale(rows)

    def shown(c: str) -> Column:
        # quartiles are exact, so only a last-digit difference near zero is rounded away
        return r(r(c, 9)) if SCALER_KINDS[c] == "robust" else r(c, 4)

    return scaled.select(KEY, DAY, *[shown(c).alias(c) for c in VARIABLES])


def scale_inverse(spark, sf_dir):
    """Distance between each reading and its scaled and unscaled self."""
    rows = gap_free(spark, sf_dir)
    kept = rows.withColumns({f"was_{c}": F.col(c) for c in VARIABLES})
    back = scaling.fit_and_scale(kept, undo=True)
    return back.select(
        KEY, DAY, *[F.abs(r(F.col(c) - F.col(f"was_{c}"), 5)).alias(f"off_{c}") for c in VARIABLES]
    )


# --- aggregation ----------------------------------------------------------


def series_summary(spark, sf_dir):
    return reports.series_summary(climate(spark, sf_dir))


def _fit_scaler(kind):
    def run(spark, sf_dir):
        rows = scaling.scale_rows(scaling.fit_scales(climate(spark, sf_dir), kind=kind))
        return rows.select(
            KEY,
            "variable",
            "kind",
            r(by_unit("center")).alias("center"),
            r(
                F.when(F.col("scale") == 1.0, F.col("scale")).otherwise(by_unit("scale"))
            ).alias("scale"),
        )

    return run


def irrigation_totals(spark, sf_dir):
    totals = reports.irrigation_totals(daily_irrigation(spark, sf_dir))
    return rounded(
        totals, KEY, "days", columns=("total_nb", "total_nb_rdc", "mean_nb_rdc"), digits=4
    )


def _whole_pack(spark, sf_dir, **settings) -> tuple[DataFrame, int, TrainConfig]:
    """Training pack over every day (no test part), and its stations."""
    config = TrainConfig(test_size=0, **settings)
    # The observed days are written first: what follows reads them again.
    return *spread_pack(climate(spark, sf_dir), config), config


def var_gram(spark, sf_dir):
    """Cross-products of today with every term up to the full lag."""
    pack, stations, config = _whole_pack(spark, sf_dir)
    lags = config.maxlags
    rows = var.gram_entries(var.moments(pack, config.variables, lags, stations=stations), config.variables, lags)
    today = [f"{c}_lag0" for c in config.variables]
    rows = rows.filter(F.col("term_a").isin("const", *today))
    constant = (F.col("term_a") == "const") & (F.col("term_b") == "const")
    n = F.max(F.when(constant, F.col("value"))).over(Window.partitionBy(KEY))
    return rows.withColumn("n", n.cast("bigint")).withColumn("value", untied(F.col("value") / n, 6))


# --- windows and sequences ------------------------------------------------


def interpolate_time(spark, sf_dir):
    grid = calendar.calendar_grid(climate(spark, sf_dir))
    return rounded(calendar.interpolate_time(grid), KEY, DAY)


def complete_series(spark, sf_dir):
    return rounded(completed(spark, sf_dir), KEY, DAY)


def temporal_split(spark, sf_dir):
    both = series.labelled_split(climate(spark, sf_dir), 180)
    return rounded(both.withColumnRenamed("split", "part"), KEY, DAY, "part")


def split_bounds(spark, sf_dir):
    bounds = series.split_bounds(climate(spark, sf_dir))
    return bounds.withColumn("train_pct", r("train_pct", 4))


def sliding_sequences(spark, sf_dir):
    """Every window of 30 days and the day after it."""
    rows = series.sliding_sequences(observed_pack(climate(spark, sf_dir), VARIABLES))
    return rows.select(
        KEY,
        DAY,
        F.size("sequence").cast("bigint").alias("length"),
        *[r(natural(c)).alias(f"target_{c}") for c in VARIABLES],
        *[
            r(F.col("sequence")[i - 1][c] / (1e6 if c == "rad_j" else 1.0)).alias(f"{c}_{i}")
            for c in VARIABLES
            for i in range(1, 31)
        ],
    )


def last_k_state(spark, sf_dir):
    state = series.last_k(gap_free(spark, sf_dir), 15)
    rows = state.select(KEY, "last_day", F.posexplode("state").alias("pos", "_s"))
    return rows.select(
        KEY,
        "last_day",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("_s.day").alias(DAY),
        *[r(F.col(f"_s.{c}") / (1e6 if c == "rad_j" else 1.0)).alias(c) for c in VARIABLES],
    )


def window_shift(spark, sf_dir):
    """The feedback step of a recursive forecast: oldest day out, a new value in."""
    state = series.last_k(gap_free(spark, sf_dir), 30)
    moved = state.select(
        KEY,
        F.arrays_zip(
            *[shift_append(F.col(f"state.{c}"), F.lit(1.5)).alias(c) for c in VARIABLES]
        ).alias("w"),
    )
    return moved.select(KEY, F.posexplode("w").alias("pos", "_w")).select(
        KEY, F.col("pos").cast("bigint").alias("pos"), *[r(F.col(f"_w.{c}")).alias(c) for c in VARIABLES]
    )


def seasonal_difference(spark, sf_dir):
    return rounded(series.seasonal_difference(gap_free(spark, sf_dir)), KEY, DAY)


def lag_matrix(spark, sf_dir):
    lags = series.lag_matrix(observed_pack(climate(spark, sf_dir), VARIABLES), VARIABLES, 15)
    return lags.select(
        KEY,
        DAY,
        *[r(natural(c)).alias(c) for c in VARIABLES],
        *[
            r(F.col(f"{c}_lag{i}") / (1e6 if c == "rad_j" else 1.0)).alias(f"{c}_lag{i}")
            for c in VARIABLES
            for i in range(1, 16)
        ],
    )


def integrate_forecast(spark, sf_dir):
    """Difference the last 45 days away from the levels, then sum them back."""
    rows = gap_free(spark, sf_dir)
    levels = [f"level_{c}" for c in VARIABLES]
    kept = rows.withColumns({f"level_{c}": F.col(c) for c in VARIABLES})
    labelled = series.labelled_split(series.seasonal_difference(kept), HORIZON)
    # A series has every day, so the test days and the state before them are its last ones.
    near = materialize(series.last_days(labelled, HORIZON + 31), "last-days")
    train, test = (near.filter(F.col("split") == x) for x in ("train", "test"))
    state = series.last_k(train, 31, levels).select(KEY, "last_day", "state")
    steps = test.select(KEY, DAY, *VARIABLES).join(state, KEY)
    # One row a variable, each with its own levels alone, so that one window serves all.
    each = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"), F.col(f"state.level_{c}").alias("tail")) for c in VARIABLES]
    steps = steps.select(KEY, DAY, F.datediff(DAY, "last_day").alias("step"), F.inline(F.array(*each)))
    back = series.integrate_forecast(steps, [KEY, "variable"])
    wide = back.groupBy(KEY, DAY).agg(*[F.max(F.when(F.col("variable") == c, F.col("value"))).alias(c) for c in VARIABLES])
    return wide.select(KEY, DAY, *[r(r(natural(c), 9)).alias(c) for c in VARIABLES])


# --- previews -------------------------------------------------------------


def preview_head_tail(spark, sf_dir):
    rows = reports.head_tail(climate(spark, sf_dir), 3)
    micro = {c: F.round(F.col(c) * 1000).cast("bigint") for c in VARIABLES}
    return rows.withColumns(micro).select(
        KEY,
        "part",
        F.col("pos").cast("bigint").alias("pos"),
        F.date_format(DAY, "yyyy-MM-dd").alias("label"),
        reports.as_record(VARIABLES).alias("record"),
    )


def results_head_tail(spark, sf_dir):
    rows = reports.head_tail(daily_irrigation(spark, sf_dir), 5)
    shown = rows.withColumn("pos", F.col("pos").cast("bigint"))
    return rounded(shown, KEY, DAY, "part", "pos", columns=IRRIGATION, digits=3)


# --- agronomy -------------------------------------------------------------


def et0_terms(spark, sf_dir):
    return climate(spark, sf_dir).select(
        KEY, DAY, *[r(c).alias(name) for name, c in agronomy.climate_et0_terms().items()]
    )


def et0_daily(spark, sf_dir):
    rows = completed(spark, sf_dir)
    return rows.select(KEY, DAY, r(agronomy.climate_et0_terms()["et0"]).alias("et0"))


def kc_curve(spark, sf_dir):
    dia = F.dayofyear(DAY)
    return climate(spark, sf_dir).select(
        KEY,
        DAY,
        dia.cast("bigint").alias("dia"),
        r(agronomy.crop_coefficient(dia)).alias("kc"),
    )


def _irrigation_columns(*columns):
    def run(spark, sf_dir):
        return rounded(daily_irrigation(spark, sf_dir), KEY, DAY, columns=columns)

    return run


def irrigation_daily(spark, sf_dir):
    # No job of its own asks whether there are rows: that would run the whole exchange twice.
    rows = agronomy.calculate_irrigation(completed(spark, sf_dir), observed=Observation("irrigation"))
    return rounded(
        rows.withColumn("dia", F.col("dia").cast("bigint")), KEY, DAY, "dia", columns=IRRIGATION
    )


def _exog_future(policy, horizon):
    def run(spark, sf_dir):
        rows = gap_free(spark, sf_dir)
        columns = naming.exog_columns("temp_c", limit=3)
        future = series.exog_future(rows, columns, horizon, policy)
        return rounded(
            future.withColumn("step", F.col("step").cast("bigint")), KEY, "step", columns=columns
        )

    return run


def future_days(spark, sf_dir):
    """Each station asks for as many days as it has observed."""
    asked = climate(spark, sf_dir).groupBy(KEY).agg(
        F.max(DAY).alias("last_day"), F.count(F.lit(1)).alias("asked")
    )
    return calendar.future_days(asked, F.col("asked").cast("int")).select(
        KEY, "last_day", F.col("step").cast("bigint").alias("step"), DAY
    )


# --- models ---------------------------------------------------------------


def sarima_ar_fit(spark, sf_dir):
    models = ar.fit(ar.differenced_pairs(gap_free(spark, sf_dir)))
    return models.select(
        KEY, "variable", r("phi", 6).alias("phi"), r(by_unit("intercept"), 6).alias("intercept"), "n"
    )


def sarima_ar_forecast(spark, sf_dir):
    models = ar.fit(ar.differenced_pairs(gap_free(spark, sf_dir)))
    path = ar.forecast(models, HORIZON)
    return path.select(
        KEY,
        "variable",
        DAY,
        F.col("step").cast("bigint").alias("step"),
        r(by_unit("value"), 4).alias("value"),
    )


def exog_regression(spark, sf_dir):
    rows = gap_free(spark, sf_dir).withColumn("rad_j", natural("rad_j"))
    out = ar.simple_regression(rows, "temp_c", naming.exog_columns("temp_c"))
    return out.select(KEY, "regressor", r("slope", 6).alias("slope"), r("intercept", 6).alias("intercept"), "n")


def _fit(family, **settings):
    def run(spark, sf_dir):
        config = TrainConfig(families=(family,), **settings)
        models = train_all(climate(spark, sf_dir), config)
        return models.drop("trained_at", "scales", "params").withColumns(
            {"coef": F.transform("coef", lambda x: F.round(x, 6)), "sigma2": r("sigma2")}
        )

    return run


def var_lag_selection(spark, sf_dir):
    pack, stations, config = _whole_pack(spark, sf_dir)
    table_ = var.lag_selection(var.fit_orders(pack, config, stations))
    return table_.select(KEY, "p", *[r(c, 4).alias(c) for c in ("aic", "bic", "hqic", "fpe")], "chosen")


def var_normal_equations(spark, sf_dir):
    """Least squares leaves errors that are uncorrelated with every regressor.

    Per station, equation and regressor of a fitted VAR(2): the mean product
    of error and regressor over the sample, rounded. Summed from the fitted
    coefficients and every day's regressors, independently of the solver.
    """
    lags, columns = 2, list(VARIABLES)
    pack, stations, config = _whole_pack(spark, sf_dir)
    fitted = var.solve(pack, columns, lags, None, stations=stations)
    rows = gap_free(spark, sf_dir)
    scaled = scaling.apply_scales(rows, pack.select(KEY, "scales"))
    regressors = [f"{c}_lag{i}" for i in range(1, lags + 1) for c in columns]
    lagged = series.lag_matrix(scaled, columns, lags).dropna(subset=regressors)
    k, terms = len(columns), ["const", *regressors]

    def products(design: pa.Table, models: pa.Table) -> pa.Table:
        names, days, coefs = [(c, t) for c in columns for t in terms], design.num_rows, models["coef"].to_pylist()
        found = []
        for coef in coefs if days else []:
            if coef is None:
                found += [None] * len(names)
                continue
            z = np.column_stack([np.ones(days), *[design[c].to_numpy() for c in regressors]])
            y = np.column_stack([design[c].to_numpy() for c in columns])
            errors = y - z @ np.reshape(coef, (len(terms), k))
            found += (errors.T @ z / days).ravel().tolist()
        many = len(found) // len(names)
        return pa.table({
            KEY: pa.array(models[KEY].to_pylist()[:1] * len(found), pa.int64()),
            "equation": pa.array([c for c, _ in names] * many, pa.string()),
            "regressor": pa.array([t for _, t in names] * many, pa.string()),
            "product": pa.array(found, pa.float64()),
        })

    long = (
        lagged.select(KEY, *columns, *regressors)
        .groupBy(KEY)
        .cogroup(materialize(fitted.select(KEY, "coef"), "fitted").groupBy(KEY))
        .applyInArrow(products, f"{KEY} bigint, equation string, regressor string, product double")
    )
    return long.select(KEY, "equation", "regressor", F.abs(r("product", 6)).alias("product"))


def _forecast(family, **settings):
    def run(spark, sf_dir):
        rows = packed_climate(spark, sf_dir)
        models = train_all(rows, TrainConfig(families=(family,), **settings))
        out = predict_all(models, history_pack(rows), HORIZON)
        return out.withColumn("value", r(by_unit("value")))

    return run


# Orders for which the estimators reduce to regressions that SQL can express.
PLAIN_AR = {"order": (1, 1, 0), "seasonal": (0, 0, 0, 1), "test_size": 0}
PLAIN_REGRESSION = {"order": (0, 1, 0), "seasonal": (0, 0, 0, 1), "test_size": 0}


def _forecast_rows(spark, sf_dir, config: TrainConfig, digits: int, policy: str = "hold"):
    rows = packed_climate(spark, sf_dir, config.variables)
    out = predict_all(
        train_all(rows, config), history_pack(rows, config.variables), HORIZON, policy
    )
    return out.select(
        "model",
        KEY,
        "variable",
        DAY,
        F.col("step").cast("bigint").alias("step"),
        r(by_unit("value"), digits).alias("value"),
    )


def sarima_plain_fit(spark, sf_dir):
    """The seasonal-model fit at order (1,1,0): one lag and a constant, scaled data."""
    models = train_all(climate(spark, sf_dir), TrainConfig(families=("sarima",), **PLAIN_AR))
    width = F.col("scales")[F.col("target")]["scale"]
    return models.select(
        KEY,
        F.col("target").alias("variable"),
        "n",
        r(F.col("coef")[1], 4).alias("phi"),
        r(
            F.col("coef")[0] * width / F.when(F.col("target") == "rad_j", 1e6).otherwise(1.0), 4
        ).alias("intercept"),
        r(F.col("sigma2") * width * width / F.when(F.col("target") == "rad_j", 1e12).otherwise(1.0), 4)
        .alias("variance"),
    )


def sarima_plain_forecast(spark, sf_dir):
    return _forecast_rows(spark, sf_dir, TrainConfig(families=("sarima",), **PLAIN_AR), 4)


def sarimax_plain_fit(spark, sf_dir):
    """Differenced target on one differenced regressor, no constant."""
    config = TrainConfig(families=("sarimax",), variables=("temp_c", "rh"), **PLAIN_REGRESSION)
    models = train_all(climate(spark, sf_dir), config)
    other = F.when(F.col("target") == "rh", F.lit("temp_c")).otherwise(F.lit("rh"))
    ratio = F.col("scales")[F.col("target")]["scale"] / F.col("scales")[other]["scale"]
    return models.select(
        KEY,
        F.col("target").alias("variable"),
        "n",
        r(F.col("coef")[0] * ratio, 4).alias("slope"),
    )


def sarimax_plain_forecast(spark, sf_dir):
    """Without ARMA terms: last level plus slope times the regressor's distance from its last."""
    config = TrainConfig(families=("sarimax",), variables=("temp_c", "rh"), **PLAIN_REGRESSION)
    return _forecast_rows(spark, sf_dir, config, 4, "head")


ONE_VARIABLE = {"variables": ("temp_c",), "test_size": 0}


def var_single_selection(spark, sf_dir):
    """Order 0 against order 1 for one variable."""
    pack, stations, config = _whole_pack(spark, sf_dir, variables=("temp_c",), maxlags=1)
    rows = var.lag_selection(var.fit_orders(pack, config, stations))
    return rows.select(
        KEY,
        F.col("p").cast("bigint").alias("p"),
        *[r(c, 5).alias(c) for c in ("aic", "bic", "hqic", "fpe")],
        "chosen",
    )


def var_pair_selection(spark, sf_dir):
    """Order 0 against order 1 for two variables together."""
    pack, stations, config = _whole_pack(spark, sf_dir, variables=("temp_c", "rh"), maxlags=1)
    rows = var.lag_selection(var.fit_orders(pack, config, stations))
    return rows.select(
        KEY,
        F.col("p").cast("bigint").alias("p"),
        *[untied(F.col(c), 5).alias(c) for c in ("aic", "bic", "hqic", "fpe")],
        "chosen",
    )


# Given coefficients, in scaled units: a constant, a variable's own last day and
# its day ``p`` days ago, and the last day of the variable after it.
GIVEN = {"const": 0.05, "last": 0.6, "first": 0.2, "next": 0.1}


def _given_coefficients(p: int) -> list[float]:
    """(1 + K * p, K) coefficients, row by row: constant, then lags 1, 2, ..., p."""
    k = len(VARIABLES)
    rows = [[GIVEN["const"]] * k] + [[0.0] * k for _ in range(p * k)]
    for j in range(k):
        rows[1 + j][j] += GIVEN["last"]
        rows[1 + (p - 1) * k + j][j] += GIVEN["first"]
        rows[1 + (j + 1) % k][j] += GIVEN["next"]
    return [x for row in rows for x in row]


def _fixed_forecast(family: str, p: int, scales: str):
    """All seven variables fed back through given coefficients, scaled in and out."""

    def run(spark, sf_dir):
        rows = packed_climate(spark, sf_dir)
        pack = training_pack(rows, TrainConfig(test_size=0))
        models = pack.select(
            F.lit(family).alias("model_type"), F.lit(f"{family}_multivariate").alias("name"), KEY,
            F.lit("multivariate").alias("target"),
            F.create_map(
                F.lit("p"), F.lit(str(p)), F.lit("variables"), F.lit(",".join(VARIABLES))
            ).alias("params"),
            F.array(*[F.lit(x) for x in _given_coefficients(p)]).alias("coef"),
            F.col(scales).alias("scales"), F.lit(None).cast("string").alias("error"),
        )
        out = predict_all(models, history_pack(rows), HORIZON)
        return out.select(
            "model", KEY, "variable", DAY, F.col("step").cast("bigint").alias("step"),
            untied(by_unit("value"), 4).alias("value"), "error",
        )

    return run


# Given coefficients of the seasonal families at the product's orders, in scaled units.
SEASONAL = {"const": 0.01, "beta": 0.1, "phi": 0.4, "theta": -0.5, "sphi": 0.2, "stheta": -0.6}


def _seasonal_fixed_forecast(family: str, policy: str = "hold"):
    """All seven variables at orders (1,1,1)(1,1,1,30) from given coefficients."""

    def run(spark, sf_dir):
        rows = packed_climate(spark, sf_dir)
        config = TrainConfig(families=(family,), test_size=0)
        pack = training_pack(rows, config)
        polynomials = [SEASONAL[n] for n in ("phi", "theta", "sphi", "stheta")]
        if family == "sarima":
            coef = [SEASONAL["const"], *polynomials]
        else:
            coef = [*[SEASONAL["beta"] * (j + 1) for j in range(len(VARIABLES) - 1)], *polynomials]
        orders = dict(zip(sarima.ORDER_FIELDS, (*config.order, *config.seasonal)))
        params = {**orders, "variables": ",".join(VARIABLES)}
        models = pack.select(
            F.lit(family).alias("model_type"), KEY, F.explode(F.array(*[F.lit(v) for v in VARIABLES])).alias("target"),
            F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]).alias("params"),
            F.array(*[F.lit(x) for x in coef]).alias("coef"), "scales", F.lit(None).cast("string").alias("error"),
        )
        out = predict_all(models, history_pack(rows), HORIZON, policy)
        return out.select(
            "model", KEY, "variable", DAY, F.col("step").cast("bigint").alias("step"),
            untied(by_unit("value"), 4).alias("value"), "error",
        )

    return run


def sarima_start_values(spark, sf_dir):
    """Where the seasonal fits start: the polynomials found by two regressions, every variable."""
    config = TrainConfig(families=("sarima",), test_size=0)
    pack, stations = spread_pack(climate(spark, sf_dir), config)
    found = sarima.start_values(pack, config, "sarima", stations)
    names = ("phi", "theta", "sphi", "stheta")
    return found.select(
        KEY, F.col("target").alias("variable"),
        *[untied(F.col("start")[i + 1], 5).alias(n) for i, n in enumerate(names)],
    )


def var_nested_selection(spark, sf_dir):
    """Orders 0 to 3 of two variables together, from one factorisation."""
    pack, stations, config = _whole_pack(spark, sf_dir, variables=("temp_c", "rh"), maxlags=3)
    rows = var.lag_selection(var.fit_orders(pack, config, stations))
    return rows.select(
        KEY,
        F.col("p").cast("bigint").alias("p"),
        *[untied(F.col(c), 5).alias(c) for c in ("aic", "bic", "hqic", "fpe")],
        "chosen",
    )


def window_normal_equations(spark, sf_dir):
    """A ridge fit leaves errors whose product with a regressor is the penalty times its weight.

    Per station, equation and regressor of the fitted 30-day window: the sum of
    products of error and regressor, less the penalty times the coefficient (the
    constant has none), over the sample's days. Summed from the fitted
    coefficients and every day's regressors, independently of the solver.
    """
    config = TrainConfig(families=("window",), test_size=0)
    lags, columns, k = config.window, list(VARIABLES), len(VARIABLES)
    pack, stations = spread_pack(climate(spark, sf_dir), config)
    fitted = var.solve(pack, columns, lags, None, config.ridge, "ranges", stations).select(KEY, "coef")
    beside = beside_pack(pack, materialize(fitted, "fitted"))
    days = beside.select(KEY, "coef", *[F.transform(c, _scaler(c, "ranges")).alias(c) for c in columns])
    penalty = np.full((1 + lags * k, 1), config.ridge)
    penalty[0] = 0.0

    def products(frames):
        for stations_ in chunks(frames, 16):
            out = []
            for row in stations_.to_dict("records"):
                z = np.column_stack([row[c] for c in columns]).astype(float)
                n = len(z) - lags
                if n < 1:
                    continue
                if row["coef"] is None:
                    out.append((row[KEY], [None] * (len(penalty) * k)))
                    continue
                # A constant and the days before today, latest first.
                x = np.hstack([np.ones((n, 1)), *[z[lags - i : lags - i + n] for i in range(1, lags + 1)]])
                coef = np.reshape(row["coef"], (len(penalty), k))
                errors = z[lags:] - x @ coef
                out.append((row[KEY], ((x.T @ errors - penalty * coef) / n).ravel().tolist()))
            yield pd.DataFrame(out, columns=[KEY, "products"])

    each = days.mapInPandas(products, f"{KEY} bigint, products array<double>")
    return each.select(KEY, F.posexplode("products").alias("pos", "product")).select(
        KEY, F.floor(F.col("pos") / k).cast("bigint").alias("place"),
        F.get(F.array(*[F.lit(c) for c in columns]), F.col("pos") % k).alias("equation"),
        F.abs(r("product", 6)).alias("product"),
    )


# A family of one's own: each day of a period has its mean, and the forecast repeats them.
PERIOD = 7


def _phase_means(values, parameters):
    period = int(parameters["period"])
    end = len(values)
    return [values[(end - 1 - p) % period :: period].mean() for p in range(period)]


def _repeat_phases(coef, state, horizon, parameters):
    period = int(parameters["period"])
    # coef[p] belongs to the days p before the last one, and so to the step that is period - p after it.
    return [coef[-h % period] for h in range(1, horizon + 1)]


def own_family_forecast(spark, sf_dir):
    """A registered family, unknown to training and forecasting code: trained, saved, loaded, forecast."""
    made = family.series_family(
        "phase_mean", _phase_means, _repeat_phases, state_days=1, parameters={"period": PERIOD}, least_days=PERIOD
    )
    family.register(made, replace=True)
    rows = climate(spark, sf_dir)
    path = scratch_path(spark, "registry")
    config = TrainConfig(families=("phase_mean",), test_size=0)
    registry.save_models(train_all(_one_short(climate(spark, sf_dir)), config), path)
    models = registry.load_models(spark, path, "phase_mean")
    out = predict_all(models, history_pack(rows), HORIZON)
    return out.select(
        "model", KEY, "variable", F.coalesce(F.date_format(DAY, "yyyy-MM-dd"), F.lit("")).alias("day"),
        F.coalesce(F.col("step").cast("bigint"), F.lit(0)).alias("step"),
        untied(by_unit("value"), 4).alias("value"), F.coalesce("error", F.lit("")).alias("error"),
    )


def var_single_forecast(spark, sf_dir):
    return _forecast_rows(
        spark, sf_dir, TrainConfig(families=("var",), maxlags=1, **ONE_VARIABLE), 4
    )


def window_single_forecast(spark, sf_dir):
    return _forecast_rows(
        spark, sf_dir, TrainConfig(families=("window",), window=1, **ONE_VARIABLE), 4
    )


def _trained(spark, sf_dir) -> tuple[str, DataFrame]:
    """All families trained on the train part and saved; the registry and the history."""
    rows = packed_climate(spark, sf_dir)
    path = scratch_path(spark, "registry")
    config = TrainConfig(families=("sarima", "sarimax", "var", "window"))
    registry.save_models(train_all(rows, config), path)
    return path, history_pack(rows)


def train_everything(spark, sf_dir):
    path, _ = _trained(spark, sf_dir)
    return registry.read_registry(spark, path).select(
        "model_type", "name", KEY, "n", r("sigma2").alias("sigma2"), F.size("coef").alias("n_coef"),
        "error",
    )


def predict_everything(spark, sf_dir):
    path, history = _trained(spark, sf_dir)
    models = registry.require_models(
        registry.load_models(spark, path, ["sarima", "sarimax", "var", "window"])
    )
    return predict_all(models, history, HORIZON)


def forecast_irrigation_query(spark, sf_dir):
    rows = packed_climate(spark, sf_dir)
    path = scratch_path(spark, "registry")
    registry.save_models(train_all(rows, TrainConfig(families=("sarima", "var"))), path)
    models = registry.load_models(spark, path, ["sarima", "var"])
    out = forecast_irrigation(models, history_pack(rows), HORIZON)
    return rounded(out, "run_id", "model", KEY, DAY, "error", columns=IRRIGATION)


# --- the whole chain at an order that SQL can follow -----------------------

# A random walk with drift: the forecast is the last level plus h times the mean step.
#: Days by which a station may lag behind the earliest or latest reading of all.
GAP_DAYS = 5

DRIFT = TrainConfig(
    families=("sarima",), order=(0, 1, 0), seasonal=(0, 0, 0, 1), test_size=0
)


def _one_short(rows: DataFrame) -> DataFrame:
    """Climate, in which station 1 has its first day alone."""
    first = F.min(DAY).over(Window.partitionBy(KEY))
    return rows.withColumn("_first", first).filter((F.col(KEY) != 1) | (F.col(DAY) == F.col("_first"))).drop("_first")


def train_drift(spark, sf_dir):
    """Models and failures by family, as the registry keeps them."""
    path = scratch_path(spark, "registry")
    registry.save_models(train_all(_one_short(climate(spark, sf_dir)), DRIFT), path)
    saved = registry.read_registry(spark, path)
    return saved.groupBy("model_type", F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count(F.lit(1)).alias("models")
    )


def predict_drift(spark, sf_dir):
    rows = packed_climate(spark, sf_dir)
    out = predict_all(train_all(rows, DRIFT), history_pack(rows), HORIZON)
    return out.select(
        "run_id", "model", KEY, "variable", DAY, F.col("step").cast("bigint").alias("step"),
        untied(by_unit("value"), 4).alias("value"), "error",
    )


def irrigation_drift(spark, sf_dir):
    """From training to season totals, results exported on the way."""
    rows = packed_climate(spark, sf_dir)
    daily = forecast_irrigation(train_all(rows, DRIFT), history_pack(rows), HORIZON)
    totals = publish(materialize(daily, "daily"), scratch_path(spark, "results"))
    return rounded(
        totals, "run_id", "model", KEY, "days", "error",
        columns=("total_nb", "total_nb_rdc", "mean_nb_rdc"), digits=3,
    )


def predict_gaps(spark, sf_dir):
    """Stations without history, models without a variable and a failed fit end as error rows.

    The gaps are those of the data: a station whose readings end more than
    ``GAP_DAYS`` before the latest reading of all has no recent history, and one
    that began more than that after the first has no model of ``rh`` yet.
    """
    rows = materialize(climate(spark, sf_dir), "climate")
    span = rows.agg(F.min(DAY).alias("first"), F.max(DAY).alias("last")).first()
    own = Window.partitionBy(KEY)
    ends = F.max(DAY).over(own)
    recent = rows.withColumn("_ends", ends).filter(F.datediff(F.lit(span["last"]), "_ends") <= GAP_DAYS)
    early = rows.groupBy(KEY).agg(F.min(DAY).alias("_begins")).filter(
        F.datediff("_begins", F.lit(span["first"])) <= GAP_DAYS
    )
    models = train_all(_one_short(rows), DRIFT)
    known = models.filter(F.col("target") == "rh").join(early.select(KEY), KEY, "left_semi")
    models = models.filter(F.col("target") != "rh").unionByName(known)
    out = forecast_irrigation(models, history_pack(recent.drop("_ends")), HORIZON)
    return out.groupBy("run_id", "model", KEY, F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count(DAY).alias("days")
    )


def _error_sums(w: np.ndarray, coef: np.ndarray, season: int, const: bool = True) -> np.ndarray:
    """Conditional error sums of (1,1,1)(1,1,1,season) models of the differences ``w``, one a row.

    ``coef`` (models, parameters) holds the constant, if there is one, phi, theta,
    Phi, Theta. One day after another for all models, apart from the estimator.
    """
    c = coef[:, 0] if const else np.zeros(len(coef))
    phi, theta, sphi, stheta = coef.T[const : const + 4]
    both, moving = phi * sphi, theta * stheta
    days = np.ascontiguousarray(w.T)
    e, first = np.zeros_like(days), season + 1
    known = days[first:] - c - phi * days[season:-1] - sphi * days[1:-season] + both * days[:-first]
    for t in range(first, len(days)):
        now = known[t - first] - theta * e[t - 1]
        now -= stheta * e[t - season]
        now -= moving * e[t - first]
        e[t] = now
    return np.einsum("tn,tn->n", e, e)


def _optimal(family: str):
    """Does any coefficient, moved a little, lower the error sum of a fitted seasonal model?

    Every station and variable at the orders the product trains with; moves out
    of the invertible moving averages are no candidates.
    """

    def run(spark, sf_dir):
        config = TrainConfig(families=(family,), test_size=0)
        season, move, const = config.seasonal[3], 0.03, family == "sarima"
        others = 0 if const else len(VARIABLES) - 1
        size = const + others + 4
        pack, stations = spread_pack(climate(spark, sf_dir), config)
        models = materialize(sarima.fit(pack, config, family, stations).select(KEY, "target", "coef"), "models")
        # A station's models go to its series, and are moved there.
        by_station = models.groupBy(KEY).agg(F.collect_list(F.struct("target", "coef")).alias("models"))
        scaled = beside_pack(pack, by_station).select(
            KEY, "models", *[F.transform(v, _scaler(v)).alias(v) for v in VARIABLES]
        )
        differenced = scaled.select(
            KEY, "models", *[difference(F.col(v), 1, 1, season).alias(v) for v in VARIABLES]
        )
        moves = np.zeros((1 + 2 * size, size))
        for i in range(size):
            moves[1 + 2 * i, i], moves[2 + 2 * i, i] = move, -move
        theta, stheta = size - 3, size - 1

        def judged(frames):
            for stations_ in chunks(frames, 4):
                rows, tried = [], []
                for record in stations_.to_dict("records"):
                    for model in record["models"]:
                        rows.append((record[KEY], model["target"], None))
                        if model["coef"] is None:
                            continue
                        given = np.asarray(model["coef"], float) + moves
                        legal = (np.abs(given[:, theta]) <= 1) & (np.abs(given[:, stheta]) <= 1)
                        legal[0] = True
                        given = given[legal]
                        y = np.asarray(record[model["target"]], float)
                        if others:
                            # The target less its regressors' share, then the errors of what is left.
                            x = [np.asarray(record[v], float) for v in VARIABLES if v != model["target"]]
                            left = y - given[:, :others] @ np.stack(x)
                        else:
                            left = np.broadcast_to(y, (len(given), len(y)))
                        tried.append((len(rows) - 1, left, given[:, others:]))
                # Series of one length step together.
                for length in {left.shape[1] for _, left, _ in tried}:
                    same = [each for each in tried if each[1].shape[1] == length]
                    sums = _error_sums(
                        np.concatenate([left for _, left, _ in same]), np.concatenate([c for _, _, c in same]),
                        season, const,
                    )
                    ends = np.cumsum([len(c) for _, _, c in same])
                    for (at, _, _), sse in zip(same, np.split(sums, ends[:-1])):
                        rows[at] = (*rows[at][:2], bool(sse[0] <= sse.min() * 1.001))
                yield pd.DataFrame(rows, columns=[KEY, "variable", "optimal"])

        return differenced.mapInPandas(judged, f"{KEY} bigint, variable string, optimal boolean")

    return run


def _scaler(variable: str, scales: str = "scales"):
    scale = F.col(scales)[variable]
    return lambda x: (x - scale["center"]) / scale["scale"]


def sarima_seasonal_ar_fit(spark, sf_dir):
    """Orders (0,0,0)(1,1,0,30): the seasonal difference on itself a season before."""
    config = TrainConfig(families=("sarima",), order=(0, 0, 0), seasonal=(1, 1, 0, 30), test_size=0)
    models = train_all(climate(spark, sf_dir), config)
    return models.select(
        KEY, F.col("target").alias("variable"), "n", r(F.col("coef")[1], 4).alias("phi"), "error"
    )


def registry_saved_types(spark, sf_dir):
    """Types found by name in a saved registry that holds this engine's own families."""
    path = scratch_path(spark, "registry")
    models = materialize(_registry_rows(spark, sf_dir), "models")
    registry.save_models(models, path)
    for family in ("var", "window"):
        named = {"model_type": F.lit(family), "name": F.lit(f"{family}_multivariate")}
        registry.save_models(models.withColumns(named), path)
    return registry.available_types(registry.list_models(registry.read_registry(spark, path)))


def forecast_keys(spark, sf_dir):
    """Which days each model forecasts: every station, variable and day of the horizon."""
    out = _forecast("var")(spark, sf_dir)
    return out.filter(F.col("error").isNull()).select(
        "model", KEY, "variable", DAY, F.col("step").cast("bigint").alias("step")
    )


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "detect_date_column": detect_date_column,
    "union_years": union_years,
    "union_mixed_headings": union_mixed_headings,
    "union_tagged": union_tagged,
    "parse_irrigation_log": parse_irrigation_log,
    "dataset_profile": dataset_profile,
    "dataset_rows": dataset_rows,
    "dataset_recommended": dataset_recommended,
    "export_json": _export("json"),
    "export_csv": _export("csv"),
    "export_parquet": _export("parquet"),
    "registry_save": registry_save,
    "registry_load": registry_load,
    "registry_types": registry_types,
    "unpivot_climate": unpivot_climate,
    "exog_select": exog_select,
    "canonical_names": canonical_names,
    "scaler_routing": scaler_routing,
    "model_family": model_family,
    "chart_variables": chart_variables,
    "chart_irrigation": chart_irrigation,
    "calendar_fields": calendar_fields,
    "calendar_grid": calendar_grid,
    "unify_forecasts": unify_forecasts,
    "forecast_gaps": forecast_gaps,
    "scale_apply": scale_apply,
    "scale_inverse": scale_inverse,
    "series_summary": series_summary,
    "fit_standard": _fit_scaler("standard"),
    "fit_robust": _fit_scaler("robust"),
    "fit_minmax": _fit_scaler("minmax"),
    "irrigation_totals": irrigation_totals,
    "var_gram": var_gram,
    "interpolate_time": interpolate_time,
    "complete_series": complete_series,
    "temporal_split": temporal_split,
    "split_bounds": split_bounds,
    "sliding_sequences": sliding_sequences,
    "last_k_state": last_k_state,
    "window_shift": window_shift,
    "seasonal_difference": seasonal_difference,
    "lag_matrix": lag_matrix,
    "integrate_forecast": integrate_forecast,
    "preview_head_tail": preview_head_tail,
    "results_head_tail": results_head_tail,
    "et0_terms": et0_terms,
    "et0_daily": et0_daily,
    "kc_curve": kc_curve,
    "etc_daily": _irrigation_columns("ETc"),
    "effective_rain": _irrigation_columns("precip_mm", "Pe"),
    "net_need": _irrigation_columns("ETc", "Pe", "NN"),
    "irrigation_daily": irrigation_daily,
    "deficit_irrigation": _irrigation_columns("ETc_RDC", "NN_RDC", "NB_RDC"),
    "exog_future": _exog_future("hold", HORIZON),
    "exog_future_head": _exog_future("head", HORIZON),
    "future_days": future_days,
    "sarima_ar_fit": sarima_ar_fit,
    "sarima_ar_forecast": sarima_ar_forecast,
    "exog_regression": exog_regression,
    "sarima_plain_fit": sarima_plain_fit,
    "sarima_plain_forecast": sarima_plain_forecast,
    "sarimax_plain_fit": sarimax_plain_fit,
    "sarimax_plain_forecast": sarimax_plain_forecast,
    "var_single_selection": var_single_selection,
    "var_single_forecast": var_single_forecast,
    "var_pair_selection": var_pair_selection,
    "var_fixed_forecast": _fixed_forecast("var", 2, "scales"),
    "window_fixed_forecast": _fixed_forecast("window", 30, "ranges"),
    "window_single_forecast": window_single_forecast,
    "sarima_fit": _fit("sarima"),
    "sarima_forecast": _forecast("sarima"),
    "sarimax_fit": _fit("sarimax"),
    "sarimax_forecast": _forecast("sarimax"),
    "var_fit": _fit("var"),
    "var_lag_selection": var_lag_selection,
    "var_normal_equations": var_normal_equations,
    "var_forecast": _forecast("var"),
    "window_fit": _fit("window"),
    "window_forecast": _forecast("window"),
    "forecast_keys": forecast_keys,
    "train_drift": train_drift,
    "predict_drift": predict_drift,
    "irrigation_drift": irrigation_drift,
    "predict_gaps": predict_gaps,
    "sarima_seasonal_ar_fit": sarima_seasonal_ar_fit,
    "sarima_optimal": _optimal("sarima"),
    "sarimax_optimal": _optimal("sarimax"),
    "sarima_start_values": sarima_start_values,
    "sarima_fixed_forecast": _seasonal_fixed_forecast("sarima"),
    "sarimax_fixed_forecast": _seasonal_fixed_forecast("sarimax"),
    "sarimax_fixed_forecast_head": _seasonal_fixed_forecast("sarimax", "head"),
    "var_nested_selection": var_nested_selection,
    "window_normal_equations": window_normal_equations,
    "own_family_forecast": own_family_forecast,
    "registry_saved_types": registry_saved_types,
    "train_all": train_everything,
    "predict_all": predict_everything,
    "forecast_irrigation": forecast_irrigation_query,
}
