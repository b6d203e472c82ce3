"""Reading and writing files: CSV rules, the irrigation log, profiles, the registry, exports."""

import os
import datetime as dt

import pytest
from pyspark.sql import functions as F

from acequia import session
from acequia.functions.agronomy import with_irrigation
from acequia.schema import CLIMATE_SCHEMA, SPANISH_NAMES, VARIABLES
from acequia.session import materialize, scratch_path, shared_folder
from acequia.sources import climate_csv, export, irrigation_log, profile, registry
from acequia.streaming.irrigation import read_stream, write_irrigation

HEAD = "Fecha,Presión atmosférica,Humedad relativa mínima,Velocidad del viento,Temperatura,Radiación solar,Precipitaciones,Humedad relativa"


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_single_station_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", f"{HEAD}\n2024-01-02,930,30,1.5,,2e7,NaN,60\n2024-01-01,931,31,2,9,1e7,4,61\n")
    rows = climate_csv.read_climate_csv(spark, path, station=5).orderBy("day").collect()
    assert [r["day"] for r in rows] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert rows[0]["station"] == 5 and rows[0]["temp_c"] == 9.0
    assert rows[1]["temp_c"] is None and rows[1]["precip_mm"] is None


def test_day_first_dates_need_their_format(spark, tmp_path):
    path = write(tmp_path / "a.csv", f"{HEAD.replace('Fecha', 'fecha dato')}\n03/02/2024,1,1,1,1,1,1,1\n")
    row = climate_csv.read_climate_csv(spark, path, date_format="dd/MM/yyyy").first()
    assert row["day"] == dt.date(2024, 2, 3)
    with pytest.raises(Exception):
        climate_csv.read_climate_csv(spark, path).collect()


def test_bad_files(spark, tmp_path):
    no_date = write(tmp_path / "a.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError, match="no date column"):
        climate_csv.read_climate_csv(spark, no_date)
    missing = write(tmp_path / "b.csv", "Fecha,Temperatura\n2024-01-01,2\n")
    with pytest.raises(ValueError, match="missing climate columns"):
        climate_csv.read_climate_csv(spark, missing)
    text = write(tmp_path / "c.csv", f"{HEAD}\n2024-01-01,abc,1,1,1,1,1,1\n")
    with pytest.raises(Exception):
        climate_csv.read_climate_csv(spark, text).collect()


def test_files_are_read_by_their_own_headings(spark, tmp_path):
    names = HEAD.split(",")
    values = dict(zip(names, ["2024-01-01", *"1234567"], strict=True))
    write(tmp_path / "a.csv", f"{HEAD}\n{','.join(values[n] for n in names)}\n")
    back = [*reversed(names), "Suelo"]
    write(tmp_path / "b.csv", "\ufeff" + ",".join(back) + "\n" + ",".join({**values, "Suelo": "9"}[n] for n in back) + "\n")
    write(tmp_path / "c.csv", f"{HEAD}\n{','.join(values[n] for n in names)}\n")
    df = climate_csv.read_climate_csv(spark, str(tmp_path))
    rows = df.select(*VARIABLES).collect()
    assert len(rows) == 3 and all(tuple(r) == (1, 2, 3, 4, 5, 6, 7) for r in rows)
    assert sorted(str(r["Suelo"]) for r in df.collect()) == ["9.0", "None", "None"]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    with pytest.raises(Exception):
        climate_csv.read_climate_csv(spark, str(tmp_path), headings=names).collect()


def test_probe_folders(spark, tmp_path):
    for name, text in (("mini1", "Fecha,h10,h20\n2024-01-01,1,2\n"), ("mini2", "h30,Fecha\n3,2024-01-02\n")):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "2024.csv", text)
    df = climate_csv.read_probe_folders(spark, {n: str(tmp_path / n) for n in ("mini1", "mini2")})
    rows = {r["probe"]: r for r in df.collect()}
    assert (rows["mini1"]["h10"], rows["mini1"]["h20"], rows["mini1"]["h30"]) == (1.0, 2.0, None)
    assert rows["mini2"]["h30"] == 3.0 and rows["mini2"]["day"] == dt.date(2024, 1, 2)


def test_log_with_other_headings_raises(spark, tmp_path):
    head = ";".join(reversed(list(irrigation_log.LOG_HEADINGS)))
    path = write(tmp_path / "log.csv", f"{head}\n{';'.join('1' * 13)}\n")
    with pytest.raises(Exception):
        irrigation_log.read_irrigation_log(spark, path).collect()


def test_tagged_union_keeps_all_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, a double")
    b = spark.createDataFrame([(3, 4.0)], "id int, b double")
    rows = {r["probe"]: r for r in climate_csv.tagged_union({"mini_2": b, "mini_1": a}).collect()}
    assert rows["mini_1"]["a"] == 2.0 and rows["mini_1"]["b"] is None
    assert rows["mini_2"]["b"] == 4.0


def test_irrigation_log(spark, tmp_path):
    head = ";".join(irrigation_log.LOG_HEADINGS)
    lines = [
        "1;PROGRAMA01;1;07/06/2024 9:09;07/06/2024 9:46;0:37:02;11,400007;0;2703,51;0;0; Horario ;1",
        "4;PROGRAMA04;1;07/06/2024 11:01;08/06/2024 2:02;15:01:00;-36,5;0;0;0;0;Forzada ;4",
        "2;PROGRAMA02;0;08/06/2024 3:00;08/06/2024 2:00;0:10:00;1;0;0;0;0; Horario ;2",
    ]
    path = write(tmp_path / "log.csv", "﻿" + "\r\n".join([head, *lines]) + "\r\n")
    rows = irrigation_log.read_irrigation_log(spark, path).orderBy("started_at").collect()
    assert len(rows) == 3
    first, second, third = rows
    assert first["started_at"] == dt.datetime(2024, 6, 7, 9, 9)
    assert first["duration_s"] == 37 * 60 + 2 and first["water_m3"] == 11.400007
    assert first["fertiliser_2_l"] == 2703.51 and first["kind"] == "Horario"
    assert not (first["negative_water"] or first["duration_mismatch"] or first["ends_before_start"])
    assert second["negative_water"] and second["kind"] == "Forzada" and second["sector"] == 4
    assert second["duration_s"] == 15 * 3600 + 60
    assert third["ends_before_start"] and third["duration_mismatch"]


def test_profile(spark, tmp_path):
    write(tmp_path / "short.csv", "﻿Fecha,b\n" + "x,1\n" * 365)
    write(tmp_path / "LONG.CSV", "Fecha,c,d\n" + "x,1,2\n" * 366)
    write(tmp_path / "other.txt", "not,this\n")
    write(tmp_path / "none.csv", "")
    write(tmp_path / "quoted.csv", '"Fecha","a, ""b"""\n')
    write(tmp_path / "undated.csv", "x,y\n1,2\n")
    rows = {r["name"]: r for r in profile.profile_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"short.csv", "LONG.CSV", "none.csv", "quoted.csv", "undated.csv"}
    assert rows["none.csv"]["message"] == "empty file" and rows["none.csv"]["rows"] == 0
    assert rows["quoted.csv"]["columns"] == ["Fecha", 'a, "b"'] and rows["quoted.csv"]["message"] == "no rows"
    assert rows["undated.csv"]["message"] == "no date column" and rows["short.csv"]["message"] is None
    assert rows["short.csv"]["rows"] == 365 and not rows["short.csv"]["recommended"]
    assert rows["LONG.CSV"]["rows"] == 366 and rows["LONG.CSV"]["recommended"]
    assert rows["short.csv"]["columns"] == ["Fecha", "b"]
    assert rows["LONG.CSV"]["size"] == (tmp_path / "LONG.CSV").stat().st_size


def test_profile_of_a_split_file(spark, tmp_path):
    """The heading is found and lines are counted once when a file is read in many blocks."""
    write(tmp_path / "a.csv", "Fecha,b\n" + "2024-01-01,1\n" * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        row = profile.profile_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["rows"], r["columns"]) for r in row] == [(5000, ["Fecha", "b"])]


def models(spark, when, coef, kind="sarima", error=None):
    return spark.createDataFrame(
        [(kind, f"{kind}_rh", 1, "rh", {"p": "1"}, coef, 1.0, 10, None, error, when)],
        registry_schema(),
    )


def registry_schema():
    from acequia.schema import REGISTRY_SCHEMA

    return REGISTRY_SCHEMA


def test_registry_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry.save_models(models(spark, dt.datetime(2024, 1, 2), [2.0]), path)
    registry.save_models(models(spark, dt.datetime(2024, 1, 1), [1.0]), path)
    registry.save_models(models(spark, dt.datetime(2024, 1, 3), [3.0], "var"), path)
    registry.save_models(models(spark, dt.datetime(2024, 1, 4), None, error="no"), path)
    got = registry.load_models(spark, path, "sarima")
    assert [r["coef"] for r in got.collect()] == [[2.0]]
    every = registry.load_models(spark, path, ["sarima"], latest=False).collect()
    assert sorted(r["error"] or "" for r in every) == ["", "", "no"]  # a failure is kept, not loaded
    registry.save_models(models(spark, dt.datetime(2024, 1, 4), None, "window", "bad"), path)
    assert registry.load_models(spark, path, "window").first()["error"] == "bad"
    assert {r["name"] for r in registry.list_models(registry.read_registry(spark, path)).collect()} == {
        "sarima_rh_model", "var_rh_model", "window_rh_model",
    }
    with pytest.raises(ValueError):
        registry.require_models(registry.load_models(spark, path, "sarimax"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_type" in plan


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame(
        [("sarima", 1, dt.date(2024, 1, 1), 1.5), ("a" * 40, 2, dt.date(2024, 1, 2), None),
         ("a" * 39, 3, dt.date(2024, 1, 2), None), ("Sarima", 4, dt.date(2024, 1, 2), None)],
        "model string, station bigint, day date, NB double",
    )
    for fmt in export.FORMATS:
        path = str(tmp_path / fmt)
        export.export_results(df, path, fmt)
        back = export.read_results(spark, path, df.withColumn("sheet", F.lit("")).schema, fmt)
        rows = {r["station"]: r for r in back.collect()}
        assert {rows[1]["sheet"], rows[4]["sheet"]} == {"SARIMA", "SARIMA~2"} and rows[1]["NB"] == 1.5
        assert rows[3]["sheet"] == "A" * 31 and rows[3]["model"] == "a" * 39
        assert rows[1]["day"] == dt.date(2024, 1, 1)
        assert rows[2]["sheet"] == "A" * 29 + "~2" and rows[2]["NB"] is None
    with pytest.raises(ValueError):
        export.export_results(df, str(tmp_path / "x"), "xlsx")


def test_exports_are_compressed(spark, tmp_path, monkeypatch):
    """Text is compressed, in files of a bounded number of rows, and reads back whole; plain text can be asked for."""
    monkeypatch.setattr(export, "ROWS_PER_FILE", 700)
    value = F.when(F.col("id") % 7 != 0, F.rand(1) * 9)
    df = spark.range(0, 3000, 1, 2).select(
        F.concat(F.lit("sarima_"), F.col("id") % 2).alias("model"), F.col("id").alias("station"),
        F.lit(dt.date(2024, 1, 1)).alias("day"), *[value.alias(c) for c in ("ETc", "NN", "ETc_RDC", "NN_RDC")],
    )
    for fmt in export.FORMATS:
        size, files = {}, {}
        for codec in (None, "none"):
            path = tmp_path / f"{fmt}-{codec}"
            export.export_results(df, str(path), fmt, codec=codec)
            found = sorted(p for p in path.rglob("part-*"))
            size[codec], files[codec] = sum(p.stat().st_size for p in found), found
            back = export.read_results(spark, str(path), df.withColumn("sheet", F.lit("")).schema, fmt)
            assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
        if fmt == "parquet":
            assert all(".zstd." in p.name for p in files[None])
        else:
            assert all(p.name.endswith(f".{fmt}.gz") for p in files[None]) and len(files[None]) == 8
            assert all(p.suffix == f".{fmt}" for p in files["none"]) and size[None] < 0.6 * size["none"]


class Session:
    """A session as far as ``shared_folder`` looks."""

    def __init__(self, folder, **conf):
        self.folder, self.conf, self.sparkContext = folder, conf, self

    def getCheckpointDir(self):
        return self.folder


def test_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert scratch_path(spark, "x").startswith(f"{folder}/acequia/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert materialize(spark.range(3), "range").count() == 3
    warehouse = {"spark.sql.warehouse.dir": "hdfs:/warehouse/"}
    assert shared_folder(Session(None, **warehouse)) == "hdfs:/warehouse"
    assert shared_folder(Session("s3a://b/checkpoints", **warehouse)) == "s3a://b/checkpoints"


def test_stream_equals_batch(spark, tmp_path):
    rows = [
        (1, dt.date(2024, 5, 1) + dt.timedelta(days=i), 930.0, 30.0, 1.0 + i, 18.0, 2e7, float(i), 60.0)
        for i in range(9)
    ]
    df = spark.createDataFrame(rows, CLIMATE_SCHEMA)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (df.filter("precip_mm < 4"), df.filter("precip_mm >= 4")):
        part.write.mode("append").parquet(source)
        query = write_irrigation(read_stream(spark, source), sink, state)
        query.awaitTermination(120)
    streamed = sorted(spark.read.parquet(sink).collect())
    assert streamed == sorted(with_irrigation(df).collect())


def test_headings_cover_the_variables():
    assert list(SPANISH_NAMES) == HEAD.split(",")[1:]


def test_profile_keeps_broken_files_as_rows(spark, tmp_path, monkeypatch):
    """A file that cannot be read, one lost after listing and one not in UTF-8 cost only themselves."""
    for i in range(9):
        write(tmp_path / f"good{i}.csv", "Fecha,b\n2024-01-01,1\n")
    write(tmp_path / "broken.csv", "Fecha,b\n2024-01-01,1\n")
    # A checksum beside a file that does not fit it, as after a fault of the disk.
    (tmp_path / ".broken.csv.crc").write_bytes(b"crc\0\0\0\x02\0\0\0\0\0")
    (tmp_path / "latin.csv").write_bytes("Fecha,año\n2024-01-01,1\n".encode("latin-1"))
    write(tmp_path / "lost.csv", "Fecha,b\n2024-01-01,1\n")
    once, read = [], profile._read_apart

    def after_the_listing(text, paths, listed):
        if not once:
            once.append((tmp_path / "lost.csv").unlink())
        return read(text, paths, listed)

    monkeypatch.setattr(profile, "_read_apart", after_the_listing)
    rows = {r["name"]: r for r in profile.profile_files(spark, str(tmp_path)).collect()}
    assert len(rows) == 12
    for i in range(9):
        assert rows[f"good{i}.csv"]["rows"] == 1 and rows[f"good{i}.csv"]["message"] is None
    assert rows["latin.csv"]["message"] == "not UTF-8"
    assert rows["latin.csv"]["rows"] == 1 and rows["latin.csv"]["columns"] is None
    assert rows["broken.csv"]["message"].startswith("unreadable: ") and "hecksum" in rows["broken.csv"]["message"]
    assert rows["lost.csv"]["message"].startswith("unreadable: ")


@pytest.mark.skipif(os.geteuid() == 0, reason="the superuser may read any file")
def test_profile_of_a_file_without_permission(spark, tmp_path):
    write(tmp_path / "good.csv", "Fecha,b\n2024-01-01,1\n")
    write(tmp_path / "closed.csv", "Fecha,b\n2024-01-01,1\n")
    (tmp_path / "closed.csv").chmod(0)
    rows = {r["name"]: r for r in profile.profile_files(spark, str(tmp_path)).collect()}
    assert rows["good.csv"]["message"] is None
    assert rows["closed.csv"]["message"].startswith("unreadable: ")


def test_intermediate_tables_are_deleted_when_a_run_ends(spark, monkeypatch):
    """What a run wrote on its way goes, and nothing else."""
    monkeypatch.setattr(session, "_SCRATCH", [])
    other = scratch_path(spark, "other")
    session._SCRATCH.clear()
    spark.range(3).write.parquet(other)
    made = materialize(spark.range(5), "made")
    path = session._SCRATCH[-1]
    assert made.count() == 5 and session.discard_scratch(spark) == 1
    assert session.discard_scratch(spark) == 0
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_rows_are_counted_while_they_are_written(spark):
    df, seen = session.materialize_counted(spark.range(7), "n", most=F.max("id"))
    assert seen == {"rows": 7, "most": 6} and df.count() == 7
