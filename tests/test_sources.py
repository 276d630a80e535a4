import pandas as pd
import pytest
from helpers import frame, minutes, pandas_of, same
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import first_of_each_name, tidy_name
from sensorloom.functions.timekit import parse_time
from sensorloom.operators import dosing, report, rollup
from sensorloom.operators.joins import outer_merge
from sensorloom.operators.windows import row_position
from sensorloom.plans.analysis import Analysis
from sensorloom.sources import delimited as dl
from sensorloom.sources import sinks, tables

GAS_HEADER = '"Time Stamp","ISO time","H2S (PPM)","Temperature (°F)"'


def gas_file(rows, preamble=8):
    return "\n".join([*[f"setting {i}" for i in range(preamble)], GAS_HEADER, *rows]) + "\n"


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def test_sensor_logs(spark, tmp_path):
    path = write(
        tmp_path,
        a=gas_file(['"9-12-2025, 7-22-54 AM",x,1.5,70', '"9-12-2025, 7-23-54 AM",x,2.5,71', "junk,,,"]),
        b=gas_file(['"9-12-2025, 7-23-54 AM",x,9.9,99', '"9-12-2025, 1-05-00 PM",x,,72']),
    )
    df = dl.load_sensor_logs(spark, path, "h2s_")
    assert df.columns == ["ts", "h2s_iso_time", "h2s_h2s_ppm", "h2s_temperature_°f"]
    got = pandas_of(df, ["ts"])
    assert got["ts"].astype(str).tolist() == ["2025-09-12 07:22:54", "2025-09-12 07:23:54", "2025-09-12 13:05:00"]
    assert got["h2s_h2s_ppm"].tolist()[:2] == ["1.5", "2.5"]  # the earlier file wins
    assert pd.isna(got["h2s_h2s_ppm"].iloc[2])


def test_file_without_a_valid_time_is_an_error(spark, tmp_path):
    path = write(tmp_path, a=gas_file(['"9-12-2025, 7-22-54 AM",x,1.5,70']), b=gas_file(["never,x,1,1"]))
    with pytest.raises(ValueError, match="no valid time"):
        dl.load_sensor_logs(spark, path, "h2s_")


def test_first_valid_time_far_below_the_header(spark, tmp_path):
    rows = [*["never,x,1,1"] * 200, '"9-12-2025, 7-22-54 AM",x,1.5,70']
    path = write(tmp_path, a=gas_file(rows), b=gas_file(['"9-12-2025, 8-22-54 AM",x,2.5,70']))
    assert dl.load_sensor_logs(spark, path, "h2s_").count() == 2


def test_data_lines_equal_to_lines_above_the_header_stay(spark, tmp_path):
    first = "2025-09-12 07:00:00,5"
    path = write(tmp_path, a="\n".join([first, first, "Time,East Sludge Out (GPM)", first, "2025-09-12 07:01:00,6"]) + "\n")
    got = pandas_of(dl.load_flow_exports(spark, path), ["ts"])
    assert got["ts"].astype(str).tolist() == ["2025-09-12 07:00:00", "2025-09-12 07:01:00"]
    assert got.iloc[:, 1].tolist() == ["5", "6"]


def split_anew(spark, monkeypatch, first, then):
    """Files are split into about so many parts in the jobs up to the header, and in those after it."""
    conf, held = spark.conf, dl.settle
    conf.set("spark.sql.files.openCostInBytes", "1")
    conf.set("spark.sql.files.minPartitionNum", str(first))

    def settle(df):
        out = held(df)
        conf.set("spark.sql.files.minPartitionNum", str(then))
        return out

    monkeypatch.setattr(dl, "settle", settle)


@pytest.mark.parametrize("first,then", [(6, 1), (1, 6), (300, 5)])
def test_no_row_depends_on_how_files_are_split(spark, tmp_path, monkeypatch, first, then):
    n, files = 240, 3
    stamps = [pd.date_range("2025-09-12", periods=n, freq="1min") + pd.Timedelta(days=k) for k in range(files)]
    names = plant.FLOW_EXPORT_COLUMNS
    wide = ["Time", *[f"tag {i}" for i in range(1, len(names))]]
    gas = lambda t: f'"{t.month}-{t.day}-{t.year}, {t.hour % 12 or 12}-{t.minute:02d}-{t.second:02d} {"AM" if t.hour < 12 else "PM"}"'
    for kind in ("gas", "flow", "plain", "marked"):
        (tmp_path / kind).mkdir()
    for k, own in enumerate(stamps):
        write(tmp_path / "gas", **{f"f{k}": gas_file([f"{gas(t)},x,{i},70" for i, t in enumerate(own)])})
        write(tmp_path / "flow", **{f"f{k}": "Time,a\nTime,West Sludge Out (GPM),East Sludge Out (GPM)\n" + "".join(f"{t},{i},2\n" for i, t in enumerate(own))})
        write(tmp_path / "plain", **{f"f{k}": ("export\n" if k % 2 else "") + ",".join(wide) + "\n" + "".join(",".join([str(t), *["1"] * (len(names) - 1)]) + "\n" for t in own)})
        write(tmp_path / "marked", **{f"f{k}": "intro\nmore\nISO time,NH3 (PPM)\n" + "".join(f"{t.isoformat()}Z,{i}\n" for i, t in enumerate(own))})
    loads = {
        "gas": lambda p: dl.load_sensor_logs(spark, p, "g_"),
        "flow": lambda p: dl.load_flow_exports(spark, p),
        "plain": lambda p: dl.load_positional_exports(spark, p),
        "marked": lambda p: dl.load_marked_table(spark, p),
    }
    try:
        for kind, load in loads.items():
            with monkeypatch.context() as m:
                split_anew(spark, m, first, then)
                assert load(str(tmp_path / kind)).count() == n * files, kind
        with monkeypatch.context() as m:
            split_anew(spark, m, first, then)
            lines = dl.read_lines(spark, str(tmp_path / "flow"))
            made = dl.quality_tables(lines, dl.settle(dl.best_header(lines)), time_label="Time", expected=["Time"])
            assert made["data"].count() == n * files and made["skipped"].count() == 0
            assert then > 100 or made["bad_rows"].count() == 0
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_lines_are_numbered_over_batches(spark, tmp_path):
    write(tmp_path, a="".join(f"a{i}\n" for i in range(25)), b="".join(f"b{i}\n" for i in range(7)), c="c0\n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = dl.read_lines(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 33 and (got["line"].str[1:].astype(int) == got["seq"]).all()


def test_header_rows_reach_the_lines_without_a_shuffle_of_them(spark, tmp_path):
    lines = dl.read_lines(spark, write(tmp_path, a=gas_file(['"9-12-2025, 7-22-54 AM",x,1.5,70'])))
    headers = sinks.settle(dl.fixed_header(lines))
    plan = dl.parse_lines(lines, headers, time_label="Time Stamp")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_positional_names(spark, tmp_path):
    names = plant.FLOW_EXPORT_COLUMNS
    other = ["Time", *[f"tag {i}" for i in range(1, len(names))]]
    row = ",".join(["2025-09-12 07:00:00", *map(str, range(1, len(names)))])
    late = ",".join(["2025-09-12 07:01:00", *map(str, range(1, len(names))), "more"])
    path = write(tmp_path, a=f"{','.join(other)}\n{row}\n", b=f"export\n{','.join([*other, 'extra'])}\n{late}\n")
    got = pandas_of(dl.load_positional_exports(spark, path), ["ts"])
    assert len(got) == 2 and got.shape[1] == len(names)
    assert got.iloc[:, 1:].values.tolist() == [[str(i) for i in range(1, len(names))]] * 2


def test_large_file_in_many_blocks_has_one_header(spark, tmp_path):
    stamps = pd.date_range("2025-09-12", periods=4000, freq="1min")
    rows = [f'"{t.month}-{t.day}-{t.year}, {t.hour % 12 or 12}-{t.minute:02d}-{t.second:02d} {"AM" if t.hour < 12 else "PM"}",x,{i},70'
            for i, t in enumerate(stamps)]
    path = write(tmp_path, a=gas_file(rows))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = dl.read_lines(spark, path)
        assert lines.select("block").distinct().count() > 5
        got = pandas_of(dl.load_sensor_logs(spark, path, "g_"), ["ts"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got["g_h2s_ppm"].astype(int).tolist() == list(range(4000))


def test_header_row_of_flow_exports(spark, tmp_path):
    text = (
        "Time,Digesters Sludge Out Flow,Unnamed: 2,Unnamed: 3\n"
        "Time,West Sludge Out (GPM),Eest Sludge Out (GPM),Digesters Sludge Out Flow\n"
        "11/10/25 12:01:00 AM,1,2,3\n,,,\n11/10/25 12:02:00 PM,4,5,6\n"
    )
    lines = dl.read_lines(spark, write(tmp_path, e=text))
    assert dl.best_header(lines).first()["header_no"] == 1
    got = pandas_of(dl.load_flow_exports(spark, str(tmp_path)), ["ts"])
    assert got["ts"].astype(str).tolist() == ["2025-11-10 00:01:00", "2025-11-10 12:02:00"]
    assert list(got.columns) == ["ts", "west_sludge_out_gpm", "eest_sludge_out_gpm", "digesters_sludge_out_flow"]


def test_equal_headers_take_the_lowest_line(spark, tmp_path):
    lines = dl.read_lines(spark, write(tmp_path, e="Time,a\nTime,b\n1/1/25 1:00:00 AM,1\n"))
    assert dl.best_header(lines).first()["header_no"] == 1
    none = dl.read_lines(spark, write(tmp_path / ".." , **{"zz_none": "a,b\n1,2\n"}) + "/zz_none.csv")
    assert dl.best_header(none).first()["header_no"] is None


def test_marker_header_and_different_layouts(spark, tmp_path):
    path = write(
        tmp_path,
        a="intro\nISO time,NH3 (PPM)\n2025-09-12T07:00:00Z,1\n",
        b="ISO time,Humidity (%),NH3 (PPM)\n2025-09-12T08:00:00Z,50,2\n",
    )
    heads = pandas_of(dl.marker_header(dl.read_lines(spark, path)), ["header_no"])
    assert heads["header_no"].tolist() == [0, 1]
    got = pandas_of(dl.load_marked_table(spark, path), ["ts"])
    assert got["nh3_ppm"].tolist() == ["1", "2"]
    assert got["humidity_%"].tolist() == [None, "50"]


def test_quality_tables(spark, tmp_path):
    path = write(
        tmp_path,
        good="Time,West Sludge Out (GPM)\n11/10/25 12:01:00 AM,1\nTime,West Sludge Out (GPM)\nbroken,2\n",
        bad="Time,x\nnever,1\n",
        none="a,b\n1,2\n",
    )
    lines = dl.read_lines(spark, path)
    t = dl.quality_tables(lines, dl.first_cell_header(lines), time_label="Time", expected=["Time", "West Sludge Out (GPM)"])
    assert t["data"].count() == 1 and t["bad_rows"].count() == 2
    d = t["diagnostics"].first()
    assert (d["rows"], d["columns_present"], d["file"].endswith("good.csv")) == (1, 2, True)
    why = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in t["skipped"].collect()}
    assert why == {"bad.csv": "No valid timestamp rows.", "none.csv": "No header row."}
    seen = {r["file"].rsplit("/", 1)[1]: r["West Sludge Out (GPM)"] for r in t["presence"].collect()}
    assert seen == {"good.csv": True, "bad.csv": False}


def test_time_formats(spark):
    rows = [("11/10/25 12:01:00 AM",), (" 9-12-2025, 7-22-54 AM",), ("2025-11-10 00:01:00",), ("bad",), (None,), ("12/31/68 1:00:00 PM",),
            ("1/1/69 1:00:00 PM",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.date_format(parse_time("t"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2025-11-10 00:01:00", "2025-09-12 07:22:54", "2025-11-10 00:01:00", None, None, "2068-12-31 13:00:00",
                   "1969-01-01 13:00:00"]


def test_names(spark):
    assert tidy_name(" West Sludge Out (GPM) ") == "west_sludge_out_gpm"
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a"), F.lit(3).alias("b"))
    assert first_of_each_name(df).first().asDict() == {"a": 1, "b": 3}


def test_frame_set_rebuilds_hours(spark, tmp_path):
    pdf = pd.DataFrame(
        {"ts": minutes(4, freq="30min"), plant.WEST: [10.0, 10, 20, 20], plant.EAST: [1.0, 1, 2, 2], plant.DIGESTER: [0.0, 0, 3, 3],
         plant.NH3: [4.0, 6, 10, 12], plant.H2S: [1.0, 3, 2, 5], "ferric_available": [0, 1, 1, 1]}
    )
    df = frame(spark, pdf)
    sinks.write_minutes(df, f"{tmp_path}/minute", "ts")
    assert sorted(p.name for p in (tmp_path / "minute").glob("date=*")) == ["date=2026-01-01"]
    sinks.write_small(rollup.plant_daily(df, "ts"), f"{tmp_path}/daily")
    sinks.write_csv(spark.createDataFrame([("bad-date", "north")], "date string, location string"), f"{tmp_path}/struvite")
    whole = Analysis.open(spark, str(tmp_path))
    assert {"total_gpm", "lbs_per_min", "transferred_lbs_vol"} <= set(whole.frames.minute.columns)
    same(pandas_of(whole.frames.hourly, ["ts"])[plant.NH3], [4, 8, 12])
    assert whole.frames.weekday is None
    assert whole.frames.side_tables["Struvite Observations"].first()["date"] is None
    assert whole.frames.side_tables["Chemistry Lab Results"] is None
    assert [tuple(r) for r in whole.events().select("chemical", "event_type").collect()] == [("Ferric", "ON")]
    part = whole.between("2026-01-01 00:30", "2026-01-01 01:00")
    assert part.frames.minute.count() == 2
    assert part.events().count() == 1  # found on the whole record
    assert part.event_metrics().count() == 0
    assert part.frames.monthly.count() == 0 or part.frames.monthly.first()["days_in_data"] >= 0
    status = {r["dataset"]: (r["n_rows"], r["present"]) for r in whole.status().collect()}
    assert status["minute"] == (4, True) and status["monthly"] == (0, False)
    assert whole.summary().first()["transitions"] == 1
    assert whole.window("last30").frames.minute.count() == 4


def test_optional_table_check(spark):
    def check(schema, title, rows=((None,) * 2,)):
        return tables.check_optional_table(spark.createDataFrame(rows, schema), title).first()

    bad = check("notes string, x int", "Chemistry Lab Results")
    assert (bad["is_valid"], len(bad["missing_required_groups"])) == (False, 2)
    good = check("date string, location string", "Struvite Observations")
    assert good["is_valid"] and "severity" in good["missing_recommended"]
    empty = check("date string, location string", "Struvite Observations", rows=())
    assert not empty["is_valid"] and len(empty["missing_required_groups"]) == 2


def test_json_sink_and_review(spark, tmp_path):
    pdf = pd.DataFrame(
        {"ts": minutes(2), "ferric_solution_lbs_per_day": [583.0, 583], "ferric_active_lbs_per_day": [8.34, 16.68],
         "hcl_solution_lbs_per_day": [None, None], "hcl_active_lbs_per_day": [1.0, 1.0], "total_gpm": [694.4444444] * 2}
    ).astype({"hcl_solution_lbs_per_day": float})
    review = report.chemistry_review(frame(spark, pdf))
    sinks.write_json(review, f"{tmp_path}/review")
    got = {r["workflow_element"]: r for r in spark.read.json(f"{tmp_path}/review").collect()}
    assert got["HCl dosing features"]["status"] == "Available"
    assert got["HCl solution feed context"]["status"] == "Missing in current window"
    assert got["Ferric dose intensity"]["median"] == pytest.approx(1.5)
    assert dosing.fixed_chemistry(spark.range(1)).first()["pH_fixed"] == 7.0


def test_outer_merge_refuses_rows_without_a_time(spark):
    a = spark.sql("SELECT timestamp'2025-01-01 00:00:00' ts, 1 v UNION ALL SELECT NULL, 2")
    b = spark.sql("SELECT timestamp'2025-01-01 00:00:00' ts, 3 w")
    with pytest.raises(Exception, match="a row has no ts"):
        outer_merge([a, b], "ts").collect()


def test_equal_times_are_split_in_the_order_of_the_ties(spark):
    df = spark.range(10).selectExpr("timestamp'2025-01-01 00:00:00' ts", "9 - id AS id")
    got = row_position(df, "ts", ties=["id"]).select("id", "position").collect()
    assert all(r["id"] == r["position"] for r in got) and len(got) == 10
