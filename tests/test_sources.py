"""Typed reads, marts as files, and the whole mart build."""

from __future__ import annotations

import csv
from pathlib import Path
from types import SimpleNamespace

import pytest
from edge_tables import ROWS, edge_tables
from pyspark.sql import functions as F
from star import STAR

from spanledger import build
from spanledger.operators.acquisition import acq_by_plan
from spanledger.schema import TABLES
from spanledger.sources import marts, orders_star
from spanledger.sources.marts import MART_PATHS, load_marts, read_mart, write_mart
from spanledger.sources.raw import load_row_counts, read_raw


def _write_csv(folder: Path, prefix: str = "") -> None:
    for name, schema in TABLES.items():
        with open(folder / f"{prefix}{name}.csv", "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(schema.fieldNames())
            for row in ROWS[name]:
                writer.writerow(["" if cell is None else cell for cell in row])


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_csv_tables_come_back_typed(spark, tmp_path):
    _write_csv(tmp_path, "export_")
    tables = read_raw(spark, str(tmp_path), prefix="export_")
    for name, df in edge_tables(spark).items():
        assert [(f.name, f.dataType) for f in tables[name].schema] == [
            (f.name, f.dataType) for f in TABLES[name]
        ]
        if name == "churn_events":  # an empty text cannot be told from a missing one in CSV
            df = df.withColumn("feedback_text", F.nullif("feedback_text", F.lit("")))
        assert _rows(tables[name]) == _rows(df)
    counts = {r.table_name: r.row_count for r in load_row_counts(tables).collect()}
    assert counts == {f"raw_{name}": len(rows) for name, rows in ROWS.items()}


def test_parquet_tables(spark, tmp_path):
    for name, df in edge_tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    tables = read_raw(spark, str(tmp_path), fmt="parquet")
    assert _rows(tables["subscriptions"]) == _rows(edge_tables(spark)["subscriptions"])


@pytest.mark.parametrize("damage", ["2023-13-45", "not a date"])
def test_a_bad_row_fails_the_read(spark, tmp_path, damage):
    _write_csv(tmp_path)
    path = tmp_path / "churn_events.csv"
    path.write_text(path.read_text().replace("2023-03-01", damage))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_raw(spark, str(tmp_path))["churn_events"].collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_mart_round_trip(spark, edge, tmp_path, fmt):
    mart = acq_by_plan(edge[0].accounts)
    write_mart(mart, f"{tmp_path}/deep/er/mart", fmt)
    back = read_mart(spark, f"{tmp_path}/deep/er/mart", fmt, mart.schema)
    assert _rows(back) == _rows(mart)
    assert read_mart(spark, f"{tmp_path}/never/written", fmt) is None


def test_build_writes_every_mart(spark, edge, tmp_path):
    inputs, _ = edge
    paths = build.build_marts(inputs.tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    assert not any((tmp_path / "work").iterdir())
    assert set(paths) == set(MART_PATHS) and len(paths) == 19
    marts = load_marts(spark, str(tmp_path / "out"))
    assert all(mart is not None and mart.columns for mart in marts.values())
    lazily = build.mart_frames(
        inputs.tables,
        inputs.spine,
        build.engagement.usage_by_feature_account(inputs.usage, inputs.subscriptions),
    )
    for name in ("eng_top_features", "eng_summary_by_churn", "churn_monthly", "mrr_by_plan"):
        back = read_mart(spark, paths[name], "csv", lazily[name].schema)
        assert _rows(back) == _rows(lazily[name])


def test_shared_folder_is_the_given_or_the_clusters():
    def with_setting(value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value or default))

    assert build.shared_folder(with_setting("/cluster/")).startswith("/cluster/spanledger-")
    assert build.shared_folder(with_setting("/cluster/"), "/own").startswith("/own/spanledger-")
    with pytest.raises(ValueError, match="share"):
        build.shared_folder(with_setting(None))


def test_build_refuses_repeated_keys_and_writes_no_mart(spark, edge, tmp_path):
    tables = dict(edge[0].tables)
    records = tables["subscriptions"]
    tables["subscriptions"] = records.union(records.limit(1))
    with pytest.raises(ValueError, match="raw_subscriptions.subscription_id"):
        build.build_marts(tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    assert not (tmp_path / "out").exists() and not any((tmp_path / "work").iterdir())


def test_build_parses_each_table_once(spark, tmp_path):
    _write_csv(tmp_path)
    tables = read_raw(spark, str(tmp_path))
    staged = []
    written = build._written
    try:
        build._written = lambda df, path: staged.append(df) or written(df, path)
        build.build_marts(tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    finally:
        build._written = written
    read = [plan for df in staged[5:] if "csv" in (plan := df._jdf.queryExecution().optimizedPlan().toString()).lower()]
    assert len(staged) == 8 and not read


def test_an_account_of_an_unknown_nation_stays(spark, tmp_path):
    for name in ("nation", "orders"):
        spark.read.parquet(f"{STAR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    customers = spark.read.parquet(f"{STAR}/customer.parquet")
    lost = F.when(F.col("c_custkey") % 3 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).cast("int")
    customers.withColumn("c_nationkey", lost).write.parquet(f"{tmp_path}/customer.parquet")
    accounts = orders_star.accounts(spark, str(tmp_path))
    assert accounts.count() == customers.count()
    assert accounts.filter("country IS NULL").count() == customers.filter("c_custkey % 3 = 0").count()


def test_build_refuses_marts_that_do_not_add_up(spark, edge, tmp_path):
    tables = dict(edge[0].tables)
    tables["accounts"] = tables["accounts"].withColumn(
        "signup_date", F.when(F.col("account_id") != "plain", F.col("signup_date"))
    )
    with pytest.raises(ValueError, match="acq_monthly"):
        build.build_marts(tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    assert not any((tmp_path / "work").iterdir())


def test_marts_come_back_with_the_types_they_were_written_with(spark, edge, tmp_path):
    inputs, _ = edge
    paths = build.build_marts(inputs.tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    usage = build.engagement.usage_by_feature_account(inputs.usage, inputs.subscriptions)
    frames = build.mart_frames(inputs.tables, inputs.spine, usage)
    marts = load_marts(spark, str(tmp_path / "out"))
    for name, frame in frames.items():
        assert marts[name].dtypes == frame.dtypes, name
    # Without the stored schema CSV types are guessed, and differ.
    Path(paths["mrr_monthly"], "_schema.json").unlink()
    assert read_mart(spark, paths["mrr_monthly"]).dtypes != frames["mrr_monthly"].dtypes


def _broken(tables):
    return {
        **tables,
        "accounts": tables["accounts"].withColumn(
            "signup_date", F.when(F.col("account_id") != "plain", F.col("signup_date"))
        ),
    }


def test_a_failing_build_leaves_the_earlier_marts(spark, edge, tmp_path):
    tables, out = dict(edge[0].tables), tmp_path / "out"
    paths = build.build_marts(tables, str(out), work=str(tmp_path / "work"))
    before = {name: _rows(read_mart(spark, path)) for name, path in paths.items()}
    with pytest.raises(ValueError, match="acq_monthly"):
        build.build_marts(_broken(tables), str(out), work=str(tmp_path / "work"))
    assert {name: _rows(read_mart(spark, path)) for name, path in paths.items()} == before
    assert not [p for p in out.iterdir() if p.name.startswith("_")]


def test_a_second_build_replaces_the_marts(spark, edge, tmp_path):
    tables, out = dict(edge[0].tables), tmp_path / "out"
    paths = build.build_marts(tables, str(out), work=str(tmp_path / "work"))
    fewer = {**tables, "support_tickets": tables["support_tickets"].limit(0)}
    build.build_marts(fewer, str(out), work=str(tmp_path / "work"))
    assert read_mart(spark, paths["sup_volume_by_churn"]).count() == 0
    assert not [p for p in out.iterdir() if p.name.startswith("_")]


def test_a_failing_switch_takes_back_what_it_changed(spark, tmp_path, monkeypatch):
    out, built = tmp_path / "out", tmp_path / "out" / "_building"
    for root, text in ((out, "old"), (built, "new")):
        for stem in ("a/x", "b/y", "c"):
            (root / stem).mkdir(parents=True)
            (root / stem / "part").write_text(text)
    move = marts.move

    def failing(spark, old, new):
        if old.endswith("_building/b/y"):
            raise OSError("lost")
        move(spark, old, new)

    monkeypatch.setattr(marts, "move", failing)
    with pytest.raises(OSError, match="lost"):
        marts.publish(spark, str(built), str(out), ["a/x", "b/y", "c"])
    assert {(out / stem / "part").read_text() for stem in ("a/x", "b/y", "c")} == {"old"}
    monkeypatch.setattr(marts, "move", move)
    (built / "a" / "x").mkdir(parents=True, exist_ok=True)
    (built / "a" / "x" / "part").write_text("new")
    marts.publish(spark, str(built), str(out), ["a/x", "b/y", "c"])
    assert {(out / stem / "part").read_text() for stem in ("a/x", "b/y", "c")} == {"new"}


def test_checks_of_a_build_start_no_job(spark, edge, tmp_path, monkeypatch):
    """Totals are observed while tables and marts are written; no written mart is read again."""
    read = []
    monkeypatch.setattr(marts, "read_mart", lambda *a, **b: read.append(a))
    counted = []
    frame = type(edge[0].accounts)
    count = frame.count
    monkeypatch.setattr(frame, "count", lambda self: counted.append(1) or count(self))
    build.build_marts(edge[0].tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    assert not read and not counted


def test_a_build_of_empty_tables(spark, empty, tmp_path):
    paths = build.build_marts(empty[0].tables, str(tmp_path / "out"), work=str(tmp_path / "work"))
    assert read_mart(spark, paths["acq_monthly"]).count() == 0
