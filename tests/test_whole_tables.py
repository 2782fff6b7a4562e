"""Queries take all rows of their tables."""

import pandas as pd

from meshquill.plans import queries

SF = "/root/testdata/sf0.001"


def test_feature_table_keeps_every_label(spark, tmp_path):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").head(12)
    e["label"] = pd.array([None, 10, 11, *range(9)], dtype="Int32")
    e.to_parquet(tmp_path / "embeddings.parquet")
    assert queries.QUERIES["feature_table"](spark, str(tmp_path)).count() == 12


def test_leakage_sides_hold_all_orders(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(queries.splits, "leaked", lambda a, b: sizes.append(a.count() + b.count()))
    queries.QUERIES["leakage_check_all"](spark, SF)
    assert sizes == [spark.read.parquet(f"{SF}/orders.parquet").count()]
