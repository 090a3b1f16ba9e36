"""Registered keys take the whole preset and all history blocks."""

from riskflow.operators import train as TR
from riskflow.plans import QUERIES
from riskflow.plans import train_queries as T
from riskflow.plans.feature_queries import pos_block, star_features

SMALL = "/root/testdata/sf0.001"


def test_forest_key_takes_the_preset(monkeypatch):
    monkeypatch.setattr(T, "_oof", lambda spark, sf_dir, spec: spec)
    assert QUERIES["train_forest_oof"](None, None) == TR.FOREST_C and TR.FOREST_C.params["numTrees"] == 300


def test_star_features_hold_the_pos_block(spark):
    out, pos = star_features(spark, SMALL), pos_block(spark, SMALL)
    assert set(pos.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert out.count() == out.select("SK_ID_CURR").distinct().count()
    name = next(c for c in pos.columns if c != "SK_ID_CURR")
    mine = pos.filter(f"`{name}` IS NOT NULL").join(out.select("SK_ID_CURR"), "SK_ID_CURR", "left_semi")
    assert out.filter(f"`{name}` IS NOT NULL").count() == mine.count() > 0
