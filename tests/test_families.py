"""Families that selections and splits may count, from rows of the catalog."""

import json

import pytest
from pyspark.sql import functions as F

from koine.functions import features
from koine.plans import build as b
from koine.schema import CLIPS

LABELS = ["xx^sil-k+o=n/A:0/E:5_2!0_xx-3/F:5_2#0_0"]


def clips(spark, rows):
    names = "clip_id string, speaker_id string, text_norm string, phonemes string, duration_sec double, moras array<string>, fullcontext_labels array<string>, disposition string, quality_score double, audio_sha256 string"
    df = spark.createDataFrame(rows, names)
    phones = F.filter(F.split("phonemes", " "), lambda t: ~t.isin("pau", "|"))
    return b.sinks.fixed_columns(df.withColumns({"biphones": b.tokens.ngrams(phones, 2), "triphones": b.tokens.ngrams(phones, 3)}), CLIPS)


def test_every_family_of_a_clip(spark):
    rows = clips(spark, [("c", "s", "なに？", "n a pau n i", 1.0, ["な", "に"], LABELS, "eligible", 0.5, "h"), ("n", None, None, None, None, None, None, "eligible", None, None)])
    got = {r.clip_id: r.asDict() for r in rows.select("clip_id", *[c.alias(f) for f, c in features.family_tokens(list(features.FAMILIES)).items()]).collect()}
    assert got["n"] == {"clip_id": "n", **dict.fromkeys(features.FAMILIES, [])}
    c = got["c"]
    assert c["phone"] == ["n", "a", "n", "i"] and c["biphone"] == ["n-a", "a-n", "n-i"] and c["triphone"] == ["n-a-n", "a-n-i"]
    assert c["mora"] == ["な", "に"] and c["pause_boundary"] == ["pau"] and c["full_context"] == LABELS
    assert c["sentence_length_band"] == ["1-3"] and c["interrogative_declarative"] == ["interrogative"] and c["speaking_rate_band"] == ["slow"]
    assert c["accent_phrase_length"] == ["5-7"] and c["accent_nucleus"] == ["nucleus@xx^sil:p5_n3"]


def test_names_that_are_no_families():
    for names, allowed in ((["phone", "tone"], tuple(features.FAMILIES)), (["phone", "phone"], tuple(features.FAMILIES)), (["pause_boundary"], features.SPLIT_FAMILIES)):
        with pytest.raises(ValueError, match="families"):
            features.family_tokens(names, allowed)


def test_a_selection_counts_its_families_alone(spark):
    rows = [(f"c{i}", f"s{i}", "まえ" if i < 3 else "まえ？", "m a e", 1.0, ["ま", "え"], None, "eligible", 0.5, f"h{i}") for i in range(4)]
    table, splits = clips(spark, rows), spark.createDataFrame([(f"c{i}", "train") for i in range(4)], "clip_id string, split string")
    config = b.Config(protocol="seen_speaker", hours=2 / 3600, families=["interrogative_declarative"])
    chosen = b.select(table, splits, config).where("disposition = 'selected'").collect()
    assert len(chosen) == 2 and all(set(json.loads(r.positive_contributions)["families"]) == {"interrogative_declarative"} for r in chosen)


def test_a_split_protects_speakers_by_its_families(spark):
    """s0 alone says a pair of phones that the others don't have; its single phones are everybody's."""
    rows = [(f"c{i}", f"s{i}", f"t{i}", "b a" if i == 0 else "a b", 1.0, [], None, "eligible", 0.5, f"h{i}") for i in range(8)]
    ratios = {"train": 0.5, "val": 0.25, "test": 0.25}
    for families in (["phone"], ["phone", "biphone"]):
        got = {r.clip_id: r.split for r in b.plan_split(clips(spark, rows), b.Config(ratios=ratios, split_families=families)).collect()}
        assert set(got.values()) == {"train", "val", "test"}
    assert got["c0"] == "train"
