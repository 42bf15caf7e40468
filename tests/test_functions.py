import unicodedata

import pytest
from pyspark.sql import functions as F

from koine.functions import quality, scoring, text, tokens


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first().r


def test_normalisation(spark):
    rows = ["Ｈｅｌｌｏ　 world", "a b\t\nc", "", None, "ｶﾞ wait....  ok.. "]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r.t for r in df.select(text.normalize_text(F.col("t")).alias("t")).collect()]
    assert got == [None if r is None else " ".join(unicodedata.normalize("NFKC", r).replace("\xa0", " ").split()) for r in rows]
    assert df.select(text.normalize_for_tts(F.col("t"))).collect()[-1][0] == "ガ wait. ok."


def test_japanese(spark):
    assert one(spark, text.japanese_ratio(F.col("t")), t="あア漢x") == 0.75 and one(spark, text.japanese_ratio(F.col("t")), t="") == 0
    reason = lambda t, loc: one(spark, text.text_reason(F.col("t"), F.col("l"), "ja", 2, 5), t=t, l=loc)
    assert reason("あいう", "en") == "text_locale" and reason("abc", "ja") == "text_not_japanese" and reason("あ", "ja-JP") == "text_length" and reason("あい", "JA") is None
    assert one(spark, text.morae(F.col("t")), t="きゃ っと ー") == ["きゃ", "っ", "と", "ー"]
    assert one(spark, text.utterance_type(F.col("t")), t="本当か ") == "interrogative"
    labels = ["x-y/E:1_2!0_x-2/F:3_1#", "x/F:3_1", "z/F:12_0#", "none", "q-r/E:1_2/F:0_1#"]
    assert one(spark, text.accent_phrase_lengths(F.col("a")), a=labels) == ["3", "12"] and one(spark, text.accent_nuclei(F.col("a")), a=labels) == ["nucleus@x:p1_n2"]


def test_token_lists(spark):
    assert one(spark, tokens.split_tokens(F.col("t")), t=" a\tb  c ") == ["a", "b", "c"] and one(spark, tokens.split_tokens(F.lit(None).cast("string")), t="") == []
    assert one(spark, tokens.phones(F.col("t")), t="SIL a Pau b | bos BOS") == ["a", "b", "bos", "BOS"]
    assert one(spark, tokens.ngrams(F.col("a"), 3), a=["x", "y"]) == [] and one(spark, tokens.ngrams(F.col("a"), 2), a=["x", "y", "z"]) == ["x-y", "y-z"]
    assert one(spark, tokens.positioned(F.col("t")), t="a b c | d | | e f") == ["a@word_initial", "b@word_medial", "c@word_final", "d@word_initial", "d@word_final", "e@word_initial", "f@word_final"]
    assert one(spark, tokens.boundary_marks(F.col("t")), t="SIL a | sil | pau") == ["sil", "|", "pau"]
    assert one(spark, tokens.substitute(F.col("a"), {"x": "p q", "y": ""}), a=["x", "y", "z"]) == ["p", "q", "z"]
    keys = ["phone:a", "mora:b:c", "d"]
    assert [one(spark, tokens.family_of(F.col("k")), k=k) for k in keys] == ["phoneme", "mora", "phoneme"] and [one(spark, tokens.token_of(F.col("k")), k=k) for k in keys] == ["a", "b:c", "d"]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(spark):
    import random

    rng = random.Random(1)
    pairs = [([], []), (["a"], []), (["ab", "c"], ["ab", "d", "c"])] + [([rng.choice("abcd") * 2 for _ in range(rng.randint(0, 9))], [rng.choice("abcd") * 2 for _ in range(rng.randint(0, 9))]) for _ in range(40)]
    pairs.append(([f"t{i}" for i in range(100)], [f"t{i}" for i in range(3, 103)]))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r.r for r in df.select(tokens.token_error_rate(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == pytest.approx([plain(a, b) / max(len(a), len(b), 1) for a, b in pairs])
    assert one(spark, tokens.char_error_rate(F.col("a"), F.col("b")), a="", b="") == 0 and one(spark, tokens.char_error_rate(F.col("a"), F.col("b")), a="ab", b="") == 1


def test_scores(spark):
    q = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in {"decode_ok": True, "clipping_ratio": 0.0, "silence_ratio": 0.0, "rms": 0.1, **k}.items()])
    p = lambda rate, up=0, down=0, **k: one(spark, scoring.pass_probability(F.lit(rate), q(**k), F.lit(2.0), F.lit(up), F.lit(down)), t=1)
    assert p(0.5) == 0.5 and p(0.5, clipping_ratio=0.02) == 0.25 and p(0.5, decode_ok=False) == 0.05 and p(1.0) == 0.98 and p(0.8, up=2, down=1) == pytest.approx(0.8 * 0.85 * 1.05)
    d = lambda a, b: one(spark, scoring.vector_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))), t=1)
    assert d([0.0, 3.0], [4.0, 0.0]) == 5 and d([0.0, float("nan")], [1.0, 2.0]) == 1 and d([float("nan")], [1.0]) == 0
    assert one(spark, scoring.redundancy(F.lit(None).cast("double"), 1.0), t=1) == 0 and one(spark, scoring.redundancy(F.lit(1.0), 1.0), t=1) == 0.5
    assert one(spark, scoring.marginal(F.lit(0), 1.0, 0.0), t=1) == pytest.approx(0.693147, 1e-5)


def test_gates(spark):
    m = lambda **k: F.struct(*[F.lit(v).cast("double").alias(n) for n, v in {"duration_sec": 2.0, "silence_ratio": 0.1, "trailing_silence_sec": 0.0, "snr_db": 25.0, "clipping_ratio": 0.0, "dc_offset": 0.0, **k}.items()])
    gate = quality.Gate(max_trailing_silence_sec=0.5, min_estimated_snr_db=5.0, min_chars_per_sec=2.0, max_chars_per_sec=20.0, min_sec_per_mora=0.1, tier_mode="reject_b", a_max_trailing_silence_sec=0.2)
    reason = lambda n=10, mora=5, **k: one(spark, quality.gate_reason(m(**k), F.lit(n), F.lit(mora), gate), t=1)
    assert reason() is None
    cases = {"gate_duration": {"duration_sec": 0.1}, "gate_silence": {"silence_ratio": 0.9}, "gate_trailing_silence": {"trailing_silence_sec": 0.6}, "gate_snr": {"snr_db": 1.0}, "gate_clipping": {"clipping_ratio": 0.5}, "gate_dc": {"dc_offset": 0.2}, "gate_text_audio_low": {"n": 1}, "gate_text_audio_high": {"n": 90}, "gate_text_audio_mora": {"mora": 50}, "gate_quality_tier_b": {"snr_db": 15.0}, "gate_quality_tier_c": {"snr_db": 6.0}}
    for want, k in cases.items():
        assert reason(**k) == want
    assert reason(trailing_silence_sec=0.3) == "gate_quality_tier_b" and reason(snr_db=None) is None
    early = quality.EarlyGate(snr=True, chars_per_sec=True, mora_duration=True).reason(gate)
    bundle = {"duration_sec": 2.0, "silence_ratio": 0.9, "trailing_silence_sec": 3.0, "snr_db": 6.0, "clipping_ratio": 1.0, "dc_offset": 0.5}
    assert early(bundle, 10, 1) is None and early(bundle | {"duration_sec": 90.0}, 10) == "early_gate_duration" and early(bundle | {"snr_db": 1.0}, 10) == "early_gate_snr"
    assert early(bundle | {"snr_db": None}, 1) == "early_gate_text_audio_low" and early(bundle, 90) == "early_gate_text_audio_high" and early(bundle, 10, 50) == "early_gate_text_audio_mora"
    every = quality.EarlyGate(False, True, False, True, True).reason(gate)
    assert every(bundle, 0) == "early_gate_silence" and every(bundle | {"silence_ratio": 0.0}, 0) == "early_gate_clipping" and every(bundle | {"silence_ratio": 0.0, "clipping_ratio": 0.0}, 0) == "early_gate_dc"
    assert quality.Gate(max_silence_ratio=0.3).merged({"max_silence_ratio": 0.9, "min_duration_sec": 1.0}, {"tier_mode": "off"}) == quality.Gate(max_silence_ratio=0.3, min_duration_sec=1.0, tier_mode="off")


def test_transcripts(spark):
    r = lambda h, ref, conf=0.9, cer=0.0, ok=True, gate=quality.AsrGate(min_confidence=0.5): one(spark, quality.asr_reason(F.lit(h).cast("string"), F.lit(ref), F.lit(conf), F.lit(cer), None, F.lit(ok), gate), t=1)
    assert [r("ab", "ab"), r(None, "ab"), r("", "ab"), r("a", "abcdef"), r("ab", "ab", conf=0.1), r("ab", "ab", cer=0.9), r("ab", "ab", ok=False)] == [None, "asr_missing", "asr_too_short", "asr_length_ratio", "asr_confidence", "asr_cer", "asr_decode_failed"]
    a = lambda p, e: one(spark, quality.aligner_reason(F.col("p"), F.col("e"), "nfa", 0.2), p=p, e=e)
    assert a(["x"], ["x"]) is None and a([], ["x"]) == "nfa_missing" and a(["x"], ["y"]) == "nfa_token_mismatch"


def test_distance_by_bit_vectors_is_the_table():
    import random

    rng = random.Random(8)
    for _ in range(300):
        a, b = (["".join(rng.choice("ab c")) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        assert tokens.distance(a, b) == row[-1] == tokens.distance("".join(a), "".join(b))


def test_linguistic_features(spark):
    from koine.functions.features import linguistic_features

    labels = ["xx^sil-k+o=n/A:0/E:5_2!0_xx-3/F:5_2#0_0", "a^b-c/E:xx_xx!xx/F:0_1#0", "xx^sil-k+o=n/E:5_2!0_xx-3/F:7_1#0_0"]
    df = spark.createDataFrame([("なに？", "n a SP | n i pau", "きゃりー なに", 2.0, labels), (None, None, None, None, None)], "t string, p string, k string, d double, l array<string>")
    f = linguistic_features(F.col("t"), F.col("p"), F.col("k"), F.col("d"), F.col("l"), down_weight=["SP", "i"])
    a, b = [r.f for r in df.select(f.alias("f")).collect()]
    assert a.phones == ["n", "a", "n", "i"] and a.biphones == ["n-a", "a-n", "n-i"] and a.triphones == ["n-a-n", "a-n-i"]
    assert a.morae == ["きゃ", "り", "ー", "な", "に"] and a.mora_bigrams[0] == "きゃ-り" and a.mora_count == 5 and a.length_band == "4-7"
    assert a.rate == 2.5 and a.rate_band == "slow" and a.utterance_type == "interrogative" and a.pause_marks == ["sp", "|", "pau"] and a.down_weighted == ["sp", "i"]
    assert a.accent_nuclei == ["nucleus@xx^sil:p5_n3"] and a.accent_phrase_length_bands == ["5-7", "5-7"]
    assert b.phones == [] and b.morae == [] and b.mora_count == 0 and b.rate is None and b.utterance_type is None and b.accent_nuclei == []


def test_marks_that_are_phones(spark):
    df = spark.createDataFrame([("BOS a EOS sil",)], "p string")
    assert df.select(tokens.phones(F.col("p"))).first()[0] == ["BOS", "a", "EOS"]


def test_readings_and_transcripts(spark):
    from koine.functions import backends

    df = spark.createDataFrame([("Ab cd",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(backends.phonemes(F.col("t"))).collect()] == ["ab | cd", None, None]
    said = lambda mode: [r[0] for r in df.select(backends.mock_transcript(F.col("t"), mode)).collect()]
    assert said("echo") == ["Ab cd", "", ""] and said("mismatch_char") == ["Ab cd＠", "＠", "＠"] and said("empty") == ["", "", ""]
    for call in (lambda: backends.phonemes(F.col("t"), "no"), lambda: backends.transcripts(F.col("t"), "no"), lambda: backends.mock_transcript(F.col("t"), "no")):
        with pytest.raises(ValueError):
            call()
