"""Edge clicks, lip noise, noise profiles, reverberation and model runners, by cases worked out by hand."""

import numpy as np
import pytest

from koine.audio import edge, models, noise
from koine.audio import metrics as m
from koine.audio import steps as s
from koine.audio.arrays import robust_line, run_around, sliding_median

RATE = 16000


def voice(seconds, seed=0, level=0.2):
    """Noise in syllables of 200 ms with a pitch, which has a sustained level."""
    t = np.arange(int(seconds * RATE)) / RATE
    rng = np.random.default_rng(seed)
    return (level * np.sin(2 * np.pi * 180 * t) * (0.6 + 0.4 * np.sin(2 * np.pi * 2.5 * t)) + 0.01 * rng.normal(size=len(t))).astype(np.float32)


def quiet(seconds, seed=1, level=1e-4):
    return (level * np.random.default_rng(seed).normal(size=int(seconds * RATE))).astype(np.float32)


def click(y, at, size=0.6, n=6):
    y = y.copy()
    y[at : at + n] += size * np.array([1, -1] * n)[:n]
    return y


def test_array_helpers():
    x = np.array([1.0, 9.0, 2.0, 2.0, 3.0])
    assert sliding_median(x, 3).tolist() == [1.0, 2.0, 2.0, 2.0, 2.0] and sliding_median(x, 7).tolist() == x.tolist() and sliding_median(x, 1).tolist() == x.tolist()
    assert abs(robust_line(x, 2.0) - (2.0 + 2 * 1.4826 * 1.0)) < 1e-12  # median 2, deviations 1 7 0 0 1: median 1
    mask = np.array([True, True, False, True, False])
    assert [run_around(mask, i) for i in range(5)] == [(0, 2), (0, 2), (0, 4), (3, 4), (3, 5)]


def test_voice_start():
    y = np.concatenate([quiet(0.3), voice(0.5)])
    start = edge.voice_start(y, RATE, 1.0)
    assert abs(start - 0.3 * RATE) <= 0.03 * RATE
    assert edge.voice_start(quiet(0.5), RATE, 6.0) == 8000 and edge.voice_start(y[:20], RATE, 6.0) == 20


def test_each_detector_of_a_click():
    y = click(quiet(0.3), 2000).astype(np.float64)
    found, why = edge.find_click(y, RATE, "leading", 9.0, 4.0, 640)
    assert why == "high" and abs(found[0] - 2000) <= 6 and found[1] <= 2000 and found[2] >= 2005
    assert edge.find_click(np.zeros(4), RATE, "leading", 9.0, 4.0, 640) == (None, "short")
    assert edge.find_click(np.sin(np.arange(4000) / 30), RATE, "leading", 9.0, 4.0, 640) == (None, "below_T")  # jumps: none beyond the line
    two = click(y, 3500, 0.5)
    assert abs(edge.find_click(two, RATE, "leading", 9.0, 4.0, 640)[0][0] - 3500) <= 6  # the later one counts
    long = quiet(0.3).astype(np.float64)
    long[1000:2000] += 0.5 * np.random.default_rng(5).normal(size=1000)  # a burst of 60 ms is no click
    assert edge.find_click(long, RATE, "leading", 9.0, 4.0, 100)[1] in ("no_pass_filters", "high") and (edge.find_click(long, RATE, "leading", 9.0, 1e6, 100) == (None, "no_pass_filters"))


def test_leading_click():
    y = np.concatenate([click(quiet(0.3), 1600), voice(1.0)])
    done = edge.edge_clicks(y, RATE, action="mute", sides="leading", voice_k=1.0)
    assert done.leading == "high" and done.leading_ms > 100 and len(done.y) == len(y)
    assert np.abs(done.y[:1500]).max() == 0 and np.array_equal(done.y[4800:], y[4800:])
    cut = edge.edge_clicks(y, RATE, action="mute_then_trim", sides="leading", voice_k=1.0)
    assert abs(len(cut.y) - RATE) < 0.1 * RATE and cut.leading_ms > done.leading_ms  # silence up to the voice went too
    ramp = edge.edge_clicks(y, RATE, action="fade", sides="leading", voice_k=1.0)
    assert ramp.leading == "high" and np.array_equal(ramp.y[700:], y[700:]) and ramp.leading_ms == 40.0
    assert edge.edge_clicks(np.concatenate([quiet(0.3), voice(1.0)]), RATE, sides="leading", voice_k=1.0).leading != "high"


def test_silence_that_a_click_needs_before_it():
    y = np.concatenate([click(quiet(0.3), 1600), voice(1.0)])
    assert edge.edge_clicks(y, RATE, sides="leading", voice_k=1.0, lead_silence_ms=50.0).leading == "high"
    assert edge.edge_clicks(y, RATE, sides="leading", voice_k=1.0, lead_silence_ms=150.0).leading == "lead_presilence_short"
    flat = (1e-4 * np.sin(np.pi * np.arange(6400) / 8)).astype(np.float32)  # frames of one level
    z = np.concatenate([voice(1.0), flat])
    z = click(z, len(z) - 800)
    assert edge.edge_clicks(z, RATE, sides="trailing", trail_ms=300.0, trail_silence_ms=100.0).trailing == "high"
    assert edge.edge_clicks(z, RATE, sides="trailing", trail_ms=300.0, trail_silence_ms=290.0).trailing == "trail_presilence_short"


def test_trailing_click():
    y = np.concatenate([voice(1.0), quiet(0.4)])
    y = click(y, len(y) - 800)
    done = edge.edge_clicks(y, RATE, sides="trailing", trail_ms=300.0)
    assert done.trailing == "high" and len(y) - 830 <= len(done.y) <= len(y) - 799 and np.array_equal(done.y, y[: len(done.y)])
    ramp = edge.edge_clicks(y, RATE, sides="trailing", trail_ms=300.0, action="fade")
    assert len(ramp.y) == len(y) and np.array_equal(ramp.y[: len(y) - 900], y[: len(y) - 900])
    for short in (np.zeros(0, np.float32), np.zeros(10, np.float32), np.zeros(4000, np.float32)):
        assert len(edge.edge_clicks(short, RATE).y) == len(short)


def test_lip_noise_is_repaired_and_voice_stays():
    y = voice(1.0)
    bad = click(y, 8000, 0.9, 2)
    spans = noise.lip_noise_spans(bad, RATE, level_ratio=1.5, crest=3.0)
    assert any(a <= 8000 < b for a, b in spans) and sum(b - a for a, b in spans) < 0.05 * RATE
    fixed = s.lip_noise_repair(bad, RATE, level_ratio=1.5, crest=3.0)
    assert np.abs(fixed[7990:8020] - y[7990:8020]).max() < 0.35 < np.abs(bad[7990:8020] - y[7990:8020]).max()
    assert noise.lip_noise_spans(y, RATE) == [] and noise.lip_noise_spans(y[:20], RATE) == [] and np.array_equal(s.lip_noise_repair(y, RATE), y)
    many = y.copy()
    for at in (3000, 8000, 12000):
        many = click(many, at, 0.7 + at / 24000, 2)
    one = noise.lip_noise_spans(many, RATE, level_ratio=1.5, crest=3.0, most=1)
    assert len(one) == 1 and one[0][0] <= 12000 < one[0][1]  # the highest peak


def test_lip_noise_is_attenuated():
    y = voice(2.0, level=0.02)
    burst = y.copy()
    burst[16000:16600] += 0.4 * np.sin(2 * np.pi * 5000 * np.arange(600) / RATE).astype(np.float32) * np.hanning(600).astype(np.float32)
    out = noise.lip_noise_suppress(burst, RATE)
    assert np.abs(out[16200:16400]).max() < 0.75 * np.abs(burst[16200:16400]).max()
    assert np.abs(out[:12000] - burst[:12000]).max() < 1e-4
    still = noise.lip_noise_suppress(y, RATE)
    assert np.abs(still - y).max() < 1e-4 and np.array_equal(noise.lip_noise_suppress(y[:100], RATE), y[:100])


def test_spans_are_cut_around_their_middle():
    spans = np.array([[0, 4], [10, 40], [90, 100]])
    assert noise.centred_spans(spans, spans.sum(axis=1) // 2, 8, 100).tolist() == [[0, 4], [21, 29], [91, 99]]
    assert noise.centred_spans(np.array([[92, 100]]), np.array([99]), 4, 100).tolist() == [[96, 100]]


def test_the_tail_raises_the_profile():
    rng = np.random.default_rng(2)
    room = np.concatenate([np.zeros(RATE), voice(1.0), 0.02 * rng.normal(size=RATE)]).astype(np.float32)
    plain = noise.spectral_subtract(room, RATE, trail_ms=0.0)
    mixed = noise.spectral_subtract(room, RATE, trail_ms=0.0, tail_mix=1.0)
    assert np.std(mixed[-RATE // 2 :]) < 0.7 * np.std(plain[-RATE // 2 :])
    assert len(noise.spectral_subtract(room[:50], RATE)) == 50


def test_an_echo_loses_ten_decibels_and_dry_speech_stays():
    rng = np.random.default_rng(4)
    t = np.arange(4 * RATE) / RATE
    dry = rng.normal(size=len(t)) * (np.sin(2 * np.pi * 1.7 * t) > 0.3) * 0.1
    delay = int(0.05 * RATE)
    wet = dry.copy()
    for i in range(delay, len(wet)):
        wet[i] += 0.6 * wet[i - delay]
    power = lambda x: float((x[2000:-2000] ** 2).mean())
    out = noise.wpe(wet.astype(np.float32), RATE, taps=12)
    assert power(out - dry) < 0.1 * power(wet - dry)
    assert power(noise.wpe(dry.astype(np.float32), RATE, taps=12) - dry) < 0.05 * power(dry)
    assert np.array_equal(noise.wpe(dry[:500].astype(np.float32), RATE), dry[:500].astype(np.float32))


def test_chunks_join_to_the_whole():
    y = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    for most, overlap in ((1000, 10), (300, 40), (64, 0), (101, 50)):
        spans = models.chunks_of(len(y), most, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(y) and all(b - a <= most for a, b in spans)
        assert np.allclose(models.joined([y[a:b] for a, b in spans], spans, len(y)), y, atol=1e-6)


def test_a_model_gives_the_same_whole_chunked_and_batched():
    seen = []

    def half(x, lengths, rate, p):
        seen.append((x.nbytes, x.shape, list(lengths)))
        assert all((x[i, n:] == 0).all() for i, n in enumerate(lengths))
        return x * p.get("by", 0.5)

    rng = np.random.default_rng(7)
    samples = [rng.normal(size=n).astype(np.float32) for n in (1000, 30, 31, 5000, 0, 29, 4000)]
    whole = models.run_model(half, samples, 100, {})
    some = models.run_model(half, samples, 100, {}, most_bytes=8000, chunk_sec=15.0, overlap_sec=1.0)
    for x, a, b in zip(samples, whole, some, strict=True):
        assert np.allclose(a, x * 0.5, atol=1e-6) and np.allclose(b, x * 0.5, atol=1e-6) and len(a) == len(b) == len(x)
    assert all(size <= 8000 or shape[0] == 1 for size, shape, _ in seen[1:] if shape[1] <= 1500)
    assert models.batches([5, 3, 4, 100], 60) == [[1, 2, 0], [3]]
    assert [len(g) for g in models.gathered(((i, np.zeros(10, np.float32)) for i in range(5)), 80)] == [2, 2, 1]


def test_registered_models_run_in_a_chain(spark):
    def louder(x, lengths, rate, p):
        if x.shape[0] > 1 and p.get("broken"):
            raise RuntimeError("too many")
        return x * 2

    models.BATCHED["sgmse"] = louder
    try:
        y = voice(0.2, level=0.1)
        for p in ({"chunk_sec": 0.05, "overlap_sec": 0.01}, {"broken": True}):
            done = s.run_all([(y, RATE), (y[:1000], RATE), (y, 8000)], s.compiled([{"type": "sgmse", **p}]))
            assert all(np.allclose(d[0], 2 * x, atol=1e-5) for d, x in zip(done, (y, y[:1000], y), strict=True))
    finally:
        del models.BATCHED["sgmse"]
    failed = s.run_all([(y, RATE)], s.compiled([{"type": "denoise", "backend": "sgmse"}]))
    assert isinstance(failed[0], ValueError)
    wav = m.encode_wav(y, RATE)
    df = spark.createDataFrame([(1, wav), (2, b"junk"), (3, None)], "id int, content binary")
    out = {r.id: r.p for r in df.select("id", s.process_udf([{"type": "normalize"}, {"type": "wpe"}])(df.content).alias("p")).collect()}
    assert out[1].reason is None and out[1].content and out[2].reason.startswith("audio_error") and out[3].content is None
