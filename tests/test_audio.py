import numpy as np
import pytest

from pyspark.sql import functions as F

from koine.audio import metrics as m
from koine.audio import steps as s
from koine.audio.arrays import runs, short_runs
from koine.audio.spectra import istft, stft

RATE = 16000


def tone(seconds=1.0, freq=220.0, amp=0.5):
    return (amp * np.sin(2 * np.pi * freq * np.arange(int(RATE * seconds)) / RATE)).astype(np.float32)


def test_wav_round_trip():
    y = tone()
    z, rate = m.decode_wav(m.encode_wav(y, RATE))
    assert rate == RATE and np.abs(y - z).max() < 1e-4
    for bad in (np.zeros(0, np.float32), np.array([np.nan], np.float32)):
        with pytest.raises(ValueError):
            m.encode_wav(bad, RATE)


def test_measures():
    y = np.concatenate([tone(1.0), np.zeros(RATE, np.float32)])
    got = m.measure(y, RATE)
    assert got["duration_sec"] == 2 and abs(got["silence_ratio"] - 0.5) < 0.02 and 0.95 < got["trailing_silence_sec"] < 1.0
    assert m.measure(np.ones(RATE, np.float32), RATE)["clipping_ratio"] == 1 and m.measure(np.ones(RATE, np.float32), RATE)["dc_offset"] == 1
    rng = np.random.default_rng(0)
    noisy = np.concatenate([tone(1.0), np.zeros(RATE, np.float32)]) + rng.normal(0, 0.005, 2 * RATE).astype(np.float32)
    assert 25 < m.snr_db(noisy, RATE) < 45 and m.snr_db(tone(0.02), RATE) is None
    assert m.frame_rms(tone(0.02), RATE).size == 0 and m.cheap(np.zeros(0), RATE)["decode_ok"] is False
    assert m.cheap(tone(), RATE)["silence_ratio"] == 0


def test_resample_keeps_a_tone():
    z, rate = s.resample(tone(0.5), RATE, 8000)
    want = 0.5 * np.sin(2 * np.pi * 220 * np.arange(4000) / 8000)
    assert rate == 8000 and len(z) == 4000 and np.abs(z[200:-200] - want[200:-200]).max() < 0.01


def test_filters_pass_and_stop():
    mix = tone(1, 100) + tone(1, 4000)
    low, high = s.butterworth(mix, RATE, 1000, "low"), s.butterworth(mix, RATE, 1000, "high")
    mid = slice(2000, -2000)
    assert np.abs(low - tone(1, 100))[mid].max() < 0.02 and np.abs(high - tone(1, 4000))[mid].max() < 0.02


def test_biquad_matches_its_recurrence():
    rng = np.random.default_rng(1)
    x, b, a = rng.normal(size=300), np.array([0.2, 0.3, 0.1]), np.array([1.0, -0.9, 0.4])
    y = np.zeros(300)
    for i in range(300):
        y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k)
    assert np.abs(s._filter(x, b, a) - y).max() < 1e-9


def test_trim():
    y = np.concatenate([np.zeros(RATE, np.float32), tone(1.0), np.zeros(RATE, np.float32)])
    seconds = lambda **k: len(s.trim_silence(y, RATE, **k)) / RATE
    assert abs(seconds() - 1.1) < 0.1 and abs(seconds(sides="leading") - 2.05) < 0.1 and abs(seconds(sides="trailing") - 2.05) < 0.1
    assert abs(seconds(pad_head_ms=100, pad_tail_ms=50) - seconds() - 0.15) < 1e-4
    spike = y.copy()
    spike[-800:-700] = 0.5
    ends = lambda n, side: len(s.trim_silence(spike, RATE, sides=side, spike_frames=n)) / RATE
    assert ends(0, "trailing") > 2.9 and abs(ends(8, "trailing") - 2.05) < 0.1 and ends(8, "both") > 1.8
    assert len(s.trim_silence(np.zeros(500, np.float32), RATE)) == 500 and len(s.trim_silence(y[:0], RATE)) == 0
    broken = y.copy()
    broken[20000] = np.nan
    assert np.isfinite(s.trim_silence(broken, RATE)).all()
    with pytest.raises(ValueError):
        s.trim_silence(y, RATE, sides="start")


def test_a_recording_beyond_the_longest_is_cut_or_rejected():
    y = np.full(40 * 1000, 0.2, np.float32)
    with pytest.raises(s.Rejected, match="trim_exceeds_max_keep_sec"):
        s.trim_silence(y, 1000, 80.0, 256, 64, max_keep_sec=30.0)
    assert len(s.trim_silence(y, 1000, 80.0, 256, 64, max_keep_sec=30.0, reject_if_truncated=False)) == 30 * 1000


def test_snr_by_hand():
    """Ten frames of one level each, no overlap: percentiles 15 and 60 of ten energies lie at places 1.35 and 5.4."""
    f = m.Frames(frame_ms=10.0, hop_ms=10.0)
    levels = np.array([0.01, 0.02, 0.02, 0.03, 0.1, 0.2, 0.4, 0.5, 0.6, 0.7])
    y = np.repeat(levels, 10).astype(np.float64)
    energy = np.sort(levels**2)
    noise, signal = energy[1] + 0.35 * (energy[2] - energy[1]), energy[5] + 0.4 * (energy[6] - energy[5])
    assert abs(m.snr_db(y, 1000, f) - 10 * np.log10(signal / noise)) < 1e-6
    assert len(m.frame_levels(y, 1000, f)) == 10 and len(m.frame_rms(y, 1000, f)) == 9
    assert m.snr_db(y[:40], 1000, f) is not None and m.snr_db(y[:39], 1000, f) is None and m.snr_db(np.full(400, 0.5), 1000, f) is None


def test_diff_click_finds_either_difference():
    y = tone(0.5, 100.0, 0.3)
    jump = y.copy()
    jump[4000:] += 0.0
    jump[4000] += 0.4
    assert np.abs(s.diff_click_repair(jump, RATE) - y).max() < 0.02
    plain = s.diff_click_repair(y, RATE)
    assert np.array_equal(plain, y)
    assert np.array_equal(s.diff_click_repair(jump, 2000), jump) and np.array_equal(s.diff_click_repair(jump[:7], RATE), jump[:7])
    two = jump.copy()
    two[6000] += 0.2
    one = s.diff_click_repair(two, RATE, most=1)
    assert abs(one[4000] - y[4000]) < 0.02 and abs(one[6000] - two[6000]) < 1e-6
    step = y.copy()
    step[4000:] += 0.2  # a step has a first difference beyond the threshold; asked for both, it has a second one too
    assert not np.array_equal(s.diff_click_repair(step, RATE, both=True), step)
    assert np.array_equal(s.diff_click_repair(jump, RATE, min_jump=2.0, second=None), jump)


def test_other_formats_go_to_registered_decoders():
    m.DECODERS.append(lambda c: (np.full(4, 0.5), 8000) if c[:4] == b"FAKE" else None)
    try:
        y, rate = m.decode(b"FAKE....")
        assert rate == 8000 and y.dtype == np.float32 and len(y) == 4
        assert m.decode(m.encode_wav(tone(), RATE))[1] == RATE
        with pytest.raises(ValueError):
            m.decode(b"\x00\x01nothing")
    finally:
        m.DECODERS.pop()


def test_normalize():
    assert abs(s.loudness(s.normalize(tone(2.0, 1000), RATE, "lufs", -23), RATE) + 23) < 0.1
    assert abs(np.abs(s.normalize(tone(1.0), RATE, "peak", -6)).max() - 10 ** (-6 / 20)) < 1e-3
    assert abs(np.abs(s.normalize(tone(0.1), RATE)).max() - 10 ** (-1 / 20)) < 1e-3
    assert (s.normalize(np.zeros(100, np.float32), RATE) == 0).all()
    # a 997 Hz sine of full scale has a loudness of -3.01
    assert abs(s.loudness(tone(3.0, 997, 1.0), RATE) + 3.01) < 0.1


def test_spectra_invert():
    y = np.random.default_rng(2).normal(size=5000)
    assert np.abs(istft(stft(y, 512, 128), 512, 128, 5000) - y).max() < 1e-9


def test_noise_goes_down():
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 0.02, 2 * RATE).astype(np.float32)
    y = np.concatenate([np.zeros(RATE, np.float32), tone(1.0)]) + noise
    z = s.spectral_subtract(y, RATE, amount=4.0, lead_ms=800, trail_ms=0)
    assert np.std(z[: RATE // 2]) < 0.4 * np.std(y[: RATE // 2]) and np.abs(z[RATE + 2000 : -2000]).max() > 0.4


def test_clicks_are_repaired():
    y = tone(1.0, 100, 0.3)
    bad = y.copy()
    bad[5000:5004] += 0.8
    assert np.abs(s.diff_click_repair(bad, RATE) - y).max() < 0.05
    hole = y.copy()
    hole[1000:1010] = 0
    s.fill_hole(hole, 1000, 1010)
    assert np.abs(hole - y).max() < 0.01
    line = np.array([0.0, 1, 9, 9, 4, 5], np.float32)
    s.fill_hole(line, 2, 4, "linear")
    assert np.allclose(line, [0, 1, 2, 3, 4, 5])


def test_runs_and_merging():
    mask = np.array([1, 1, 0, 1, 0, 0, 1, 1, 1], bool)
    assert runs(mask).tolist() == [[0, 2], [3, 4], [6, 9]]
    assert short_runs(mask, 2).tolist() == [1, 1, 0, 1, 0, 0, 0, 0, 0]
    assert s.merged(np.array([[5, 6], [8, 9], [20, 30]]), 1, 1, 25) == [(4, 10), (19, 25)]


def test_compiler():
    chain = [{"type": "edge_click", "post_spectral": True}, {"type": "denoise", "backend": "none"}, {"type": "normalize"}]
    assert [x["type"] for x in s.compiled(chain)] == ["decode", "denoise", "edge_click", "normalize"]
    assert [x["type"] for x in s.compiled(chain, skip_denoise=True)] == ["decode", "normalize", "edge_click"]
    with pytest.raises(ValueError):
        s.compiled([{"type": "magic"}])
    s.BACKENDS["sidon"] = lambda y, rate, p: y * 2
    assert np.allclose(s.run(tone(), RATE, s.compiled([{"type": "sidon"}]))[0], 2 * tone())
    del s.BACKENDS["sidon"]


def test_in_spark(spark, tmp_path):
    from koine.sources.tables import audio_files

    (tmp_path / "a.wav").write_bytes(m.encode_wav(np.concatenate([tone(), np.zeros(RATE, np.float32)]), RATE))
    (tmp_path / "b.wav").write_bytes(b"no recording")
    files = audio_files(spark, str(tmp_path))
    out = {r.path[-5:]: r for r in files.select("path", m.metrics_udf("content").alias("m"), m.cheap_udf("content").alias("c"), s.process_udf([{"type": "trim_silence"}])(F.col("content")).alias("p")).collect()}
    assert out["a.wav"].m.duration_sec == 2 and out["a.wav"].p.reason is None and m.decode_wav(out["a.wav"].p.content)[0].size < 1.2 * RATE
    assert out["b.wav"].m.duration_sec is None and out["b.wav"].c.decode_ok is False and out["b.wav"].p.reason.startswith("audio_error")
