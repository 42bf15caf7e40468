"""Short-time spectra."""

from __future__ import annotations

import numpy as np

def stft(y: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Centred short-time spectra with a Hann window: frames by bins."""
    padded = np.pad(y, size // 2, mode="reflect" if len(y) > size // 2 else "constant")
    n = 1 + max(0, len(padded) - size) // hop
    window = np.hanning(size + 1)[:-1]
    frames = np.stack([padded[i * hop : i * hop + size] for i in range(n)])
    return np.fft.rfft(frames * window, axis=1)


def istft(spectra: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    window = np.hanning(size + 1)[:-1]
    out, norm = np.zeros(hop * (len(spectra) - 1) + size), np.zeros(hop * (len(spectra) - 1) + size)
    for i, f in enumerate(np.fft.irfft(spectra, size, axis=1)):
        out[i * hop : i * hop + size] += f * window
        norm[i * hop : i * hop + size] += window**2
    whole = (out / np.maximum(norm, 1e-8))[size // 2 :]
    return np.pad(whole, (0, max(0, length - len(whole))))[:length]
