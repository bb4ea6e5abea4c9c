"""Spectral features of a waveform, from published definitions, in NumPy.

Frames are ``hop`` apart and centred, with a Hann window of ``size`` samples and
zero padding at the ends. Mel filters are triangles on the O'Shaughnessy scale
with unit area. Parity with any library's last digits is not claimed.
"""

from __future__ import annotations

import numpy as np

SIZE = 2048
COEFFICIENTS = 13


def frames(y: np.ndarray, hop: int, size: int = SIZE) -> np.ndarray:
    """(frames, size) centred frames."""
    padded = np.pad(y, size // 2)
    n = 1 + max(0, len(padded) - size) // hop
    return np.lib.stride_tricks.sliding_window_view(padded, size)[:: hop][:n]


def power(y: np.ndarray, hop: int, size: int = SIZE) -> np.ndarray:
    """(frames, bins) squared magnitudes."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(frames(y, hop, size) * window, axis=1)) ** 2


def mel_filters(rate: float, size: int = SIZE, count: int = 128) -> np.ndarray:
    """(count, bins) triangular filters of unit area."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), count + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def decibels(p: np.ndarray, floor: float = 80.0) -> np.ndarray:
    """Ten times the logarithm, no lower than ``floor`` under the maximum."""
    db = 10 * np.log10(np.maximum(p, 1e-10))
    return np.maximum(db, db.max(initial=-100.0) - floor)


def onset_strength(y: np.ndarray, rate: float, hop: int) -> np.ndarray:
    """Mean positive change of the log-mel spectrum from frame to frame."""
    mel = decibels(power(y, hop) @ mel_filters(rate).T)
    return np.concatenate([[0.0], np.maximum(0, np.diff(mel, axis=0)).mean(axis=1)])


def mfcc(y: np.ndarray, rate: float, hop: int, count: int = COEFFICIENTS) -> np.ndarray:
    """(frames, count) orthonormal cosine transform of the log-mel spectrum."""
    mel = decibels(power(y, hop) @ mel_filters(rate).T)
    n = mel.shape[1]
    basis = np.cos(np.pi / n * np.outer(np.arange(count), np.arange(n) + 0.5)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return mel @ basis.T


def tempo(onset: np.ndarray, frames_per_second: float) -> float | None:
    """Beats a minute from the autocorrelation of onsets, near 120; none if silent."""
    if not len(onset) or onset.max() <= 0:
        return None
    x = onset - onset.mean()
    lags = np.arange(1, len(x))
    bpm = 60 * frames_per_second / lags
    ok = (bpm >= 30) & (bpm <= 300)
    if not ok.any():
        return None
    corr = np.array([np.dot(x[k:], x[:-k]) for k in lags[ok]])
    return float(bpm[ok][np.argmax(corr * np.exp(-0.5 * np.log2(bpm[ok] / 120) ** 2))])


def sound_features(y: np.ndarray, rate: float, hop_seconds: float = 0.05) -> dict:
    """Frame features of a sound, their means, and its tempo."""
    if y.ndim > 1:
        y = y.mean(axis=-1)
    hop = max(1, int(rate * hop_seconds))
    p = power(y, hop)
    f = np.fft.rfftfreq(SIZE, 1 / rate)
    mag = np.sqrt(p)
    total = np.maximum(mag.sum(1), 1e-12)
    centroid = (mag @ f) / total
    bandwidth = np.sqrt((mag * (f - centroid[:, None]) ** 2).sum(1) / total)
    flat = np.exp(np.log(np.maximum(p, 1e-10)).mean(1)) / np.maximum(p, 1e-10).mean(1)
    fr = frames(y, hop, hop)
    rms = np.sqrt((fr**2).mean(1))
    crossing = (np.diff(np.signbit(fr), axis=1)).mean(1)
    coeff = mfcc(y, rate, hop)
    return {
        "average_rms": float(rms.mean()), "peak_rms": float(rms.max()), "average_spectral_centroid": float(centroid.mean()), "average_spectral_bandwidth": float(bandwidth.mean()),
        "average_spectral_flatness": float(flat.mean()), "average_zero_crossing_rate": float(crossing.mean()), "estimated_tempo": tempo(onset_strength(y, rate, hop), rate / hop),
        "mfcc_means": coeff.mean(0).tolist(), "frames": len(rms),
    }
