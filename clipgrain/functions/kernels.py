"""Numeric kernels over one clip's samples or frame scores; Spark hands them Arrow batches."""

from __future__ import annotations

import io
import wave

import numpy as np

RATE = 16_000


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Channel 0 of a PCM WAV as float32, scaled only if its peak is above one, and its rate."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    x = x[::channels]
    peak = float(np.abs(x).max(initial=0))
    return (x / peak if peak > 1 else x), rate


def resample(x: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    if rate == target or not len(x):
        return x
    n = max(1, round(len(x) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x).astype(np.float32)


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping rows of ``size`` samples; the end is padded with zeros."""
    n = max(1, 1 + -(-max(0, len(x) - size) // hop))
    padded = np.concatenate([x, np.zeros((n - 1) * hop + size - len(x), x.dtype)]) if (n - 1) * hop + size > len(x) else x
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:n]


def pitch(x: np.ndarray, rate: int, floor: float = 75.0, ceiling: float = 600.0, step: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frame centres in seconds and f0 in Hz by normalised autocorrelation; 0 is unvoiced."""
    size, hop = int(3 * rate / floor), int(rate * (step or 0.75 / floor))
    if len(x) < size:
        return np.zeros(0), np.zeros(0)
    rows = frames(x.astype(np.float64), size, hop)
    rows = (rows - rows.mean(axis=1, keepdims=True)) * np.hanning(size)
    n = 1 << (2 * size - 1).bit_length()
    own = np.fft.irfft(np.abs(np.fft.rfft(rows, n)) ** 2)[:, : size]
    window = np.fft.irfft(np.abs(np.fft.rfft(np.hanning(size), n)) ** 2)[:size]
    energy = own[:, :1]
    norm = own / np.maximum(energy, 1e-12) / np.maximum(window / window[0], 1e-3)
    low, high = max(2, int(rate / ceiling)), min(size - 2, int(rate / floor))
    band = norm[:, low : high + 1]
    peak = (band[:, 1:-1] > band[:, :-2]) & (band[:, 1:-1] >= band[:, 2:])
    # Shorter periods are preferred a little, as every multiple of a period matches as well.
    score = np.where(peak, band[:, 1:-1] - 0.01 * np.log2(np.arange(low + 1, high) * floor / rate + 1), -1)
    best = score.argmax(axis=1) + low + 1
    at = np.arange(len(norm))
    a, b, c = norm[at, best - 1], norm[at, best], norm[at, best + 1]
    bend = a - 2 * b + c
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
    loud = np.sqrt(energy[:, 0] / size) > 0.03 * max(np.abs(x).max(initial=0), 1e-9)
    voiced = (b > 0.45) & loud & (score.max(axis=1) > -1)
    return (at * hop + size / 2) / rate, np.where(voiced, rate / (best + shift), 0.0)


def intensity(x: np.ndarray, rate: int, step: float = 0.01) -> np.ndarray:
    """Level in dB over 32 ms windows."""
    size = int(0.032 * rate)
    rows = frames(x.astype(np.float64), size, int(step * rate))
    return 10 * np.log10(np.maximum((rows**2).mean(axis=1), 1e-12) / 4e-10)


def formants(x: np.ndarray, rate: int, step: float = 0.01, count: int = 3) -> np.ndarray:
    """(frame, formant) in Hz from linear prediction at 11 kHz; NaN where undefined."""
    x = resample(x, rate, 11_000)
    size = int(0.05 * 11_000)
    if len(x) < size:
        return np.full((0, count), np.nan)
    x = np.append(x[:1], x[1:] - 0.94 * x[:-1]).astype(np.float64)
    out = []
    for row in frames(x, size, int(step * 11_000)) * np.hamming(size):
        r = np.correlate(row, row, "full")[size - 1 : size + 10]
        found = np.full(count, np.nan)
        if r[0] > 1e-9:
            idx = np.abs(np.subtract.outer(np.arange(10), np.arange(10)))
            a = np.linalg.lstsq(r[idx] + 1e-9 * r[0] * np.eye(10), r[1:11], rcond=None)[0]
            z = np.roots(np.concatenate(([1], -a)))
            z = z[np.imag(z) > 0]
            f, width = np.angle(z) * 11_000 / (2 * np.pi), -np.log(np.abs(z)) * 11_000 / np.pi
            good = np.sort(f[(f > 90) & (f < 5400) & (width < 400)])[:count]
            found[: len(good)] = good
        out.append(found)
    return np.array(out)


def voiced_samples(x: np.ndarray, top_db: float = 30.0, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Mask of samples in frames within ``top_db`` of the loudest frame; frames are centred."""
    if not len(x):
        return np.zeros(0, bool)
    rows = frames(np.pad(x.astype(np.float64), size // 2), size, hop)
    level = np.sqrt((rows**2).mean(axis=1))
    loud = 20 * np.log10(np.maximum(level, 1e-10) / max(level.max(), 1e-10)) > -top_db
    return np.repeat(loud, hop)[: len(x)] if len(loud) * hop >= len(x) else np.append(np.repeat(loud, hop), np.zeros(len(x) - len(loud) * hop, bool))


def forced_alignment(log_probs: np.ndarray, targets: list[int], blank: int = 0) -> np.ndarray | None:
    """The best path of ids per frame through the targets with blanks between; None if they don't fit.

    Equal targets in a row need a blank between them. Of equal paths the one that
    moves on latest is taken.
    """
    frames_n, n = len(log_probs), len(targets)
    if not n or n + sum(a == b for a, b in zip(targets, targets[1:], strict=False)) > frames_n:
        return None
    states = np.full(2 * n + 1, blank)
    states[1::2] = targets
    skip = np.zeros(len(states), bool)
    skip[2:] = (states[2:] != blank) & (states[2:] != states[:-2])
    score = np.full(len(states), -np.inf)
    score[:2] = log_probs[0, states[:2]]
    back = np.zeros((frames_n, len(states)), np.int8)
    for t in range(1, frames_n):
        stay, one = score, np.append(-np.inf, score[:-1])
        two = np.where(skip, np.append([-np.inf, -np.inf], score[:-2]), -np.inf)
        best = np.maximum(np.maximum(stay, one), two)
        back[t] = np.where(stay == best, 0, np.where(one == best, 1, 2))
        score = best + log_probs[t, states]
    at = len(states) - 1 if score[-1] >= score[-2] else len(states) - 2
    path = np.empty(frames_n, np.int64)
    for t in range(frames_n - 1, -1, -1):
        path[t] = states[at]
        at -= back[t, at]
    return path
