"""Audio values to mono waveforms, with pluggable decoders and resampler.

These are the per-row helpers of the encoding and feature jobs; they run inside
Spark tasks on one audio value at a time.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from voxloom.vocab import SAMPLE_RATE

# bytes -> (samples, or samples by channel; sample rate)
Decoder = Callable[[bytes], tuple[np.ndarray, int]]
# samples, from rate, to rate -> samples
Resampler = Callable[[np.ndarray, int, int], np.ndarray]


class AudioError(ValueError):
    """A row's audio cannot be used; the message becomes the row's error."""


def wav_decoder(data: bytes) -> tuple[np.ndarray, int]:
    """Uncompressed 8-, 16- or 32-bit WAV."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise AudioError(f"unsupported sample width {width}")
    return (samples.reshape(-1, channels) if channels > 1 else samples), rate


def installed_decoders() -> list[Decoder]:
    """Decoders for compressed formats, if their libraries are present, then WAV."""
    found: list[Decoder] = []
    try:
        import soundfile

        found.append(lambda data: soundfile.read(io.BytesIO(data), dtype="float32"))
    except ImportError:
        pass
    try:
        import librosa

        found.append(lambda data: librosa.load(io.BytesIO(data), sr=None, mono=True))
    except ImportError:
        pass
    return [*found, wav_decoder]


def installed_resampler() -> Resampler | None:
    """A resampler, if its library is present."""
    try:
        import librosa
    except ImportError:
        return None
    return lambda samples, rate, target: librosa.resample(samples, orig_sr=rate, target_sr=target)


@dataclass(frozen=True)
class AudioLoader:
    """Bytes or decoded samples to a mono float32 waveform at the codec's rate."""

    decoders: Sequence[Decoder] = (wav_decoder,)
    resampler: Resampler | None = None
    sample_rate: int = SAMPLE_RATE

    def load(
        self, data: bytes | None = None, array: Sequence[float] | None = None, rate: int | None = None
    ) -> np.ndarray:
        """Decoded samples win over bytes; channels are averaged on the bytes path only."""
        if array is not None:
            samples = np.asarray(array, dtype=np.float32)
        elif data is not None:
            samples, rate = self._decode(bytes(data))
            if samples.ndim > 1:
                samples = samples.mean(axis=1)
        else:
            raise AudioError("unsupported_audio")
        if rate != self.sample_rate:
            if self.resampler is None:
                raise AudioError("no_resampler")
            samples = self.resampler(samples, int(rate or 0), self.sample_rate)
        return np.asarray(samples, dtype=np.float32)

    def _decode(self, data: bytes) -> tuple[np.ndarray, int]:
        last: Exception = AudioError("no_decoder")
        for decode in self.decoders:
            try:
                return decode(data)
            except Exception as exc:  # the next decoder may know the format
                last = exc
        raise last
