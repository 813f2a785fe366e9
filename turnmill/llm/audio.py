"""Telephony audio columns.

`store` keeps bytes as the samples of a WAV file (a binary column of a Parquet table in the
shared folder): as 8-bit mu-law or A-law, or as the 4-bit codes of IMA ADPCM blocks.  `decode`
expands mu-law and A-law by lookup tables and IMA ADPCM by stepping through the samples of all
blocks at once with numpy, `resample` changes the rate with a windowed-sinc filter in whole
numbers, `decoded` gives the resampled PCM of a table of files, and `described` the features and
digest of stored PCM.

PCM is stored as 16-bit samples, low and high bytes apart (`packed_pcm`), at a rate that is a parameter; its
samples are weighted sums of many decoded ones and stand in no other column.  Whole numbers give the
same samples on every machine.

A null text is empty.  Payloads are padded with bytes 0 to a positive multiple of 64, so an
empty text is 64 samples.  Equal texts give equal files and features.  A file of another format
raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
RATE, UNIT = 8000, 64
#: Bytes that head an ADPCM block, bits of the filter's whole-number coefficients, and its taps where the rate doesn't fall.
HEAD, BITS, TAPS = 4, 14, 16
#: Level of the stored tables' compression.
LEVEL = 9
#: Forms that a hash of the payload picks from: an ADPCM file decodes to twice as many samples, so there are fewer of them.
KINDS = (MULAW, ALAW, MULAW, ALAW, MULAW, ALAW, MULAW, IMA)
#: The stored PCM's rate is RATE * UP / DOWN.
UP, DOWN = 1, 4
#: PCM that a batch of decoded files holds before the next begins.
BYTES_AT_ONCE = 16 << 20

#: Step sizes and index changes of IMA ADPCM.  Fixed values.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
    1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int64) ^ 0x55
    step, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(step == 0, low + 8, low + 0x108 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(samples: bytes, kind: int = MULAW, rate: int = RATE, bits: int = 8, block: int = 1, extra: bytes = b"") -> bytes:
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * block, block, bits) + (struct.pack("<H", len(extra)) + extra if kind != PCM else b"")
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(file: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and sample bytes of a mono WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        found[name] = file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    kind, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or kind not in (PCM, ALAW, MULAW, IMA):
        raise ValueError(f"format {kind} with {channels} channels")
    return kind, rate, block, found[b"data"]


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks; all blocks advance together, sample by sample."""
    blocks = np.frombuffer(data, np.uint8)[: len(data) // block * block].reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = blocks[:, 2].astype(np.int64).clip(0, len(STEPS) - 1)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1).astype(np.int64)
    steps, changes = np.array(STEPS), np.array(CHANGES)
    out = np.empty((len(blocks), nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], steps[index]
        size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + changes[code & 7], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.ravel()


def decode(file: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and their rate."""
    kind, rate, block, data = parse(file)
    if kind == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
    if kind == IMA:
        return decode_ima(data, block), rate
    return _TABLES[kind][np.frombuffer(data, np.uint8)], rate


def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A Hann-windowed sinc for each of `up` phases (taps x up), in units of 1 / 2^BITS."""
    cut = min(1.0, up / down)
    t = np.arange(taps)[:, None] - (taps / 2 - 1) - np.arange(up)[None, :] / up
    bank = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (taps / 2), -1, 1)))
    return np.rint(bank / bank.sum(0) * (1 << BITS)).astype(np.int32)


def taps_for(up: int, down: int) -> int:
    """Taps of the filter: more where the rate falls, as its cut-off does."""
    return TAPS * max(1, -(-down // up))


def resample(samples: np.ndarray, up: int, down: int, at_once: int = 1 << 16) -> np.ndarray:
    """The samples at up / down times their rate, clipped to 16 bits; a bounded part at a time."""
    taps = taps_for(up, down)
    bank, length = _filter(up, down, taps), -(-len(samples) * up // down)
    padded = np.pad(samples.astype(np.int32), (taps // 2 - 1, taps // 2 + down))
    out = np.empty(length, np.int16)
    for r in range(up):  # every `up`-th output has the same phase, and begins `down` samples after the one before
        begin, phase = divmod(r * down, up)
        mine = out[r::up]
        for k in range(0, len(mine), at_once):
            n = min(at_once, len(mine) - k)
            total = np.full(n, 1 << (BITS - 1), np.int32)
            for t in np.flatnonzero(bank[:, phase]).tolist():
                first = begin + k * down + t
                total += padded[first : first + (n - 1) * down + 1 : down] * bank[t, phase]
            mine[k : k + n] = np.clip(total >> BITS, -32768, 32767)
    return out


def packed_pcm(pcm: np.ndarray) -> tuple[bytes, bytes]:
    """The low and the high bytes of 16-bit samples: a table's compression finds more in each alone."""
    low, high = pcm.astype("<i2").view(np.uint8).reshape(-1, 2).T
    return low.tobytes(), high.tobytes()


def unpacked_pcm(low: bytes, high: bytes) -> np.ndarray:
    return np.stack([np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)], 1).view("<i2").ravel()


def features(pcm: np.ndarray, rate: int) -> str:
    """Seconds, loudness, peak, crossings of zero and the share of energy in changes."""
    x = pcm.astype(np.float64)
    energy = float(x @ x)
    changes = np.diff(x)
    return f"rate={rate};n={len(x)};rms={(energy / max(1, len(x))) ** 0.5:.3f};peak={int(np.abs(x).max(initial=0))};zero={int(np.count_nonzero(np.diff(np.signbit(x))))};change={float(changes @ changes) / energy if energy else 0.0:.4f}"


def coded(payload: bytes, kind: int) -> bytes:
    """A WAV file whose samples are the payload's bytes, or in ADPCM the codes of blocks of UNIT bytes that begin at 0."""
    if kind != IMA:
        return wav(payload, kind)
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return wav(np.pad(blocks, ((0, 0), (HEAD, 0))).tobytes(), IMA, bits=4, block=HEAD + UNIT)


def payload_of(file: bytes) -> bytes:
    """What `coded` was given."""
    kind, _, block, data = parse(file)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, HEAD:].tobytes() if kind == IMA else data


def store(docs: DataFrame, kinds: tuple[int, ...] = KINDS) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file of the padded text), written and read back; a hash of the payload picks one of the kinds."""

    def make(batches):
        for batch in batches:
            files, sizes = [], []
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py()
                sizes.append(len(raw))
                payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")
                files.append(coded(payload, kinds[zlib.crc32(payload) % len(kinds)]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(files, pa.binary())})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return saved(source.mapInArrow(make, "doc_id long, n_bytes long, media binary"), "media", LEVEL)


def decoded(files: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """The files' columns without media, their digests, the payload's, and the resampled PCM (as `packed_pcm` has it) with its rate."""
    kept = [c for c in files.columns if c != "media"]

    def read(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "rate", "pcm_low", "pcm_high")}
                start, held = at, 0
                while at < batch.num_rows and held < BYTES_AT_ONCE:
                    file = batch.column("media")[at].as_py()
                    payload = payload_of(file)
                    samples, rate = decode(file)
                    low, high = packed_pcm(resample(samples, up, down))
                    rows["payload_bytes"].append(len(payload))
                    rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                    rows["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
                    rows["media_bytes"].append(len(file))
                    rows["media_sha256"].append(hashlib.sha256(file).hexdigest())
                    rows["rate"].append(rate * up // down)
                    rows["pcm_low"].append(low)
                    rows["pcm_high"].append(high)
                    at, held = at + 1, held + 2 * len(low)
                kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "rate": pa.int64(), "pcm_low": pa.binary(), "pcm_high": pa.binary()}
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(start, at - start) for c in kept} | {c: pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()})

    given = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.mapInArrow(read, f"{given}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, rate long, pcm_low binary, pcm_high binary")


def described(stored: DataFrame) -> DataFrame:
    """The columns of decoded files without rate and pcm, with the features and digest of the PCM (as little-endian 16-bit samples)."""
    kept = [c for c in stored.columns if c not in ("rate", "pcm_low", "pcm_high")]

    def read(batches):
        for batch in batches:
            rows = {"feature": [], "pcm_sha256": []}
            for low, high, rate in zip(batch.column("pcm_low"), batch.column("pcm_high"), batch.column("rate"), strict=True):
                pcm = unpacked_pcm(low.as_py(), high.as_py())
                rows["feature"].append(features(pcm, rate.as_py()))
                rows["pcm_sha256"].append(hashlib.sha256(pcm.astype("<i2").tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {c: pa.array(v, pa.string()) for c, v in rows.items()})

    given = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in kept)
    return stored.mapInArrow(read, f"{given}, feature string, pcm_sha256 string")
