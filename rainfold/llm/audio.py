"""Telephony audio as DataFrame columns: G.711 mu-law and A-law, IMA ADPCM, resampled PCM.

`pack` puts code bytes into WAVE containers, `unpack` parses the containers again, expands the codes (companded codes by
a lookup table, ADPCM blocks by numpy with all blocks of a slice of rows side by side) and resamples to 16-bit PCM.
Rows are independent, so both are maps without a shuffle; memory is bounded by a slice of some MB or one longer row.

Null or empty payloads are stored as an empty data chunk. Repeated rows give a row each, an empty table gives none. Bytes of an
unknown codec name raise a ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.llm.common import batch_of, fields, in_batches, slices

#: Format tags of WAVE containers (fixed values of that format).
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
#: Data bytes of an ADPCM block beside its header of four bytes.
ADPCM_DATA = 192
#: Step sizes and index moves of IMA ADPCM (fixed values of that format).
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code: complemented, sign, three bits of segment, four of step, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code: every other bit inverted, set sign bit means positive."""
    code = np.arange(256) ^ 0x55
    segment, step = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(segment == 0, step, (step + 256) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def compress(pcm: np.ndarray, codec: str) -> bytes:
    """The nearest G.711 code of each 16-bit sample (the smaller code on ties)."""
    values = TABLES[codec].astype(np.int32)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    at = np.clip(np.searchsorted(ranked, pcm.astype(np.int32)), 1, 255)
    lower = pcm - ranked[at - 1] <= ranked[at] - pcm
    return order[np.where(lower, at - 1, at)].astype(np.uint8).tobytes()


def wave(codec: str, payload: bytes, rate: int = 8000) -> bytes:
    """A WAVE container that holds the payload's bytes unchanged; ADPCM blocks start from silence."""
    if codec == "ima_adpcm":
        body = np.frombuffer(payload + b"\0" * (-len(payload) % ADPCM_DATA), np.uint8).reshape(-1, ADPCM_DATA)
        data = np.hstack([np.zeros((len(body), 4), np.uint8), body]).tobytes()
        align, per_block, bits = ADPCM_DATA + 4, 2 * ADPCM_DATA + 1, 4
        extra = struct.pack("<HH", 2, per_block)
        fact = (len(body)) * per_block
    else:
        data, align, bits, extra, fact = payload, 1, 8, struct.pack("<H", 0), len(payload)
        per_block = 1
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // per_block, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, fact)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wave(media: bytes) -> tuple[str, int, memoryview]:
    """(codec, sample rate, data bytes) of a container."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE container")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), "")
        if name == b"data":
            if not codec:
                raise ValueError("unknown codec")
            return codec, rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (one a row, header included): one step for all blocks at a time."""
    n = len(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = blocks[:, 4:]
    nibbles = np.empty((2 * codes.shape[1], n), np.uint8)
    nibbles[0::2], nibbles[1::2] = (codes & 15).T, (codes >> 4).T
    out = np.empty((nibbles.shape[0] + 1, n), np.int16)
    out[0] = value
    # change and next index for each (index, nibble), so that a step is two gathers
    steps, nibble = IMA_STEPS[:, None], np.arange(16)[None, :]
    change = (steps >> 3) + (steps >> 2) * ((nibble & 1) > 0) + (steps >> 1) * ((nibble & 2) > 0) + steps * ((nibble & 4) > 0)
    change = np.where(nibble & 8, -change, change).astype(np.int32).ravel()
    after = np.clip(np.arange(89)[:, None] + IMA_MOVES[None, :], 0, 88).astype(np.int32).ravel()
    for t in range(len(nibbles)):
        cell = (index << 4) | nibbles[t]
        value = np.clip(value + change[cell], -32768, 32767)
        index = after[cell]
        out[t + 1] = value
    return out.T


def lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Whole-number taps (unit 2**14) of a Hamming-windowed sinc for a rate change of up/down."""
    wide = max(up, down)
    at = np.arange(-half * wide, half * wide + 1)
    taps = np.sinc(at / wide) * np.hamming(len(at)) * (up / wide)
    return np.round(taps * 2**14)


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational rate change; sums of whole numbers in doubles are exact, so any machine gives the same samples."""
    if up == down or not len(pcm):
        return pcm
    taps = lowpass(up, down)
    middle = len(taps) // 2
    source, out = pcm.astype(np.float64), np.empty(len(pcm) * up)
    for phase in range(up):
        part = taps[(middle + phase) % up :: up]
        lead = (middle + phase) // up
        out[phase::up] = np.convolve(source, part)[lead : lead + len(pcm)]
    return np.clip(np.floor(out[::down] / 2**14 + 0.5), -32768, 32767).astype("<i2")


def pack(df: DataFrame, payload: str, codec: str, keep: Sequence[str] = (), rate: int = 8000) -> DataFrame:
    """keep + (media BINARY): the payload column's bytes in a container of the codec named in the column `codec`."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["payload__"]):
            rows = zip(b.column("payload__").to_pylist(), b.column("codec__").to_pylist(), strict=True)
            yield batch_of(b, keep, media=pa.array([wave(c, p or b"", rate) for p, c in rows], pa.binary()))

    made = in_batches(df).select(*keep, F.col(payload).alias("payload__"), F.col(codec).alias("codec__"))
    return made.mapInArrow(kernel, ", ".join(filter(None, [fields(df, keep), "media binary"])))


def unpack(df: DataFrame, media: str = "media", keep: Sequence[str] = (), target_rate: int = 16000) -> DataFrame:
    """keep + (codec, payload, pcm, samples, peak, crossings, energy): what a container holds, read back.

    pcm is little-endian 16-bit mono at target_rate; peak, sign changes and the energy (sum of squares) are whole numbers.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["media__"]):
            parsed = [parse_wave(m) for m in b.column("media__").to_pylist()]
            coded = [np.frombuffer(d, np.uint8).reshape(-1, ADPCM_DATA + 4) if c == "ima_adpcm" else None for c, _, d in parsed]
            some = [x for x in coded if x is not None and len(x)]
            plain, at = decode_adpcm(np.concatenate(some)) if some else None, 0
            out: dict[str, list] = {k: [] for k in ("codec", "payload", "pcm", "samples", "peak", "crossings", "energy")}
            for (codec, rate, data), blocks in zip(parsed, coded, strict=True):
                if blocks is None:
                    payload, pcm = bytes(data), TABLES[codec][np.frombuffer(data, np.uint8)]
                else:
                    payload = blocks[:, 4:].tobytes()
                    pcm = plain[at : at + len(blocks)].reshape(-1) if len(blocks) else np.empty(0, np.int16)
                    at += len(blocks)
                common = np.gcd(rate, target_rate)
                pcm = resample(pcm, int(target_rate // common), int(rate // common))
                wide = pcm.astype(np.float64)
                signs = pcm < 0
                row = (codec, payload, pcm.astype("<i2").tobytes(), len(pcm), int(np.abs(wide).max(initial=0)), int((signs[1:] != signs[:-1]).sum()), int(np.dot(wide, wide)))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = {"codec": pa.string(), "payload": pa.binary(), "pcm": pa.binary()}
            yield batch_of(b, keep, **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    added = "codec string, payload binary, pcm binary, samples bigint, peak bigint, crossings bigint, energy bigint"
    made = in_batches(df).select(*keep, F.col(media).alias("media__"))
    return made.mapInArrow(kernel, ", ".join(filter(None, [fields(df, keep), added])))


def text_payload(text: str = "text", unit: int = 192) -> F.Column:
    """UTF-8 bytes of a text (null: none), spaces appended up to a positive multiple of `unit`."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(raw, F.expr("cast(repeat(' ', " + str(unit) + ") as binary)").substr(F.lit(1), pad))


def media_digest(docs: DataFrame) -> DataFrame:
    """Every text as telephony audio, read back: the contract columns of op1, the codec and the PCM's size and digest.

    The payload's CRC-32 modulo 3 picks the codec, so equal texts get equal media. Null texts are empty: 192 spaces.
    """
    made = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("n_bytes"), text_payload().alias("payload"))
    codec = F.element_at(F.array(*[F.lit(c) for c in TAGS]), (F.crc32("payload") % 3 + 1).cast("int"))
    packed = pack(made.withColumn("codec_in", codec), "payload", "codec_in", ["doc_id", "n_bytes"])
    stored = packed.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    got = unpack(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("samples=%d;peak=%d;crossings=%d;energy=%d", "samples", "peak", "crossings", "energy").alias("feature"),
        "codec",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.crc32("pcm").alias("pcm_crc32"),
    )
