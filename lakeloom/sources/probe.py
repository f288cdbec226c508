"""What the headers of media files say, and hooks for decoders that read more than headers.

Only the head and the tail of a file are read, on the executors. Pictures and samples need a decoder, which is
given as a function of a path and runs on the executors too.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.media import MKV_CODECS, supported_codec
from lakeloom.operators import kernels

HEAD, TAIL = 1 << 20, 1 << 17
#: Extensions that are known but not supported whatever they hold; fixed values.
REFUSED = ("mp4", "mov", "m4a")
#: Element numbers of the Matroska format; fixed values.
_SEGMENT, _INFO, _SCALE, _DURATION, _TRACKS, _ENTRY, _TYPE, _CODEC, _VIDEO, _WIDTH, _HEIGHT, _AUDIO, _RATE, _CHANNELS, _BITS = (
    0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x83, 0x86, 0xE0, 0xB0, 0xBA, 0xE1, 0xB5, 0x9F, 0x6264,
)
_PARENTS = (_SEGMENT, _INFO, _TRACKS, _ENTRY, _VIDEO, _AUDIO)
FIELDS = {"media_type": pa.string(), "container": pa.string(), "codec": pa.string(), "width": pa.int32(), "height": pa.int32(), "sample_rate": pa.int32(), "channels": pa.int32(), "bit_depth": pa.int32(), "duration_s": pa.float64()}
_SQL = ", ".join(f"{n} {({pa.string(): 'string', pa.int32(): 'int', pa.float64(): 'double'})[t]}" for n, t in FIELDS.items())


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A number of variable length, where it ends, and whether all its bits are set (an unknown size)."""
    first = data[at]
    n = 9 - first.bit_length()
    if not first or at + n > len(data):
        raise ValueError("a broken number")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << 7 * n) - 1)
    return raw if keep_marker else value, at + n, value == (1 << 7 * n) - 1


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Elements in order; those that hold others come before what they hold. A cut end is no error."""
    at = 0
    while at < len(data):
        try:
            number, at, _ = _vint(data, at, True)
            size, at, unknown = _vint(data, at, False)
        except (IndexError, ValueError):
            return
        if number in _PARENTS:
            yield number, b""
            continue  # what is inside follows
        yield number, data[at : at + size]
        at = len(data) if unknown else at + size


def _matroska(data: bytes) -> dict | None:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        return None
    out: dict = {"container": "webm" if b"webm" in data[:64] else "mkv"}
    scale, duration, track, place = 1_000_000, None, 0, None
    number = lambda b: struct.unpack(">f" if len(b) == 4 else ">d", b)[0] if len(b) in (4, 8) else 0.0
    whole = lambda b: int.from_bytes(b, "big")
    for e, body in _elements(data[4 + _skip(data) :]):
        if e == _ENTRY:
            track += 1
        if e in _PARENTS:
            place = e
        elif e == _SCALE:
            scale = whole(body)
        elif e == _DURATION and place == _INFO:
            duration = number(body)
        elif track != 1:
            continue  # the first track speaks for the file
        elif e == _CODEC:
            out["codec"] = body.rstrip(b"\0").decode("ascii", "replace")
        elif place == _VIDEO and e in (_WIDTH, _HEIGHT):
            out["width" if e == _WIDTH else "height"] = whole(body)
        elif place == _AUDIO and e == _RATE:
            out["sample_rate"] = int(number(body))
        elif place == _AUDIO and e in (_CHANNELS, _BITS):
            out["channels" if e == _CHANNELS else "bit_depth"] = whole(body)
    if "codec" not in out:
        return None
    out["media_type"] = "audio" if out["codec"] in MKV_CODECS and out["codec"].startswith("A_") else "video"
    out["codec"] = MKV_CODECS.get(out["codec"], out["codec"].lower())
    if duration is not None:
        out["duration_s"] = duration * scale / 1e9
    return out


def _skip(data: bytes) -> int:
    """Bytes of the file's first element after its number."""
    size, at, _ = _vint(data, 4, False)
    return at - 4 + size


def _wave(data: bytes) -> dict | None:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form, frames = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data" and form:
            frames = size // max(1, form[4])
            break
        at += 8 + size + (size & 1)
    if form is None:
        return None
    return {"media_type": "audio", "container": "wav", "codec": "wav", "channels": form[1], "sample_rate": form[2], "bit_depth": form[5], "duration_s": None if frames is None else frames / max(1, form[2])}


def _flac(data: bytes) -> dict | None:
    if data[:4] != b"fLaC" or len(data) < 26 or data[4] & 127:
        return None
    bits = int.from_bytes(data[18:26], "big")
    rate, frames = bits >> 44, bits & ((1 << 36) - 1)
    return {"media_type": "audio", "container": "flac", "codec": "flac", "sample_rate": rate, "channels": (bits >> 41 & 7) + 1, "bit_depth": (bits >> 36 & 31) + 1, "duration_s": frames / max(1, rate) if frames else None}


def _ogg(data: bytes, tail: bytes) -> dict | None:
    if data[:4] != b"OggS" or len(data) < 28:
        return None
    packet = data[27 + data[26] :]
    last = tail.rfind(b"OggS")
    frames = struct.unpack_from("<q", tail, last + 6)[0] if 0 <= last <= len(tail) - 14 else None
    out = {"media_type": "audio", "container": "ogg"}
    if packet[:8] == b"OpusHead" and len(packet) >= 19:
        skip = struct.unpack_from("<H", packet, 10)[0]
        return out | {"codec": "opus", "channels": packet[9], "sample_rate": 48000, "duration_s": None if frames is None else max(0, frames - skip) / 48000}
    if packet[:7] == b"\x01vorbis" and len(packet) >= 30:
        rate = struct.unpack_from("<I", packet, 12)[0]
        return out | {"codec": "vorbis", "channels": packet[11], "sample_rate": rate, "duration_s": None if frames is None else max(0, frames) / max(1, rate)}
    return None


def probe_bytes(head: bytes, tail: bytes, extension: str) -> dict | None:
    """What a file's head and tail say, or None where nothing knows the format."""
    for found in (_matroska, _wave, _flac):
        try:
            if (out := found(head)) is not None:
                return out
        except (IndexError, ValueError, struct.error):
            continue
    if (out := _ogg(head, tail)) is not None:
        return out
    if extension.lower() in REFUSED:
        return {"media_type": "video", "container": "mov" if extension.lower() == "mov" else "mp4", "codec": None}
    return None


def _ends(path: str) -> tuple[bytes, bytes]:
    with open(path, "rb") as f:
        head = f.read(HEAD)
        size = f.seek(0, os.SEEK_END)
        f.seek(max(0, size - TAIL))
        return head, f.read(TAIL)


def probe_files(files: DataFrame, path_col: str = "path", once: bool = False) -> DataFrame:
    """files with FIELDS, supported, and status: ok, unsupported (no format or codec that is known to be open) or failed (with probe_error).

    A file whose header can't be read fails; one that nothing knows is unsupported, which is no damage. A path that several
    rows have is read once and joined back; with `once`, rows are known to have a path each, and are read where they are.
    """
    if clash := {*FIELDS, "probe_path", "supported", "status", "probe_error"} & {*files.columns}:
        files = files.drop(*clash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows, errors = [], []
            for path in rb.column(rb.schema.get_field_index(path_col if once else "probe_path")).to_pylist():
                if path is None:
                    rows.append({})
                    errors.append(None)
                    continue
                try:
                    rows.append(probe_bytes(*_ends(path), os.path.splitext(path)[1].lstrip(".")) or {})
                    errors.append(None)
                except OSError as e:
                    rows.append({})
                    errors.append(f"{type(e).__name__}: {e.strerror}")
            cols = [pa.array([r.get(n) for r in rows], t) for n, t in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*rb.columns, *cols, pa.array(errors, pa.string())], names=[*rb.schema.names, *FIELDS, "probe_error"])

    if once:
        given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
        joined = files.mapInArrow(run, f"{given}, {_SQL}, probe_error string")
    else:
        found = files.select(F.col(path_col).alias("probe_path")).where("probe_path is not null").distinct().mapInArrow(run, f"probe_path string, {_SQL}, probe_error string")
        joined = files.join(found, files[path_col] == found["probe_path"], "left").drop("probe_path")
    known = F.coalesce(supported_codec(F.col("codec")), F.lit(False))
    status = F.when(F.col("probe_error").isNotNull(), "failed").when(known, "ok").otherwise("unsupported")
    return joined.withColumn("supported", known).withColumn("status", status)


def technical_of(kind: Column, codec: Column, width: Column, height: Column, seconds: Column) -> Column:
    """Struct of media_type, codec, container (empty), supported, width, height and duration_s; pictures are unknown and unsupported."""
    picture, video = kind == "image", kind == "video"
    named = F.when(picture, "image").otherwise(F.coalesce(codec, F.lit("")))
    return F.struct(
        F.when(kind.isin("audio", "video"), kind).otherwise("unknown").alias("media_type"), named.alias("codec"), F.lit("").alias("container"), (~picture & supported_codec(named)).alias("supported"),
        F.when(video, width).alias("width"), F.when(video, height).alias("height"), seconds.alias("duration_s"),
    )


Frame = tuple[bytes, int, int]


def hash_videos(files: DataFrame, middle_frame: Callable[[str], Frame | None], path_col: str = "path") -> DataFrame:
    """(path, hash): the difference hash of each file's middle frame, null where the decoder gives none.

    middle_frame(path) decodes the frame at half the duration: its RGBA bytes, width and height.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            frames = [middle_frame(p) for p in rb.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([None if f is None else kernels.dhash(*f) for f in frames], pa.int64())], names=["path", "hash"])

    return files.select(F.col(path_col).alias("path")).where("path is not null").mapInArrow(run, "path string, hash long")


def fingerprint_audio(files: DataFrame, decode: Callable[[str], tuple | None], windows: int = 8, path_col: str = "path") -> DataFrame:
    """(path, fingerprint): null where the decoder gives nothing. decode(path) gives all samples, interleaved, and the number of channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path in rb.column(0):
                pcm = decode(path.as_py())
                value = None if pcm is None else kernels.audio_fingerprint(pcm[0], pcm[1], windows)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([value], pa.list_(pa.float32()))], names=["path", "fingerprint"])

    return files.select(F.col(path_col).alias("path")).where("path is not null").mapInArrow(run, "path string, fingerprint array<float>")


def decode_frames(files: DataFrame, frames: Callable[[str], Iterator[Frame]], max_frames: int, stride: int = 1, path_col: str = "path") -> DataFrame:
    """(asset_id, frame, data, width, height) of every stride-th of the first max_frames frames; a batch of Arrow holds one frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path in rb.column(0).to_pylist():
                for i, (data, width, height) in enumerate(frames(path)):
                    if i >= max_frames:
                        break
                    if i % stride == 0:
                        cols = ([path], pa.string()), ([i], pa.int32()), ([data], pa.binary()), ([width], pa.int32()), ([height], pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], names=["asset_id", "frame", "data", "width", "height"])

    return files.select(F.col(path_col).alias("path")).where("path is not null").mapInArrow(run, "asset_id string, frame int, data binary, width int, height int")
