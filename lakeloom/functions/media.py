"""Classification of files by extension and codec, and projection of probe results."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import ascii_fold

# Extensions, containers and codecs that the classification must know.
VIDEO_EXTENSIONS = ("mov", "mp4", "m4v", "mkv", "avi", "webm", "mts", "m2ts", "mxf", "wmv", "flv", "mpg", "mpeg", "dv")
AUDIO_EXTENSIONS = ("wav", "aiff", "aif", "mp3", "aac", "m4a", "flac", "ogg", "opus", "wma")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif", "webp", "dpx", "exr")
CONTAINERS = {
    "mov": "mov", "m4v": "mov", "mp4": "mp4", "m4a": "mp4", "mkv": "mkv", "avi": "avi", "webm": "webm", "wav": "wav",
    "aiff": "aiff", "aif": "aiff", "flac": "flac", "mp3": "mp3", "ogg": "ogg", "opus": "ogg",
}
VIDEO_CODECS = ("av1", "vp9", "vp8", "theora", "ffv1")
AUDIO_CODECS = ("opus", "vorbis", "flac", "pcm", "wav")
SUPPORTED_CONTAINERS = ("matroska", "webm", "ogg", "wav", "flac", "mp4-av1")
SUPPORTED_EXTENSIONS = ("mkv", "webm", "ogv", "ogg", "oga", "opus", "flac", "wav", "mp4")
PROBE_VIDEO, PROBE_AUDIO = ("mkv", "webm", "ogv", "mp4"), ("ogg", "oga", "opus", "flac", "wav")
PROBE_SUPPORTED = ("mkv", "webm", "ogg", "wav", "flac", "opus")
MKV_CODECS = {
    "V_AV1": "av1", "V_VP9": "vp9", "V_VP8": "vp8", "V_THEORA": "theora", "V_FFV1": "ffv1",
    "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_PCM": "pcm", "A_PCM/INT/LIT": "pcm",
}


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(*VIDEO_EXTENSIONS), "video").when(ext.isin(*AUDIO_EXTENSIONS), "audio").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("other")


def container(ext: Column) -> Column:
    return _look_up(CONTAINERS, ext)


def mkv_codec(codec_id: Column) -> Column:
    return _look_up(MKV_CODECS, codec_id)


def supported_codec(codec: Column) -> Column:
    return ascii_fold(codec).isin(*VIDEO_CODECS, *AUDIO_CODECS)


def supported_extension(ext: Column) -> Column:
    return ascii_fold(ext).isin(*SUPPORTED_EXTENSIONS)


def extension_probe(ext: Column) -> Column:
    """Struct of media_type, container, codec and supported, from the extension alone (simple dialect)."""
    kind = F.when(ext.isin(*PROBE_VIDEO), "video").when(ext.isin(*PROBE_AUDIO), "audio").otherwise("unknown")
    return F.struct(kind.alias("media_type"), ext.alias("container"), ext.alias("codec"), (supported_codec(ext) | ext.isin(*PROBE_SUPPORTED)).alias("supported"))


def duration_ms(seconds: Column) -> Column:
    """Rounded half away from zero; null unless finite and not negative."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(ok, F.round(seconds * 1000).cast("long"))


def frame_rate(fps: Column) -> Column:
    """(num, den) in thousandths; null unless positive, finite and within 32 bits."""
    num = F.round(fps * 1000)
    return F.when((fps > 0) & ~F.isnan(fps) & (fps < float("inf")) & (num <= 2**32 - 1), F.struct(num.cast("long").alias("num"), F.lit(1000).cast("long").alias("den")))


def technical(container_: Column, video: Column, audio: Column, width: Column, height: Column, fps: Column, seconds: Column) -> Column:
    """Probe values as one struct; streams list video before audio."""
    stream = lambda codec, kind: F.when(codec.isNotNull(), F.struct(F.lit(kind).alias("kind"), ascii_fold(codec).alias("codec")))
    streams = F.transform(F.array_compact(F.array(stream(video, "video"), stream(audio, "audio"))), lambda s, i: F.struct(i.alias("index"), s["kind"].alias("kind"), s["codec"].alias("codec")))
    return F.struct(
        container_.alias("container"), ascii_fold(video).alias("video_codec"), ascii_fold(audio).alias("audio_codec"), width.cast("int").alias("width"), height.cast("int").alias("height"),
        frame_rate(fps).alias("frame_rate"), duration_ms(seconds).alias("duration_ms"), streams.alias("streams"),
    )


def technical_is_empty(t: Column) -> Column:
    empty = F.size(t["streams"]) == 0
    for f in ("container", "video_codec", "audio_codec", "width", "height", "frame_rate", "duration_ms"):
        empty = empty & t[f].isNull()
    return empty


def derivative_paths(root: Column, asset_id: Column) -> Column:
    """Where an asset's derivatives lie, by kind."""
    base = F.concat(root, F.lit("/"), asset_id.cast("string"), F.lit("/"))
    return F.create_map(*(x for kind, name in (("thumbnail", "thumbnail.jpg"), ("proxy", "proxy.webm"), ("waveform", "waveform.json")) for x in (F.lit(kind), F.concat(base, F.lit(name)))))
