"""Audio sources: WAV files and base64 payloads to frame tables, with failures as data."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = "path string, duration_s double, error string, pitch array<struct<time_us:bigint,f0_hz:double>>, intensity array<double>, formants array<array<double>>, clipped double, voiced_share double"


#: Endings of clip files.
ENDINGS = "*.{wav,mp3,m4a,flac,ogg,webm}"


def read_clips(spark: SparkSession, path: str, pattern: str = ENDINGS) -> DataFrame:
    """``path, content`` of all files below ``path`` whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def decode_payloads(requests: DataFrame, column: str = "audio_base64", path: str = "clip_id") -> DataFrame:
    """``path, content`` of base64 payloads; what isn't base64 is skipped in decoding, as lenient readers do."""
    return requests.select(F.col(path).cast("string").alias("path"), F.unbase64(column).alias("content"))


def measure(clips: DataFrame) -> DataFrame:
    """Frames and levels of each clip; ``error`` says why a clip could not be read. Only WAV is decoded here."""

    def run(batches):
        from clipgrain.functions import kernels as K

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    if not content:
                        raise ValueError("empty audio")
                    x, rate = K.read_wav(content)
                    t, f0 = K.pitch(x, rate)
                    f = [[None if v != v else float(v) for v in row] for row in K.formants(x, rate)]
                    mask = K.voiced_samples(x)
                    rows.append({"path": path, "duration_s": len(x) / rate, "error": None, "pitch": [{"time_us": round(a * 1e6), "f0_hz": float(b)} for a, b in zip(t, f0, strict=True)], "intensity": K.intensity(x, rate).tolist(), "formants": f, "clipped": float((abs(x) >= 0.99).mean()) if len(x) else 0.0, "voiced_share": float(mask.mean()) if len(x) else 0.0})
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append({"path": path, "duration_s": None, "error": f"{type(e).__name__}: {e}"[:300], "pitch": None, "intensity": None, "formants": None, "clipped": None, "voiced_share": None})
            struct = pa.struct([("time_us", pa.int64()), ("f0_hz", pa.float64())])
            schema = pa.schema([("path", pa.string()), ("duration_s", pa.float64()), ("error", pa.string()), ("pitch", pa.list_(struct)), ("intensity", pa.list_(pa.float64())), ("formants", pa.list_(pa.list_(pa.float64()))), ("clipped", pa.float64()), ("voiced_share", pa.float64())])
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return clips.mapInArrow(run, MEASURES)


def pitch_frames(measured: DataFrame) -> DataFrame:
    """``clip_id, frame_idx, time_us, f0_hz`` with the clip's path as its id."""
    return measured.select(F.col("path").alias("clip_id"), F.posexplode("pitch").alias("frame_idx", "p")).select("clip_id", "frame_idx", "p.time_us", "p.f0_hz")


def intensity_frames(measured: DataFrame) -> DataFrame:
    return measured.select(F.col("path").alias("clip_id"), F.posexplode("intensity").alias("idx", "db"))
