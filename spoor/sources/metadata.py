"""The metadata file of a trace."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .container import decoded
from .records import _put, _Reader

# The file's first bytes, its version, and its flags from bit 0 on.
MAGIC = b"CTMD"
VERSION = 3
FLAGS = (
    "mcr_fields", "replay_launch_fields", "layout_snapshot", "trace_filter_provenance", "column_aware_steps", "alternate_source_views",
    "column_breakpoints", "column_motions", "call_stream", "step_stream", "value_stream", "io_event_stream", "interning_tables",
)
SCHEMA = "version int, flags int, recording_id string, program string, args array<string>, workdir string, recorder_id string, paths array<string>"


def build(recording_id: str, program: str, args: list[str], workdir: str, recorder_id: str, paths: list[str], flags: int = 0) -> bytes:
    out = bytearray(MAGIC + struct.pack("<HH", VERSION, flags))
    for part in (recording_id, program, args, workdir, recorder_id, paths):
        if isinstance(part, list):
            _put(out, len(part), *[p.encode() for p in part])
        else:
            _put(out, part.encode())
    return bytes(out)


def _parse(data: bytes) -> tuple:
    if data[:4] != MAGIC:
        raise ValueError("no metadata")
    version, flags = struct.unpack_from("<HH", data, 4)
    if version != VERSION or flags >> len(FLAGS):
        raise ValueError(f"version {version} or flags {flags:#x} of the metadata are unknown")
    r = _Reader(data, 8)
    text = lambda: r.bytes().decode("utf-8")
    return version, flags, text(), text(), r.several(text), text(), text(), r.several(text)


def read(files: DataFrame, name: str = "meta.dat") -> DataFrame:
    """path, version, flags, recording_id, program, args, workdir, recorder_id, paths, features (names of the flags) of each container with metadata.

    What optional flags append behind the paths is left unread.
    """
    rows = decoded(files, name, SCHEMA, lambda data: iter([_parse(data)]))
    return rows.withColumn("features", F.array_compact(F.array(*[F.when(F.col("flags").bitwiseAND(1 << i) != 0, n) for i, n in enumerate(FLAGS)])))
