"""Multi-channel recordings in the open header-and-samples format: a text header, and samples of 16 or 12 bits.

A header names the record, how many channels it has, its rate and length; a line for each channel names its file, format (16 or
212), gain with baseline and unit, and what it measures. Channels of a file are interleaved. The data source plans
partitions from the headers alone, PART_FRAMES frames of a record in each, and every task reads only its own bytes. Where there
are very many short parts, a partition takes a run of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from somaframe.functions.frames import spread
from somaframe.functions.shipping import ship
from somaframe.sources.files import loader

FORMAT = "somaframe_records"
SCHEMA = "name string, signal string, i long, time_s double, value double, fs_hz double"
#: Frames (one sample of each channel) that a task reads, and those decoded at once. Even, so that pairs of 12-bit samples stay whole.
PART_FRAMES, BATCH_FRAMES = 4_000_000, 200_000
#: Up to so many parts each is a partition; beyond, partitions hold runs of parts, where opening a file counts as OPEN_FRAMES frames. And
#: how many headers are read at once.
MOST_SINGLE, OPEN_FRAMES, READERS = 64, 20_000, 16
#: Fixed values of the format: rate and gain where a header gives none, and the number that stands for a missing sample.
DEFAULT_RATE, DEFAULT_GAIN = 250.0, 200.0
MISSING = {16: -(1 << 15), 212: -(1 << 11)}


@dataclass(frozen=True)
class Channel:
    file: str
    format: int
    gain: float
    baseline: float
    label: str


@dataclass(frozen=True)
class Header:
    name: str
    rate: float
    frames: int | None
    channels: tuple[Channel, ...]


def parse_header(text: str) -> Header:
    lines = [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    name, n, *rest = lines[0].split()
    rate = float(re.split(r"[/(]", rest[0])[0]) if rest else DEFAULT_RATE
    channels = []
    for line in lines[1 : 1 + int(n)]:
        file, kind, *more = line.split(maxsplit=8)
        gain = re.match(r"([-+.\deE]+)?(?:\(([-+\d]+)\))?", more[0]) if more else None
        zero = float(more[2]) if len(more) > 2 else 0.0
        number = int(re.match(r"\d+", kind)[0])
        if number not in MISSING or not re.fullmatch(r"\d+", kind):
            raise ValueError(f"{name}: samples of format {kind} are not known")
        channels.append(Channel(file, number, float(gain[1] or 0) or DEFAULT_GAIN if gain else DEFAULT_GAIN, float(gain[2]) if gain and gain[2] else zero, more[6] if len(more) > 6 else ""))
    if len({c.format for c in channels}) > 1 or len({c.file for c in channels}) > 1:
        raise ValueError(f"{name}: all channels must be in one file, in one format")
    return Header(name.split("/")[0], rate, int(rest[1]) or None if len(rest) > 1 else None, tuple(channels))


def decode(data: bytes, kind: int) -> np.ndarray:
    """Samples as integers. Three bytes hold two samples of 12 bits: the low bytes are the first and the third, the
    middle one has the high bits of the first in its low half."""
    if kind == 16:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int64)
    b = np.frombuffer(data + b"\0" * (-len(data) % 3), np.uint8).reshape(-1, 3).astype(np.int64)
    pairs = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 2] | (b[:, 1] >> 4) << 8], axis=1).ravel()
    return ((pairs + 2048) % 4096 - 2048)[: len(data) * 2 // 3]


def encode(samples: np.ndarray, kind: int) -> bytes:
    least = MISSING[kind]
    if len(samples) and not (least <= samples.min() and samples.max() < -least):
        raise ValueError(f"samples do not fit into format {kind}")
    if kind == 16:
        return samples.astype("<i2").tobytes()
    padded = np.append(samples, np.zeros(len(samples) % 2, np.int64)) & 4095
    first, second = padded[::2], padded[1::2]
    out = np.stack([first & 255, first >> 8 | second >> 8 << 4, second & 255], axis=1).astype(np.uint8).tobytes()
    return out[: len(out) - len(samples) % 2]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part:
    header: Header
    first: int
    frames: int


@dataclass
class Run(InputPartition):
    parts: list[Part]


def in_runs(parts: Sequence[Part]) -> list[Run]:
    """One part each, or runs of parts of about equal work: as many as the work asks for, MOST_SINGLE at least."""
    if len(parts) <= MOST_SINGLE:
        return [Run([p]) for p in parts]
    upto = np.cumsum([p.frames + OPEN_FRAMES for p in parts])
    n = max(MOST_SINGLE, -(-int(upto[-1]) // PART_FRAMES))
    runs: dict[int, list[Part]] = {}
    for part, place in zip(parts, ((upto - 1) * n // upto[-1]).tolist(), strict=True):
        runs.setdefault(place, []).append(part)
    return [Run(r) for r in runs.values()]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.signals = [s for s in options.get("signals", "ecg,resp").lower().split(",") if s]
        self.part = int(options.get("partframes", PART_FRAMES)) // 2 * 2 or 2
        self.named = [s for s in options.get("records", "").split(",") if s]

    def partitions(self) -> Sequence[InputPartition]:
        store, path = _store(self.path)
        files = [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file]
        heads, sizes = sorted(f.path for f in files if f.extension == "hea"), {f.path: f.size or 0 for f in files}
        if self.named:
            heads = [h for h in heads if h.rsplit("/", 1)[-1][:-4] in self.named]

        def split(head: str) -> list[Part]:
            with store.open_input_stream(head) as file:
                header = parse_header(file.read().decode())
            if not header.channels:
                return []
            size = sizes[f"{path}/{header.channels[0].file}"] if f"{path}/{header.channels[0].file}" in sizes else store.get_file_info(f"{path}/{header.channels[0].file}").size or 0
            there = size * (8 if header.channels[0].format == 16 else 16) // (16 if header.channels[0].format == 16 else 24) // len(header.channels)
            frames = min(there, header.frames) if header.frames else there
            return [Part(header, at, min(self.part, frames - at)) for at in range(0, frames, self.part)]

        with ThreadPoolExecutor(READERS) as pool:
            parts = [p for own in pool.map(split, heads) for p in own]
        return in_runs(parts) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (b for part in partition.parts for b in self._part(part)):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH_FRAMES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _part(self, part: Part) -> Iterator[pa.RecordBatch]:
        header, n = part.header, len(part.header.channels)
        picked = {s: next((k for k, c in enumerate(header.channels) if s in c.label.lower()), None) for s in self.signals}
        store, path = _store(self.path)
        kind = header.channels[0].format
        with store.open_input_file(f"{path}/{header.channels[0].file}") as file:
            for at in range(part.first, part.first + part.frames, BATCH_FRAMES):
                frames = min(BATCH_FRAMES, part.first + part.frames - at)
                bits = 16 if kind == 16 else 12
                file.seek(at * n * bits // 8)
                samples = decode(file.read(-(-frames * n * bits // 8)), kind)[: frames * n].reshape(frames, n)
                i = np.arange(at, at + frames)
                for signal, k in picked.items():
                    if k is not None:
                        channel, own = header.channels[k], samples[:, k]
                        value = pa.array((own - channel.baseline) / channel.gain, mask=own == MISSING[kind])
                        yield pa.RecordBatch.from_arrays([pa.array([header.name] * frames), pa.array([signal] * frames), pa.array(i), pa.array(i / header.rate), value, pa.array(np.full(frames, header.rate))], names=["name", "signal", "i", "time_s", "value", "fs_hz"])


class Records(DataSource):
    """Options: path of the folder; signals, comma-separated, each matched to the first channel whose description contains it;
    records, the only ones to read; partFrames."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})


@loader("binary_records")
def read_records(spark: SparkSession, folder: str, signals: Sequence[str] = ("ecg", "resp"), records: Sequence[str] = (), part_frames: int = PART_FRAMES) -> DataFrame:
    """name, signal, i, time_s, value (null if missing), fs_hz of the records of a folder."""
    ship(spark)
    spark.dataSource.register(Records)
    return spark.read.format(FORMAT).options(path=folder, signals=",".join(signals), records=",".join(records), partFrames=part_frames).load()


def write_records(rows: DataFrame, folder: str, rate: float, kind: int = 16, gain: float = DEFAULT_GAIN, channels: Sequence[str] = ("ecg", "resp"), baseline: int = 0) -> DataFrame:
    """Writes rows (name, i, one column for each channel; null is missing) as records, one file and header for each name: what
    the reader is tested against. Names of records and numbers of frames come back; a group is one record, as the format is one file."""
    ship(rows.sparkSession)

    def run(record: pd.DataFrame) -> pd.DataFrame:
        record = record.sort_values("i")
        name = record["name"].iloc[0]
        values = record[list(channels)].to_numpy(float)
        digits = np.where(np.isnan(values), MISSING[kind], np.round(np.nan_to_num(values) * gain) + baseline).astype(np.int64)
        lines = [f"{name} {len(channels)} {rate:g} {len(record)}", *(f"{name}.dat {kind} {gain:g}({baseline})/mV {12 if kind == 212 else 16} 0 0 0 0 {c}" for c in channels)]
        store, path = _store(folder)
        store.create_dir(path)
        for ending, data in ((".dat", encode(digits.ravel(), kind)), (".hea", ("\n".join(lines) + "\n").encode())):
            with store.open_output_stream(f"{path}/{name}{ending}") as file:
                file.write(data)
        return pd.DataFrame({"name": [name], "frames": [len(record)]})

    return spread(rows.select("name", "i", *channels), "name").groupBy("name").applyInPandas(run, "name string, frames long").orderBy(F.col("name"))
