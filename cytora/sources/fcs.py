"""Instrument files as a Spark data source: ``spark.read.format("fcs").load(path)``.

With option ``part`` = ``events`` (the default) each event is a row of (sample, event_idx, event_values); large
files are read by several tasks, each a range of events. With ``part`` = ``text`` each file is one row of its keywords,
channels and cytometer, read from the head of the file alone.
"""

from __future__ import annotations

import fnmatch
import glob
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cytora.operators.packed import parse

#: Bytes of event data that one task reads.
TASK_BYTES = 64 << 20
CYTOMETER_KEYS = ("cyt", "cytometer", "instrname", "instrument", "machine")


class FcsError(ValueError):
    """The file breaks the format."""


def _number(raw: bytes) -> int:
    text = raw.decode("ascii", "replace").strip()
    return int(text) if text.isdigit() else 0


def parse_header(head: bytes) -> dict[str, int | str]:
    """Version and segment offsets of the first 58 bytes."""
    if len(head) < 58 or not head.startswith(b"FCS"):
        raise FcsError("no header of an instrument file")
    at = lambda a: _number(head[a : a + 8])
    return {"version": head[3:6].decode("ascii", "replace"), "text_begin": at(10), "text_end": at(18), "data_begin": at(26), "data_end": at(34), "analysis_begin": at(42), "analysis_end": at(50)}


def parse_text(segment: bytes) -> dict[str, str]:
    """Keywords of a text segment: the first character separates, doubled it stands for itself; the last value of a key counts."""
    text = segment.decode("utf-8", "replace")
    if not text:
        return {}
    mark, parts, now, i = text[0], [], [], 1
    while i < len(text):
        if text[i] != mark:
            now.append(text[i])
        elif i + 1 < len(text) and text[i + 1] == mark:
            now.append(mark)
            i += 1
        else:
            parts.append("".join(now))
            now = []
        i += 1
    if now:
        parts.append("".join(now))
    return {k.strip().lower().replace("$", ""): v for k, v in zip(parts[::2], parts[1::2]) if k.strip()}


def _positive(text: str | None) -> int:
    text = (text or "").strip()
    return int(text) if text.isdigit() else 0


def _real(text: str | None, default: float) -> float:
    try:
        v = float((text or "").strip())
        return v if math.isfinite(v) else default
    except ValueError:
        return default


def channels(keys: dict[str, str]) -> list[dict[str, object]]:
    """Name, label, maximum and gain of each channel, with defaults for what is missing."""
    out = []
    for n in range(1, _positive(keys.get("par")) + 1):
        name = keys.get(f"p{n}n", "").strip() or f"P{n}"
        out.append({"idx": n - 1, "name": name, "label": keys.get(f"p{n}s", "").strip(), "maximum": _real(keys.get(f"p{n}r"), 262144.0), "gain": _real(keys.get(f"p{n}g"), 1.0)})
    return out


def layout(keys: dict[str, str], header: dict[str, int | str]) -> tuple[int, np.dtype, int]:
    """(first byte, type of a value, events) of the data segment; types other than I, F and D are refused.

    Integers take the width of the first channel; widths other than 8, 16 and 32 read as zeros (a type of size 0).
    """
    kind = keys.get("datatype", "").strip().upper()
    big = keys.get("byteord", "").replace(" ", "") in ("4,3,2,1", "2,1")
    order = ">" if big else "<"
    begin = _positive(keys.get("begindata")) or int(header["data_begin"])
    total = _positive(keys.get("tot"))
    if kind == "F":
        return begin, np.dtype(order + "f4"), total
    if kind == "D":
        return begin, np.dtype(order + "f8"), total
    if kind == "I":
        width = _positive(keys.get("p1b"))
        return begin, np.dtype({8: "u1", 16: order + "u2", 32: order + "u4"}.get(width, "V0")), total
    raise FcsError(f"data type {kind or 'missing'} is not supported")


def spillover(keys: dict[str, str]) -> tuple[list[str], np.ndarray] | None:
    """(names, matrix) of the first spillover entry; None where it is missing or damaged."""
    text = next((keys[k] for k in ("spillover", "spill", "comp") if k in keys), None)
    if text is None:
        return None
    values = [v for _, v, _ in parse(text)]
    try:
        n = int(values[0])
        names, numbers = values[1 : n + 1], [float(v) for v in values[n + 1 : n + 1 + n * n]]
    except (ValueError, IndexError):
        return None
    if n < 1 or len(names) != n or len(numbers) != n * n or not all(names):
        return None
    return names, np.array(numbers).reshape(n, n)


def cytometer(keys: dict[str, str]) -> str:
    return next((keys[k].strip() for k in CYTOMETER_KEYS if keys.get(k, "").strip()), "Default")


_STRUCTURAL = re.compile(r"^(p\d+\w+|par|tot|mode|datatype|byteord|nextdata|begin\w+|end(data|analysis|stext)|spill|spillover|comp|timestep)$")
#: Names that we show for standard keywords; other keywords show their words.
DISPLAY = {
    "fil": "File name", "date": "Date", "btim": "Begin time", "etim": "End time", "op": "Operator", "inst": "Institution", "src": "Specimen source",
    "smno": "Specimen label", "exp": "Experimenter", "proj": "Project", "cells": "Cells", "com": "Comment", "vol": "Sample volume", "abrt": "Events aborted",
    "lost": "Events lost", "plateid": "Plate ID", "platename": "Plate name", "wellid": "Well ID", "last_modified": "Last modified", "last_modifier": "Last modifier",
}


def display_name(key: str) -> str:
    """Readable name of a keyword: a fixed one, ``Laser n ...``, or its words."""
    if key in DISPLAY:
        return DISPLAY[key]
    if m := re.fullmatch(r"laser(\d+)(\w*)", key):
        return f"Laser {m[1]} {m[2].strip('_').replace('_', ' ')}".strip()
    words = re.sub(r"[_\-.]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)", " ", key)).split()
    return " ".join(words).capitalize()


def metadata(keys: dict[str, str]) -> dict[str, str]:
    """Keywords that describe the sample, by display name; structural and blank ones are left out."""
    return {display_name(k): v.strip() for k, v in keys.items() if v.strip() and not _STRUCTURAL.match(k) and k not in CYTOMETER_KEYS}


def _open(path: str):
    """A file of the local disk or, with a scheme (hdfs, s3, gs ...), of the file system the cluster shares."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


Head = tuple[dict[str, str], dict[str, int | str]]


def read_head(path: str) -> Head:
    with _open(path) as f:
        header = parse_header(f.read(58))
        f.seek(int(header["text_begin"]))
        return parse_text(f.read(int(header["text_end"]) - int(header["text_begin"]) + 1)), header


def read_events(path: str, first: int, count: int, head: Head | None = None) -> np.ndarray:
    """``count`` events from ``first`` on as single precision; ``head`` saves reading it again."""
    keys, header = head or read_head(path)
    begin, kind, total = layout(keys, header)
    width = _positive(keys.get("par"))
    count = max(0, min(count, total - first))
    if not count or not width:
        return np.zeros((0, width), dtype=np.float32)
    if kind.itemsize == 0:
        return np.zeros((count, width), dtype=np.float32)
    with _open(path) as f:
        f.seek(begin + first * width * kind.itemsize)
        raw = f.read(count * width * kind.itemsize)
    if len(raw) < count * width * kind.itemsize:
        if kind.kind == "f":
            raise FcsError(f"{path}: the data segment is too short")
        raw = raw.ljust(count * width * kind.itemsize, b"\0")
    return np.frombuffer(raw, dtype=kind).reshape(count, width).astype(np.float32)


def _paths(pattern: str) -> list[str]:
    found = []
    for p in pattern.split(","):
        p = re.sub(r"^file:(//)?", "", p)
        if "://" in p:
            found.extend(_remote(p))
            continue
        hits = [p] if os.path.exists(p) else glob.glob(p)
        for h in hits:
            found.extend(sorted(glob.glob(os.path.join(h, "*.[fF][cC][sS]"))) if os.path.isdir(h) else [h])
    return sorted(set(found))


def _remote(pattern: str) -> list[str]:
    """Instrument files of a folder, or that match a pattern in the last part of a path, on a shared file system."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(pattern.partition("*")[0].rpartition("/")[0] if "*" in pattern else pattern)
    scheme = pattern.partition("://")[0]
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [pattern]
    names = [i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
    wanted = pattern.rpartition("/")[2] if "*" in pattern else "*.[fF][cC][sS]"
    host = pattern.partition("://")[2].partition("/")[0] if inner.startswith("/") else ""
    return [f"{scheme}://{host}{n}" for n in sorted(names) if fnmatch.fnmatch(n.rpartition("/")[2], wanted)]


class Piece(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


_EVENTS = "sample string, path string, event_idx bigint, event_values array<float>"
_TEXT = "sample string, path string, text_map map<string,string>, cytometer string, event_count bigint, channels array<struct<idx:int,name:string,label:string,maximum:double,gain:double>>"


class FcsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.part = options.get("part", "events")
        self.files = _paths(options.get("path", ""))
        self.bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        if self.part == "text":
            return [Piece(p, 0, 0) for p in self.files]
        out: list[InputPartition] = []
        for p in self.files:
            keys, header = read_head(p)
            _, kind, total = layout(keys, header)
            step = max(1, self.bytes // max(1, _positive(keys.get("par")) * max(kind.itemsize, 1)))
            out.extend(Piece(p, a, step) for a in range(0, max(total, 1), step))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch | tuple]:
        name = os.path.splitext(os.path.basename(partition.path))[0]
        if self.part == "text":
            keys, _ = read_head(partition.path)
            rows = [tuple(c.values()) for c in channels(keys)]
            yield name, partition.path, keys, cytometer(keys), _positive(keys.get("tot")), rows
            return
        head = read_head(partition.path)
        for a in range(partition.first, partition.first + partition.count, 16384):
            x = read_events(partition.path, a, min(16384, partition.first + partition.count - a), head)
            if not len(x):
                return
            n, w = x.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([partition.path] * n), pa.array(np.arange(a, a + n, dtype=np.int64)), lists], names=["sample", "path", "event_idx", "event_values"])


class FcsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs"

    def schema(self) -> str:
        return _TEXT if self.options.get("part", "events") == "text" else _EVENTS

    def reader(self, schema) -> FcsReader:
        return FcsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FcsSource)


def write(path: str, x: np.ndarray, names: list[str], keys: dict[str, str] | None = None, kind: str = "F", big: bool = False, mark: str = "/", bits: int = 32) -> None:
    """A small file of our own, for tests and exports."""
    order = ">" if big else "<"
    dtype = {"F": order + "f4", "D": order + "f8", "I": {8: "u1", 16: order + "u2", 32: order + "u4"}.get(bits, order + "u4")}[kind]
    data = np.asarray(x).astype(dtype).tobytes()
    text: dict[str, str] = {"$PAR": str(len(names)), "$TOT": str(len(x)), "$DATATYPE": kind, "$BYTEORD": "4,3,2,1" if big else "1,2,3,4"}
    for i, n in enumerate(names, 1):
        text |= {f"$P{i}N": n, f"$P{i}B": str(64 if kind == "D" else bits), f"$P{i}R": "262144"}
    text |= keys or {}
    double = lambda s: s.replace(mark, mark * 2)
    body = (mark + "".join(f"{double(k)}{mark}{double(v)}{mark}" for k, v in text.items())).encode()
    begin = 58 + len(body)
    offsets = [58, begin - 1, begin, begin + len(data) - 1, 0, 0]
    with open(path, "wb") as f:
        f.write(b"FCS3.1    " + b"".join(str(o).rjust(8).encode() for o in offsets) + body + data)
