"""Tensors from files of numbers (safetensors, npy, npz), and latents of clips. Nothing is unpickled."""

from __future__ import annotations

import ast
import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import batched_udf
TENSORS = "map<string, struct<shape:array<int>,values:array<float>>>"
#: Names of the number formats of safetensors; BF16 is the upper half of a float.
_FORMATS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}
MAX_HEADER = 1 << 24


def safetensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors by name: eight bytes of header length, a JSON header, then the numbers."""
    (size,) = struct.unpack_from("<Q", data)
    if size > min(MAX_HEADER, len(data) - 8):
        raise ValueError("not a safetensors file")
    header, out = json.loads(data[8 : 8 + size]), {}
    for name, told in header.items():
        if name == "__metadata__":
            continue
        a, b = told["data_offsets"]
        if not 0 <= a <= b <= len(data) - 8 - size:
            raise ValueError(f"{name} lies outside the file")
        values = np.frombuffer(data[8 + size + a : 8 + size + b], _FORMATS[told["dtype"]])
        if told["dtype"] == "BF16":
            values = (values.astype("<u4") << 16).view("<f4")
        out[name] = values.reshape(told["shape"])
    return out


def npy(data: bytes) -> np.ndarray:
    """One array; arrays of objects are refused."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = data[6] >= 2
    (size,) = struct.unpack_from("<I" if wide else "<H", data, 8)
    start = 12 if wide else 10
    if size > MAX_HEADER:
        raise ValueError("header too long")
    told = ast.literal_eval(data[start : start + size].decode("latin1").strip())
    kind = np.dtype(told["descr"])
    if kind.hasobject or kind.names:
        raise ValueError("only plain numbers are read")
    return np.frombuffer(data[start + size :], kind, count=int(np.prod(told["shape"], dtype=np.int64))).reshape(told["shape"], order="F" if told["fortran_order"] else "C")


def tensors_of(data: bytes) -> dict[str, np.ndarray]:
    """By the file's first bytes; an npy file's array has an empty name."""
    if data[:6] == b"\x93NUMPY":
        return {"": npy(data)}
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n.removesuffix(".npy"): npy(z.read(n)) for n in z.namelist()}
    return safetensors(data)


def load_tensors(content: Column, strict: bool = True) -> Column:
    """Map of name to shape and values (row by row) of a file's contents; null for what cannot be read, unless `strict`."""

    @batched_udf(TENSORS)
    def run(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                out.append(None if c is None else {k: {"shape": list(v.shape), "values": v.astype(np.float32).ravel().tolist()} for k, v in tensors_of(bytes(c)).items()})
            except Exception:
                if strict:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(content)


def clip_frames(total: Column, rgb_total: Column, wanted: Column | int | None = None, skip: Column | int = 1, u: Column | None = None) -> Column:
    """Places of the latent frames that hold `wanted` of a video's `rgb_total` frames, every `skip`-th of them.

    A latent frame stands for ceil(rgb_total / total) frames. The start is 0, or drawn by `u` (from
    0 to 1) so that as many frames fit. More than there are is an error.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    skip = as_column(skip)
    wanted = rgb_total if wanted is None else as_column(wanted)
    n = F.ceil(wanted / F.ceil(rgb_total / total)).cast("int")
    room = total - n
    start = F.lit(0) if u is None else F.least(F.floor(u * (room + 1)), room).cast("int")
    taken = F.sequence(start, start + n - 1, skip.cast("int"))
    return F.when(n * skip <= total, taken).otherwise(F.raise_error(F.lit("too few latent frames")).cast("array<int>"))


def skip_of(fps: Column, target: Column | float) -> Column:
    """The whole number of source frames per target frame; another ratio is an error."""
    ratio = fps / target
    return F.when((ratio >= 1) & (ratio == F.floor(ratio)), ratio.cast("int")).otherwise(F.raise_error(F.lit("the frame rates have no whole ratio")).cast("int"))


def take_frames(tensor: Column, frames: Column) -> Column:
    """The values of some frames (the first axis) of a tensor, one after another."""
    each = F.aggregate(F.slice(tensor["shape"], F.lit(2), F.size(tensor["shape"])), F.lit(1), lambda a, x: a * x)
    return F.flatten(F.transform(frames, lambda i: F.slice(tensor["values"], i * each + 1, each)))


def sample_clip(mean: Column, logvar: Column, frames: Column, key: Column, seed: int = 42) -> Column:
    """mean + noise * exp(logvar / 2) over the frames; the noise is fixed by seed, key and place."""
    from .media import hash_normal

    m, v = take_frames(mean, frames), take_frames(logvar, frames)
    noise = F.transform(m, lambda _, i: hash_normal(F.lit(str(seed)), key, i))
    return F.zip_with(m, F.zip_with(v, noise, lambda x, e: e * F.exp(x / 2)), lambda a, b: (a + b).cast("float"))
