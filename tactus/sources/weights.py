"""Weight files and their configurations: which to take, and reading them, from any store that Spark reads by a path or an address."""

from __future__ import annotations

import io
import json
import posixpath

import numpy as np
import pyarrow.fs

from tactus.sources.store import store_of

# File kinds in the order in which they are looked for, and the number types of safetensors files.
WEIGHTS, CONFIGS = (".safetensors", ".npz"), (".yaml", ".yml", ".json")
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


# How an ensemble is named, how its members are, and how many they are.
ENSEMBLE, MEMBER, MEMBERS = "-all", "-fold", 8


def members(name: str, number: int = MEMBERS) -> list[str]:
    """The networks that a name stands for: an ensemble's members in order, or the name itself."""
    if not name.endswith(ENSEMBLE):
        return [name]
    return [f"{name.removesuffix(ENSEMBLE)}{MEMBER}{k}" for k in range(number)]


def _first(asked: list[str], told: str) -> str:
    for p in asked:
        store, path = store_of(p)
        if store.get_file_info(path).type == pyarrow.fs.FileType.File:
            return p
    raise FileNotFoundError(f"{told}: looked for {', '.join(asked)}")


def resolve_weights(name: str, path: str | None = None, folder: str | None = None) -> str:
    """The weight file: an explicit path, else <folder>/<name> of the first kind that is there."""
    return _first([path] if path else [posixpath.join(folder or ".", name + kind) for kind in WEIGHTS], f"no weights of {name}")


def resolve_ensemble(name: str, folder: str | None = None, number: int = MEMBERS) -> list[str]:
    """The weight files of all that a name stands for; the first member that isn't there raises."""
    return [resolve_weights(m, folder=folder) for m in members(name, number)]


def resolve_config(weights: str) -> str:
    """The configuration beside a weight file."""
    return _first([posixpath.splitext(weights)[0] + kind for kind in CONFIGS], f"no configuration of {weights}")


def _content(path: str) -> bytes:
    store, place = store_of(path)
    with store.open_input_stream(place) as f:
        return f.read()


def read_weights(path: str) -> dict[str, np.ndarray]:
    """Named arrays of a .npz or .safetensors file."""
    if path.endswith(".npz"):
        with np.load(io.BytesIO(_content(path)), allow_pickle=False) as f:
            return {k: f[k] for k in f.files}
    whole = _content(path)
    start = 8 + int.from_bytes(whole[:8], "little")
    head, data = json.loads(whole[8:start]), whole[start:]
    out = {}
    for name, entry in head.items():
        if name != "__metadata__":
            start, end = entry["data_offsets"]
            out[name] = np.frombuffer(data[start:end], TYPES[entry["dtype"]]).reshape(entry["shape"])
    return out


def read_config(path: str) -> dict:
    """A configuration: JSON, or the flat `key: value` lines of a YAML file."""
    text = _content(path).decode()
    if path.endswith(".json"):
        return json.loads(text)
    out: dict = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if not colon or line[:1] in " #-" or not value.strip():
            continue
        try:
            out[key.strip()] = json.loads(value.strip())
        except ValueError:
            out[key.strip()] = value.strip().strip("'\"")
    return out
