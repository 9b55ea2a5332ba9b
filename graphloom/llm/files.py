"""Files in the shared folder, written and read by the workers themselves."""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs


def write_file(folder: str, name: str, parts) -> str:
    """Write ``parts`` (bytes-likes) to a new file and return its address.

    The file appears under its name once it is whole. A retried task writes
    another file, and only the address that a finished task returns is read.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/.{unique}") as out:
        for p in parts:
            out.write(p)
    system.move(f"{path}/.{unique}", f"{path}/{unique}")
    return f"{folder}/{unique}"


def open_file(address: str):
    """A readable, seekable file."""
    system, path = fs.FileSystem.from_uri(address)
    return system.open_input_file(path)


HELD_BYTES = 1 << 28
_held: OrderedDict[str, np.ndarray] = OrderedDict()


def mapped(address: str) -> np.ndarray:
    """The bytes of a file as a memory map.

    Files of a store that cannot be mapped are read; ``HELD_BYTES`` of them are
    kept, those used of late, for as long as nobody else holds them.
    """
    if address.startswith(("file:///", "/")):
        path = address.removeprefix("file://")
        return np.asarray(np.memmap(path, np.uint8, "r")) if fs.LocalFileSystem().get_file_info(path).size else np.zeros(0, np.uint8)
    if address not in _held:
        with open_file(address) as f:
            _held[address] = np.frombuffer(f.read(), np.uint8)
        while sum(map(len, _held.values())) > HELD_BYTES and len(_held) > 1:
            _held.popitem(last=False)
    _held.move_to_end(address)
    return _held[address]
