"""SHA-256 in stretches: the state after one stretch is a value, and another task goes on from it."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyarrow import fs

#: Bytes held at a time.
PIECE_BYTES = 4 << 20
#: Fixed value: size of the state (SHA256_CTX) in OpenSSL's public header.
STATE_BYTES = 112


def _openssl() -> ctypes.CDLL:
    """The OpenSSL that ``hashlib`` itself uses; ``hashlib`` offers no state."""
    return ctypes.CDLL(getattr(_hashlib, "__file__", None))


def resumable() -> bool:
    return all(hasattr(_openssl(), f"SHA256_{step}") for step in ("Init", "Update", "Final"))


def pieces(address: str, at: int, end: int) -> Iterator[bytes]:
    """Bytes ``at`` to ``end`` of the file; one that has become shorter is an error."""
    parts = urlsplit(address)
    local = parts.scheme in ("", "file")
    system, path = (fs.LocalFileSystem(), unquote(parts.path)) if local else fs.FileSystem.from_uri(address)
    with system.open_input_file(path) as file:
        file.seek(at)
        while at < end:
            piece = file.read(min(PIECE_BYTES, end - at))
            if not piece:
                raise OSError(f"{address} ends at byte {at}, listed with {end} or more")
            at += len(piece)
            yield piece


def advance(address: str, state: bytes, at: int, end: int, length: int) -> bytes:
    """The state after bytes ``at`` to ``end`` of a file of ``length`` bytes; after the last of them the digest in hex."""
    if at == 0 and end == length:
        whole = hashlib.sha256()
        for piece in pieces(address, at, end):
            whole.update(piece)
        return whole.hexdigest().encode()
    lib, held = _openssl(), ctypes.create_string_buffer(state, STATE_BYTES)
    if at == 0:
        lib.SHA256_Init(held)
    for piece in pieces(address, at, end):
        lib.SHA256_Update(held, ctypes.c_char_p(piece), ctypes.c_size_t(len(piece)))
    if end < length:
        return held.raw
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, held)
    return out.raw.hex().encode()
