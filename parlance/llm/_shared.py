"""Helpers that the training-data operators share: hashing, and the library's shared storage by its names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from parlance.storage import drop_stored, fresh_path, shared_dir, stored

__all__ = ["WS", "drop_stored", "fresh_path", "held_out_bucket", "mix64", "shared_dir", "stored"]

#: Python's bytes.split() and bytes.lower() use exactly the separators
#: [\x20\x09-\x0D] and exactly the letters A-Z.
WS = r"\x20\x09-\x0D"


def held_out_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo modulus (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit integers (vectorised, wraps modulo 2^64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
