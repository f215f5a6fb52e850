"""Hashes of words, one at a time, and the order of a labelled sample, written out for the tests."""

import re
import struct
import zlib

import xxhash

M = (1 << 64) - 1
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor & M
    return h ^ h >> 31


def word_hash(word: bytes) -> int:
    return mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(word)) & M)


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def sample(texts, marks, most):
    """doc_ids in the order in which they are learned from."""
    rank = lambda d: xxhash.xxh64(struct.pack("<q", d), seed=42).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [d for d in sorted(marks, key=lambda d: signed(rank(d)))[:most] if d in texts]


def spaced(text):
    """(word, start) of the words between white space, and the text's bytes."""
    raw = text.encode()
    return [(m[0], m.start()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)], raw
