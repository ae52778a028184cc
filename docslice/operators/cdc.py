"""Chunks of bytes whose cuts the content defines.

Rules whose hash looks at a window of the last bytes only are evaluated for all positions at once with numpy, and cuts
are then picked from the candidates; of rules with state all but two are xors of prefixes as well, and these two run
byte by byte. Every kernel works on one text at a time, with
no shuffle. Sizes and offsets are bytes; a chunk's content is decoded with replacement where a cut splits a character,
and its digest is of the bytes.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame

from docslice.operators.kernel import chunk_rows

MIN, AVG, MAX = 2048, 8192, 65536
M53 = (1 << 53) - 1
TOP = 1 << 52
POLY = 0x3DA3358B4DC173
SCHEMA = "start long, n_bytes long, digest string"

Cuts = Callable[[bytes], Iterator[int]]


def picked(candidates: np.ndarray, n: int, least: int, most: int) -> Iterator[int]:
    """Ends of chunks: the first candidate end at `least` bytes or more, else `most` bytes."""
    start = 0
    while n - start > 0:
        k = int(np.searchsorted(candidates, start + least))
        end = int(candidates[k]) if k < len(candidates) else n + 1
        end = min(end, start + most, n)
        yield end
        start = end


@lru_cache(maxsize=4)
def gear_table(kind: str) -> np.ndarray:
    if kind == "crc":
        v = np.arange(256, dtype=np.uint64)
        for _ in range(8):
            v = np.where(v & np.uint64(1), v >> np.uint64(1) ^ np.uint64(0xEDB88320), v >> np.uint64(1))
        return v
    own = random.Random(42)
    draw = [own.getrandbits(32) for _ in range(256)]
    return np.array([x | i << 24 for i, x in enumerate(draw)] if kind == "gear" else draw, np.uint64)


def fastcdc(data: bytes, least: int = MIN, avg: int = AVG, most: int = MAX, bits: int = 13) -> Iterator[int]:
    """Gear hash, whose low bits depend on as many last bytes. A cut stands before the byte at which it is taken; past
    the average the wider mask gives a second choice, used if none is found up to twice the average."""
    n = len(data)
    g = gear_table("crc")[np.frombuffer(data, np.uint8)]
    low = np.zeros(n + 1, np.uint64)  # hash before byte p
    for i in range(min(bits, n)):
        low[i + 1 :] += g[: n - i] << np.uint64(i)
    main = np.flatnonzero(low & np.uint64((1 << bits) - 1) == 0)
    second = np.flatnonzero(low & np.uint64((1 << (bits - 1)) - 1) == 0)
    start = 0
    while start < n:
        if start + least >= n:
            yield n
            return
        top = min(start + most, n)
        zone = min(start + 2 * avg, top)
        k = int(np.searchsorted(main, start + least))
        if k < len(main) and main[k] < zone:
            end = int(main[k])
        else:
            k = int(np.searchsorted(second, max(start + avg, start + least)))
            end = int(second[k]) if k < len(second) and second[k] < zone else top
        yield end
        start = end


def _turned(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    """32-bit values (in 64 bits) rotated left."""
    by = by & np.uint64(31)
    return (v << by | v >> (np.uint64(32) - by)) & np.uint64(0xFFFFFFFF)


class Turning:
    """Values of a hash that is rotated by one bit and xored with a byte's value at each step, at any position and from
    any start: each byte's value is kept in the frame of position 0, so that runs of bytes are xors of two prefixes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        back = _turned(values, np.uint64(32) - np.arange(n, dtype=np.uint64) % np.uint64(32))
        self.prefix = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(back)]) if n else np.zeros(1, np.uint64)

    def at(self, first: int, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes from `first` to before each of `ends`."""
        return _turned(self.prefix[ends] ^ self.prefix[first], (ends - 1).astype(np.uint64))


def fastcdc_rolling(data: bytes, kind: str = "rabin", least: int = MIN, avg: int = AVG, most: int = MAX, bits: int = 13) -> Iterator[int]:
    """As fastcdc, with a hash over all bytes of the chunk: polynomial (rabin) or rotate and xor (buzhash)."""
    mask, wide, n, start = (1 << bits) - 1, (1 << (bits - 1)) - 1, len(data), 0
    turning = Turning(np.frombuffer(data, np.uint8).astype(np.uint64) * np.uint64(0x9E3779B9) & np.uint64(0xFFFFFFFF)) if kind != "rabin" else None
    while start < n:
        if start + least >= n:
            yield n
            return
        top = min(start + most, n)
        zone = min(start + 2 * avg, top)
        first = max(start + avg, start + least)
        if turning is not None:
            at = np.arange(start + least, zone)  # the hash before each of these bytes
            h = turning.at(start, at)
            main = np.flatnonzero(h & np.uint64(mask) == 0)
            second = np.flatnonzero((h & np.uint64(wide) == 0) & (at >= first))
            end = int(at[main[0]]) if len(main) else int(at[second[0]]) if len(second) else top
        else:
            h, end = 0, 0
            for b in data[start : start + least]:
                h = (h * 256 + b) % POLY
            for p, b in enumerate(data[start + least : zone], start + least):
                if not h & wide:
                    if not h & mask:
                        end = p
                        break
                    if not end and p >= first:
                        end = -p
                h = (h * 256 + b) % POLY
            end = abs(end) or top
        yield end
        start = end


def _polynomial(data: bytes, window: int, modulus: int = 10**9 + 7) -> np.ndarray:
    """Hash of the `window` bytes that end at each position, by joining windows of doubling length."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(len(b), np.uint64)
    done, part, size, bit = 0, b, 1, window
    m = np.uint64(modulus)
    while bit:
        if bit & 1:
            shifted = np.zeros(len(b), np.uint64)
            shifted[done:] = part[: max(0, len(b) - done)]
            out = (out + shifted * np.uint64(pow(256, done, modulus))) % m
            done += size
        bit >>= 1
        if bit:
            wide = part.copy()
            wide[size:] = (wide[size:] + part[: max(0, len(b) - size)] * np.uint64(pow(256, size, modulus))) % m
            part, size = wide, size * 2
    return out


def rolling_polynomial(data: bytes, window: int = 64, least: int = MIN, target: int = AVG, most: int = MAX) -> Iterator[int]:
    at = np.flatnonzero(_polynomial(data, window) % np.uint64(max(1, (1 << 20) // target)) == 0) + 1
    return picked(at, len(data), least, most)


def rolling_rabin(data: bytes, window: int = 64, least: int = MIN, target: int = AVG, most: int = MAX) -> Iterator[int]:
    """The state is shifted by a byte and cut to `degree` bits at each step, so it is what the last bytes, and those
    that left the window, put in: positions are computed all at once. `least` must reach beyond window and state."""
    degree = POLY.bit_length() - 1
    if least < window + degree // 8 + 2:
        raise ValueError("least is below the window and the bytes of the state")
    full, n = np.uint64((1 << degree) - 1), len(data)
    # fixed rule: where a byte leaves the window its table value is shifted by the window's bits, modulo the degree
    leaving = np.array([v << ((window - 1) * 8 % degree) & int(full) for v in _mod_table(degree)], np.uint64)
    b = np.frombuffer(data, np.uint8)
    put = b.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    out[window:] = leaving[b[: max(0, n - window)]]
    h = np.zeros(n, np.uint64)
    for j in range(min(n, degree // 8 + 1)):
        h[j:] ^= (put[: n - j] << np.uint64(8 * j) ^ (out[: n - j] << np.uint64(8 * j) & full) << np.uint64(8)) & full
    return picked(np.flatnonzero(h % np.uint64(max(1, (1 << 20) // target)) == 0) + 1, n, least, most)


@lru_cache(maxsize=2)
def _mod_table(degree: int) -> list[int]:
    """Each byte's remainder, as the rule has it."""
    out = []
    for i in range(256):
        v = i << (degree - 8)
        for _ in range(8):
            v = (v << 1 ^ POLY if v >> (degree - 1) & 1 else v << 1) & ((1 << degree) - 1)
        out.append(v)
    return out


def buzhash(data: bytes, window: int = 64, mask: int = 0x1FFF, least: int = MIN, most: int = MAX, every: int | None = None) -> Iterator[int]:
    """The byte that leaves is taken out before the next rotation, so the state keeps a trace of earlier bytes: after it
    left, a byte is in the state twice, one step apart. Both are xors of prefixes, taken in stretches of a chunk."""
    turning, n, start = Turning(gear_table("draw")[np.frombuffer(data, np.uint8)]), len(data), 0
    while start < n:
        top = min(start + most, n)
        end = top
        for a in range(start + max(1, least), top + 1, 4096):
            ends = np.arange(a, min(a + 4096, top + 1))
            h = turning.at(start, ends)
            gone = ends - start > window
            left = ends[gone] - window
            h[gone] ^= _turned(turning.prefix[left] ^ turning.prefix[start], ends[gone].astype(np.uint64))
            hit = np.flatnonzero(h % np.uint64(every) == 0 if every else h & np.uint64(mask) == 0)
            if len(hit):
                end = int(ends[hit[0]])
                break
        yield end
        start = end


@lru_cache(maxsize=4)
def _leaving(window: int) -> list[int]:
    """Fixed rule: what each byte has put in by the time that it leaves the window."""
    power = 1
    for _ in range(window - 1):
        power = power * 256 % M53
        if power >= TOP:
            power = (power ^ POLY) & M53
    return [b * power for b in range(256)]


def _folded(data: bytes, window: int, least: int, most: int, modulus: int, cut: Callable[[int, int], bool]) -> Iterator[int]:
    """Chunks under a polynomial hash that is folded (fixed rule: from TOP on xored with POLY), so that it must be
    followed byte by byte from each chunk's start. cut(hash, size) is only asked where hash % modulus is 0."""
    n, start, leaving = len(data), 0, _leaving(window)
    while start < n:
        end, h, size = min(start + most, n), 0, 0
        for b in data[start : min(start + window, end)]:
            h = (h * 256 + b) % M53
            if h >= TOP:
                h = (h ^ POLY) & M53
            size += 1
            if size >= least and h % modulus == 0 and cut(h, size):
                break
        else:
            quiet = min(end, max(start + window, start + least - 1))
            for b, out in zip(data[start + window : quiet], data[start : max(start, quiet - window)], strict=True):
                h = ((h - leaving[out]) * 256 + b) % M53
                if h >= TOP:
                    h = (h ^ POLY) & M53
            size = max(size, quiet - start)
            for b, out in zip(data[quiet:end], data[max(0, quiet - window) : end - window], strict=False):
                h = ((h - leaving[out]) * 256 + b) % M53
                if h >= TOP:
                    h = (h ^ POLY) & M53
                size += 1
                if h % modulus == 0 and size >= least and cut(h, size):
                    break
        yield start + size
        start += size


def rabin(data: bytes, window: int = 48, mask: int = 0x1FFF, least: int = MIN, most: int = MAX) -> Iterator[int]:
    return _folded(data, window, least, most, mask + 1, lambda h, _: not h & mask)


def tttd(data: bytes, window: int = 48, primary: int = 1024, secondary: int = 4096, least: int = MIN, target: int = AVG, most: int = MAX, hit: tuple[int, int] = (0, 0)) -> Iterator[int]:
    """A hit of the rare divisor cuts at once, one of the frequent divisor from half of the target on."""
    modulus = math.gcd(primary, secondary) if hit == (0, 0) else 1
    return _folded(data, window, least, most, modulus, lambda h, size: h % secondary == hit[1] or (h % primary == hit[0] and size >= target // 2))


def gear_cdc(data: bytes, window: int = 32, mask: int = (1 << 22) - 1, zeros: int = 13, least: int = MIN, most: int = MAX) -> Iterator[int]:
    """Xor of the table over the window; leading zeros of the masked value, seen as 32 bits."""
    g = gear_table("gear")[np.frombuffer(data, np.uint8)] & np.uint64(0xFFFFFFFF)
    run = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(g)]) if len(g) else np.zeros(1, np.uint64)
    h = run[1:].copy()
    h[window:] ^= run[1 : len(g) - window + 1] if len(g) > window else h[:0]
    at = np.flatnonzero((h & np.uint64(mask)) < np.uint64(1 << (32 - zeros))) + 1
    return picked(at, len(data), least, most)


LEVELS = {
    "micro": (512, 2048, 0x3FF, "polynomial"),
    "small": (2048, 8192, 0x7FF, "polynomial"),
    "medium": (8192, 32768, 0xFFF, "sha1"),
    "large": (32768, 131072, 0x1FFF, "sha1"),
    "super": (131072, 1048576, 0x3FFF, "sha1"),
}


def level_for(n: int) -> str:
    return next((name for name, below in (("micro", 4096), ("small", 32768), ("medium", 262144), ("large", 2097152)) if n < below), "super")


def ml_cdc(data: bytes, level: str | None = None, window: int = 48) -> Iterator[int]:
    """A level by the size of the content; polynomial or SHA-1 of the window."""
    least, most, mask, kind = LEVELS[level or level_for(len(data))]
    n = len(data)
    if n <= least:
        return iter([n] if n else [])
    if kind == "polynomial":
        return picked(np.flatnonzero(_polynomial(data, window) & np.uint64(mask) == 0) + 1, n, least, most)

    def walk() -> Iterator[int]:
        start = 0
        while start < n:
            end = min(start + most, n)
            for p in range(start + least - 1, end):
                if not int.from_bytes(hashlib.sha1(data[p + 1 - window : p + 1]).digest()[:4], "big") & mask:
                    end = p + 1
                    break
            yield end
            start = end

    return walk()


def universal_rolling(data: bytes, target: int = 1024, least: int = 512, most: int = 2048) -> Iterator[int]:
    """Sum of a window of bytes modulo 256 equal to the target's; else the last space in the final 100 bytes."""
    n = len(data)
    window = min(32, (most - least) // 4)
    total = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8), dtype=np.int64)])
    at = np.flatnonzero((total[window:] - total[: len(total) - window]) % 256 == target % 256) if n >= window else np.zeros(0, np.int64)
    start = 0
    while start < n:
        if start + least >= n:
            yield n
            return
        first, last = max(start + least, start + target - target // 2), min(start + most, n)
        k = int(np.searchsorted(at, first))
        if k < len(at) and at[k] + window <= last:
            end = int(at[k])
        else:
            back = min(100, last - start - least)
            space = data.rfind(b" ", last - back + 1, last + 1)
            end = space if space > start else last
        yield end
        start = end


def _chunks(text: str | bytes | None, cuts: Cuts) -> Iterator[tuple]:
    data = text if isinstance(text, bytes) else (text or "").encode()
    start = 0
    for end in cuts(data):
        piece = data[start:end]
        yield piece.decode("utf-8", "replace"), start, len(piece), hashlib.md5(piece).hexdigest()
        start = end


def content_defined(df: DataFrame, rule: Cuts, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """doc_id, chunk_index, content, size, start, n_bytes, digest by one of the rules of this module."""
    return chunk_rows(df, partial(_chunks, cuts=partial(rule, **settings)), [text], SCHEMA, key)
