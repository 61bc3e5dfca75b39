"""FLAC media columns: mono streams of 8-bit samples, decoded to PCM blocks with seekable offsets.

The encoder predicts each block of BLOCK samples by the best fixed predictor (or keeps a constant
or the plain samples) and writes Rice residuals, a checksum of each header and frame, an MD5 of the
whole and a seek table with each frame (of streams near a gigabyte with every second, third and so on). The decoder
also takes linear predictors of up to order 32, partitioned residuals, plain partitions and wasted bits.
Frames are worked on side by side: a step decodes one sample of each.

Hostile cases: a null text is an empty one, whose payload is 64 zero bytes; a payload of any length
is handled in groups of GROUP frames, so memory doesn't grow with it; a stream that is damaged, or of
several channels or over 16 bits, raises ValueError in decode(), and in read_back() gives a row with nulls and the
reason in error; repeated rows
give repeated rows; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import small_batches

BLOCK = 1024
#: Frames worked on side by side.
GROUP = 4096
#: Frames whose samples are encoded at a time, so that they stay in the cache.
NEAR = 128
PAD = 64
#: Zero bytes behind the frames: more than 16 samples can use up before the end is looked for.
AHEAD = 128
RATE = 8000
MAX_RICE = 14
#: Bytes that a seek table may have; fixed by the format.
MOST_SEEK = (1 << 24) - 1
#: Coefficients of the fixed predictors by order; fixed by the format.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}

MEDIA = "doc_id long, n_bytes long, media binary"
BLOCKS = "doc_id long, block long, sample_offset long, n_samples long, byte_offset long, pcm binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, block_offsets array<long>, error string"


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out.append(v)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = [int(x) for x in _crc_table(8, 0x07)], _crc_table(16, 0x8005)
#: Leading zeros of 16 bits.
_ZEROS = np.array([16 - v.bit_length() for v in range(1 << 16)], np.uint64)
_1, _3, _7, _48, _63 = (np.uint64(x) for x in (1, 3, 7, 48, 63))


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The frame checksum of each span of buf."""
    order = np.argsort(starts - ends, kind="stable")
    at, sizes = starts[order], (ends - starts)[order]
    crc = np.zeros(len(at), np.uint16)
    live = len(at)
    for t in range(int(sizes[0]) if live else 0):
        while live and sizes[live - 1] <= t:
            live -= 1
        c = crc[:live]
        crc[:live] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ buf[at[:live] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _coded(number: int) -> bytes:
    """A frame number in the variable-length form of the format."""
    if number < 0x80:
        return bytes([number])
    more = next(n for n in range(1, 7) if number < 1 << (5 * n + 6))
    tail = [0x80 | (number >> (6 * k)) & 0x3F for k in reversed(range(more))]
    return bytes([(0xFF00 >> (more + 1)) & 0xFF | number >> (6 * more), *tail])


@lru_cache(65536)
def _header(number: int, size: int) -> bytes:
    head = bytes([0xFF, 0xF8, (0xA0 if size == BLOCK else 0x70) | 0x04, 0x02]) + _coded(number)
    if size != BLOCK:
        head += struct.pack(">H", size - 1)
    return head + bytes([_crc8(head)])


def _packed(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int) -> bytes:
    """Bytes with values of up to 32 bits written at bit places: (place, value, width), none upon another.

    Each value falls into two 32-bit words; sums of what falls into a word are exact, as no bits meet.
    """
    words = np.zeros(bits // 32 + 2)
    for place, value, width in chunks:
        if len(place):
            shifted = value.astype(np.uint64) << (64 - width - (place & 31)).astype(np.uint64)
            word = place >> 5
            words += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), len(words))
            words += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    return words.astype(">u4").tobytes()[: bits // 8]


def _frames(samples: np.ndarray, sizes: np.ndarray, numbers: list[int]) -> list[bytes]:
    """The frames, but for their checksums, of consecutive blocks of 8-bit samples."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    within = np.arange(len(samples)) - np.repeat(starts, sizes)
    wide = samples.astype(np.int32)
    cost, folded = [], []
    res = wide
    for order in range(3):
        if order:
            res = np.concatenate(([0], np.diff(res))).astype(np.int32)
        u = np.where(within >= order, (res << 1) ^ (res >> 31), 0)
        folded.append(u)
        cost.append(np.add.reduceat(u, starts) + np.where(sizes > order, 0, 1 << 40))
    best = np.argmin(cost, axis=0)
    of = np.repeat(best, sizes)
    u = np.choose(of, folded)
    bits = np.array([np.add.reduceat(u >> k, starts) + (k + 1) * (sizes - best) for k in range(10)])
    rice = np.argmin(bits, axis=0)
    total = bits[rice, np.arange(len(sizes))] + 10 + 8 * best
    constant = np.maximum.reduceat(samples, starts) == np.minimum.reduceat(samples, starts)
    plain = ~constant & (total >= 8 * sizes)
    total = np.where(constant, 8, np.where(plain, 8 * sizes, total)) + 8
    room = -(-total // 8) * 8
    at = np.cumsum(room) - room
    coded = ~constant & ~plain
    kind = np.where(constant, 0, np.where(plain, 0b10, (0b001000 | best) << 1))
    raw = np.repeat(plain, sizes) | (np.repeat(coded, sizes) & (within < of))
    rest = np.repeat(coded, sizes) & (within >= of)
    k = np.repeat(rice, sizes)[rest]
    v = u[rest].astype(np.int64)
    q = v >> k
    full = np.zeros(len(samples), np.int64)
    full[rest] = q + 1 + k
    before = np.cumsum(full) - full
    ends_at = (np.repeat(at + 18 + 8 * best - before[starts], sizes) + before)[rest] + q
    chunks = [
        (at, kind, np.full(len(at), 8)),
        (at[constant] + 8, wide[starts[constant]] & 0xFF, np.full(int(constant.sum()), 8)),
        ((at + 8 + 8 * best)[coded], rice[coded], np.full(int(coded.sum()), 10)),  # method 0, one partition, its parameter
        (np.repeat(at + 8, sizes)[raw] + 8 * within[raw], wide[raw] & 0xFF, np.full(int(raw.sum()), 8)),
        (ends_at, (v & ((1 << k) - 1)) | (1 << k), k + 1),
    ]
    body = _packed(chunks, int(room.sum()))
    cut, found = (at // 8).tolist() + [len(body)], []
    for i, (n, size) in enumerate(zip(numbers, sizes.tolist())):
        found.append(_header(n, size) + body[cut[i] : cut[i + 1]])
    return found


def _summed(frames: list[bytes]) -> list[bytes]:
    """Frames with their checksums behind them."""
    sizes = np.array([len(f) for f in frames])
    ends = np.cumsum(sizes)
    sums = crc16(np.frombuffer(b"".join(frames), np.uint8), ends - sizes, ends)
    return [f + struct.pack(">H", c) for f, c in zip(frames, sums.tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of unsigned bytes; none is empty."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    plan = [(i, n, p[a : a + BLOCK]) for i, p in enumerate(payloads) for n, a in enumerate(range(0, len(p), BLOCK))]
    for g in range(0, len(plan), GROUP):
        part, made = plan[g : g + GROUP], []
        for h in range(0, len(part), NEAR):
            few = part[h : h + NEAR]
            samples = (np.frombuffer(b"".join(b for _, _, b in few), np.uint8) ^ np.uint8(0x80)).view(np.int8)
            made += _frames(samples, np.array([len(b) for _, _, b in few]), [n for _, n, _ in few])
        for (i, _, _), f in zip(part, _summed(made)):
            frames[i].append(f)
    out = []
    for p, fs in zip(payloads, frames):
        signed = (np.frombuffer(p, np.uint8) ^ np.uint8(0x80)).tobytes()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, at, every = [], 0, 1 + 18 * len(fs) // MOST_SEEK
        for n, f in enumerate(fs):
            if n % every == 0:
                points.append(struct.pack(">QQH", n * BLOCK, at, min(BLOCK, len(p) - n * BLOCK)))
            at += len(f)
        seek = b"".join(points)
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(fs))
    return out


@lru_cache(65536)
def _parsed(head: bytes, block: int) -> tuple[int, int, int]:
    """(frame or sample number, block size, bytes) of the header that head begins with."""
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should be")
    code, rate = head[2] >> 4, head[2] & 15
    if head[3] >> 4 or head[3] & 1:
        raise ValueError("one channel only")
    first = head[4]
    more = 0 if first < 0x80 else next(k for k in range(1, 8) if not (first << (k + 1)) & 0x80)
    number = first if not more else first & (0x3F >> more)
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    at = 5 + more
    if code in (6, 7):
        size = int.from_bytes(head[at : at + code - 5], "big") + 1
        at += code - 5
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if _crc8(head[:at]) != head[at]:
        raise ValueError("a header's checksum is wrong")
    return number, size, at + 1


class Stream:
    """The metadata of a stream."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        self.data, self.points, at, last = data, [], 4, False
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = struct.unpack(">H", body[2:4])[0]
                packed = int.from_bytes(body[10:18], "big")
                self.bits, self.samples, self.md5 = (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
                if packed >> 41 & 7:
                    raise ValueError("one channel only")
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
            at += 4 + size
        self.first = at
        if self.bits > 16:
            raise ValueError("up to 16 bits a sample only")

    def complete(self) -> bool:
        """If the seek table has every frame."""
        at = 0
        for start, _, n in self.points:
            if start != at:
                return False
            at += n
        return bool(self.points) and at == self.samples


def _decoded(buf: np.ndarray, starts: list[int], blocks: list[int], bits: list[int]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Samples, ends and numbers of the frames that start at the given bytes of buf."""
    raw = buf.tobytes()
    heads = [_parsed(raw[s : s + 16], b) for s, b in zip(starts, blocks)]
    padded = np.concatenate((buf, np.zeros(AHEAD + 8, np.uint8)))
    # The 64 bits from each byte on: an array whose items overlap.
    window = np.ndarray((len(buf) + AHEAD,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = sorted(range(len(starts)), key=lambda i: -heads[i][1])
    n = np.array([heads[i][1] for i in order])
    p = np.array([8 * (starts[i] + heads[i][2]) for i in order], np.int64)
    depth = np.array([bits[i] for i in order])
    limit = 8 * len(buf)

    def take(width: np.ndarray | int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Up to 32 bits of each frame; moves on."""
        at = p[which]
        if len(at) and int(at.max()) > limit:
            raise ValueError("a frame ends too soon")
        w = window[at >> 3] << (at & 7).astype(np.uint64)
        p[which] = at + width
        return ((w >> np.uint64(1)) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return v - ((v >> (np.asarray(width) - 1)) << np.asarray(width))

    kind = take(8)
    if (kind & 0x80).any():
        raise ValueError("a subframe of an unknown kind")
    # Bits that all samples end with zero in are left out; how many is said in unary.
    wasted = np.zeros(len(order), np.int64)
    going = np.flatnonzero(kind & 1)
    while len(going):
        wasted[going] += 1
        going = going[take(1, going) == 0]
    depth = depth - wasted
    if (depth < 1).any():
        raise ValueError("more wasted bits than a sample has")
    kind >>= 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind < 2)).all():
        raise ValueError("a subframe of an unknown kind")
    lag = np.where(fixed, kind & 7, np.where(linear, (kind & 31) + 1, 0))
    most = int(n.max())
    out = np.zeros((most, len(order)), np.int32)
    same = np.flatnonzero(kind == 0)
    if len(same):
        out[:, same] = signed(take(depth[same], same), depth[same])
    for i in np.flatnonzero(kind == 1):
        for t in range(n[i]):
            out[t, i] = signed(take(depth[i : i + 1], np.array([i])), depth[i : i + 1])[0]
    for t in range(int(lag.max())):
        which = np.flatnonzero(lag > t)
        out[t, which] = signed(take(depth[which], which), depth[which])
    coef, shift = np.zeros((len(order), max(1, int(lag.max()))), np.int64), np.zeros(len(order), np.int64)
    for o, c in FIXED.items():
        if o and (which := fixed & (lag == o)).any():
            coef[which, :o] = c
    which = np.flatnonzero(linear)
    if len(which):
        precision = np.zeros(len(order), np.int64)
        precision[which] = take(4, which) + 1
        shift[which] = take(5, which)
        for j in range(int(lag[which].max())):
            part = which[lag[which] > j]
            coef[part, j] = signed(take(precision[part], part), precision[part])
    coded = np.flatnonzero(fixed | linear)
    rice, width, each = np.zeros(len(order), np.int64), np.full(len(order), 4), np.full(len(order), 1 << 40)
    if len(coded):
        width[coded] = 4 + take(2, coded)
        each[coded] = n[coded] >> take(4, coded)
    # The frames with residuals, longest first, so that those still running are the first ones.
    place, param, own_lag, lengths, parts_of = p[coded].astype(np.uint64), rice[coded].astype(np.uint64), lag[coded], n[coded], each[coded]
    rows = np.zeros((most if len(coded) else 0, len(coded)), np.int32)
    latest = int(own_lag.max()) if len(coded) else 0
    rows[:latest] = out[:latest, coded]
    turns = {int(x) for x in own_lag}  # steps at which a partition's parameter is read
    for size in np.unique(parts_of):
        turns.update(range(0, most, max(1, int(size))))
    own_coef, own_shift, own_width = coef[coded], shift[coded], width[coded]
    predicted, plain = bool(latest), np.full(len(coded), -1)
    live = len(coded)
    for t in range(len(rows)):
        while live and lengths[live - 1] <= t:
            live -= 1
        turn: np.ndarray | slice = slice(0, live) if t >= latest else np.flatnonzero(own_lag[:live] <= t)
        if t in turns:
            now = np.arange(live)[turn]
            fresh = now[(t == own_lag[now]) | (t % parts_of[now] == 0)]
            if len(fresh):
                p[coded[fresh]] = place[fresh].astype(np.int64)
                param[fresh] = take(own_width[fresh], coded[fresh]).astype(np.uint64)
                place[fresh] = p[coded[fresh]].astype(np.uint64)
                escaped = param[fresh].astype(np.int64) == (1 << own_width[fresh]) - 1
                plain[fresh] = -1
                if escaped.any():  # plain samples of the width that follows
                    which = fresh[escaped]
                    p[coded[which]] = place[which].astype(np.int64)
                    plain[which] = take(5, coded[which])
                    place[which], param[which] = p[coded[which]].astype(np.uint64), 0
        k, at = param[turn], place[turn]
        if not t & 15 and len(at) and int(at.max()) > limit:
            raise ValueError("a frame ends too soon")
        w = window[at >> _3] << (at & _7)
        raw = plain[turn]
        straight = np.flatnonzero(raw >= 0)
        bits_here, from_here = w[straight], at[straight]
        w[straight] = ~np.uint64(0)  # no zeros to look for
        q = _ZEROS.take((w >> _48).view(np.int64))
        long = np.flatnonzero(q == 16)
        if len(long):
            going = long
            while len(going):  # runs of zeros, 16 at a time
                far = at[going] + q[going]
                if int(far.max()) > limit:
                    raise ValueError("a frame ends too soon")
                more = _ZEROS[(window[far >> _3] << (far & _7)) >> _48]
                q[going] += more
                going = going[more == 16]
            far = at[long] + q[long]
            if int(far.max()) > limit:
                raise ValueError("a frame ends too soon")
            w[long] = window[far >> _3] << (far & _7)
            used = q + _1
            skip = used.copy()
            skip[long] = 1
        else:
            used = skip = q + _1
        v = (q << k) | (((w << skip) >> _1) >> (_63 - k))
        place[turn] = at + used + k
        value = (v >> _1).view(np.int64) ^ -(v & _1).view(np.int64)
        if len(straight):
            size = raw[straight]
            some_bits = ((bits_here >> _1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            value[straight] = np.where(size > 0, some_bits - ((some_bits >> np.maximum(size - 1, 0)) << size), 0)
            ends_at = place[turn]
            ends_at[straight] = from_here + size.astype(np.uint64)
            place[turn] = ends_at
        if predicted:
            now = np.arange(live)[turn]
            some = np.flatnonzero(own_lag[now])
            if len(some):
                top = int(own_lag[now[some]].max())
                back = rows[max(0, t - top) : t, now[some]][::-1].astype(np.int64)
                value[some] += (back * own_coef[now[some], : len(back)].T).sum(axis=0) >> own_shift[now[some]]
        rows[t, turn] = value
    if len(coded):
        if int(place.max()) > limit:
            raise ValueError("a frame ends too soon")
        p[coded] = place.astype(np.int64)
        if len(coded) == len(order):
            out = rows
        else:
            out[:, coded] = rows
    if wasted.any():
        out = out << wasted
    ends = (p + 7) // 8
    if len(ends) and int(ends.max()) + 2 > len(buf):
        raise ValueError("a frame ends too soon")
    begin = np.array([starts[i] for i in order])
    stored = buf[ends].astype(np.int64) << 8 | buf[ends + 1]
    if (crc16(buf, begin, ends) != stored).any():
        raise ValueError("a frame's checksum is wrong")
    samples: list[np.ndarray] = [out[:0, 0]] * len(order)
    stops, numbers = [0] * len(order), [0] * len(order)
    columns = np.ascontiguousarray(out.T)
    for row, i in enumerate(order):
        samples[i], stops[i], numbers[i] = columns[row, : n[row]], int(ends[row]) + 2, heads[i][0]
    return samples, stops, numbers


def blocks(streams: list[Stream]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream its blocks in order: sample offset, byte offset of the frame, samples."""
    found: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in streams]
    base = np.cumsum([0, *(len(s.data) for s in streams)]).tolist()
    direct = [i for i, s in enumerate(streams) if s.complete()]
    plan = [(i, streams[i].first + off, start, n) for i in direct for start, off, n in streams[i].points]
    for g in range(0, len(plan), GROUP):
        part = plan[g : g + GROUP]
        low, high = base[part[0][0]] + part[0][1], base[part[-1][0] + 1]
        spans = [base[i] + at - low for i, at, _, _ in part]
        buf = _span(streams, base, part[0][0], part[-1][0], low, high, spans[-1])
        samples, _, _ = _decoded(buf, spans, [streams[i].block for i, *_ in part], [streams[i].bits for i, *_ in part])
        for (i, at, start, n), s in zip(part, samples):
            if len(s) != n:
                raise ValueError("the seek table is wrong")
            found[i].append((start, at, s))
    # Without a whole seek table a frame's place is known when the one before is decoded.
    todo = {i: (streams[i].first, 0) for i in range(len(streams)) if not streams[i].complete() and streams[i].samples}
    for i, (at, start) in todo.items():
        data = np.frombuffer(streams[i].data, np.uint8)
        while start < streams[i].samples:
            high = min(len(data), at + 64 * 1024 + 4 * streams[i].block)
            s, ends, _ = _decoded(data[at:high], [0], [streams[i].block], [streams[i].bits])
            found[i].append((start, at, s[0]))
            at, start = at + ends[0], start + len(s[0])
    return found


def _span(streams: list[Stream], base: list[int], first: int, last: int, low: int, high: int, final: int) -> np.ndarray:
    """Bytes low to high of the streams laid end to end; of a long last stream only what its last frame can need."""
    high = min(high, low + final + 64 * 1024 + 4 * streams[last].block)
    parts = []
    for i in range(first, last + 1):
        a, b = max(low, base[i]), min(high, base[i + 1])
        parts.append(streams[i].data[a - base[i] : b - base[i]])
    return np.frombuffer(b"".join(parts), np.uint8)


def _whole(stream: Stream, found: list[tuple[int, int, np.ndarray]]) -> bytes:
    """The unsigned bytes of a stream's blocks, checked against count and MD5."""
    pcm = np.concatenate([b for _, _, b in found]) if found else np.zeros(0, np.int64)
    signed = pcm.astype(np.int8)
    if len(pcm) != stream.samples or (any(stream.md5) and hashlib.md5(signed.tobytes()).digest() != stream.md5):
        raise ValueError("the stream's samples aren't those that it was made of")
    return (signed.view(np.uint8) ^ np.uint8(0x80)).tobytes()


def decode(media: list[bytes]) -> list[bytes]:
    """The unsigned bytes of 8-bit streams, checked against counts and MD5."""
    streams = [Stream(m) for m in media]
    return [_whole(s, found) for s, found in zip(streams, blocks(streams))]


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and these filled up by zeros to a positive multiple of PAD."""
    data = (text or "").encode("utf-8")
    return len(data), data + bytes(-len(data) % PAD or (0 if data else PAD))


#: Bytes of payload that a vectorised step works on at a time.
STEP = 4 << 20


def _runs(items: list, sizes: list[int]) -> Iterator[list]:
    run, total = [], 0
    for x, n in zip(items, sizes):
        if run and total + n > STEP:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column("doc_id"), batch.column("text")))
        for run in _runs(rows, [len(t.as_buffer()) if t.is_valid else 0 for _, t in rows]):
            made = [payload(t.as_py()) for _, t in run]
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, _ in run], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(encode([p for _, p in made]), pa.binary())], ["doc_id", "n_bytes", "media"])


def feature(data: bytes, n_blocks: int) -> str:
    """Peak, zero crossings and energy of the samples, and how many blocks they came in."""
    s = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    return f"blocks={n_blocks};peak={int(np.abs(s).max())};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())};energy={int((s * s).sum())}"


def _digested(media: list[bytes]) -> list[tuple]:
    """What DIGEST has of each stream after its number of bytes."""
    streams = [Stream(m) for m in media]
    out = []
    for m, s, found in zip(media, streams, blocks(streams)):
        data = _whole(s, found)
        out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(data, len(found)), [at for _, at, _ in found], None))
    return out


def _safely(media: list[bytes]) -> list[tuple]:
    """The same; a stream that can't be read doesn't take the others with it."""
    try:
        return _digested(media)
    except ValueError as e:
        if len(media) == 1:
            return [(None, None, None, len(media[0]), hashlib.sha256(media[0]).hexdigest(), None, None, str(e))]
        return [row for m in media for row in _safely([m])]


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*[(x.split()[0], _KINDS[x.split()[1]]) for x in DIGEST.split(", ")])
    for batch in batches:
        rows = [(i, n, m or b"") for i, n, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")))]
        for run in _runs(rows, [len(m) for _, _, m in rows]):
            out = [(i, n, *digest) for (i, n, _), digest in zip(run, _safely([m for _, _, m in run]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], list(names))


def _pcm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()))
        for run in _runs(rows, [len(m) for _, m in rows]):
            out = [(i, k, start, len(s), at, s.astype(np.int8).tobytes()) for (i, _), found in zip(run, blocks([Stream(m) for _, m in run])) for k, (start, at, s) in enumerate(found)]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of each text's padded bytes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, MEDIA)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row for each block of 8-bit streams (doc_id, media), with its sample and byte offset."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_pcm, BLOCKS)


def read_back(media: DataFrame) -> DataFrame:
    """The digest of what each stored stream (doc_id, n_bytes, media) holds."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_back, DIGEST)
