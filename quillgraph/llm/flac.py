"""FLAC streams in numpy: many frames at a time, one lane for each frame.

All frames of an Arrow batch advance together, one sample a step, so bit reading costs a few
array operations a step whatever the number of frames. The decoder takes mono streams with
constant, verbatim, fixed and linear-predictive subframes, partitioned Rice residuals with
escapes, and any block size; it checks each header's CRC-8, each frame's CRC-16 and the MD5 of
the samples. Frames are found by their sync code and header check, as a seeking player does;
what only looks like a header inside a frame is told by the frame's checksum.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the format.
BLOCK = 192
SAMPLE_BITS = 8
SAMPLE_RATE = 8000
_SIZES = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_ROW = 288
#: Orders of linear prediction that the encoder tries, bits of a coefficient and their shift.
LPC_ORDERS, LPC_BITS, LPC_SHIFT = (2, 4), 10, 7
#: Bits of a frame that linear prediction must save. Its frames share no patterns with others,
#: which the compression of the stored table finds in frames of fixed predictors.
LPC_GAIN = 32
#: Frames whose linear predictors are worked out at a time.
_TOGETHER = 4096


def _crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
#: Leading zeros of 16 bits.
_ZEROS = np.array([16 - k.bit_length() for k in range(1 << 16)], np.int64)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start : start + size] for each lane."""
    table, crc, full = (_CRC8, _CRC16)[bits == 16], np.zeros(len(starts), np.uint32), (1 << bits) - 1
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    for k in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-left, -k, "left"))
        crc[:n] = table[(crc[:n] >> (bits - 8)) ^ data[at[:n] + k]] ^ (crc[:n] << 8 & full)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the UTF-8 scheme, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6 if k < 6 else 36))
    return bytes([(0xFF00 >> more + 1 & 0xFF) | n >> 6 * more, *(0x80 | n >> 6 * k & 0x3F for k in reversed(range(more)))])


class _Rows:
    """A row of bits for each lane; ``put`` appends up to 16 bits to the lanes given."""

    def __init__(self, lanes: int):
        self.buf = np.zeros(lanes * _ROW, np.uint8)
        self.base = np.arange(lanes) * _ROW
        self.pos = np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray | slice, value: np.ndarray, bits: np.ndarray | int) -> None:
        pos = self.pos[lanes]
        at, word = self.base[lanes] + (pos >> 3), value << (24 - (pos & 7) - bits)
        self.buf[at] |= (word >> 16).astype(np.uint8)
        self.buf[at + 1] |= (word >> 8 & 255).astype(np.uint8)
        self.buf[at + 2] |= (word & 255).astype(np.uint8)
        self.pos[lanes] = pos + bits


def _coefficients(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised coefficients of a linear predictor for each lane, from its autocorrelation."""
    y = x.astype(np.float64)
    lags = np.stack([(y[:, : BLOCK - k] * y[:, k:]).sum(1) for k in range(order + 1)], 1)
    near = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    matrix = lags[:, near] + (lags[:, :1, None] * 1e-6 + 1e-3) * np.eye(order)
    exact = np.linalg.solve(matrix, lags[:, 1:, None])[:, :, 0]
    most = 1 << LPC_BITS - 1
    return np.clip(np.round(exact * (1 << LPC_SHIFT)), -most, most - 1).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload: unsigned bytes as signed 8-bit samples, frames of 192.

    Payload sizes are positive multiples of 192. Each frame takes the cheapest of a constant, a
    verbatim, five fixed-predictor and two linear-prediction subframes with the best Rice parameter.
    """
    if not payloads:
        return []
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    lanes, n_frames = len(x), [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(n) for n in n_frames])
    best, order, residual = np.full(lanes, 1 << 30), np.zeros(lanes, np.int64), np.zeros((lanes, BLOCK), np.int16)
    rice, e = np.zeros(lanes, np.int64), x
    for o in range(len(_FIXED)):
        if o:
            e = np.diff(e, axis=1)
        u = ((e << 1) ^ (e >> 15)).astype(np.uint16)
        mean = u.mean(1) + 1e-9
        guess = np.clip(np.floor(np.log2(mean)), 0, 13).astype(np.int64)
        for k in (guess, guess + 1):
            cost = 10 + SAMPLE_BITS * o + (BLOCK - o) * (k + 1) + (u >> k[:, None].astype(np.uint16)).sum(1, dtype=np.int64)
            won = cost < best
            best, order, rice = np.where(won, cost, best), np.where(won, o, order), np.where(won, k, rice)
        here = order == o
        residual[here, o:] = u[here].astype(np.int16)
    lpc, coef = np.zeros(lanes, bool), np.zeros((lanes, max(LPC_ORDERS)), np.int64)
    for some in (slice(at, at + _TOGETHER) for at in range(0, lanes, _TOGETHER)):
        y = x[some]
        for o in LPC_ORDERS:
            q = _coefficients(y, o)
            guess = sum(q[:, i, None] * y[:, o - 1 - i : BLOCK - 1 - i].astype(np.int64) for i in range(o))
            e = (y[:, o:] - (guess >> LPC_SHIFT)).astype(np.int16)
            u = ((e << 1) ^ (e >> 15)).astype(np.uint16)
            lead = np.clip(np.floor(np.log2(u.mean(1) + 1e-9)), 0, 13).astype(np.int64)
            for k in (lead, lead + 1):
                cost = LPC_GAIN + 19 + (SAMPLE_BITS + LPC_BITS) * o + (BLOCK - o) * (k + 1) + (u >> k[:, None].astype(np.uint16)).sum(1, dtype=np.int64)
                won = cost < np.where(lpc[some], best[some], np.minimum(best[some], SAMPLE_BITS * BLOCK + LPC_GAIN))
                best[some], order[some], rice[some] = np.where(won, cost, best[some]), np.where(won, o, order[some]), np.where(won, k, rice[some])
                lpc[some] |= won
                mine = np.flatnonzero(won)
                coef[some.start + mine, :o] = q[mine]
                residual[some.start + mine, o:] = u[mine].astype(np.int16)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (best >= SAMPLE_BITS * BLOCK)
    coded = np.flatnonzero(~constant & ~verbatim)
    out = _Rows(lanes)
    number = [_number(k) for k in range(max(n_frames))]
    lengths = np.array([len(b) for b in number])[numbers]
    head = np.zeros((lanes, 12), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x10, 0x02)
    padded = np.array([list(b.ljust(7, b"\0")) for b in number], np.uint8)
    head[:, 4:11] = padded[numbers]
    crc = _crc(head.ravel(), np.arange(lanes) * 12, 4 + lengths, 8)
    rows = out.buf.reshape(lanes, _ROW)
    rows[:, :12] = head
    rows[np.arange(lanes), 4 + lengths] = crc
    out.pos += 8 * (5 + lengths)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 31, 8) + order))
    out.put(slice(None), kind << 1, 8)
    raw = x.astype(np.int64) & 255
    if (lane := np.flatnonzero(constant)).size:
        out.put(lane, raw[lane, 0], 8)
    if (lane := np.flatnonzero(verbatim)).size:
        for j in range(BLOCK):
            out.put(lane, raw[lane, j], 8)
    for j in range(len(_FIXED) - 1):
        lane = coded[order[coded] > j]
        out.put(lane, raw[lane, j], 8)
    if (lane := coded[lpc[coded]]).size:
        out.put(lane, np.full(len(lane), (LPC_BITS - 1) << 5 | LPC_SHIFT), 9)
        for j in range(max(LPC_ORDERS)):
            on = lane[order[lane] > j]
            out.put(on, coef[on, j] & (1 << LPC_BITS) - 1, LPC_BITS)
    out.put(coded, rice[coded], 10)  # coding method 0, partition order 0, one parameter
    k, first, codes = rice[coded], order[coded], np.ascontiguousarray(residual[coded].astype(np.uint16).T).astype(np.int64)
    for j in range(BLOCK):
        if j < len(_FIXED):
            on = first <= j
            lane, kk, u = coded[on], k[on], codes[j][on]
        else:
            lane, kk, u = coded, k, codes[j]
        out.pos[lane] += u >> kk
        out.put(lane, (1 << kk) | (u & ((1 << kk) - 1)), kk + 1)
    sizes = (out.pos + 7) >> 3
    crc = _crc(out.buf, out.base, sizes, 16)
    out.buf[out.base + sizes] = crc >> 8
    out.buf[out.base + sizes + 1] = crc & 255
    sizes += 2
    whole = out.buf.reshape(lanes, _ROW)[np.arange(_ROW) < sizes[:, None]].tobytes()
    ends, at, streams = np.concatenate([[0], np.cumsum(sizes)]), 0, []
    for p, n in zip(payloads, n_frames):
        own = sizes[at : at + n]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2) * 2 + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3)
        info += (SAMPLE_RATE << 44 | 0 << 41 | SAMPLE_BITS - 1 << 36 | len(p)).to_bytes(8) + hashlib.md5(signed).digest()
        streams.append(b"fLaC" + b"\x80" + len(info).to_bytes(3) + info + whole[ends[at] : ends[at + n]])
        at += n
    return streams


class _Bits:
    """Reads bits of many lanes at their own positions."""

    def __init__(self, data: np.ndarray, pos: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,))
        self.pos = pos

    def peek(self, lanes) -> np.ndarray:
        p = self.pos[lanes]
        return self.words[np.minimum(p >> 3, len(self.words) - 1)].astype(np.uint64) << (p & 7).astype(np.uint64)

    def take(self, lanes, bits) -> np.ndarray:
        w = self.peek(lanes)
        bits = np.broadcast_to(np.asarray(bits, np.int64), w.shape)
        self.pos[lanes] += bits
        return (w >> (63 - bits).astype(np.uint64) >> np.uint64(1)).astype(np.int64)

    def take_signed(self, lanes, bits) -> np.ndarray:
        v, half = self.take(lanes, bits), np.int64(1) << np.maximum(np.asarray(bits, np.int64) - 1, 0)
        return np.where(np.asarray(bits) > 0, (v ^ half) - half, 0)

    def take_rice(self, lanes, k: np.ndarray) -> np.ndarray:
        w = self.peek(lanes)
        zeros = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        if (zeros == 16).any():
            q, left = np.zeros(len(zeros), np.int64), np.arange(len(zeros))
            lane = np.arange(len(self.pos))[lanes]
            while left.size:
                z = _ZEROS[(self.peek(lane[left]) >> np.uint64(48)).astype(np.int64)]
                q[left] += z
                self.pos[lane[left]] += z
                left = left[z == 16]
                if left.size and (self.pos[lane[left]] >> 3 >= len(self.words) - 8).any():
                    raise ValueError("a residual runs past the end of the stream")
            self.pos[lane] += 1
            u = q << k | self.take(lane, k)
        else:
            tail = w << (zeros + 1).astype(np.uint64) >> (63 - k).astype(np.uint64) >> np.uint64(1)
            u = zeros << k | tail.astype(np.int64)
            self.pos[lanes] += zeros + 1 + k
        return u >> 1 ^ -(u & 1)


def _headers(data: np.ndarray, info_end: np.ndarray, stops: np.ndarray, bits_of: np.ndarray):
    """Frames of all streams: (stream, start, header bytes, block size, sample bits, number)."""
    at = np.flatnonzero((data[:-5] == 0xFF) & (data[1:-4] & 0xFE == 0xF8))
    stream = np.searchsorted(info_end, at, "right") - 1
    at, stream = (v[(stream >= 0) & (at < stops[stream])] for v in (at, stream))
    grown = np.concatenate([data, np.zeros(16, np.uint8)])
    byte = lambda k: grown[at + k].astype(np.int64)
    size_code, rate_code, channel, bits_code = byte(2) >> 4, byte(2) & 15, byte(3) >> 4, byte(3) >> 1 & 7
    lead = byte(4)
    more = np.select([lead < 0x80, lead >> 5 == 6, lead >> 4 == 14, lead >> 3 == 30, lead >> 2 == 62, lead >> 1 == 126, lead == 254], range(7), -1)
    number = np.where(more == 0, lead, lead & np.where(more > 0, 0x3F >> np.maximum(more, 0), 0))
    for k in range(1, 7):
        number = np.where(more >= k, number << 6 | byte(4 + k) & 0x3F, number)
    extra = np.select([size_code == 6, size_code == 7], [1, 2], 0)
    after = 5 + np.maximum(more, 0)
    stored_size = np.where(extra == 1, grown[at + after], grown[at + after].astype(np.int64) << 8 | grown[at + after + 1]) + 1
    block = np.where(extra > 0, stored_size, np.array([_SIZES.get(k, 0) for k in range(16)])[size_code])
    head = after + extra + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0)
    bits = np.where(bits_code == 0, bits_of[stream], np.array([_BITS.get(k, 0) for k in range(8)])[bits_code])
    ok = (more >= 0) & (block > 0) & (channel == 0) & (bits > 0) & (rate_code != 15) & (byte(3) & 1 == 0)
    ok &= _crc(grown, at, head, 8) == grown[at + head]
    return tuple(v[ok] for v in (stream, at, head + 1, block, bits, number))


def _unsound(data: np.ndarray, at: np.ndarray, stream: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each stream whether one of its frames fails its CRC-16, or it has none."""
    bad = counts == 0
    if len(at):
        last = np.concatenate([stream[1:] != stream[:-1], [True]])
        stop = np.where(last, stops[stream], np.concatenate([at[1:], [0]]))
        bad[stream[_crc(data, at, stop - at, 16) != 0]] = True
    return bad


def _chain(data: np.ndarray, at: np.ndarray, number: np.ndarray, stop: int) -> list[int]:
    """Of the places that look like headers those whose frames, numbered in a row, all have the
    right CRC-16; ValueError if there is no such chain."""
    ends = np.append(at, stop)
    path, turn = [0], [1]  # the frames so far, and for each the next end to try
    while path:
        k, e = path[-1], turn[-1]
        while e < len(ends) and (e < len(at) and number[e] != number[k] + 1 or _crc(data, ends[k : k + 1], ends[e : e + 1] - ends[k], 16)[0]):
            e += 1
        turn[-1] = e + 1
        if e >= len(ends):
            path.pop()
            turn.pop()
        elif e == len(at):
            return path
        else:
            path.append(e)
            turn.append(e + 1)
    raise ValueError("a frame's checksum is wrong")


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stream its samples and the sample offset of each frame; ValueError if damaged."""
    if not streams:
        return []
    joined = b"".join(streams)
    data = np.frombuffer(joined, np.uint8)
    stops = np.cumsum([len(s) for s in streams])
    begins, info_end, totals, sums, bits_of = stops - [len(s) for s in streams], [], [], [], []
    for s, at in zip(streams, begins):
        if s[:4] != b"fLaC" or s[4] & 0x7F or len(s) < 42:
            raise ValueError("not a FLAC stream")
        packed = int.from_bytes(s[18:26])
        if packed >> 41 & 7:
            raise ValueError("only mono streams are read")
        bits_of.append((packed >> 36 & 31) + 1)
        totals.append(packed & (1 << 36) - 1)
        sums.append(s[26:42])
        end, last = 42, s[4] >> 7
        while not last:
            last, end = s[end] >> 7, end + 4 + int.from_bytes(s[end + 1 : end + 4])
        info_end.append(at + end)
    info_end = np.array(info_end)
    stream, at, head, block, bits, number = _headers(data, info_end, stops, np.array(bits_of))
    keep, want = np.zeros(len(at), bool), [0] * len(streams)
    for k, (own, no) in enumerate(zip(stream.tolist(), number.tolist())):
        if no == want[own]:
            keep[k], want[own] = True, no + 1
    bad = _unsound(data, at[keep], stream[keep], stops, np.array(want))
    for own in np.flatnonzero(bad & (np.array(totals) > 0)).tolist():
        # Something inside a frame looked like the next header.
        mine = np.flatnonzero(stream == own)
        keep[mine] = False
        keep[mine[_chain(data, at[mine], number[mine], int(stops[own]))]] = True
    stream, at, head, block, bits = (v[keep] for v in (stream, at, head, block, bits))
    first = np.concatenate([[True], stream[1:] != stream[:-1]]) if len(stream) else np.zeros(0, bool)
    if not np.array_equal(at[first], info_end[np.array(totals) > 0]):
        raise ValueError("a stream does not begin with a frame")
    stop = np.where(np.concatenate([first[1:], [True]]), stops[stream], np.concatenate([at[1:], [0]])) if len(stream) else at
    samples, end_pos = _decode_frames(data, (at + head) * 8, block, bits)
    if ((end_pos + 7 >> 3) + 2 != stop).any():
        raise ValueError("a frame has another length than its contents")
    out, k = [], 0
    used = np.arange(samples.shape[0]) < block[:, None]
    flat, ends = samples.T[used], np.concatenate([[0], np.cumsum(block)])
    per_stream = np.bincount(stream, minlength=len(streams))
    for n, total, md5, b in zip(per_stream, totals, sums, bits_of):
        x, offsets = flat[ends[k] : ends[k + n]], ends[k : k + n] - ends[k]
        width = np.int8 if b <= 8 else np.int16
        if len(x) != total or any(md5) and hashlib.md5(x.astype(width).astype(f"<i{b + 7 >> 3}").tobytes()).digest() != md5:
            raise ValueError("the samples differ from those that were encoded")
        out.append((x, offsets))
        k += n
    return out


def _decode_frames(data: np.ndarray, pos: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (one column a frame) and the bit position after each frame's subframe."""
    lanes, longest = len(pos), int(block.max(initial=0))
    r, every = _Bits(data, pos.copy()), slice(None)
    kind = r.take(every, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits and reserved bits are not read")
    kind >>= 1
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("a reserved kind of subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    deep = int(order.max(initial=0))
    x = np.zeros((deep + longest, lanes), np.int32)  # `deep` rows of padding come first
    if constant.any():
        lane = np.flatnonzero(constant)
        x[deep:, lane] = r.take_signed(lane, bits[lane])
    for j in range(deep):
        lane = np.flatnonzero(order > j)
        x[deep + j, lane] = r.take_signed(lane, bits[lane])
    coef, shift = np.zeros((deep, lanes), np.int64), np.zeros(lanes, np.int64)
    for o in range(1, min(4, deep) + 1):
        coef[:o, fixed & (order == o)] = np.array(_FIXED[o])[:, None]
    if (lane := np.flatnonzero(lpc)).size:
        width = r.take(lane, 4) + 1
        shift[lane] = r.take_signed(lane, 5)
        for i in range(deep):
            on = order[lane] > i
            coef[i, lane[on]] = r.take_signed(lane[on], width[on])
    coded = np.flatnonzero(fixed | lpc)
    method = r.take(coded, 2)
    splits = r.take(coded, 4)
    k, raw, n, first = np.zeros(len(coded), np.int64), np.full(len(coded), -1), block[coded], order[coded]
    step = n >> splits
    simple = deep == 0 or not shift.any()
    plain = np.flatnonzero(verbatim)
    starts = np.zeros(longest, bool)
    for o, s, m in set(zip(first.tolist(), step.tolist(), n.tolist())):
        starts[[o, *range(s, m, s)] if o < m else []] = True
    uniform = (n == longest).all()
    for j in range(longest):
        if plain.size:
            lane = plain[block[plain] > j]
            x[deep + j, lane] = r.take_signed(lane, bits[lane])
        on = np.flatnonzero((first <= j) & (n > j)) if j < deep or not uniform else None
        lane = coded if on is None else coded[on]
        if not lane.size:
            continue
        at = slice(None) if on is None else on
        if starts[j]:
            new = np.arange(len(coded))[at]
            new = new[(j == first[new]) | (j % np.maximum(step[new], 1) == 0)]
            size = 4 + method[new]
            k[new] = r.take(coded[new], size)
            raw[new] = -1
            if (esc := new[k[new] == (1 << size) - 1]).size:
                raw[esc] = r.take(coded[esc], 5)
        if (raw[at] >= 0).any():
            e = np.zeros(len(lane), np.int64)
            is_raw = raw[at] >= 0
            e[is_raw] = r.take_signed(lane[is_raw], raw[at][is_raw])
            e[~is_raw] = r.take_rice(lane[~is_raw], k[at][~is_raw])
        else:
            e = r.take_rice(lane, k[at])
        guess = np.zeros(len(lane), np.int64)
        for i in range(deep):
            guess += coef[i, lane] * x[deep + j - 1 - i, lane]
        x[deep + j, lane] = e + (guess if simple else guess >> shift[lane])
    return x[deep:], r.pos


PAD = BLOCK


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with blanks to a positive multiple of 192, and their own number."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % PAD or PAD * (not raw)), len(raw)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a FLAC stream), one row for each row.

    Null texts are empty, and an empty text is one frame of blanks; texts of any length are
    encoded whole; equal texts give equal streams, so repeated rows and ties do; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [payload_of(t) for t in batch.column("text").to_pylist()]
            media = encode([p for p, _ in both])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in both], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, frames_per_block: int = 64) -> DataFrame:
    """doc_id, block, sample_offset, n_samples, pcm (16-bit little-endian), one row a block.

    A damaged stream fails the job; a null stream has no blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            given = [(d, m) for d, m in zip(ids, batch.column("media").to_pylist()) if m is not None]
            cols: list[list] = [[], [], [], [], []]
            for (doc_id, _), (x, offsets) in zip(given, decode([m for _, m in given])):
                bounds = [*offsets[::frames_per_block].tolist(), len(x)]
                for no, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for c, v in zip(cols, (doc_id, no, a, b - a, x[a:b].astype("<i2").tobytes())):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media"))
    return rows.mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def _feature(x: np.ndarray) -> str:
    """Mean level, sign changes and peak of the samples, as integers."""
    x = x.astype(np.int64)
    return f"energy={int((x * x).sum()) // len(x)};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


def _seek(x: np.ndarray, offsets: np.ndarray) -> str:
    """The number of frames, and sample offset and first sample of the middle one."""
    middle = int(offsets[len(offsets) // 2])
    return f";frames={len(offsets)};seek={middle}:{int(x[middle])}"


def describe(media: DataFrame) -> DataFrame:
    """Digests of streams of ``encode_texts``, from the samples and frame offsets that decoding
    gives back, one row for each row. A damaged stream fails the job, as its text is lost; equal
    streams give equal rows; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            streams = batch.column("media").to_pylist()
            found = decode(streams)
            samples = [x for x, _ in found]
            back = [(x + 128).astype(np.uint8).tobytes() for x in samples]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([sha(b) for b in back], pa.string()),
                pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                pa.array([len(s) for s in streams], pa.int64()),
                pa.array([sha(s) for s in streams], pa.string()),
                pa.array([_feature(x) + _seek(x, at) for x, at in found], pa.string()),
            ], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
