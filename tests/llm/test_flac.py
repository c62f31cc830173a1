from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import flac, queries


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=5))
def test_round_trip(payloads):
    payloads = [p + b" " * (-len(p) % 192) for p in payloads]
    for p, (x, offsets) in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p
        assert offsets.tolist() == list(range(0, len(p), 192))


def test_kinds_of_frames():
    wave = (128 + 90 * np.sin(np.arange(1920) / 9)).astype(np.uint8).tobytes()
    noise = np.random.default_rng(1).integers(0, 256, 1920, dtype=np.uint8).tobytes()
    steps = bytes(range(192)) * 2
    flat = b"\x07" * 384
    for p in (wave, noise, steps, flat, wave + flat + noise):
        ((x, _),) = flac.decode(flac.encode([p]))
        assert (x + 128).astype(np.uint8).tobytes() == p
    assert len(flac.encode([wave])[0]) < len(wave) * 0.8
    assert len(flac.encode([flat])[0]) < 80


def test_linear_prediction_and_escapes_are_read():
    """A frame written by hand: order 2 prediction with coefficients, two partitions, one escaped."""
    x = np.cumsum(np.cumsum(np.resize([1, -2, 1, 0, 2, -2], 192))).astype(int) % 50
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    bits += put(0b0_100001_0, 8) + put(int(x[0]), 8) + put(int(x[1]), 8) + put(4 - 1, 4) + put(1, 5) + put(4, 4) + put(-2, 4)
    residual = [int(x[k]) - ((4 * int(x[k - 1]) - 2 * int(x[k - 2])) >> 1) for k in range(2, 192)]
    bits += put(0, 2) + put(1, 4) + put(15, 4) + put(9, 5) + "".join(put(r, 9) for r in residual[:94]) + put(6, 4)
    for r in residual[94:]:
        u = r << 1 ^ r >> 63
        bits += "0" * (u >> 6) + "1" + put(u & 63, 6)
    bits += "0" * (-len(bits) % 8)
    body = b"\xff\xf8\x10\x02\x00"
    body += bytes([int(flac._crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([5]), 8)[0])]) + int(bits, 2).to_bytes(len(bits) // 8)
    body += int(flac._crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), 16)[0]).to_bytes(2)
    info = (192).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 192).to_bytes(8) + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    ((back, _),) = flac.decode([b"fLaC\x80\x00\x00\x22" + info + body])
    assert back.tolist() == x.tolist()


def test_a_planted_header_with_the_next_number():
    """A whole false header with number 66 inside verbatim frame 65 must not end that frame."""
    noise = np.random.default_rng(9).integers(0, 256, 192 * 80, dtype=np.uint8)
    false = bytes([0xFF, 0xF8, 0x10, 0x02, 66])
    false += bytes([int(flac._crc(np.frombuffer(false, np.uint8), np.array([0]), np.array([5]), 8)[0])])
    stored = np.frombuffer(false, np.uint8) ^ 128  # samples are the bytes less 128
    noise[192 * 65 + 40 : 192 * 65 + 46] = stored
    p = noise.tobytes()
    stream = flac.encode([p])[0]
    assert false in stream
    ((x, offsets),) = flac.decode([stream])
    assert (x + 128).astype(np.uint8).tobytes() == p and len(offsets) == 80
    both = flac.decode([flac.encode([b"plain ".ljust(192)])[0], stream])
    assert len(both[1][0]) == len(p)


def _plain_decode(stream):
    """A reader of its own, bit by bit, for mono streams with frames of 192 samples."""
    bits = "".join(f"{b:08b}" for b in stream[42:])
    at, out = 0, []

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    while at < len(bits):
        assert take(14) == 0b11111111111110 and take(2) == 0 and take(16) == 0x1002
        lead = take(8)
        while lead & 0x40 and lead & 0x80:  # more bytes of the frame number
            take(8)
            lead = lead << 1 & 0xFF | 0x80 if lead << 1 & 0x40 else 0
        take(8)
        kind, x = take(8) >> 1, []
        if kind == 0:
            x = [signed(8)] * 192
        elif kind == 1:
            x = [signed(8) for _ in range(192)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            coef, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[order] if kind < 32 else [], 0
            if kind >= 32:
                width, shift = take(4) + 1, signed(5)
                coef = [signed(width) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            while len(x) < 192:
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - i] for i, c in enumerate(coef)) >> shift))
        at += -at % 8 + 16
        out += x
    return out


def test_an_independent_reader_agrees():
    wave = (128 + 90 * np.sin(np.arange(1920) / 9)).astype(np.uint8).tobytes()
    text = ("the quick brown fox, " * 100).encode()[:1920]
    noise = np.random.default_rng(1).integers(0, 256, 384, dtype=np.uint8).tobytes()
    tone = (128 + 90 * np.sin(np.arange(1920) * 2.1)).astype(np.uint8).tobytes()
    kinds = set()
    for p in (wave, tone, text, noise, b" " * 192, bytes(range(192))):
        stream = flac.encode([p])[0]
        assert [v + 128 for v in _plain_decode(stream)] == list(p)
        kinds.add(stream[42 + 6] >> 1)
    assert any(k >= 32 for k in kinds) and 0 in kinds and any(8 <= k <= 12 for k in kinds)


def test_damage_is_noticed():
    stream = flac.encode([b"some text that is not flat at all ".ljust(384)])[0]
    for at in (50, len(stream) // 2, len(stream) - 1):
        with pytest.raises(ValueError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 4]) + stream[at + 1 :]])


def test_query(spark, small, documents):
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    found = queries.op3_flac_media(spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r.doc_id]
        padded = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_values_of_hard_rows(hard):
    texts = {(r.doc_id, r.text) for r in hard.collect()}
    rows = flac.describe(flac.encode_texts(hard)).collect()
    wanted = sorted(str((d, len((t or "").encode()), hashlib.sha256(flac.payload_of(t)[0]).hexdigest())) for d, t in texts)
    assert sorted({str((r.doc_id, r.n_bytes, r.payload_sha256)) for r in rows}) == sorted(set(wanted))


def test_hard_rows_and_blocks(hard, nothing):
    media = flac.encode_texts(hard)
    assert flac.describe(media).count() == hard.count() and flac.describe(flac.encode_texts(nothing)).count() == 0
    blocks = flac.pcm_blocks(media).filter("doc_id = 4").orderBy("block").collect()
    text = hard.filter("doc_id = 4").first().text.encode()
    pcm = b"".join(b.pcm for b in blocks)
    assert (np.frombuffer(pcm, "<i2") + 128).astype(np.uint8).tobytes().rstrip() == text
    assert [b.sample_offset for b in blocks] == [64 * 192 * k for k in range(len(blocks))]
