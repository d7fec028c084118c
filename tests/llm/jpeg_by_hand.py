"""A writer and a slow reader of baseline JPEGs, bit by bit, to compare the media operator with."""

from __future__ import annotations

import struct

import numpy as np


def marker(code, body):
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def table(r, symbols):
    """A Huffman table (how many codes of each length, then symbols): codes of random lengths, none all ones."""
    left, counts, room = len(symbols), [], 1
    for length in range(1, 17):
        room *= 2
        # codes of this length leave room for the others below
        n = 0
        while n < left and (room - n - 1) * (1 << (16 - length)) > left - n and length > 3 and r.random() < 0.7:
            n += 1
        if length == 16:
            n = left
        counts.append(n)
        left -= n
        room -= n
    return bytes(counts) + bytes(symbols)


def codes(spec):
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[spec[at]] = f"{code:0{length}b}"
            code, at = code + 1, at + 1
        code <<= 1
    return out


def extra(v):
    size = abs(v).bit_length()
    return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""


def write(r, width, height, sampling, restart=0, filled=6):
    """A JPEG of random coefficients: its bytes, and for each component (blocks down, blocks across, 64)."""
    dc, ac = table(r, list(range(12))), table(r, [run << 4 | size for run in range(16) for size in range(1, 9)] + [0x00, 0xF0])
    dc_codes, ac_codes = codes(dc), codes(ac)
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(sampling) == 1:
        across, down, sampling = -(-width // 8), -(-height // 8), [(1, 1)]
    grids = []
    for h, v in sampling:
        grid = np.zeros((down * v, across * h, 64), int)
        grid[:, :, 0] = r.integers(-300, 301, grid.shape[:2])
        for _ in range(filled):
            spot = r.integers(1, 64, grid.shape[:2])
            np.put_along_axis(grid, spot[:, :, None], r.integers(-200, 201, grid.shape[:2])[:, :, None], 2)
        grids.append(grid)
    parts, bits, past, unit = [], [], [0] * len(sampling), 0

    def close():
        whole = "".join(bits)
        whole += "1" * (-len(whole) % 8)
        bits.clear()
        parts.append(int(whole, 2).to_bytes(len(whole) // 8, "big").replace(b"\xff", b"\xff\x00"))

    for y in range(down):
        for x in range(across):
            if restart and unit and unit % restart == 0:
                close()
                parts.append(bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
                past = [0] * len(sampling)
            unit += 1
            for k, (h, v) in enumerate(sampling):
                for b in range(h * v):
                    block = grids[k][y * v + b // h, x * h + b % h].tolist()
                    step, past[k] = block[0] - past[k], block[0]
                    bits.append(dc_codes[abs(step).bit_length()] + extra(step))
                    run = 0
                    last = max((i for i in range(1, 64) if block[i]), default=0)
                    for value in block[1 : last + 1]:
                        if not value:
                            run += 1
                            continue
                        while run > 15:
                            bits.append(ac_codes[0xF0])
                            run -= 16
                        bits.append(ac_codes[run << 4 | abs(value).bit_length()] + extra(value))
                        run = 0
                    if last < 63:
                        bits.append(ac_codes[0])
    close()
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    scan = bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + bytes([0, 63, 0])
    head = b"\xff\xd8" + marker(0xDB, bytes([0]) + bytes([8] * 64)) + marker(0xC0, frame) + marker(0xC4, b"\x00" + dc) + marker(0xC4, b"\x10" + ac)
    return head + (marker(0xDD, struct.pack(">H", restart)) if restart else b"") + marker(0xDA, scan) + b"".join(parts) + b"\xff\xd9", grids
