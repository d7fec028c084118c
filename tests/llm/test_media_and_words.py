"""Ordinary images against a writer that works bit by bit, and words that simple hashes confuse."""

from __future__ import annotations

import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import jpeg_by_hand  # noqa: E402

from shelfwise.llm import common, lm_scoring, media_jpeg, ngram_join, substring_dedup  # noqa: E402

SHAPES = [(8, 8, [(1, 1)], 0), (100, 52, [(1, 1)], 0), (100, 52, [(2, 2), (1, 1), (1, 1)], 0), (130, 40, [(2, 1), (1, 1), (1, 1)], 4), (77, 90, [(1, 1)], 7), (64, 64, [(2, 2)], 5)]


@pytest.mark.parametrize("side_by_side", [0, media_jpeg.SIDE_BY_SIDE, 10**9])
def test_images_by_hand(monkeypatch, side_by_side):
    """Images with and without restarts, the last interval shorter than the others or not, tables of their own, subsampled or not."""
    monkeypatch.setattr(media_jpeg, "SIDE_BY_SIDE", side_by_side)
    r = np.random.default_rng(4)
    made = [jpeg_by_hand.write(r, *shape) for shape in SHAPES * 2]
    for keep in (64, 1, 10):
        for (_, grids), found, (width, height, _, _) in zip(made, media_jpeg.decode([x for x, _ in made], keep), SHAPES * 2, strict=True):
            header, parts = found
            assert (header.width, header.height) == (width, height)
            assert all(a.shape[:2] == b.shape[:2] and (a == b[:, :, :keep]).all() for a, b in zip(parts, grids, strict=True))
    for x, grids in made:
        [(width, height, printed, crc)] = media_jpeg.describe([x])
        pixels = np.clip(np.rint(grids[0][:, :, 0] * 8 / 8 + 128), 0, 255).astype(np.uint8)
        assert (printed, crc) == (media_jpeg.average_hash(pixels), f"{zlib.crc32(pixels.tobytes()):08x}")
        if len(x) > 800:  # cut short inside the scan
            assert media_jpeg.describe([x[: (len(x) + 600) // 2]]) == [None]


def test_a_large_image_without_restarts_takes_seconds():
    image, grids = jpeg_by_hand.write(np.random.default_rng(6), 1600, 1200, [(2, 2), (1, 1), (1, 1)], 0, 9)
    assert len(image) > 500_000
    begun = time.process_time()
    [(header, parts)] = media_jpeg.decode([image])
    assert time.process_time() - begun < 15
    assert all((a == b).all() for a, b in zip(parts, grids, strict=True))


def test_lookups_of_many_tables_are_bounded():
    r = np.random.default_rng(8)
    for _ in range(150):
        media_jpeg._lookup(jpeg_by_hand.table(r, list(r.permutation(12))))
    assert media_jpeg._lookup.cache_info().currsize <= media_jpeg.LOOKUPS


def alternating(n: int, a: str, b: str) -> str:
    """The Thue-Morse word: its bits are alike in every polynomial hash modulo 2 ** 64 from 1,024 letters on."""
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


LONG_WORDS = [alternating(n, *x) for n in (512, 1024, 2048, 4096) for x in ("ab", "ba")]


def test_word_hashes_tell_words_apart():
    r = np.random.default_rng(3)
    words = {"".join(map(chr, r.integers(97, 100, r.integers(1, 40)))).encode() for _ in range(30_000)} | {x.encode() for x in LONG_WORDS} | {b"a" * n for n in range(1, 200)} | {b"x\x00", b"x", b"x\x00\x00"}
    listed = sorted(words)
    w = common.Words([b" ".join(listed)])
    assert len(w.hash) == len(listed) == len(set(w.hash.tolist()))
    # the same hash wherever a word stands
    back = common.Words([b"  ".join(listed[i : i + 7]) for i in range(0, len(listed), 7)])
    assert (back.hash == w.hash).all()
    assert len(common.Words([]).hash) == len(common.Words([b"", b" \n"]).hash) == 0


def test_long_regular_words_are_different_words(spark):
    """Texts that differ in one such word: nothing repeats, nothing links, and the one not trained on isn't known."""
    one, other = LONG_WORDS[2:4]
    place = lambda w: " ".join([*(f"w{i}" for i in range(10)), w, *(f"w{i}" for i in range(10, 19))])
    ids = sorted(range(1, 40), key=lambda i: zlib.crc32(str(i).encode()) % 5 == 1)  # the last is held out
    rows = [(ids[0], place(one)), (ids[-1], place(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeated_words(df).collect()} == {i: 0 for i, _ in rows}
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(df).collect()} == {i: i for i, _ in rows} == {i: c for i, (_, c) in brute.components(rows).items()}
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known) for r in lm_scoring.score(df).collect()}
    assert got == {ids[0]: (False, 21, 21), ids[-1]: (True, 21, 20)}
