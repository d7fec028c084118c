"""Removal of repeated word windows behind a count-min prefilter.

Documents are packed into blocks of bounded size where they are read.  Each
block counts its windows in the rows of a count-min sketch and sends the cells
it touched, packed, to the tasks that hold those cells; merged there, the counts
can only be too high.  Each block gets back one bit per cell it touched: seen
twice or more, or not.  The second pass sends only windows whose cells are all
repeated, with a 96-bit hash, to be grouped exactly; what comes back are the
windows that are later copies.

Both ways go in two steps (Exchange): a group of blocks is merged before it
meets the others, so messages don't grow with the square of the blocks.  The
sketch grows with the input and is never held in one place, and nothing is
broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOCK_BYTES, Exchange, Words, block_numbers, block_texts, byte_lengths, forget, guarded_id, mixed, pack_rising, packed_blocks, parts_by, passing_tables, restored_id, runs, shared_table, squeezed, text_bytes, unpack_rising,
    unsqueezed,
)

WIDTH = 20
#: Rows of the sketch, and cells per window in each (at least; a power of two in all).
ROWS = 2
CELLS = 4
#: Cells of the sketch that one task merges.
SHARD_CELLS = 1 << 24


def pack_sorted(values: np.ndarray) -> bytes:
    """Strictly rising uint64 values as byte differences, larger ones apart."""
    steps = np.diff(values, prepend=np.uint64(0))
    small = np.minimum(steps, np.uint64(255)).astype(np.uint8)
    large = steps[small == 255]
    return squeezed(np.uint64(len(values)).tobytes() + small.tobytes() + large.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = unsqueezed(blob)
    n = int(np.frombuffer(raw[:8], np.uint64)[0])
    small = np.frombuffer(raw, np.uint8, n, 8)
    steps = small.astype(np.uint64)
    steps[small == 255] = np.frombuffer(raw, np.uint64, -1, 8 + n)
    return np.cumsum(steps, dtype=np.uint64)


def _among(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among the sorted ``values``; a table of their low bits rules most out."""
    if not len(values):
        return np.zeros(len(asked), bool)
    mask = np.uint64((1 << 24) - 1)
    table = np.zeros(1 << 24, bool)
    table[(values & mask).astype(np.int64)] = True
    out = table[(asked & mask).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(values, asked[maybe]), len(values) - 1)
    out[maybe] = values[at] == asked[maybe]
    return out


class Block:
    """The distinct documents of a block in the order of id and text, and their windows."""

    def __init__(self, row, width: int, wide: bool = False):
        texts, ids, prints = block_texts(row), block_numbers(row, "_id", "int64"), block_numbers(row, "_print", "int64")
        self.order = np.lexsort((prints, ids))
        ids, prints = ids[self.order], prints[self.order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
        self.which = np.cumsum(new) - 1  # the distinct document of each row, rows in order
        self.row_ids, self.ids, self.prints = ids, ids[new], prints[new]
        self.texts = [texts[i] for i in self.order[new]]
        self.width = width
        doc, place, first, second = [], [], [], []
        for a, b in runs(byte_lengths(self.texts)):
            w = Words(self.texts[a:b])
            at, h = w.windows(width)
            doc.append((w.text[at] + a).astype(np.int32))
            place.append((at - w.offset[w.text[at]]).astype(np.int32))
            first.append(h)
            if wide:
                second.append(w.windows(width, 7)[1].astype(np.uint32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.doc, self.place, self.hash = join(doc, np.int32), join(place, np.int32), join(first, np.uint64)
        self.hash2 = join(second, np.uint32)

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of the block's windows, sorted; whether two windows fall in one; each window's cell."""
        cell = mixed(self.hash, row + 1) >> np.uint64(64 - bits)
        distinct, counts = np.unique(cell, return_counts=True)
        return distinct, counts > 1, cell


def _edges(sorted_cells: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each of 2^parts ranges of cells begins, and the end."""
    return np.searchsorted(sorted_cells, np.arange((1 << parts) + 1, dtype=np.uint64) << np.uint64(bits - parts))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=count).astype(bool)


def repeated_words(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, with_kept: bool = False) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept_sha256[, kept]).

    Removes each word in a window of ``width`` words whose sequence also starts
    earlier: in a document of smaller id, or earlier in the same document.
    NULL ids come before all others.  Rows of one id and one text are one
    document and get the same result; of rows with one id and different texts,
    the order is that of a hash.  ``kept`` is the text left, its words joined by
    one space.  The id must be an integer.  An empty table gives no rows; other
    columns are not read.
    """
    rows = df.select(guarded_id(df, id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_print"), text_bytes(text).alias("_text"))
    with passing_tables(df.sparkSession):
        removed = shared_table(_removed(rows, width, block_bytes, with_kept), keep=True)
    return removed.select(restored_id(df, id_col), "n_words", "n_removed", "kept_sha256", *([F.col("kept").cast("string").alias("kept")] if with_kept else []))


def _removed(rows: DataFrame, width: int, block_bytes: int, with_kept: bool) -> DataFrame:
    blocks = packed_blocks(rows, {"_id": "int64", "_print": "int64"}, block_bytes)
    number, volume = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("text_bytes"), F.lit(0))).first()
    meet = Exchange(number, number)
    bits = max(12, int(np.ceil(np.log2(max(2, volume / 6 * CELLS)))))
    coarse = max(0, int(np.ceil(np.log2(meet.side))))
    fine = max(coarse, bits - int(np.log2(SHARD_CELLS)))
    per = 1 << (fine - coarse)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for packed in pdf.to_dict("records"):
                block, number, out = Block(packed, width), packed["block"], []
                for row in range(ROWS):
                    cells, twice, _ = block.cells(row, bits)
                    edge = _edges(cells, bits, coarse)
                    for c in np.flatnonzero(np.diff(edge)):
                        a, b = edge[c], edge[c + 1]
                        out.append((meet.group(number), row << 32 | int(c), number, pack_sorted(cells[a:b]), _bits(twice[a:b])))
                yield pd.DataFrame(out, columns=["grp", "coarse", "block", "cells", "twice"])

    sent = shared_table(blocks.mapInPandas(sketch, "grp int, coarse long, block long, cells binary, twice binary"))

    def merged(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The cells of each row, all of them, and which of those more than one window falls in."""
        each = [unpack_sorted(x) for x in pdf["cells"]]
        cells, where = np.unique(np.concatenate(each), return_inverse=True)
        weight = np.concatenate([1 + _flags(t, len(x)) for t, x in zip(pdf["twice"], each, strict=True)])
        return each, cells, np.bincount(where, weight, len(cells)) > 1

    def shards(cells: np.ndarray, c: int) -> Iterator[tuple[int, slice]]:
        edge = np.searchsorted(cells, (np.arange(per + 1, dtype=np.uint64) + np.uint64(c * per)) << np.uint64(bits - fine))
        for s in np.flatnonzero(np.diff(edge)):
            yield int(s), slice(edge[s], edge[s + 1])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        g, c = int(pdf["grp"].iloc[0]), int(pdf["coarse"].iloc[0])
        _, cells, twice = merged(pdf)
        out = []
        for s, own in shards(cells, c & 0xFFFFFFFF):
            first = np.uint64((c & 0xFFFFFFFF) * per + s) << np.uint64(bits - fine)
            out.append((g, c, s, pack_sorted(cells[own] - first), _bits(twice[own])))
        return pd.DataFrame(out, columns=["grp", "coarse", "fine", "cells", "twice"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << (bits - fine), np.uint8)
        for cells, twice in zip(pdf["cells"], pdf["twice"], strict=True):
            at = unpack_sorted(cells)
            count[at] = np.minimum(count[at] + 1 + _flags(twice, len(at)), 2)
        return pd.DataFrame({"grp": pdf["grp"], "coarse": pdf["coarse"], "fine": pdf["fine"], "repeated": [_bits(count[unpack_sorted(c)] > 1) for c in pdf["cells"]]})

    def spread(asked: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        each, cells, _ = merged(asked)
        flags, held = np.zeros(len(cells), bool), dict(zip(back["fine"], back["repeated"], strict=True))
        for s, own in shards(cells, int(asked["coarse"].iloc[0]) & 0xFFFFFFFF):
            flags[own] = _flags(held[s], own.stop - own.start)
        return pd.DataFrame({"block": asked["block"], "coarse": asked["coarse"], "repeated": [_bits(flags[np.searchsorted(cells, x)]) for x in each]})

    merges = sent.groupBy("grp", "coarse").applyInPandas(combine, "grp int, coarse long, fine int, cells binary, twice binary")
    settled = shared_table(merges.groupBy("coarse", "fine").applyInPandas(settle, "grp int, coarse long, fine int, repeated binary"))
    repeated = shared_table(sent.groupBy("grp", "coarse").cogroup(settled.groupBy("grp", "coarse")).applyInPandas(spread, "block long, coarse long, repeated binary"))

    for table in (sent, settled):
        forget(table)

    # second pass: a message of windows has their hashes, blocks, places (document << 32 | word), and the documents' ids and prints
    message = {"h1": np.uint64, "h2": np.uint32, "block": np.int64, "local": np.int64, "id": np.int64, "print": np.int64}
    kinds = ", ".join(f"{c} binary" for c in message)

    def sent_as(w: dict[str, np.ndarray], own: np.ndarray) -> tuple[bytes, ...]:
        own = own[np.lexsort((w["local"][own], w["block"][own]))]
        return tuple(squeezed(w[c][own].tobytes()) for c in message)

    def candidates(docs: pd.DataFrame, bit_rows: pd.DataFrame) -> pd.DataFrame:
        """The windows whose cells are all repeated: first ones in the block to be compared, others at once as later."""
        names = ["grp", "coarse", "number", "later", *message]
        if not len(docs):
            return pd.DataFrame(columns=names)
        block, number, out = Block(docs.iloc[0], width, wide=True), docs["block"].iloc[0], []
        held = dict(zip(bit_rows["coarse"], bit_rows["repeated"], strict=True))
        at = np.arange(len(block.hash))
        for row in range(ROWS):
            cells, _, cell = block.cells(row, bits)
            edge, flags = _edges(cells, bits, coarse), np.zeros(len(cells), bool)
            for c in np.flatnonzero(np.diff(edge)):
                a, b = edge[c], edge[c + 1]
                flags[a:b] = _flags(held[row << 32 | int(c)], b - a)
            at = at[_among(cells[flags], cell[at])]
        local = block.doc[at].astype(np.int64) << 32 | block.place[at]
        order = np.lexsort((local, block.hash2[at], block.hash[at]))
        h1, h2 = block.hash[at][order], block.hash2[at][order]
        first = np.ones(len(at), bool)
        first[order[1:]] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        out.append((-1, -1, number, pack_rising(local[~first]), *[None] * len(message)))
        at, local = at[first], local[first]
        w = {"h1": block.hash[at], "h2": block.hash2[at], "block": np.full(len(at), number, np.int64), "local": local, "id": block.ids[block.doc[at]], "print": block.prints[block.doc[at]]}
        for c, own in parts_by(meet.coarse(meet.shard(mixed(w["h1"], 11))), meet.side):
            out.append((meet.group(number), c, number, None, *sent_as(w, own)))
        return pd.DataFrame(out, columns=names)

    second = shared_table(blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(candidates, f"grp int, coarse int, number long, later binary, {kinds}"))

    late = [shared_table(second.where("grp < 0").select(F.col("number").alias("block"), "later"))]
    forget(repeated)

    def windows(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        """All windows of some messages, and which of them have the words of one that starts earlier."""
        w = {c: np.concatenate([np.frombuffer(unsqueezed(x), kind) for x in pdf[c]]) for c, kind in message.items()}
        w["place"] = w["local"] & 0xFFFFFFFF
        order = np.lexsort([w[k] for k in ("place", "print", "id", "h2", "h1")])
        new = np.ones(len(order), bool)
        new[1:] = (w["h1"][order[1:]] != w["h1"][order[:-1]]) | (w["h2"][order[1:]] != w["h2"][order[:-1]])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the earliest of the same words
        later = np.zeros(len(order), bool)
        later[order] = np.any([w[k][order] != w[k][head] for k in ("id", "print", "place")], 0)
        return w | {"later": later}

    def by_block(block: np.ndarray, local: np.ndarray) -> list[tuple[int, bytes]]:
        order = np.lexsort((local, block))
        block, local = block[order], local[order]
        edge = np.flatnonzero(np.diff(block, prepend=-1))  # blocks count from 0
        return [(int(block[a]), pack_rising(local[a:b])) for a, b in zip(edge, np.append(edge[1:], len(block))[: len(edge)], strict=True)]

    def first_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        """Later windows within a group of blocks (by block, shard -1), and the first ones by shard."""
        g, c, w = pdf["grp"].iloc[0], pdf["coarse"].iloc[0], windows(pdf)
        out = [(g, c, -1, number, later, *[None] * len(message)) for number, later in by_block(w["block"][w["later"]], w["local"][w["later"]])]
        first = np.flatnonzero(~w["later"])
        for s, own in parts_by(meet.shard(mixed(w["h1"][first], 11)) // meet.side, meet.shards // meet.side + 1):
            out.append((g, c, s, -1, None, *sent_as(w, first[own])))
        return pd.DataFrame(out, columns=["grp", "coarse", "shard", "number", "later", *message])

    groups = shared_table(second.where("grp >= 0").groupBy("grp", "coarse").applyInPandas(first_of_group, f"grp int, coarse int, shard int, number long, later binary, {kinds}"))

    late.append(shared_table(groups.where("shard < 0").select(F.col("number").alias("block"), "later")))
    forget(second)

    def first_of_all(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each group of blocks, which of its windows have the words of an earlier one in any group."""
        w, out, at = windows(pdf), [], 0
        for g, c, blob in zip(pdf["grp"], pdf["coarse"], pdf["h2"], strict=True):
            own = np.arange(at, at + len(unsqueezed(blob)) // 4)
            at, own = at + len(own), own[w["later"][own]]
            out.append((g, c, squeezed(w["block"][own].tobytes()), squeezed(w["local"][own].tobytes())))
        return pd.DataFrame(out, columns=["grp", "coarse", "block", "local"])

    def spread_later(pdf: pd.DataFrame) -> pd.DataFrame:
        block, local = (np.concatenate([np.frombuffer(unsqueezed(x), np.int64) for x in pdf[c]]) for c in ("block", "local"))
        return pd.DataFrame(by_block(block, local), columns=["block", "later"])

    exact = shared_table(groups.where("shard >= 0").groupBy("coarse", "shard").applyInPandas(first_of_all, "grp int, coarse int, block binary, local binary"))
    forget(groups)
    later = exact.groupBy("grp", "coarse").applyInPandas(spread_later, "block long, later binary")
    for table in late:
        later = later.unionByName(table)

    def remove(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = ["_id", "n_words", "n_removed", "kept_sha256", "kept"]
        if not len(docs):
            return pd.DataFrame(columns=names)
        later = np.sort(np.concatenate([np.zeros(0, np.int64), *[unpack_rising(x) for x in found["later"]]]))
        block, out = Block(docs.iloc[0], width), []
        for n, content in enumerate(block.texts):
            w = content.split()
            a, b = np.searchsorted(later, [n << 32, (n + 1) << 32])
            if a == b:
                kept, gone = b" ".join(w), 0
            else:
                edge = np.zeros(len(w) + 1, np.int32)
                start = later[a:b] & 0xFFFFFFFF
                np.add.at(edge, start, 1)
                np.add.at(edge, start + width, -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept, gone = b" ".join(x for x, s in zip(w, stays.tolist(), strict=True) if s), len(w) - int(stays.sum())
            out.append((len(w), gone, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        return pd.DataFrame([(key, *out[n]) for key, n in zip(block.row_ids.tolist(), block.which.tolist(), strict=True)], columns=names)

    return blocks.groupBy("block").cogroup(later.groupBy("block")).applyInPandas(remove, "_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def op4(spark, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WIDTH - 1}), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM d WHERE len(ws) >= {WIDTH})
), late AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS i FROM late
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
