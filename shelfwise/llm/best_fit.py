"""Packing token sequences by bounded-space online best-fit.

Pieces come one after the other and each is placed for good when it comes: into
the open bin with the least free space that still takes it, or into a new bin.
Open bins are kept by free space, and one integer used as a bitset says which
free spaces occur, so the best fit is its lowest set bit from the piece's length
on.  At most a fixed number of bins is open; when one more is needed, the
fullest closes.  Pieces are dealt evenly to groups of a bounded number, each of
which is one such stream, read in short runs whose longest pieces come first;
what a group leaves open costs a few bins of thousands.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, guarded_id, guarded_type, restored_id, runs, shared_table, text_bytes

WINDOW = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Bins open at a time.
OPEN_BINS = 1024
#: Pieces that wait for their turn, the longest first.
RUN = 2048
#: Pieces of a group, about.
GROUP_ROWS = 32_768
#: Chunks whose ids a task remembers.
REMEMBERED = 800_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class OpenBins:
    """Open bins by free space; the bits of ``free`` are the free spaces that occur."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, max(1, most)
        self.free, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def _take(self, space: int) -> int:
        own = self.bins[space]
        number = own.pop()
        if not own:
            self.free ^= 1 << space
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece; 1 <= length <= window."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.window, self.made
            self.made += 1
            self.open += 1
            if self.open > self.most:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
        left = space - length
        if left:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(number)
        else:
            self.open -= 1  # full
        return number, self.window - space


class ChunkEncoder:
    """Ids as ``tokenizers`` gives them for a file whose normalizer only composes, lower-cases and treats white space alike.

    No token crosses white space, so a text's ids are those of its chunks, one
    after the other, and chunks seen before are looked up.  New chunks of plain
    Latin letters, digits and signs are encoded all at once: the file's own
    pattern cuts them, and its merges, with the word's end as one more byte, are
    the ranks of a byte-pair encoder.  Others go to ``tokenizers`` one by one.
    """

    #: Another character, or the "<|" of an added token.
    ODD = re.compile("[^ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<[|]")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") == "</w>":
            self._ranks(spec)

    def _ranks(self, spec: dict) -> None:
        import regex
        import tiktoken

        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            core = token.removesuffix("</w>")
            ranks[bytes(byte_of[c] for c in core) + b"\x01" * (core != token)] = number
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        numbers = [spec["model"]["vocab"][a + b] for a, b in merges]
        if numbers != sorted(numbers) or len(ranks) != len(spec["model"]["vocab"]) or not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            return
        self.space = ranks[b" "]
        self.cut = regex.compile(f"(?:{spec['pre_tokenizer']['pretokenizers'][0]['pattern']['Regex']})")
        self.fast = tiktoken.Encoding("ranks", pat_str=r"[^\x01\x20]+\x01|\x20", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, chunks: set[bytes]) -> None:
        joined = "".join([c.decode() + " " for c in chunks])
        odd = set() if self.fast else chunks
        at = self.ODD.search(joined) if self.fast else None
        while at:
            a, b = joined.rfind(" ", 0, at.start()) + 1, joined.find(" ", at.start())
            odd.add(joined[a:b].encode())
            at = self.ODD.search(joined, b)
        for raw in odd:
            self.known[raw] = np.array(self.slow.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        plain = list(chunks - odd)
        if plain:
            joined = b" ".join(plain).decode().lower() + " "
            ids = np.array(self.fast.encode_ordinary(self.cut.sub("\\g<0>\x01", joined)), "<u4")
            ends = (np.flatnonzero(ids == self.space) * 4).tolist()
            data = ids.tobytes()
            self.known.update(zip(plain, [data[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)], strict=True))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for first, end in runs(byte_lengths(texts)):
            chunks = [raw.split() for raw in texts[first:end]]  # at ASCII white space
            new = set().union(*chunks).difference(self.known)
            if len(self.known) + len(new) > self.remembered:
                self.known.clear()
                new = set().union(*chunks)
            self._learn(new)
            for own in chunks:
                yield b"".join(map(self.known.__getitem__, own))


def places(lengths: np.ndarray, window: int = WINDOW, most: int = OPEN_BINS, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece of one stream."""
    bins, offsets, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), OpenBins(window, most)
    for a in range(0, len(lengths), run):
        order = a + np.argsort(-lengths[a : a + run], kind="stable")
        for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            bins[i], offsets[i] = held.place(n)
    return bins, offsets


def pack(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, with_ids: bool = False, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A document is its token ids and END_ID (NULL, empty or white text: END_ID
    alone).  Only documents of more than ``window`` ids are cut, into pieces of
    ``window`` of which the last may be shorter; each piece lies whole in one
    sequence, without gaps from offset 0 on.  Repeated rows and rows with equal
    or NULL ids are packed each for itself, and dealt to groups like any others;
    an empty table gives no rows; other columns are not read.  ``with_ids``
    adds the ids of a piece, from which packing.write_sequences writes
    sequences.
    """
    path = path or default_path()
    kind = guarded_type(df, id_col)
    schema = f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ChunkEncoder(path)
        for pdf in batches:
            rows = []
            for key, number, ids in zip(pdf["_id"], pdf["_row"], encode(pdf["_text"].tolist()), strict=True):
                whole = ids + end
                for piece, at in enumerate(range(0, len(whole), 4 * window)):
                    part = whole[at : at + 4 * window]
                    rows.append((key, number, piece, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=names)

    docs = df.select(guarded_id(df, id_col), F.monotonically_increasing_id().alias("_row"), text_bytes(text).alias("_text"))
    cut = shared_table(docs.mapInPandas(pieces, schema))
    groups = max(1, -(-cut.count() // group_rows))

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_mix", "_row", "piece"], ignore_index=True)
        number, offset = places(pdf["length"].to_numpy(np.int64), window, open_bins)
        return pdf.assign(sequence_id=(pdf["_group"].to_numpy(np.int64) << 32) + number, offset=offset)[out_names]

    mix = F.xxhash64("_row", "piece")
    rows = cut.drop("ids").withColumn("_mix", mix).withColumn("_group", F.pmod(F.xxhash64("_mix"), F.lit(groups)).cast("long"))
    out = f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out_names = [f.split()[0] for f in out.split(", ")]
    packed = rows.groupBy("_group").applyInPandas(placed, out)
    if with_ids:
        packed = packed.join(cut.select("_row", "piece", "ids"), ["_row", "piece"])
    return packed.select(restored_id(df, id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op13(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
