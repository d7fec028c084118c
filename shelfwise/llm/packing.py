"""Packing token sequences into windows by non-negative least squares on the length histogram.

Full windows are cut from each document first; what is left of a document is
one piece shorter than a window.  The histogram of those lengths (at most one
bin per length) is all the driver sees.  It enumerates the combinations of one,
two or three lengths that fill a window, solves for how often each is to be
repeated (non-negative least squares), rounds down, and packs what remains
best-fit, longest first.  The plan is a table of slots per length; each piece
finds its slot from its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, guarded_id, guarded_type, restored_id, shared_table, text_or_empty

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 0
#: Steps of the least-squares solver.
STEPS = 400
#: Pieces of one length that are numbered in one group, about.
GROUP_ROWS = 100_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


class Encoder:
    """Ids as ``tokenizers`` gives them for the JSON file, without special tokens.

    The same vocabulary as ranks encodes several times faster; a text that
    holds the string of an added token goes to ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(a in text for a in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def combinations(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, 3) indexes into ``lengths`` (-1: none) of all ways to fill the window with up to three of them, and their padding.

    A single length always counts as a way, with the rest of the window as
    padding.  All ways are listed: about window^2 / 12 triples if every length
    occurs, 87,381 for a window of 1,024 and 1.4 million for 4,096.
    """
    where = np.full(window + 1, -1)
    where[lengths] = np.arange(len(lengths))
    n = len(lengths)
    rows = [np.stack([np.arange(n), np.full(n, -1), np.full(n, -1)], 1)]
    mate = where[window - lengths]
    pair = np.flatnonzero((mate >= 0) & (lengths <= window - lengths))
    rows.append(np.stack([pair, mate[pair], np.full(len(pair), -1)], 1))
    a, b = np.triu_indices(n)
    c = window - lengths[a] - lengths[b]
    ok = c >= lengths[b]
    a, b, c = a[ok], b[ok], where[c[ok]]
    a, b, c = a[c >= 0], b[c >= 0], c[c >= 0]
    rows.append(np.stack([a, b, c], 1))
    out = np.concatenate(rows)
    filled = np.where(out >= 0, lengths[np.maximum(out, 0)], 0).sum(1)
    return out, window - filled


def solve(ways: np.ndarray, padding: np.ndarray, counts: np.ndarray, window: int, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats x that make A x near ``counts``, A[i, k] being how often way k uses length i.

    Accelerated projected gradient on |A x - counts|^2, plus the padding of a
    way as a small linear cost.
    """
    n, k = len(counts), len(ways)
    used = ways >= 0
    index = np.where(used, ways, n)

    def forward(x):
        return np.bincount(index.ravel(), np.repeat(x, 3), n + 1)[:n]

    def back(r):
        return np.concatenate([r, [0.0]])[index].sum(1)

    scale = max(1.0, float(counts.max(initial=0)))
    b = counts / scale
    v = np.random.default_rng(0).random(k)
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1.0 / (1.05 * float(np.linalg.norm(back(forward(v)))))
    cost = 0.05 * padding / window * b.mean()
    x = y = np.zeros(k)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * (back(forward(y) - b) + cost))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x * scale


def plan(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[pd.DataFrame, int]:
    """Slots for all pieces shorter than a window, and the number of windows they take.

    A slot row (length, first, number, sequence, offset) says that pieces
    first .. first+number-1 of that length lie at ``offset`` in the windows
    from ``sequence`` on, one each.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    if not len(lengths):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("length", "first", "number", "sequence", "offset")}), 0
    ways, padding = combinations(lengths, window)
    repeats = np.floor(solve(ways, padding, counts.astype(np.float64), window) + 1e-6).astype(np.int64)
    repeats[padding > 0] = 0
    left = counts.copy()
    slots, next_sequence, taken = [], 0, np.zeros(len(lengths), np.int64)

    def place(parts: list[int], times: int) -> None:
        nonlocal next_sequence
        offset = 0
        for i in parts:
            slots.append((lengths[i], taken[i], times, next_sequence, offset))
            taken[i] += times
            left[i] -= times
            offset += lengths[i]
        next_sequence += times

    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        parts = [int(i) for i in ways[k] if i >= 0]
        need = np.bincount(parts, minlength=len(lengths))
        times = min(int(repeats[k]), int((left[need > 0] // need[need > 0]).min()))
        if times > 0:
            place(parts, times)
    while (left > 0).any():  # residuals: the longest, then again the longest that fits
        room, parts, use = window, [], left.copy()
        while True:
            fits = np.flatnonzero((use > 0) & (lengths <= room))
            if not len(fits):
                break
            parts.append(int(fits[-1]))
            use[fits[-1]] -= 1
            room -= int(lengths[fits[-1]])
        need = np.bincount(parts, minlength=len(lengths))
        place(parts, int((left[need > 0] // need[need > 0]).min()))
    return pd.DataFrame(slots, columns=["length", "first", "number", "sequence", "offset"]).astype(np.int64), next_sequence


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, paths: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document is its token ids and END_ID (NULL or empty text: END_ID alone).
    Each id lies in exactly one piece; pieces of a sequence are gapless from
    offset 0.  ``with_ids`` adds the ids of a piece, from which sequences are
    written.  Repeated rows are packed each; an empty table gives no rows;
    other columns are not read.
    """
    json_path, ranks_path = paths or default_paths()
    schema = f"_id {guarded_type(df, id_col)}, _piece_of long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(json_path, ranks_path)
        for pdf in batches:
            rows = []
            for key, number, content in zip(pdf["_id"], pdf["_piece_of"], pdf["_text"], strict=True):
                ids = np.array([*encode(content), END_ID], "<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((key, number, at, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.astype(np.int32),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    docs = df.select(guarded_id(df, id_col), F.monotonically_increasing_id().alias("_piece_of"), text_or_empty(text).alias("_text"))
    cut = shared_table(docs.mapInPandas(pieces, schema))

    short = cut.where(F.col("length") < window)
    histogram = short.groupBy("length").count().toPandas()  # at most window - 1 rows
    slots, sequences = plan(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), window)

    # number the pieces of each length, and the full windows as a length of their own
    most = max(1, -(-cut.groupBy("length").count().agg(F.max("count")).first()[0] // GROUP_ROWS)) if sequences or len(cut.take(1)) else 1
    numbered = cut.withColumn("_group", block_of(most, "_id", "_piece_of"))
    sizes = numbered.groupBy("length", "_group").count()  # at most a row per length and GROUP_ROWS pieces of the commonest
    earlier = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_group", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    place = Window.partitionBy("length", "_group").orderBy("_id", "_piece_of", "start")
    numbered = numbered.join(bases, ["length", "_group"]).withColumn("_number", F.col("_base") + F.row_number().over(place) - 1)

    table = {int(n): g[["first", "sequence", "offset"]].to_numpy(np.int64) for n, g in slots.sort_values(["length", "first"]).groupby("length")}

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        sequence, offset = sequences + number, np.zeros(len(number), np.int64)
        for n in np.unique(length):
            if n < window:
                own = np.flatnonzero(length == n)
                rows = table[int(n)]
                at = np.searchsorted(rows[:, 0], number[own], "right") - 1
                sequence[own] = rows[at, 1] + number[own] - rows[at, 0]
                offset[own] = rows[at, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return numbered.withColumn("_slot", slot("length", "_number")).select(
        restored_id(df, id_col), "start", "length", "ids_crc32", "doc_tokens", "_slot.sequence_id", "_slot.offset", *(["ids"] if with_ids else [])
    )


def write_sequences(packed: DataFrame, path: str, parts: int = 64) -> None:
    """Write (sequence_id, ids) of a packing made with ``with_ids``: the token ids of each sequence in order."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    ids = F.flatten(F.transform("_parts", lambda x: x["ids"]))
    whole.select("sequence_id", ids.alias("ids")).repartitionByRange(parts, "sequence_id").write.parquet(path)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
