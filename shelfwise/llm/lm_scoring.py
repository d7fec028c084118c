"""Language-model scores of all documents: context-tree weighting, and a word baseline.

The counts a context tree needs are those of its longest contexts with their
next byte; word counts serve the baseline.  Documents are packed into blocks of
bounded size where they are read.  A block counts its own keys once and sends
them, packed, to shards of the keys, in two steps (Exchange).  A shard holds
whole contexts of three bytes and builds the tree below them; the depths above
are added up on the driver (at most 65,536 two-byte contexts of 255 nodes, some
thousand contexts in practice).  Each key then has one log probability, which
goes back the same way to the blocks that asked for it, and documents are
scored block by block.  Nothing that grows with the corpus is broadcast or
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_tree as tree
from .common import (
    BLOCK_BYTES, Exchange, Words, block_numbers, block_texts, byte_lengths, distinct, forget, guarded_id, mixed, packed_blocks, parts_by, passing_tables, restored_id, runs, shared_table, squeezed, text_bytes, unsqueezed,
)

#: One part in FOLDS is held out: the documents whose id, as text, has this remainder of its crc32.
FOLDS, HELD_OUT = 5, 1
#: Slots of the table by which a block finds its keys.
_SLOT_BITS = 22
_END_WORD = np.uint64(0x5EEDED0FF1CE0001)
GRAM, WORD = 0, 1


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 values: differences, byte planes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_array(values: np.ndarray) -> bytes:
    return squeezed(values.tobytes())


def unpack_array(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(unsqueezed(blob), kind)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts added up."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Lookup:
    """Finds many keys in a sorted list, most of them in one step."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, np.uint64(64 - _SLOT_BITS)
        self.slot = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.slot[(mixed(keys) >> self.bits).astype(np.int64)] = np.arange(len(keys))

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self.slot[(mixed(asked) >> self.bits).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero(self.keys[at] != asked)  # another key took the slot
        at[other] = np.searchsorted(self.keys, asked[other])
        return at


#: Bytes kept of a log10 probability, in steps of 2^-35 (3e-11).
_VALUE_BYTES, _STEP = 5, 35


def pack_values(values: np.ndarray, kind: int) -> bytes:
    """Word counts, or log10 probabilities from -16 to 0."""
    if kind == WORD:
        return pack_array(values)
    steps = np.rint(-values * (1 << _STEP)).astype(np.int64)
    return squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :_VALUE_BYTES].T).tobytes())


def unpack_values(blob: bytes, kind: int) -> np.ndarray:
    if kind == WORD:
        return unpack_array(blob, np.int64)
    planes = np.frombuffer(unsqueezed(blob), np.uint8).reshape(_VALUE_BYTES, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :_VALUE_BYTES] = planes.T
    return steps.view(np.int64).ravel() / -float(1 << _STEP)


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram keys and word keys of lower-cased texts with their end, and how many of each a text has."""
    data, starts, ends = tree.layout(texts)
    w = Words(texts)
    words = np.insert(w.hash, w.offset[1:], _END_WORD)
    return tree.keys_of(data, starts, ends), ends - starts, words, w.count + 1


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    Learns from the documents that aren't held out and scores all, by whole
    texts with A-Z lowered (NULL: empty; a NULL id is never held out).  Scores
    are log10 probabilities, of the text and its end.  The id must be an
    integer.  Repeated rows are learnt from and scored each; an empty table
    gives no rows; other columns are not read.  Without any training document
    all counts are 0 and N is 0; base_score is then that of a uniform guess and
    score that of KT estimates without counts, 1/2 for each bit.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    rows = df.select(guarded_id(df, id_col), held.cast("int").alias("_held"), text_bytes(text).alias("_text"))
    with passing_tables(df.sparkSession):
        scored, n_train = _scored(rows, block_bytes)
        scored = shared_table(scored, keep=True)
    return scored.select(
        restored_id(df, id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _scored(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    spark = rows.sparkSession
    blocks = packed_blocks(rows, {"_id": "int64", "_held": "int8"}, block_bytes)
    number = blocks.count()
    meet = Exchange(number, number)

    def shard_of(kind: int, keys: np.ndarray) -> np.ndarray:
        return meet.shard(mixed(keys >> np.uint64(8 * (tree.DEPTH + 1 - tree.Subtree.TOP)) if kind == GRAM else keys, 3 + kind))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                texts, train = [t.lower() for t in block_texts(row)], block_numbers(row, "_held", "int8") == 0
                keys: dict[int, list] = {GRAM: [], WORD: []}
                counts: dict[int, list] = {GRAM: [], WORD: []}
                for a, b in runs(byte_lengths(texts)):
                    grams, per_text, words, per_words = _keys(texts[a:b])
                    for kind, values, per in ((GRAM, grams, per_text), (WORD, words, per_words)):
                        learnt = np.repeat(train[a:b], per)
                        for part, weight in ((values[learnt], 1), (values[~learnt], 0)):
                            key, n = np.unique(part, return_counts=True)
                            keys[kind].append(key)
                            counts[kind].append(n * weight)
                out = []
                for kind in keys:
                    key, n = summed(keys[kind], counts[kind])
                    for c, own in parts_by(meet.coarse(shard_of(kind, key)), meet.side):
                        out.append((meet.group(row["block"]), c, row["block"], kind, pack_keys(key[own]), pack_array(n[own].astype(np.uint32))))
                yield pd.DataFrame(out, columns=["grp", "coarse", "block", "kind", "keys", "counts"])

    def own_keys(texts: list[bytes]) -> dict[int, list[np.ndarray]]:
        """The distinct keys of a block, for each coarse shard, as count() has sent them."""
        keys: dict[int, list] = {GRAM: [], WORD: []}
        for a, b in runs(byte_lengths(texts)):
            grams, _, words, _ = _keys(texts[a:b])
            keys[GRAM].append(distinct(grams))
            keys[WORD].append(distinct(words))
        whole = {kind: distinct(np.concatenate(parts)) for kind, parts in keys.items()}
        return {kind: [(c, key[own]) for c, own in parts_by(meet.coarse(shard_of(kind, key)), meet.side)] for kind, key in whole.items()}

    sent = shared_table(blocks.mapInPandas(count, "grp int, coarse int, block long, kind int, keys binary, counts binary"))

    def merged(pdf: pd.DataFrame, kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
        own = pdf[pdf["kind"] == kind]
        return summed([unpack_keys(x) for x in own["keys"]], [unpack_array(x, dtype).astype(np.int64) for x in own["counts"]])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        """The counts of a group of blocks and a coarse shard, by shard."""
        g, c, out = pdf["grp"].iloc[0], pdf["coarse"].iloc[0], []
        for kind in (GRAM, WORD):
            key, n = merged(pdf, kind, np.uint32)
            for s, own in parts_by(shard_of(kind, key) // meet.side, meet.shards // meet.side + 1):
                out.append((g, c, s * meet.side + c, kind, pack_keys(key[own]), pack_array(n[own])))
        return pd.DataFrame(out, columns=["grp", "coarse", "shard", "kind", "keys", "counts"])

    asked = shared_table(sent.groupBy("grp", "coarse").applyInPandas(combine, "grp int, coarse int, shard int, kind int, keys binary, counts binary"))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = merged(pdf, GRAM, np.int64)
        _, words = merged(pdf, WORD, np.int64)
        return pd.DataFrame([(pdf["shard"].iloc[0], pack_keys(key), pack_array(n), int(words.sum()), int((words > 0).sum()))], columns=["shard", "keys", "counts", "tokens", "types"])

    sums = shared_table(asked.groupBy("shard").applyInPandas(total, "shard int, keys binary, counts binary, tokens long, types long"))
    totals = sums.agg(F.sum("tokens"), F.sum("types")).first()
    n_train, n_types = int(totals[0] or 0), int(totals[1] or 0)

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, counts in zip(pdf["keys"], pdf["counts"], strict=True):
                yield pd.DataFrame(tree.Subtree(unpack_keys(keys), unpack_array(counts, np.int64)).summary())

    nodes = sums.select("keys", "counts").mapInPandas(summary, "code long, zeros double, ones double, lw double")
    upper = nodes.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "lw")]).toPandas()  # at most 65,536 * 255 rows
    top = spark.sparkContext.broadcast(tree.Top(*[upper[c].to_numpy() for c in ("code", "zeros", "ones", "lw")]))

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """To each group, what its keys have: a log10 probability, a word its count."""
        out = []
        if len(asked):
            built = tree.Subtree(unpack_keys(known["keys"].iloc[0]), unpack_array(known["counts"].iloc[0], np.int64))
            table = {GRAM: (built.levels[tree.DEPTH].key, built.log10(top.value)), WORD: merged(asked, WORD, np.int64)}
            for g, c, kind, blob in zip(asked["grp"], asked["coarse"], asked["kind"], asked["keys"], strict=True):
                keys, values = table[kind]
                out.append((g, c, kind, blob, pack_values(values[np.searchsorted(keys, unpack_keys(blob))], kind)))
        return pd.DataFrame(out, columns=["grp", "coarse", "kind", "keys", "values"])

    answers = shared_table(
        asked.groupBy("shard").cogroup(sums.select("shard", "keys", "counts").groupBy("shard")).applyInPandas(answer, "grp int, coarse int, kind int, keys binary, values binary")
    )

    forget(asked)
    forget(sums)

    def spread(asked: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        """A group's answers: to each block, the values of the keys it sent, in their order."""
        out = []
        for kind in (GRAM, WORD):
            own = back[back["kind"] == kind]
            if len(own):
                keys, values = np.concatenate([unpack_keys(x) for x in own["keys"]]), np.concatenate([unpack_values(x, kind) for x in own["values"]])
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                own = asked[asked["kind"] == kind]
                out += [(block, c, kind, pack_values(values[np.searchsorted(keys, unpack_keys(blob))], kind)) for block, c, blob in zip(own["block"], own["coarse"], own["keys"], strict=True)]
        return pd.DataFrame(out, columns=["block", "coarse", "kind", "values"])

    to_blocks = shared_table(sent.groupBy("grp", "coarse").cogroup(answers.groupBy("grp", "coarse")).applyInPandas(spread, "block long, coarse int, kind int, values binary"))
    forget(sent)
    forget(answers)

    def apply(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        names = ["_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
        if not len(docs):
            return pd.DataFrame(columns=names)
        row, look = docs.iloc[0], {}
        texts, parts = [t.lower() for t in block_texts(row)], []
        held = {(kind, c): blob for kind, c, blob in zip(back["kind"], back["coarse"], back["values"], strict=True)}
        for kind, own in own_keys(texts).items():
            keys, values = np.concatenate([k for _, k in own]), np.concatenate([unpack_values(held[kind, c], kind) for c, _ in own])
            order = np.argsort(keys)
            look[kind] = Lookup(keys[order]), values[order]
        for a, b in runs(byte_lengths(texts)):
            grams, per_text, words, per_words = _keys(texts[a:b])
            at, values = look[GRAM]
            scores = np.add.reduceat(values[at(grams)], np.cumsum(per_text) - per_text)
            at, counts = look[WORD]
            c = counts[at(words)]
            starts = np.cumsum(per_words) - per_words
            base = np.add.reduceat(np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1))), starts)
            parts.append(pd.DataFrame({"n_tokens": per_words, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "base_score": base, "score": scores, "n_bytes": per_text - 1}))
        out = pd.concat(parts, ignore_index=True)
        out["_id"], out["held_out"] = block_numbers(row, "_id", "int64"), block_numbers(row, "_held", "int8") == 1
        return out[names]

    scored = blocks.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInPandas(
        apply, "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    )
    return scored, n_train


def op1(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
