"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

Documents with equal n-gram sets are one class; the join is among classes.
N-grams get one global order: by hash, but n-grams that many documents hold
come last.  Two sets as similar as asked share an n-gram among the first few of
each (prefix filter), so a class sends only those, packed, to the shard of each
n-gram.  A shard pairs each class with one class of its n-gram (a star).  Pairs
that parity bitmaps can't rule out are counted by vertical partitioning: the
order is cut into fragments, the common n-grams at its end being the last, each
fragment counts its part of the overlap, and the parts are summed per pair.  Stars already connect most of a group; what is
left to compare are members of one group that are still in different components
and whose distances to the group's centre leave a link possible.  Up to here no
group is expanded into all its pairs, and none is held in one task: n-grams of
very many classes are dealt to several shards, and large groups are cut in parts
that each meet those outside the group's main component.

Links are counted afterwards: both ends of a link are in one component, so the
classes of each component are cut into blocks and each pair of blocks counts its
links from the whole sets, as a matrix product.  Only counts leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_lengths, distinct, guarded_id, mixed, pack_rising, passing_tables, restored_id, runs, shared_table, text_bytes, text_or_empty, unpack_rising

WIDTH = 5
#: Least similarity, in percent.
PERCENT = 80
FRAGMENTS = 4
#: N-grams that at least this many documents hold come last in the order.  At
#: most MAX_HEAVY of them, the commonest, are told to all tasks (8 bytes each);
#: which are does not change the result, only the work.
HEAVY = 32
MAX_HEAVY = 1_000_000
#: An n-gram of more documents goes to several shards.
HOT_MEMBERS = 4096
#: Members of an n-gram that are compared with each other in one piece, about.
GROUP_MEMBERS = 512
#: Pairs of each member of an n-gram that are counted before all others.
LIKELIEST = 3
#: Classes and n-grams of a block, the unit in which links are counted, about.
LINK_CLASSES = 1024
LINK_GRAMS = 1 << 19
#: Cells of a matrix of classes by n-grams.
CELLS = 1 << 22
#: Windows held before a task reports its common n-grams.
FLUSH = 2_000_000
_MIN = -(1 << 63)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted; a shorter text is one n-gram, one without words none."""
    for a, b in runs(byte_lengths(texts)):
        w = Words([t.lower() for t in texts[a:b]])
        at, h = w.windows(width)
        count = np.bincount(w.text[at], minlength=b - a) if len(at) else np.zeros(b - a, np.int64)
        edge = np.concatenate(([0], np.cumsum(count)))
        for i in range(b - a):
            if count[i]:
                yield distinct(h[edge[i] : edge[i + 1]])
            elif w.count[i]:
                whole = w.hash[w.offset[i] : w.offset[i + 1]]
                yield mixed(np.bitwise_xor.reduce(mixed(whole + np.arange(len(whole), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keepdims=True), 9)
            else:
                yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(s, 21).sum(dtype=np.uint64).astype(np.int64)), int(mixed(s, 22).sum(dtype=np.uint64).astype(np.int64))


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the members in each of 2^k >= 2 |s| cells (at least 64): its differing bits bound the difference of two sets."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((mixed(s, 23) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0).tobytes()


def _folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Packed bitmaps, one a row, folded to ``width`` bytes: cell modulo cells."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, width), 1) if bitmaps.shape[1] > width else bitmaps


def _least_difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None]
    width = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())


class _Bitmaps:
    """The bitmaps of a group, stacked by width, to compare many pairs at a time."""

    def __init__(self, bitmaps: list[bytes]):
        self.width = byte_lengths(bitmaps)
        self.place, self.stack = np.zeros(len(bitmaps), np.int64), {}
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.stack[int(w)] = np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint8).reshape(-1, w)

    def difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        both = self.width[i] << 32 | self.width[j]
        for code in np.unique(both):
            own = np.flatnonzero(both == code)
            x, y = int(code >> 32), int(code & 0xFFFFFFFF)
            least = min(x, y)
            for a in range(0, len(own), 1 << 16):
                part = own[a : a + (1 << 16)]
                left, right = self.stack[x][self.place[i[part]]], self.stack[y][self.place[j[part]]]
                out[part] = np.bitwise_count(_folded(left, least) ^ _folded(right, least)).sum(1)
        return out


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _among_first(values: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their value."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.searchsorted(ranked, ranked)
    out = np.zeros(len(values), bool)
    out[order[np.arange(len(values)) - first < k]] = True
    return out


def _split(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in the global order: those that aren't common, by hash, and then the common ones, by hash."""
    if not len(heavy):
        return s, s[:0]
    last = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
    return s[~last], s[last]


def fragments(s: np.ndarray, heavy: np.ndarray) -> list[np.ndarray]:
    """The global order cut into FRAGMENTS: equal ranges of hashes, and the common n-grams at the end."""
    light, common = _split(s, heavy)
    edge = np.searchsorted(light >> np.uint64(32), np.arange(FRAGMENTS) * ((1 << 32) // (FRAGMENTS - 1)))
    edge[-1] = len(light)
    return [*(light[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)), common]


def linked_counts(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of the other side each set links with; without ``right``, of its own side, itself left out."""
    sides = [left] if right is None else [left, right]
    _, column = np.unique(np.concatenate([x for side in sides for x in side]), return_inverse=True)
    size = [byte_lengths(side) for side in sides]
    columns = np.split(column, [size[0].sum()])[: len(sides)]
    held = [np.bincount(c, minlength=column.max() + 1) for c in columns]
    use = np.flatnonzero(held[0] > 1 if right is None else (held[0] > 0) & (held[1] > 0))
    cells = []
    for c, n in zip(columns, size, strict=True):
        order = np.argsort(c, kind="stable")
        cells.append((np.repeat(np.arange(len(n)), n)[order], c[order]))
    step = max(1, CELLS // max(map(len, sides)))
    overlap = np.zeros((len(sides[0]), len(sides[-1])))
    for a in range(0, len(use), step):
        part, matrices = use[a : a + step], []
        for (row, c), side in zip(cells, sides, strict=True):
            lo, hi = np.searchsorted(c, part[0], "left"), np.searchsorted(c, part[-1], "right")
            at = np.searchsorted(part, c[lo:hi])
            ok = part[at] == c[lo:hi]
            m = np.zeros((len(side), len(part)), np.float32)
            m[row[lo:hi][ok], at[ok]] = 1
            matrices.append(m)
        overlap += matrices[0] @ matrices[-1].T
    linked = 100 * overlap >= percent * (size[0][:, None] + size[-1][None, :] - overlap)
    if right is None:
        np.fill_diagonal(linked, False)
    return linked.sum(1), linked.sum(0)


def links(df: DataFrame, id_col: str, text: str, width: int, percent: int, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, components): (_id, _print, uid, n, cls, n_links) of each row, and (cls, component) of the classes that have links.

    n_links is NULL without links, and everywhere if links aren't to be ``counted``.
    """
    spark = df.sparkSession
    rows = df.select(guarded_id(df, id_col), text_bytes(text).alias("_text"), F.xxhash64(text_or_empty(text)).alias("_print"))

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def report():
            h = np.concatenate(held)
            h.sort()
            h = h[np.concatenate(([False], h[1:] == h[:-1]))]  # all but the first of each
            h, n = np.unique(h, return_counts=True)
            return pd.DataFrame({"h": h.astype(np.int64), "n": n + 1})

        for pdf in batches:
            for s in shingle_sets([bytes(x) for x in pdf["_text"]], width):
                held.append(s)
                size += len(s)
                if size > FLUSH:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    seen = rows.select("_text").mapInPandas(common, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = shared_table(seen.where(F.col("n") >= HEAVY)).orderBy(F.col("n").desc(), "h").limit(MAX_HEAVY).toPandas()
    heavy = spark.sparkContext.broadcast(np.sort(top["h"].to_numpy(np.int64).astype(np.uint64)))
    top = top[top["n"] > HOT_MEMBERS].sort_values("h", key=lambda h: h.astype("uint64"))
    hot = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64).astype(np.uint64), -(-top["n"].to_numpy(np.int64) // HOT_MEMBERS)))

    def parts_of(gram: np.ndarray) -> np.ndarray:
        """In how many shards each n-gram is: one, if it isn't hot."""
        hashes, parts = hot.value
        if not len(hashes):
            return np.ones(len(gram), np.int64)
        at = np.minimum(np.searchsorted(hashes, gram), len(hashes) - 1)
        return np.where(hashes[at] == gram, parts[at], 1)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, mark, s in zip(pdf["_id"], pdf["_print"], shingle_sets([bytes(x) for x in pdf["_text"]], width), strict=True):
                prefix = np.concatenate(_split(s, heavy.value))[: _prefix_length(len(s), percent)] if len(s) else s
                out.append((key, mark, len(s), *_signature(s), prefix.tobytes(), _bitmap(s)))
            yield pd.DataFrame(out, columns=["_id", "_print", "n", "s1", "s2", "prefix", "bitmap"])

    docs = rows.mapInPandas(describe, "_id long, _print long, n long, s1 long, s2 long, prefix binary, bitmap binary")
    docs = shared_table(docs.withColumn("uid", F.monotonically_increasing_id()))
    classes = docs.groupBy("n", "s1", "s2").agg(F.min("uid").alias("cls"), F.min(F.struct("_id", "uid")).alias("_first"))
    classes = shared_table(classes.select("n", "s1", "s2", "cls", F.col("_first._id").alias("first_id")))
    reps = shared_table(docs.join(classes.select(F.col("cls").alias("uid"), "first_id"), "uid").where("n > 0").select("uid", "n", "s1", "s2", "first_id", "prefix", "bitmap"))

    # prefix n-grams, packed by shard
    volume = reps.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // (4 << 20)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["prefix"].map(len).to_numpy(np.int64) // 8
            for a, b in runs(sizes * 24, 8 << 20):
                gram = np.frombuffer(b"".join(pdf["prefix"][a:b]), np.uint64)
                uid, n = np.repeat(pdf["uid"].to_numpy(np.int64)[a:b], sizes[a:b]), np.repeat(pdf["n"].to_numpy(np.int64)[a:b], sizes[a:b])
                part = mixed(uid.astype(np.uint64), 32) % parts_of(gram).astype(np.uint64)
                to = (mixed(gram + part * np.uint64(0x9E3779B97F4A7C15), 31) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edge = np.searchsorted(to[order], np.arange(shards + 1))
                out = []
                for s in np.flatnonzero(np.diff(edge)):
                    own = order[edge[s] : edge[s + 1]]
                    out.append((int(s), gram[own].tobytes(), pack_rising(uid[own]), pack_rising(n[own])))
                yield pd.DataFrame(out, columns=["shard", "gram", "uid", "n"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        """Members of n-grams that two classes or more hold, with the class at the centre.

        That is the first of them, so that a large group of near copies, whose n-grams have almost the same members, has few centres.
        """
        gram = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["gram"]])
        uid, n = (np.concatenate([unpack_rising(x) for x in pdf[c]]) for c in ("uid", "n"))
        order = np.lexsort((uid, gram))
        gram, uid, n = gram[order], uid[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        size = np.diff(np.concatenate((first, [len(gram)])))
        centre = np.repeat(uid[first], size)
        several = np.repeat(parts_of(gram[first]) > 1, size)  # has members in other shards
        keep = several | (np.repeat(size, size) > 1)
        return pd.DataFrame({"gram": gram[keep].astype(np.int64), "uid": uid[keep], "n": n[keep], "centre": centre[keep], "several": several[keep]})

    dealt = reps.select("uid", "n", "prefix").mapInPandas(deal, "shard int, gram binary, uid binary, n binary")
    found = shared_table(dealt.groupBy("shard").applyInPandas(shared, "gram long, uid long, n long, centre long, several boolean"))
    first_of = found.where("several").groupBy("gram").agg(F.min("centre").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1")  # at most MAX_HEAVY rows
    members = found.where("not several").drop("several").union(found.where("several").join(first_of, "gram").select("gram", "uid", "n", "first"))

    @F.pandas_udf("long")
    def difference(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_least_difference(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    small = reps.select("uid", "n", "bitmap")

    def count(pairs: DataFrame) -> DataFrame:
        """(a, b, low, overlap) of pairs of classes: at least this many n-grams differ; the overlap, NULL where those rule a link out."""
        sided = (
            pairs.join(small.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba")), "a")
            .join(small.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb")), "b")
        )
        # |A| + |B| - 2 |A & B| <= (|A| + |B|) (1 - t) / (1 + t) for similarity t
        bounded = shared_table(sided.withColumn("low", difference("ba", "bb")).drop("ba", "bb"))
        open_ = bounded.where((100 + percent) * F.col("low") <= (100 - percent) * (F.col("na") + F.col("nb")))
        wanted = open_.select(F.col("a").alias("uid")).union(open_.select(F.col("b").alias("uid"))).distinct()
        wanted = wanted.join(reps.select("uid", "s1", "s2", F.col("first_id").alias("_id")), "uid")
        texts = rows.join(wanted.select("_id").distinct(), "_id", "left_semi")

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for s in shingle_sets([bytes(x) for x in pdf["_text"]], width):
                    signs = _signature(s)
                    out += [(*signs, f, part.tobytes()) for f, part in enumerate(fragments(s, heavy.value))]
                yield pd.DataFrame(out, columns=["s1", "s2", "fragment", "grams"])

        parts = texts.select("_text").mapInPandas(cut, "s1 long, s2 long, fragment int, grams binary")
        parts = parts.join(wanted.select("uid", "s1", "s2"), ["s1", "s2"]).select("uid", "fragment", "grams").dropDuplicates(["uid", "fragment"])
        parts = shared_table(parts)

        @F.pandas_udf("long")
        def both(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)], dtype="int64")

        partial = (
            open_.select("a", "b").join(parts.select(F.col("uid").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
            .join(parts.select(F.col("uid").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
            .select("a", "b", both("ga", "gb").alias("part"))
        )
        overlap = partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"))
        return shared_table(bounded.join(overlap, ["a", "b"], "left"))

    linked = lambda pairs: pairs.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    centres = small.select(F.col("uid").alias("centre"), F.col("n").alias("nc"))
    star = members.where("uid <> centre").select("uid", "n", "centre").distinct().join(centres, "centre").where(fits(F.col("n"), F.col("nc")))
    star = count(star.select(F.least("uid", "centre").alias("a"), F.greatest("uid", "centre").alias("b")).distinct())
    first_links = linked(star)
    components = connected(first_links)

    # distance of members to their centre: exact where counted, at least this much where not
    union = F.col("na") + F.col("nb")
    far = star.select(
        "a", "b",
        F.when(F.col("overlap").isNotNull(), 1 - F.col("overlap") / (union - F.col("overlap"))).otherwise(2 * F.col("low") / (union + F.col("low"))).alias("at_least"),
        F.when(F.col("overlap").isNotNull(), 1 - F.col("overlap") / (union - F.col("overlap"))).otherwise(1.0).alias("at_most"),
    )
    # a member that is of another size than its centre was not counted: the sizes bound its distance
    near = (
        members.join(far.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "at_least", "at_most"), (F.least("uid", "centre") == F.col("_a")) & (F.greatest("uid", "centre") == F.col("_b")), "left").drop("_a", "_b")
        .withColumn("at_least", F.when(F.col("uid") == F.col("centre"), 0.0).otherwise(F.coalesce("at_least", F.lit(1 - percent / 100))))
        .withColumn("at_most", F.when(F.col("uid") == F.col("centre"), 0.0).otherwise(F.coalesce("at_most", F.lit(1.0))))
    )
    near = shared_table(near)

    def open_pairs(components: DataFrame, best: int | None) -> DataFrame:
        """Pairs of members of one n-gram in different components that may be linked; with ``best``, only each member's likeliest."""
        placed = near.join(components, near["uid"] == components["cls"], "left").drop("cls").withColumn("component", F.coalesce("component", "uid"))
        # of n-grams with the same members, one stands for all
        held = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("uid")).alias("_x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("_y"))
        alike = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_components"), F.sum("_n").alias("_size"), F.max(F.struct("_n", "component")).alias("_most"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"))
        several = alike.where("_components > 1").groupBy("_size", "_x", "_y").agg(F.min(F.struct("gram", "_most")).alias("_g"))
        pieces = lambda n: F.ceil(n / F.lit(float(GROUP_MEMBERS))).cast("int")
        several = several.select("_g.gram", F.col("_g._most.component").alias("_main"), pieces(F.col("_size")).alias("_parts"), pieces(F.col("_size") - F.col("_g._most._n")).alias("_chunks"))
        groups = placed.join(several, "gram").join(reps.select("uid", "bitmap"), "uid")
        # a large group: each part of its members meets each chunk of those outside its main component
        part, chunk = F.pmod(F.xxhash64("uid", F.lit(2)), F.col("_parts")).cast("int"), F.pmod(F.xxhash64("uid", F.lit(3)), F.col("_chunks")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outside = groups.where("_parts > 1 and component <> _main").withColumn("_j", chunk).withColumn("_outside", F.lit(True)).withColumn("_i", every("_parts"))
        inside = groups.withColumn("_i", part).withColumn("_outside", F.lit(False)).withColumn("_j", F.when(F.col("_parts") > 1, F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(F.array(F.lit(0)))).withColumn("_j", F.explode("_j"))
        dealt = inside.unionByName(outside).withColumn("_shard", F.pmod(F.xxhash64("gram", "_i", "_j"), F.lit(shards)))
        return dealt.groupBy("_shard").applyInPandas(lambda pdf: remaining(pdf, best), "a long, b long").distinct()

    def remaining(pdf: pd.DataFrame, best: int | None) -> pd.DataFrame:
        """Pairs of one n-gram in different components that could still be linked, by sizes, distances to the centre and bitmaps."""
        limit, out = 1 - percent / 100 + 1e-9, []
        pdf = pdf.sort_values(["gram", "_i", "_j", "n", "uid"], kind="stable")
        uid, n, comp, low, high, side, main = (pdf[c].to_numpy() for c in ("uid", "n", "component", "at_least", "at_most", "_outside", "_main"))
        bitmaps = [bytes(x) for x in pdf["bitmap"]]
        piece = pdf[["gram", "_i", "_j"]].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]).any(1))))
        for a, b in zip(first, [*first[1:], len(pdf)], strict=True):
            maps = _Bitmaps(bitmaps[a:b])

            def keep(i, j, a=a, b=b, maps=maps):
                u, s, c, x, y = uid[a:b], n[a:b], comp[a:b], low[a:b], high[a:b]
                ok = (c[i] != c[j]) & (x[j] - y[i] <= limit) & (x[i] - y[j] <= limit)
                ok &= 100 * np.minimum(s[i], s[j]) >= percent * np.maximum(s[i], s[j])
                i, j = i[ok], j[ok]
                differ = maps.difference(i, j)
                ok = (100 + percent) * differ <= (100 - percent) * (s[i] + s[j])
                i, j, differ = i[ok], j[ok], differ[ok]
                if best is not None:
                    order = np.argsort(differ / (s[i] + s[j]), kind="stable")
                    i, j = i[order], j[order]
                    ok = _among_first(i, best) | _among_first(j, best)
                    i, j = i[ok], j[ok]
                out.append(np.stack([u[i], u[j]], 1))

            others = np.flatnonzero(side[a:b])
            if not len(others):
                keep(*np.triu_indices(b - a, 1))
                continue
            own = np.flatnonzero(~side[a:b])
            i, j = np.repeat(own, len(others)), np.tile(others, len(own))
            # of two outside the main component, each is in a part and in a chunk
            ok = (comp[a:b][i] == main[a:b][i]) | (uid[a:b][i] < uid[a:b][j])
            keep(i[ok], j[ok])
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, 1), axis=0) if len(pairs) else pairs
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    # the likeliest pairs first: most groups of near copies are one component after them
    likely = shared_table(open_pairs(components, LIKELIEST).join(star.select("a", "b"), ["a", "b"], "left_anti"))
    more_links = shared_table(first_links.union(linked(count(likely))).distinct())
    rest = open_pairs(connected(more_links), None).join(star.select("a", "b"), ["a", "b"], "left_anti").join(likely, ["a", "b"], "left_anti")
    all_links = shared_table(more_links.union(linked(count(shared_table(rest)))).distinct())
    components = connected(all_links)
    rows_out = docs.select("_id", "_print", "uid", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "cls"), ["n", "s1", "s2"])
    placed = rows_out.select("_id", "_print", "uid", "n", "cls")
    if not counted:
        return placed.withColumn("n_links", F.lit(None).cast("long")), components

    # all links of each class, also those that no component needed
    parts = components.join(reps.select(F.col("uid").alias("cls"), "n"), "cls").groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("grams"))
    parts = parts.withColumn("blocks", F.greatest(F.ceil(F.col("classes") / LINK_CLASSES), F.ceil(F.col("grams") / LINK_GRAMS)).cast("int"))
    blocks = shared_table(components.join(parts, "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    several = blocks.where("classes > 2").join(reps.select(F.col("uid").alias("cls"), "s1", "s2", F.col("first_id").alias("_id")), "cls")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(*_signature(s), s.tobytes()) for s in shingle_sets([bytes(x) for x in pdf["_text"]], width)], columns=["s1", "s2", "grams"])

    def count_links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of each class with those of one other block of its component, or of its own."""
        out = []
        for (_, i, j), pair in pdf.groupby(["component", "i", "j"]):
            left, right = pair[pair["block"] == i], pair[pair["block"] == j] if i != j else None
            if right is not None and not (len(left) and len(right)):
                continue
            x, y = linked_counts(*([np.frombuffer(g, np.uint64) for g in side["grams"]] if side is not None else None for side in (left, right)), percent)
            out += [(left["cls"], x)] + ([(right["cls"], y)] if right is not None else [])
        return pd.concat([pd.DataFrame({"cls": c.to_numpy(), "n_links": k}) for c, k in out] or [pd.DataFrame({"cls": [], "n_links": []}, dtype="int64")])

    texts = rows.join(several.select("_id").distinct(), "_id", "left_semi").select("_text")
    sets = texts.mapInPandas(whole, "s1 long, s2 long, grams binary").join(several.select("cls", "s1", "s2", "component", "block", "blocks"), ["s1", "s2"])
    sets = shared_table(sets.drop("s1", "s2").dropDuplicates(["cls"]))
    volume = sets.agg(F.sum(F.octet_length("grams") * F.col("blocks").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // (4 << 20)))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cls", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "grams")
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64("component", "i", "j"), F.lit(shards)))
    degree = dealt.groupBy("_shard").applyInPandas(count_links, "cls long, n_links long").groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    degree = shared_table(degree.union(blocks.where("classes = 2").select("cls", F.lit(1).cast("long"))))
    return placed.join(degree, "cls", "left"), components


def connected(edges: DataFrame) -> DataFrame:
    """(cls, component) of all nodes of an edge list (a, b): the component is its smallest node.

    Each round, every node learns the smallest label among its neighbours and
    then takes its label's label, so paths shorten as they are walked.
    """
    both = shared_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = shared_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["cls"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["cls"] == near["a"]).select("cls", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        step = shared_table(step)
        jump = step.select(F.col("cls").alias("_c"), F.col("component").alias("_to"))
        step = step.join(jump, F.col("component") == F.col("_c")).select("cls", "old", F.least("component", "_to").alias("component"))
        step = shared_table(step)
        changed = step.where("old <> component").limit(1).count()
        labels = step.select("cls", "component")
        if not changed:
            return labels


def similar_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, n_links, is_first).

    Two documents link when their sets of distinct ``width``-word shingles
    (A-Z lowered; a shorter text is one shingle) have a Jaccard similarity of
    ``percent`` or more.  component_id is the smallest id reachable by links,
    the document's own included (NULL ids come first and stay NULL).  n_links
    counts all texts it links with, those with its own set of shingles as none;
    is_first marks one row of each group.  Documents without words, NULL texts among them,
    link with nothing and are their own group, each row.  An empty table gives
    no rows; other columns are not read.  The id must be an integer.
    """
    groups = _grouped(df, id_col, text, width, percent)
    kind = df.schema[id_col].dataType
    return groups.select(
        restored_id(df, id_col), F.col("n").alias("n_shingles"), F.when(F.col("_first_id") != _MIN, F.col("_first_id")).cast(kind).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("uid") == F.col("_first_uid")).alias("is_first"), "uid",
    )


def _grouped(df: DataFrame, id_col: str, text: str, width: int, percent: int, counted: bool = True) -> DataFrame:
    """(_id, _print, uid, n, n_links) of each row and (_first_id, _first_print, _first_uid) of the first row of its group."""
    with passing_tables(df.sparkSession):
        documents, components = links(df, id_col, text, width, percent, counted)
        placed = shared_table(documents.join(components, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
        names = placed.where("n > 0").groupBy("component").agg(F.min(F.struct("_id", "uid", "_print")).alias("_f"))
        first = lambda c: F.when(F.col("n") > 0, F.col(f"_f.{c}")).otherwise(F.col(c))
        out = placed.join(names, "component", "left").select("_id", "_print", "uid", "n", "n_links", first("_id").alias("_first_id"), first("_print").alias("_first_print"), first("uid").alias("_first_uid"))
        return shared_table(out, keep=True)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with one of each group of near copies: that of the smallest id (NULL first).

    Judged row by row: an id that occurs with several texts keeps those that
    are no copies.  Rows that repeat the id and the text of the one that stays
    go but for one.  Rows without words, NULL texts among them, all stay.
    Columns may have any names; an empty table gives no rows.  The id must be
    an integer.
    """
    groups = _grouped(df, id_col, text, WIDTH, PERCENT, counted=False)
    same = (F.col("_id") == F.col("_first_id")) & (F.col("_print") == F.col("_first_print"))
    marks = groups.where("n > 0").groupBy("_id", "_print").agg(F.max(same).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    marks = shared_table(marks.where("not _stays or _rows > 1"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), guarded_id(df, id_col), F.xxhash64(text_or_empty(text)).alias("_print"))
    marked = rows.join(marks, ["_id", "_print"], "left")
    kept = marked.where("_stays is null").select("_row.*")
    if marks.where("_stays").limit(1).count():  # rows repeated as they are
        kept = kept.union(marked.where("_stays").dropDuplicates(["_id", "_print"]).select("_row.*"))
    return kept


def op8(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")
