"""Personal data: patterns, and a character BiLSTM-CRF for what they miss.

The tagger is trained on the driver, in numpy, on windows with labelled spans:
those that the patterns find in a bounded sample of documents, and made-up ones
in forms that the patterns don't cover.  It reads whole texts in overlapping
windows; a character's scores are averaged over its windows, more weight in
their middle.  The best tag sequence of the whole text is then found.  A span counts
if the CRF is sure of its characters, they are written in one of the forms that
its kind can have (what runs on behind the form isn't part of the span), and its
digits pass the exact checks (ranges, Luhn).
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_tagger import PAD, CharTagger, codes
from .common import byte_lengths, guarded_id, guarded_type, restored_id, runs, shared_root, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Documents that give training windows at most, windows of each, and made-up texts beside them.
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 8
MADE_UP = 1600
#: Characters of a window in training, and in use with the step to the next one.
TRAIN_WINDOW = 72
WINDOW, STRIDE = 256, 224
#: Windows that the tagger reads at a time.
BATCH = 512
#: Added to the score of a character known to be outside.
OUTSIDE = 100.0
#: Least probability of each character of a span.
SURE = 0.25

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"@|[\[({](?:at|AT)[\])}]")
_NOT_DIGIT = re.compile("[^0-9]+")
_WRITTEN = r"(?:{0}|\x20?[\[({{](?:{0}|{1}|{2})[\])}}]\x20?)"
_DOT = _WRITTEN.format(r"\.", "dot", "DOT")
#: How a span of each kind may be written; says where one ends, not whether it is one.
FORMS = (
    re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*{_WRITTEN.format('@', 'at', 'AT')}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]?[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9])(?<![0-9][./_-])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){9,14}(?![./_-]?[0-9])"),
)
_DIGITS_BEFORE, _DIGITS_AFTER = re.compile(r"[0-9][./_-]?\Z"), re.compile("[./_-]?[0-9]")
#: Characters around what the tagger marks in which the form is looked for.
AROUND = 60


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d if d < 5 else 2 * d - 9
        total += d
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind, failing ones dropped."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def luhn_card(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 15 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 2


def in_range(kind: int, found: str) -> bool:
    """The exact checks of what the tagger proposes: an e-mail's @, (at) or [at], numbers of an address, digits and Luhn sum of a card, digits of a phone."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == 0:
        return bool(_AT.search(found))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 2
    return 10 <= len(digits) <= 15


def made_up(r: np.random.Generator, words: list[str], count: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans in many forms, and look-alikes that are none."""
    number = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda x: x[int(r.integers(len(x)))]
    name = lambda: pick(words).lower()[:10] or "x"

    def card() -> str:
        body = pick(["4", "51", "37", "6011"]) + number(11)
        body = body[:15]
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(["", " ", "-", ".", "/", "_"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        if r.random() < 0.5:
            a, b, c = number(3), number(3), number(4)
            return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{pick(['44', '49', '33', '34'])} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"00{pick(['44', '49', '33'])} {number(2)} {b} {c}"])
        sep = pick([" ", "-", ".", "/"])
        groups = [number(n) for n in pick([(3, 3, 4), (3, 3, 4), (2, 4, 4), (4, 3, 3), (3, 4, 4), (2, 3, 3, 2)])]
        if r.random() < 0.3:
            groups[0] = f"({groups[0]})"
        before = pick(["", "", f"00{pick(['1', '44', '49', '33', '39', '81'])}{sep}", f"+{number(2)}{sep}", f"1{sep}", f"+{number(1)}{sep}"])
        last = pick([sep, "-", " "])
        return before + sep.join(groups[:-1]) + last + groups[-1]

    def email() -> str:
        ending = pick(["com", "org", "net", "co", "de", "fr", "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(r.integers(2, 5))))])
        host = pick([name(), name(), f"{name()}-{name()}", f"{name()}{number(1)}"]) + pick([".", ".", f".{name()[:3]}."]) + ending
        user = pick([name(), f"{name()}.{name()}", f"{name()}{number(2)}", f"{name()}_{number(3)}", f"{name()}.{number(2)}", f"{name()[0]}_{name()}", f"{name()}-{name()}"])
        at, dot = pick([("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("(AT)", "(DOT)"), ("{at}", "{dot}"), (" {at} ", " {dot} "), ("[at]", "."), ("(at)", ".")])
        whole = f"{user}{at}{host.replace('.', dot)}"
        return whole.upper() if r.random() < 0.1 else whole

    def ip() -> str:
        return pick([".", "[.]", "[.]", "(.)", "[dot]", "(dot)"]).join(str(int(r.integers(0, 256))) for _ in range(4))

    def other() -> str:
        return pick([
            number(int(r.integers(1, 9))), f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", f"{number(3)},{number(3)}.{number(2)}", number(16), f"#{number(6)}",
            "".join(pick("0123456789abcdef") for _ in range(int(r.integers(16, 41)))), f"{number(3)}-{number(2)}-{number(4)}", f"@{name()}", f"{name()}{number(3)}", f"{number(4)} {number(4)} {number(4)} {number(3)}", f"$ {number(3)}.{number(2)}",
            f"{name()} at {name()}", f"the dot {name()}", f"{name()} (at {name()})", f"www.{name()}.com", f"{name()}.{name()}.txt", f"http://{name()}.org/{name()}", f"at {number(2)} {name()}", f"{number(4)}-{number(4)}", f"{name()}: {number(4)}", f"{name()}-{name()}", f"[{name()}]", f"({name()})",
            f"{number(2)}.{number(2)}.{number(4)}", f"{number(12)}", f"{number(3)}.{number(3)}.{number(3)}.{number(3)}.{number(2)}",
        ])

    def some() -> str:
        found = " ".join(pick(words) for _ in range(int(r.integers(1, 6))))
        return found.upper() if r.random() < 0.1 else found

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(r.integers(2, 5))):
            text += some() + pick([" ", " ", ": ", "\n", ", ", ". "])
            kind = (0, 1, 2, 3, 3, 4, 4, 4)[int(r.integers(8))]
            piece = (email, ip, card, phone, other)[kind]()
            if kind < 4:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + pick([" ", ". ", ", ", "\n", "### ", " ", "; "])
        out.append((text + some() if r.random() < 0.7 else text, spans))
    return out


def labels(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The tag of each character: 2k+1 begins kind k, 2k+2 goes on."""
    tags = np.zeros(length, np.int8)
    for a, k, b in reversed(spans):
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


def windows_of(text: str, spans: list[tuple[int, int, int]], centres: list[int], size: int = TRAIN_WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Character and tag windows around some places of a text; all spans in them are labelled."""
    ids, tags = codes(text), labels(len(text), spans)
    for at in centres:
        part = slice(max(0, at - size // 2), max(0, at - size // 2) + size)
        yield np.pad(ids[part], (0, size - len(ids[part])), constant_values=PAD), np.pad(tags[part], (0, size - len(tags[part])))


def sample_windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """At most SAMPLE_WINDOWS training windows of a document: around pattern spans, around other numbers, and anywhere."""
    spans, r = pattern_spans(text), np.random.default_rng(len(text))
    centres = [(a + b) // 2 for a, _, b in spans][: SAMPLE_WINDOWS - 4]
    centres += [m.start() for _, m in zip(range(2), re.finditer("[0-9]{3,}", text), strict=False)]
    centres += r.integers(0, len(text) + 1, 2).tolist()
    return list(windows_of(text, spans, centres))


def training_set(sample: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of sample documents, and of made-up texts in their words and as many of random letters, so that names needn't be known ones."""
    prose = " ".join("".join(map(chr, ids[ids < 128])) for ids, _ in sample)
    words = sorted(set(re.findall(r"[^\W\d_]+", prose))) or ["call", "write", "to", "the", "office", "order", "from", "and"]
    words, r = words[:: -(-len(words) // 3000)], np.random.default_rng(9)
    words += ["".join(map(chr, r.integers(97, 123, int(r.integers(2, 10))))) for _ in words]
    pairs = list(sample)
    for t, spans in made_up(np.random.default_rng(3), words, MADE_UP):
        numbers = [m.start() for m in re.finditer("[0-9]{3,}", t)]
        pairs += windows_of(t, spans, [(a + b) // 2 for a, _, b in spans] + numbers[:1] + [len(t) // 3])
    return np.stack([a for a, _ in pairs]), np.stack([b for _, b in pairs]).astype(np.int64)


def train(sample: list[tuple[np.ndarray, np.ndarray]]) -> tuple[CharTagger, list[float]]:
    """The tagger from windows of sample documents and made-up ones."""
    model = CharTagger(2 * len(KINDS) + 1)
    losses = model.fit(*training_set(sample), epochs=11, batch=32, rate=0.025)
    return model, losses


def stretches(inside: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the characters marked."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


_WEIGHT = (1 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / (WINDOW / 2) + 0.05).astype(np.float32)[:, None]


class Read:
    """The tagger's scores of some texts, read in windows."""

    def __init__(self, model: CharTagger, texts: list[str]):
        ids = [codes(t) for t in texts]
        self.lengths, self.tags = np.array([len(x) for x in ids]), model.tags
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        windows = [(i, at) for i, x in enumerate(ids) for at in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE) if len(x)]
        windows.sort(key=lambda w: min(WINDOW, len(ids[w[0]]) - w[1]))  # short ones together
        self.place, self.planes = {w: divmod(k, BATCH) for k, w in enumerate(windows)}, []
        gain = np.full(int((self.lengths + 1).sum()), -1e6, np.float32)
        for a in range(0, len(windows), BATCH):
            part = windows[a : a + BATCH]
            length = min(WINDOW, len(ids[part[-1][0]]) - part[-1][1])
            batch = np.full((len(part), length), PAD, np.int16)
            for row, (i, at) in enumerate(part):
                own = ids[i][at : at + length]
                batch[row, : len(own)] = own
            self.planes.append(model.planes(batch))
            for (i, at), own in zip(part, model.gains(self.planes[-1]), strict=True):
                here = gain[self.starts[i] + at : self.starts[i] + min(at + length, self.lengths[i])]
                np.maximum(here, own[: len(here)], out=here)
        self.inside = model.may_be_inside(gain, self.lengths) if len(gain) else gain > 0

    def scores(self, i: int, a: int, b: int) -> np.ndarray:
        """(b - a, tags) scores of the characters from a to b of text i, averaged over the windows that hold them."""
        out, shares = np.zeros((b - a, self.tags), np.float32), np.zeros((b - a, 1), np.float32)
        for at in range(max(0, (a - WINDOW) // STRIDE) * STRIDE, b, STRIDE):
            if (i, at) in self.place:
                batch, row = self.place[i, at]
                held = self.planes[batch]
                lo, hi = max(a, at), min(b, at + len(held), int(self.lengths[i]))
                if lo < hi:
                    weight = _WEIGHT[lo - at : hi - at]
                    out[lo - a : hi - a] += held[lo - at : hi - at, :, row] * weight
                    shares[lo - a : hi - a] += weight
        return out / shares


def tagged_spans(model: CharTagger, texts: list[str]) -> list[list[tuple[int, int, int, np.ndarray]]]:
    """(start, kind, end, probability of each character) of the spans that the tagger finds in each text, before any check."""
    out: list[list[tuple[int, int, int, np.ndarray]]] = [[] for _ in texts]
    for first, last in runs(byte_lengths(texts)):
        read = Read(model, texts[first:last])
        # what surrounds a stretch is outside in the best sequence, so each can be decoded by itself
        near = stretches(read.inside)
        whose = np.searchsorted(read.starts, [a for a, _ in near], "right") - 1
        ranges, held = [], []
        for (a, b), i in zip(near, whose.tolist(), strict=True):
            a, b = max(a - int(read.starts[i]) - 1, 0), min(b - int(read.starts[i]) + 1, int(read.lengths[i]))
            s = read.scores(i, a, b)
            s[0, 0] += OUTSIDE * (a > 0)
            s[-1, 0] += OUTSIDE * (b < read.lengths[i])
            ranges.append((i, a))
            held.append(s)
        tags = model.decode(held)
        some = [k for k, best in enumerate(tags) if best.any()]
        for k, sure in zip(some, model.posteriors([held[k] for k in some]), strict=True):
            (i, begin), best, t = ranges[k], tags[k], 0
            while t < len(best):
                if not best[t]:
                    t += 1
                    continue
                kind, start = (int(best[t]) - 1) // 2, t
                t += 1
                while t < len(best) and best[t] == 2 * kind + 2:
                    t += 1
                out[first + i].append((begin + start, kind, begin + t, sure[np.arange(start, t), best[start:t]]))
    return out


def uncut(text: str, a: int, b: int) -> bool:
    """Whether characters a to b begin and end where words do."""
    return (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())


def in_form(text: str, kind: int, a: int, b: int) -> list[tuple[int, int]]:
    """Where characters a to b hold something in a form of the kind: all of them but blanks and signs at their ends, or the forms that lie in them by half and more."""
    while a < b and text[a] in " \n\t,;:":
        a += 1
    while b > a and text[b - 1] in " \n\t,;:.#*$%&|<>":
        b -= 1
    more = kind and (_DIGITS_AFTER.match(text, b) or _DIGITS_BEFORE.search(text, max(0, a - 2), a))
    if not more and uncut(text, a, b) and FORMS[kind].fullmatch(text, a, b):
        return [(a, b)]
    around = [m.span() for m in FORMS[kind].finditer(text, max(0, a - AROUND), min(len(text), b + AROUND))]
    return [(x, y) for x, y in around if 2 * (min(b, y) - max(a, x)) >= y - x]


def added_spans(model: CharTagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of which it is sure, in a form of their kind, that pass the exact checks, cut no word and touch no pattern span or each other."""
    out = []
    for text, known, new in zip(texts, base, tagged_spans(model, texts), strict=True):
        good, taken = [], list(known)
        for begin, tagged, end, sure in new:
            # cards and phones can look alike, so a long run of digits in a card's form is one if its check digit says so
            cards = [(2, a, b) for a, b in in_form(text, 2, begin, end) if luhn_card(text[a:b])] if tagged == 3 else []
            for k, a, b in cards or [(tagged, *x) for x in in_form(text, tagged, begin, end)]:
                if uncut(text, a, b) and sure[max(a - begin, 0) : b - begin].min() >= SURE and in_range(k, text[a:b]) and all(b <= x or y <= a for x, _, y in taken):
                    good.append((a, k, b))
                    taken.append((a, k, b))
        out.append(good)
    return out


_fitted: dict[str, CharTagger] = {}


def fitted(df: DataFrame, text: str) -> CharTagger:
    """A tagger trained on windows of at most SAMPLE_DOCS documents of ``df``: those with a digit or @ whose text hashes are the smallest.

    Windows are cut where the documents are; only those come to the driver.
    The weights are kept in the shared folder under a hash of all they were
    trained on, so the same sample is trained on once.
    """
    spark = df.sparkSession
    rows = df.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    last = rows.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, t in zip(pdf["h"], pdf["t"], strict=True):
                yield pd.DataFrame([(h, a.tobytes(), b.tobytes()) for a, b in sample_windows(t)], columns=["h", "ids", "tags"])

    found = rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).mapInPandas(cut, "h long, ids binary, tags binary").toPandas().sort_values(["h", "ids", "tags"])
    sample = [(np.frombuffer(a, np.int16), np.frombuffer(b, np.int8)) for a, b in zip(found["ids"], found["tags"], strict=True)]
    mark = hashlib.sha256(b"".join(x.tobytes() for x in training_set(sample)) + repr(sorted((k, v.shape) for k, v in CharTagger(2 * len(KINDS) + 1).p.items())).encode()).hexdigest()[:32]
    if mark not in _fitted:
        path = f"{shared_root(spark)}/shelfwise-tagger-{mark}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            model = CharTagger(2 * len(KINDS) + 1)
            with np.load(io.BytesIO(spark.read.parquet(path).first()["weights"])) as held:
                model.p = {k: held[k] for k in held.files}
        else:
            model = train(sample)[0]
            out = io.BytesIO()
            np.savez(out, **model.p)
            spark.createDataFrame([(bytearray(out.getvalue()),)], "weights binary").write.mode("overwrite").parquet(path)
        _fitted[mark] = model
    return _fitted[mark]


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    Counts and base_sha256 are of the patterns, spans holds the tagger's too, in
    code points, end exclusive.  NULL is an empty text and has none; repeated
    rows are searched each; an empty table gives no rows; other columns are not
    read.
    """
    model = df.sparkSession.sparkContext.broadcast(fitted(df, text))
    schema = f"_id {guarded_type(df, id_col)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["_text"])
            base = [pattern_spans(t) for t in texts]
            out = []
            for key, b, new in zip(pdf["_id"], base, added_spans(model.value, texts, base), strict=True):
                counts = [sum(k == x for _, k, _ in b) for x in range(4)]
                out.append((key, *counts, hashlib.sha256(joined(b).encode()).hexdigest(), joined(sorted(b + new)), len(new)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    found = df.select(guarded_id(df, id_col), text_or_empty(text).alias("_text")).mapInPandas(search, schema)
    return found.select(restored_id(df, id_col), *found.columns[1:])


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in capitals."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all personal data in its text masked; texts without any, and NULL, stay as they are.

    Repeated rows are masked each; an empty table gives no rows; other columns
    stay, whatever their names.
    """
    model = df.sparkSession.sparkContext.broadcast(fitted(df, text))

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        texts = list(column)
        held = [i for i, t in enumerate(texts) if t]
        base = [pattern_spans(texts[i]) for i in held]
        for i, b, new in zip(held, base, added_spans(model.value, [texts[i] for i in held], base), strict=True):
            if b or new:
                texts[i] = masked(texts[i], b + new)
        return pd.Series(texts, dtype=object)

    return df.withColumn(text, clean(F.col(text)))


def op7(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
