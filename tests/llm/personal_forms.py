"""Personal data written by another hand than the tagger's training texts: other names, hosts, endings, and some forms of its own."""

from __future__ import annotations

import brute

NAMES = "oyelaran szczepan nguyen lindqvist abernathy kowalczyk iturralde mbeki thorvald yamashita okonkwo fitzgerald deshpande quispe zeynep haraldur".split()
HOSTS = "protonmail fastpost uni-graz kestrel-labs northwind tuttelage inbox7 gridmail openrelay voskhod".split()
ENDINGS = "edu io info gov co.uk ac.nz eu biz".split()


def digits(r, n):
    return "".join(map(str, r.integers(0, 10, n)))


def email(r, pick):
    user = pick([pick(NAMES), f"{pick(NAMES)}.{pick(NAMES)}", f"{pick(NAMES)}{digits(r, 2)}", f"{pick(NAMES)[0]}_{pick(NAMES)}", f"{pick(NAMES)}-{pick(NAMES)}"])
    at, dot = pick([(" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("(at)", "."), (" [at] ", "."), ("{at}", "{dot}")])
    return user + at + f"{pick(HOSTS)}.{pick(ENDINGS)}".replace(".", dot)


def ip(r, pick):
    return pick(["[.]", "(.)", "[dot]"]).join(str(int(x)) for x in r.integers(1, 255, 4))


def card(r, pick):
    body = (pick(["4", "52", "35", "6011"]) + digits(r, 15))[:15]
    body += next(c for c in "0123456789" if brute.luhn(body + c))
    return pick([".", "/", "_"]).join(body[i : i + 4] for i in range(0, 16, 4))


def phone(r, pick):
    a, b, c = f"{int(r.integers(201, 990))}", digits(r, 3), digits(r, 4)
    return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"0044 20 {digits(r, 4)} {c}", f"{a}/{b}-{c}", f"{a} {b} {c}"])


def planted(r, prose, count):
    """(text, kind, start, end): one of the kind in prose that goes on after it, kinds in turn."""
    pick = lambda x: x[int(r.integers(len(x)))]
    out = []
    for i in range(count):
        words = pick(prose).split()
        at = int(r.integers(0, max(1, len(words) - 40)))
        cut = at + int(r.integers(3, 20))
        before, after = " ".join(words[at:cut]), " ".join(words[cut : cut + 20])
        span = (email, ip, card, phone)[i % 4](r, pick)
        out.append((f"{before} {span}{pick([' ', ' ', '. ', ', ', '; '])}{after}", i % 4, len(before) + 1, len(before) + 1 + len(span)))
    return out
