"""A character tagger in numpy: bidirectional LSTM emissions, CRF transitions.

Trained by gradient descent on the negative log likelihood of labelled windows
(backpropagation through time; forward and backward recursions of the CRF), with
a share of the emissions' own cross entropy, so that a single character's scores
say how likely its tags are.  Tag 0 is outside, 2k+1 begins a span of kind k and
2k+2 goes on with it; nothing else may come before 2k+2.  The gates are softsigns,
x / (1 + |x|), which cost a fraction of a tanh.  Everything is seeded, so the same
windows give the same weights.
"""

from __future__ import annotations

import numpy as np

CHARS = 130  # ASCII, one code for all else, one for padding
OTHER, PAD = 128, 129
#: Share of the emissions' cross entropy in the loss, and the score of a transition that can't be.
OWN_SHARE, NEVER = 0.1, -1e4


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, OTHER).astype(np.int16)


def _soft(x):
    return x / (1 + np.abs(x))


def _slope(y):
    """The derivative of _soft where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


class CharTagger:
    """``tags`` tag 0 is outside; inside a batch all windows have one length."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 10, seed: int = 5):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.tags, self.hidden = tags, hidden
        self.p = {"emb": 0.5 * r.standard_normal((CHARS, embed)).astype(np.float32), "out": w(2 * hidden, tags), "bias": np.zeros(tags, np.float32)}
        self.p |= {"trans": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1
            self.p |= {f"wx{d}": w(embed, 4 * hidden), f"wh{d}": w(hidden, 4 * hidden), f"b{d}": b}

    def _moves(self, dtype=np.float32) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the first tag and of each transition."""
        tag = np.arange(self.tags)
        inner = (tag > 0) & (tag % 2 == 0)
        ok = ~inner[None, :] | (tag[None, :] == tag[:, None]) | (tag[None, :] == tag[:, None] + 1)
        return self.p["first"].astype(dtype), np.where(ok, self.p["trans"], NEVER).astype(dtype)

    def _both(self, name: str) -> np.ndarray:
        return np.stack((self.p[f"{name}f"], self.p[f"{name}b"]))

    def _lstm(self, x, keep):
        """Hidden states (n, steps, 2 * hidden) of both directions, run side by side: one reads each window backwards."""
        n, steps, size = len(x), x.shape[1], self.hidden
        seq = np.ascontiguousarray(np.stack((x, x[:, ::-1])).transpose(0, 2, 1, 3)).reshape(2, steps * n, -1)
        pre = (seq @ self._both("wx") + self._both("b")[:, None]).reshape(2, steps, n, 4 * size)
        wh = self._both("wh")
        h, c, out, tape = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32), np.empty((2, steps, n, size), np.float32), []
        for t in range(steps):
            z = pre[:, t] + h @ wh
            z = _soft(z)
            g = z[..., 2 * size : 3 * size]
            i, f, o = 0.5 * z[..., :size] + 0.5, 0.5 * z[..., size : 2 * size] + 0.5, 0.5 * z[..., 3 * size :] + 0.5
            old_h, old_c = h, c
            c = f * c + i * g
            tc = _soft(c)
            h = o * tc
            out[:, t] = h
            if keep:
                tape.append((i, f, g, o, tc, old_h, old_c))
        out = out.transpose(0, 2, 1, 3)
        return np.concatenate((out[0], out[1, :, ::-1]), 2), (seq, tape)

    def _lstm_back(self, dout, kept, grad):
        """Gradient of the inputs; adds that of the weights to ``grad``."""
        (seq, tape), (n, steps, _), size = kept, dout.shape, self.hidden
        back, wx = self._both("wh").transpose(0, 2, 1), self._both("wx")
        dout = np.stack((dout[..., :size], dout[:, ::-1, size:])).transpose(0, 2, 1, 3)
        dz = np.empty((2, steps, n, 4 * size), np.float32)
        dh, dc = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, g, o, tc, _, old_c = tape[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * _slope(tc)
            now = dz[:, t]
            gate = lambda y: 0.5 * _slope(2 * y - 1)
            now[..., :size], now[..., size : 2 * size] = dc * g * gate(i), dc * old_c * gate(f)
            now[..., 2 * size : 3 * size], now[..., 3 * size :] = dc * i * _slope(g), dh * tc * gate(o)
            dh, dc = now @ back, dc * f
        flat = dz.reshape(2, steps * n, 4 * size)
        before = np.stack([x[5] for x in tape], 1).reshape(2, steps * n, size)
        dwx, dwh, db = seq.transpose(0, 2, 1) @ flat, before.transpose(0, 2, 1) @ flat, flat.sum(1)
        for k, d in enumerate("fb"):
            grad[f"wx{d}"] += dwx[k]
            grad[f"wh{d}"] += dwh[k]
            grad[f"b{d}"] += db[k]
        dx = (flat @ wx.transpose(0, 2, 1)).reshape(2, steps, n, -1).transpose(0, 2, 1, 3)
        return dx[0] + dx[1, :, ::-1]

    def planes(self, ids: np.ndarray) -> np.ndarray:
        """(length, tags, windows) scores of each character's tag.

        The same network as in training, without its tape, and with the
        windows side by side in memory.
        """
        (n, steps), size, p = ids.shape, self.hidden, self.p
        x = np.ascontiguousarray(p["emb"][ids].transpose(1, 2, 0))
        wide = x.shape[1]
        out = np.empty((2, steps, size, n), np.float32)
        one, half = np.float32(1), np.float32(0.5)
        for d, name in enumerate("fb"):
            weights = np.concatenate((p[f"wx{name}"], p[f"wh{name}"], p[f"b{name}"][None])).T.astype(np.float32)
            held = np.zeros((wide + size + 1, n), np.float32)  # a character, the last output, 1
            held[-1] = 1
            h, c, z, y = held[wide : wide + size], np.zeros((size, n), np.float32), np.empty((4 * size, n), np.float32), np.empty((4 * size, n), np.float32)
            i, f, g, o = (z[k * size : (k + 1) * size] for k in range(4))
            soft = y[:size]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                held[:wide] = x[t]
                np.matmul(weights, held, out=z)
                np.abs(z, out=y)
                y += one
                z /= y
                f += one
                i += one
                c *= f
                i *= g
                c += i
                c *= half
                np.abs(c, out=soft)
                soft += one
                np.divide(c, soft, out=soft)
                o += one
                o *= half
                np.multiply(o, soft, out=h)
                out[d, t] = h
        scores = np.matmul(p["out"][:size].T, out[0])
        scores += np.matmul(p["out"][size:].T, out[1])
        scores += p["bias"][:, None]
        return scores

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(windows, length, tags) scores of each character's tag."""
        return self.planes(ids).transpose(2, 0, 1)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences, and its gradient.

        The CRF's forward and backward sums are of probabilities, scaled to 1
        at each step; the logarithms of the scales add up to the partition sum.
        """
        p, n, steps = self.p, len(ids), ids.shape[1]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        x = p["emb"][ids]
        h, kept = self._lstm(x, True)
        e = (h @ p["out"] + p["bias"]).astype(np.float64)
        first, trans = self._moves(np.float64)
        top = e.max(2, keepdims=True)
        q, go = np.exp(e - top), np.exp(trans)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, steps, 1))
        for t in range(steps):
            a = (alpha[:, t - 1] @ go if t else np.exp(first)) * q[:, t]
            scale[:, t] = a.sum(1, keepdims=True)
            alpha[:, t] = a / scale[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = (q[:, t + 1] * beta[:, t + 1] / scale[:, t + 1]) @ go.T
        z = (np.log(scale) + top).sum((1, 2))
        rows = np.arange(n)
        gold = first[tags[:, 0]] + e[rows[:, None], np.arange(steps), tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        de = alpha * beta
        grad["first"] += (de[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=self.tags)) / n
        pair = go * (alpha[:, :-1].reshape(-1, self.tags).T @ (q * beta / scale)[:, 1:].reshape(-1, self.tags))
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1)
        grad["trans"] += pair / n
        own = q / q.sum(2, keepdims=True)
        own_loss = -np.log(own[rows[:, None], np.arange(steps), tags]).sum(1)
        de += OWN_SHARE * own
        de[rows[:, None], np.arange(steps), tags] -= 1 + OWN_SHARE
        de = (de / n).astype(np.float32)
        grad["out"] += h.reshape(-1, h.shape[2]).T @ de.reshape(-1, self.tags)
        grad["bias"] += de.sum((0, 1))
        np.add.at(grad["emb"], ids, self._lstm_back(de @ p["out"].T, kept, grad))
        return float((z - gold + OWN_SHARE * own_loss).mean()), grad

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, losses, step = np.random.default_rng(11), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, held = r.permutation(len(ids)), []
            for a in range(0, len(ids), batch):
                own = order[a : a + batch]
                loss, grad = self.loss(ids[own], tags[own])
                held.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                now = rate * (1 - 0.9 * step / total) * min(1.0, 5.0 / max(norm, 1e-9)) / 1.0
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(held)))
        return losses

    @staticmethod
    def _side_by_side(emissions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequences one after the other, longest first: order, lengths, where each begins, all scores, and how many are longer than t."""
        lengths = np.array([len(e) for e in emissions])
        order = np.argsort(-lengths, kind="stable")
        held = lengths[order]
        begin = np.concatenate(([0], np.cumsum(held)[:-1]))
        return order, held, begin, np.concatenate([emissions[i] for i in order]), np.searchsorted(-held, -np.arange(held[0]), "left")

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence under each (length, tags) array; lengths may differ and are all at least 1.

        Sequences go side by side, longest first: at each step those that are
        long enough are the first ones.  Memory is that of the characters.
        """
        if not emissions:
            return []
        order, held, begin, flat, alive = self._side_by_side(emissions)
        first, trans = self._moves()
        score, back = first + flat[begin], []
        last = np.zeros(len(order), np.int8)
        for t in range(1, held[0]):
            n = alive[t]
            last[n : len(score)] = score[n:].argmax(1)
            whole = score[:n, :, None] + trans
            back.append(whole.argmax(1).astype(np.int8))
            score = whole.max(1) + flat[begin[:n] + t]
        last[: len(score)] = score.argmax(1)
        tags = np.empty(len(flat), np.int8)
        tags[begin + held - 1] = last
        for t in range(held[0] - 1, 0, -1):
            n = alive[t]
            at = begin[:n] + t
            tags[at - 1] = back[t - 1][np.arange(n), tags[at]]
        out: list[np.ndarray] = [tags[:0]] * len(order)
        for i, a, n in zip(order, begin, held, strict=True):
            out[i] = tags[a : a + n]
        return out

    def gains(self, planes: np.ndarray) -> np.ndarray:
        """(windows, length): the most that a character can add to a run of tags other than 0, against tag 0.

        ``planes`` are (length, tags, windows) scores.  What averaged scores
        can add is never more than the largest of what each can add.
        """
        _, trans = self._moves()
        best, still = None, trans[0, 0]
        for b in range(1, self.tags, 2):
            on = planes[:, b + 1] + trans[b + 1, b + 1]
            new = planes[:, b] + max(trans[b, b + 1] - trans[b + 1, b + 1], 0) + max((trans[1:, b] - still).max(), 0) + still
            on = np.maximum(on, new, out=on)
            best = on if best is None else np.maximum(best, on, out=best)
        best -= planes[:, 0] + still
        return np.ascontiguousarray(best.T)

    def may_be_inside(self, gain: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which characters the best tag sequence can have inside a span, of texts one after the other; all others are outside in it.

        ``gain`` has a place after each text that is not read.  A run of tags
        other than 0 is worth no more, against tag 0 throughout, than the sum of
        its gains less what going in and out costs.  Only characters in a run
        of positive worth are left.
        """
        first, trans = self._moves(np.float64)
        still, ends = trans[0, 0], np.cumsum(lengths + 1)
        starts, gain = ends - lengths - 1, gain.astype(np.float64) + 1e-3
        enter, leave = trans[0, 1::2].max() - still, trans[1:, 0].max() - still
        gain[starts] += max(0.0, (first[1:] - first[0]).max() - enter)
        gain[np.maximum(ends - 2, starts)] += max(0.0, -leave)
        gain[ends - 1] = -1e7  # between two texts
        total = np.concatenate(([0.0], np.cumsum(gain)))
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        return most > -(enter + leave)

    def posteriors(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """(length, tags) probability of each character's tag, under all tag sequences, for each array of scores."""
        if not emissions:
            return []
        order, held, begin, flat, alive = self._side_by_side(emissions)
        flat = flat.astype(np.float64)
        first, trans = self._moves(np.float64)
        q, go = np.exp(flat - flat.max(1, keepdims=True)), np.exp(trans)
        alpha, beta = np.empty_like(q), np.ones_like(q)
        alpha[begin] = np.exp(first) * q[begin]
        for t in range(held[0]):
            at = begin[: alive[t]] + t
            if t:
                alpha[at] = (alpha[at - 1] @ go) * q[at]
            alpha[at] /= alpha[at].sum(1, keepdims=True)
        for t in range(held[0] - 1, 0, -1):
            at = begin[: alive[t]] + t
            b = (q[at] * beta[at]) @ go.T
            beta[at - 1] = b / b.sum(1, keepdims=True)
        both = alpha * beta
        both /= both.sum(1, keepdims=True)
        out: list[np.ndarray] = [both[:0]] * len(order)
        for i, a, n in zip(order, begin, held, strict=True):
            out[i] = both[a : a + n]
        return out
