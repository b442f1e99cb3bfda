"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, trained in numpy.

Each word is a step. Its inputs are learnt vectors of the word and of its characters (the mean over its first 3 to 6 characters and
all runs of 4), trained with the network, beside statistics of the training documents: how much likelier toxic ones hold the word and
its runs of characters, shrunk to 0 by a prior, at their most and on average. Words and runs are hashed into tables of a
fixed size, so none is dropped and the model's size doesn't depend on the data; learnt vectors start at 0 and move only for
what SEEN training documents hold, so what training hardly saw adds nothing. A token without white space above LONG characters makes several steps: its words between marks, and slices of LONG
characters that overlap by half, so none of it goes unread. Two gated recurrent layers read a window of WIDTH words forwards and backwards, attention pools their states, and
a logistic unit scores the window. Windows overlap by half and cover the whole text; a document's score is
its highest window's. The network is trained on one window of each training document, the one that it scores highest itself, so it
finds out which window earned the label.

Training uses at most POSITIVE + NEGATIVE labelled rows of the training folds, chosen by hash of the id, and of these skips
texts above LONGEST characters; a task of an executor trains, and the driver gets the model, whose size is fixed. Statistics come from half of them, the network from the other half, then the
roles are swapped for the statistics only; every CHECKth document is left out of the network's training, and on these a logistic curve
is fitted that makes a probability of a score. Scoring reads every text whole; a worker keeps the inputs of at most WORDS distinct words and
starts over beyond, which costs time only. A null or empty text gets the score of a window without
words. Labels, language, source and id are no inputs. Rows with repeated ids are scored one by one; a repeated label counts as toxic if any is.
"""

from __future__ import annotations

import math
import pickle
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, share, sliced

POSITIVE, NEGATIVE, LONGEST = 2500, 5000, 20_000
FOLDS, WIDTH, STRIDE, HIDDEN, ATTEND = 5, 24, 12, 8, 8
ODDS, LEARNT = 6, 6  # inputs: statistics, and the length of each of the two learnt vectors
INPUTS = ODDS + 2 * LEARNT
TABLE, ROWS, WORDS = 1 << 18, 1 << 15, 120_000  # places of the hashed statistics, rows of each table of learnt vectors
RUN, STARTS = 4, (3, 4, 5, 6)
CORE = re.compile(r"^[\W_]+|[\W_]+$")
LONG, INNER = 32, "\x1f"  # longest token that is one step; what marks a slice from inside a token: no token holds it
PART = re.compile(r"[^\W_]+")
RATE, SLOW, DECAY, OMIT, CHECK, SEEN = 0.01, 0.03, 1e-4, 0.5, 5, 50


def held_out(key: str) -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS; such labels are never trained on."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def steps(text: str) -> list[str]:
    """The steps of a text: its tokens in lower case, and slices and words of the long ones as they stand."""
    tokens = text.lower().split()
    if max(map(len, tokens), default=0) <= LONG:
        return tokens
    return [step for token in tokens for step in ([token] if len(token) <= LONG else parts(token))]


def parts(token: str) -> list[str]:
    half = LONG // 2
    slices = [(i, 0, (INNER if i else "") + token[i : i + LONG]) for i in range(0, len(token) - half, half)]
    words = [(m.start(), 1, m.group()) for m in PART.finditer(token) if len(m.group()) <= LONG]
    return [step for _, _, step in sorted(slices + words)]


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Steps:
    """Steps as hashed features, all at once: of each the word, and its pieces: runs of RUN characters anywhere and, unless it
    begins inside a token, its first STARTS characters. Features are places in a table of TABLE."""

    def __init__(self, words: list[str]):
        import numpy as np

        parts = [self.features(words[i : i + (1 << 15)]) for i in range(0, max(len(words), 1), 1 << 15)]
        self.worded, self.word, self.flat, self.count = (np.concatenate(x) for x in zip(*parts))
        self.start = np.cumsum(self.count) - self.count

    @staticmethod
    def features(words: list[str]):
        import numpy as np

        cores = [CORE.sub("", w) for w in words]
        size = np.array([len(c) for c in cores], "int64")
        first = np.cumsum(size) - size
        inner = np.array([w.startswith(INNER) for w in words], bool)
        code = mixed(np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64") + np.uint64(1))
        power = np.cumprod(np.full(int(size.max(initial=8)) + 1, 0x9E3779B97F4A7C15, "uint64"), dtype="uint64")
        step = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(code)) - first[step]

        def hashed(start, n: int, salt: int):
            return (mixed(sum(code[start + i] * power[i] for i in range(n)) + np.uint64(salt)) % np.uint64(TABLE)).astype("int32")

        # a slice from inside a token, or a step of marks alone, is no word
        some, word = size > 0, np.zeros(len(words), "int32")
        if some.any():
            word[some] = mixed(np.add.reduceat(code * power[at], first[some])) % np.uint64(TABLE)
        spots = np.flatnonzero(at + RUN <= size[step])
        owner, value = [step[spots]], [hashed(spots, RUN, 0)]
        for n in STARTS:
            own = np.flatnonzero((size >= n) & ~inner)
            owner.append(own)
            value.append(hashed(first[own], n, n))
        owner, value = np.concatenate(owner), np.concatenate(value)
        return some & ~inner, word, value[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def runs(self, idx):
        """The pieces of the steps idx as one array, and how many each has."""
        import numpy as np

        count = self.count[idx]
        first = np.cumsum(count) - count
        return self.flat[np.repeat(self.start[idx] - first, count) + np.arange(count.sum())], count


class Inputs:
    """Hashed log-odds of words and of character pieces, from documents and their labels."""

    def __init__(self, known: Steps, held: list, marks: list[int]):
        """held: the numbers of each document's distinct steps in known."""
        import numpy as np

        words, chars = np.zeros((2, TABLE)), np.zeros((2, TABLE))
        for idx, mark in zip(held, marks):
            words[mark, np.unique(known.word[idx[known.worded[idx]]])] += 1
            chars[mark, np.unique(known.runs(idx)[0])] += 1
        rate = (sum(marks) + 0.5) / (len(marks) + 1)
        self.words, self.chars = self.odds(words, rate), self.odds(chars, rate)

    @staticmethod
    def odds(counts, rate: float, prior: float = 6.0):
        """0 for what fewer than three toxic documents hold or what says little."""
        import numpy as np

        clean, toxic = counts
        out = np.log((toxic + prior * rate) / (clean + prior * (1 - rate)) * (1 - rate) / rate)
        return np.where((toxic >= 3) & (out > 0.7), out, 0.0).astype("float32")

    def vectors(self, known: Steps):
        """The statistics of all steps: the word's, its pieces' at their most, mean of three and mean, a strong sign, and 1."""
        import numpy as np

        n = len(known.word)
        out = np.zeros((n, ODDS), "float32")
        out[:, 0] = np.where(known.worded, self.words[known.word], 0)
        own, segment = self.chars[known.flat], np.repeat(np.arange(n), known.count)
        order = np.lexsort((-own, segment))
        own = own[order]  # segments stay where they are
        rank = np.arange(len(own)) - np.repeat(known.start, known.count)
        out[segment[rank == 0], 1] = own[rank == 0]  # all are at least 0
        out[:, 2] = np.bincount(segment[rank < 3], own[rank < 3], n) / 3
        out[:, 3] = np.bincount(segment, own, n) / np.maximum(known.count, 1)
        out[:, 4], out[:, 5] = out[:, 1] > 2, 1.0
        return out


class Network:
    """Learnt vectors of words and pieces, two directions of gated recurrence, attention, one output; weights are plain arrays."""

    def __init__(self, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        new = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype("float32")
        h = HIDDEN
        self.p = {"A": new(2 * h, ATTEND), "c": np.zeros(ATTEND, "float32"), "v": new(ATTEND, 1)[:, 0], "w": new(2 * h, 1)[:, 0], "o": np.zeros(1, "float32")}
        self.p |= {"word": np.zeros((ROWS, LEARNT), "float32"), "char": np.zeros((ROWS, LEARNT), "float32")}
        for d in "fb":
            self.p |= {f"W{d}": new(INPUTS, 3 * h), f"U{d}": new(h, 3 * h), f"b{d}": np.zeros(3 * h, "float32")}

    def inputs(self, odds, known: Steps, idx):
        """The whole input vectors of the steps idx."""
        import numpy as np

        flat, count = known.runs(idx)
        chars = np.zeros((len(idx), LEARNT), "float32")
        some = count > 0
        if some.any():
            chars[some] = np.add.reduceat(self.p["char"][flat % ROWS], (np.cumsum(count) - count)[some], 0) / count[some, None]
        return np.concatenate([odds[idx], self.p["word"][known.word[idx] % ROWS] * known.worded[idx, None], chars], 1)

    def learn(self, known: Steps, idx, slope):
        """Gradients of the two tables from those of the input vectors of the steps idx."""
        import numpy as np

        out = {}
        flat, count = known.runs(idx)
        word, char = slope[:, ODDS : ODDS + LEARNT] * known.worded[idx, None], slope[:, ODDS + LEARNT :] / np.maximum(count, 1)[:, None]
        for name, at, part in (("word", known.word[idx] % ROWS, word), ("char", flat % ROWS, np.repeat(char, count, 0))):
            out[name] = np.stack([np.bincount(at, part[:, i], ROWS) for i in range(LEARNT)], 1).astype("float32")
        return out

    def gates(self, vectors):
        """What the inputs add to the gates of both directions, for a table of words."""
        import numpy as np

        return np.concatenate([vectors @ self.p["Wf"] + self.p["bf"], vectors @ self.p["Wb"] + self.p["bb"]], 1).astype("float32")

    def recur(self, d: str, g, mask, keep: bool):
        """States of one direction: g (batch, steps, 3h) are the inputs' parts of the gates."""
        import numpy as np

        u, h = self.p[f"U{d}"], HIDDEN
        batch, steps = mask.shape
        state, states, saved = np.zeros((batch, h), "float32"), np.empty((batch, steps, h), "float32"), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = state @ u
            zr = 1 / (1 + np.exp(-(g[:, t, : 2 * h] + a[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, t, 2 * h :] + r * a[:, 2 * h :])
            m = mask[:, t : t + 1]
            fresh = state + m * (1 - z) * (n - state)
            if keep:
                saved.append((t, state, z, r, n, a[:, 2 * h :]))
            state = fresh
            states[:, t] = state
        return states, saved

    def forward(self, gates, mask, keep: bool = False):
        """Logits of windows."""
        import numpy as np

        h, p = 3 * HIDDEN, self.p
        f, sf = self.recur("f", gates[:, :, :h], mask, keep)
        b, sb = self.recur("b", gates[:, :, h:], mask, keep)
        states = np.concatenate([f, b], 2)
        e = np.tanh(states @ p["A"] + p["c"])
        s = np.where(mask > 0, e @ p["v"], -1e9)
        s = np.exp(s - s.max(1, keepdims=True)) * mask
        alpha = s / np.maximum(s.sum(1, keepdims=True), 1e-9)
        pooled = (alpha[:, :, None] * states).sum(1)
        logit = pooled @ p["w"] + p["o"][0]
        return (logit, (states, e, alpha, pooled, sf, sb)) if keep else logit

    def backward(self, x, mask, made, miss):
        """Gradients for the loss's derivative `miss` by the logits, that of x, the input vectors, among them."""
        import numpy as np

        p, h = self.p, HIDDEN
        states, e, alpha, pooled, sf, sb = made
        g = {"w": pooled.T @ miss, "o": miss.sum(keepdims=True)}
        dpool = miss[:, None] * p["w"]
        dalpha = (states * dpool[:, None, :]).sum(2)
        ds = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        g["v"] = (e * ds[:, :, None]).sum((0, 1))
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = np.einsum("bti,btj->ij", states, de)
        g["c"] = de.sum((0, 1))
        g["x"] = np.zeros_like(x)
        dstates = alpha[:, :, None] * dpool[:, None, :] + de @ p["A"].T
        for d, saved, part in (("f", sf, slice(0, h)), ("b", sb, slice(h, 2 * h))):
            u = p[f"U{d}"]
            gu, gw, gb = np.zeros_like(u), np.zeros_like(p[f"W{d}"]), np.zeros_like(p[f"b{d}"])
            carry = np.zeros((len(miss), h), "float32")
            for t, before, z, r, n, an in reversed(saved):
                m = mask[:, t : t + 1]
                out = carry + dstates[:, t, part]
                dn = out * m * (1 - z) * (1 - n * n)
                dz = -out * m * (n - before) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                dg = np.concatenate([dz, dr, dn], 1)
                gu += before.T @ da
                gw += x[:, t].T @ dg
                g["x"][:, t] += dg @ p[f"W{d}"].T
                gb += dg.sum(0)
                carry = out * (1 - m * (1 - z)) + da @ u.T
            g |= {f"U{d}": gu, f"W{d}": gw, f"b{d}": gb}
        return g


def numbered(texts: list[str], ids: dict[str, int]):
    """The steps of all texts as one line of numbers, and how many each text has; new steps get the next numbers in ids."""
    import numpy as np

    lines = [np.fromiter((ids.setdefault(w, len(ids)) for w in steps(t)), "int32") for t in texts]
    return np.concatenate([*lines, np.empty(0, "int32")]), np.array([len(line) for line in lines], "int64")


class Scorer:
    """Turns texts into windows of word numbers and scores them; the table of words is of bounded size."""

    def __init__(self, inputs: Inputs, network: Network, steep: float = 1.0, shift: float = 0.0):
        self.inputs, self.network, self.steep, self.shift = inputs, network, steep, shift
        self.reset()

    def reset(self) -> None:
        import numpy as np

        self.ids: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), "float32")

    def numbers(self, texts: list[str]):
        """Numbers of all words, and how many each text has."""
        import numpy as np

        if len(self.ids) > WORDS:
            self.reset()
        had = len(self.ids)
        line, counts = numbered(texts, self.ids)
        if len(self.ids) > had:
            known = Steps(list(self.ids)[had:])
            while len(self.table) < len(self.ids):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[had : len(self.ids)] = self.network.gates(self.network.inputs(self.inputs.vectors(known), known, np.arange(len(known.word))))
        return line, counts

    def refresh(self) -> None:
        """In training: the gates of all words (known, with their statistics odds) under the network's present weights."""
        import numpy as np

        n = len(self.odds)
        self.table = np.empty((max(n, 1), 6 * HIDDEN), "float32")
        for i in range(0, n, 1 << 14):
            idx = np.arange(i, min(i + (1 << 14), n))
            self.table[idx] = self.network.gates(self.network.inputs(self.odds, self.known, idx))

    def windows(self, counts):
        """Starts and ends of all windows in the line of all words, and each one's text."""
        import numpy as np

        many = np.maximum(1, -(-(counts - WIDTH) // STRIDE) + 1)
        text = np.repeat(np.arange(len(counts)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        first = np.cumsum(counts) - counts
        return first[text] + nth * STRIDE, (first + counts)[text], text

    def gather(self, line, starts, ends):
        import numpy as np

        at = starts[:, None] + np.arange(WIDTH)
        mask = (at < ends[:, None]).astype("float32")
        ids = np.append(line, 0)[np.minimum(at, len(line))]
        return ids, mask

    def by_parts(self, worth, line, starts, ends):
        """worth(ids, mask) of all windows, some at a time."""
        import numpy as np

        out = np.empty(len(starts), "float32")
        for i in range(0, len(starts), 2048):
            out[i : i + 2048] = worth(*self.gather(line, starts[i : i + 2048], ends[i : i + 2048]))
        return out

    def logits(self, line, starts, ends):
        return self.by_parts(lambda ids, mask: self.network.forward(self.table[ids], mask), line, starts, ends)

    def score(self, texts: list[str]):
        import numpy as np

        if not texts:
            return np.empty(0)
        line, counts = self.numbers(texts)
        starts, ends, text = self.windows(counts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, self.logits(line, starts, ends))
        return 1 / (1 + np.exp(-np.clip(best * self.steep + self.shift, -30, 30).astype("float64")))


def fit(texts: list[str], marks: list[int], rounds: int = 12, seed: int = 5) -> Scorer:
    """A scorer from labelled texts, the same for the same rows."""
    import numpy as np

    network, rng = Network(seed), np.random.default_rng(seed)
    half = [i % 2 for i in range(len(texts))]
    sides = [[i for i in range(len(texts)) if half[i] == s] for s in (0, 1)]
    pick = lambda xs, idx: [xs[i] for i in idx]
    ids: dict[str, int] = {}
    every, many = numbered(texts, ids)
    known, own = Steps(list(ids)), np.split(every, np.cumsum(many)[:-1]) if texts else []
    held = [np.unique(x) for x in own]
    # each half is read with the statistics of the other: no document's own label is in its statistics
    parts = []
    for s in (0, 1):
        scorer = Scorer(Inputs(known, pick(held, sides[1 - s]), pick(marks, sides[1 - s])), network)
        scorer.known, scorer.odds = known, scorer.inputs.vectors(known)
        if len(ids) and sides[s]:
            counts = many[sides[s]]
            parts.append((scorer, np.concatenate(pick(own, sides[s])), *scorer.windows(counts), np.array(pick(marks, sides[s]), "float32")))
    # learnt vectors are for what SEEN documents hold: rarer things could only be learnt by heart
    often = {"word": np.zeros(ROWS, "float32"), "char": np.zeros(ROWS, "float32")}
    for idx in held:
        often["word"][np.unique(known.word[idx[known.worded[idx]]] % ROWS)] += 1
        often["char"][np.unique(known.runs(idx)[0] % ROWS)] += 1
    often = {name: (n >= SEEN).astype("float32")[:, None] for name, n in often.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    rows = []
    for k in range(rounds):
        if k % 2 == 0:  # which window stands for its document is asked anew every other round
            rows = []
            for which, (scorer, line, starts, ends, text, mark) in enumerate(parts):
                if k == 0:  # before the network can tell: the window whose words speak most
                    strength = scorer.odds[:, :2].max(1)
                    worth = scorer.by_parts(lambda ids, mask: (strength[ids] * mask).max(1), line, starts, ends)
                else:
                    scorer.refresh()
                    worth = scorer.logits(line, starts, ends)
                    scorer.reset()
                order = np.lexsort((-worth, text))
                heads = order[np.r_[True, text[order][1:] != text[order][:-1]]]
                ids, mask = scorer.gather(line, starts[heads], ends[heads])
                # every CHECKth document is left for the curve at the end
                rows += [(which, i, m, y) for n, i, m, y in zip(text[heads], ids, mask, mark[text[heads]]) if n % CHECK]
        for _ in range(3):
            turn = rng.permutation(len(rows))
            for i in range(0, len(rows), 128):
                batch = sorted((rows[j] for j in turn[i : i + 128]), key=lambda r: r[0])
                mask, y = np.stack([r[2] for r in batch]), np.array([r[3] for r in batch], "float32")
                made_of, vectors, back, base = [], [], [], 0
                for which in sorted({r[0] for r in batch}):
                    scorer = parts[which][0]
                    own, inverse = np.unique(np.stack([r[1] for r in batch if r[0] == which]), return_inverse=True)
                    made_of.append((scorer, own, base))
                    vectors.append(network.inputs(scorer.odds, scorer.known, own))
                    # learnt vectors are left out at random: the network has to do without them too
                    vectors[-1][:, ODDS:] *= (rng.random((len(own), 1)) >= OMIT).astype("float32")
                    back.append(inverse.reshape(-1, WIDTH) + base)
                    base += len(own)
                vectors, back = np.concatenate(vectors), np.concatenate(back)
                x = vectors[back]
                logit, made = network.forward(network.gates(vectors)[back], mask, keep=True)
                miss = ((1 / (1 + np.exp(-logit)) - y) / len(batch)).astype("float32")
                grads, step = network.backward(x, mask, made, miss), step + 1
                slope, flat = grads.pop("x").reshape(-1, INPUTS), back.reshape(-1)
                slope = np.stack([np.bincount(flat, slope[:, c], base) for c in range(INPUTS)], 1)
                tables = [network.learn(scorer.known, own, slope[at : at + len(own)]) for scorer, own, at in made_of]
                grads |= {name: sum(t[name] for t in tables) * often[name] for name in ("word", "char")}
                for name, g in grads.items():
                    a, b = moment[name]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    fix = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    rate = RATE * SLOW if name in ("word", "char") else RATE
                    if name in ("word", "char"):
                        network.p[name] *= 1 - DECAY
                    network.p[name] -= (rate * fix * a / (np.sqrt(b) + 1e-8)).astype("float32")
    # what makes a probability of a score is fitted to the documents left out: the network never saw their labels
    logits, truth = [np.empty(0)], [np.empty(0)]
    for scorer, line, starts, ends, text, mark in parts:
        scorer.refresh()
        best = np.full(len(mark), -np.inf)
        np.maximum.at(best, text, scorer.logits(line, starts, ends))
        logits.append(best[::CHECK])
        truth.append(mark[::CHECK])
    return Scorer(Inputs(known, held, marks), network, *calibrated(np.concatenate(logits), np.concatenate(truth)))


def calibrated(score, truth, rounds: int = 50) -> tuple[float, float]:
    """Slope (above 0) and shift of the logistic curve of truth by score; 1 and 0 where there is but one class."""
    import numpy as np

    if len(truth) == 0 or truth.min() == truth.max():
        return 1.0, 0.0
    spread = max(float(score.std()), 1e-6)
    x = np.stack([score / spread, np.ones(len(score))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):  # Newton's steps, with a prior that keeps the curve from growing steep without end
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (truth - p) - 0.01 * w
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope), -2, 2)
    return max(float(w[0]), 1e-3) / spread, float(w[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", mark: str = "toxic") -> Scorer:
    """A scorer learnt from a bounded sample of labelled rows outside the held-out fold."""
    own = labels.filter(F.col(key).isNotNull() & F.col(mark).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(mark).alias("_mark"))
    order = [F.xxhash64(F.lit("toxicity"), F.col(key)), F.col(key)]
    some = lambda value, n: own.filter(F.col("_mark") == value).orderBy(*order).limit(n)
    chosen = F.broadcast(some(1, POSITIVE).union(some(0, NEGATIVE)))  # POSITIVE + NEGATIVE rows at most
    rows = docs.select(key, "text").join(chosen, key).filter(F.char_length(F.coalesce("text", F.lit(""))) <= LONGEST)
    rows = rows.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("_mark").cast("int").alias("mark"))

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        parts = [batch.to_pandas() for batch in batches]
        if parts:
            got = pd.concat(parts).sort_values(["key", "text"], kind="stable")
            model = fit(got["text"].tolist(), got["mark"].tolist())
            made = pickle.dumps((model.inputs, model.network, model.steep, model.shift))
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["model"])

    # the sample is bounded, so one task holds it, and the driver the model only
    made = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return Scorer(*pickle.loads(made[0]["model"])) if made else fit([], [])


def score(df: DataFrame, model: Scorer, text: str = "text") -> DataFrame:
    """Adds score (0 to 1); an own column of that name is replaced. The broadcast model is of a fixed size: two tables of TABLE, two of ROWS."""
    import pyarrow as pa

    shared = share(df.sparkSession, (model.inputs, model.network, model.steep, model.shift))
    kept = [c for c in df.columns if c != "score"]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]

    def run(batches):
        scorer = Scorer(*shared.value)  # this task's own words
        for batch in sliced(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [scorer.score(texts[i : i + 64]) for i in range(0, len(texts), 64)]
            flat = [float(x) for part in found for x in part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.float64())], [*batch.schema.names, "score"])

    return df.select(*kept).mapInArrow(lean(run), ", ".join([*schema, "score double"]))
