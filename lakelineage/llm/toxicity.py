"""Toxicity of a text, by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Each word enters as the sum of a word embedding and the mean embedding of its character n-grams, so that unseen forms
of a word still say something. Only words and n-grams of several documents have embeddings; they start
from how much those documents' labels say, so that a small sample isn't learned by heart. Two gated recurrent layers read a window of words from either end, attention pools
their states, and a logistic unit scores the window. A text's score is that of its highest window; windows overlap.
A run of over LONGEST characters without white space enters as several words, which overlap.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.sampling import held_out, labelled_sample

WINDOW, STRIDE = 40, 30  # words
BUCKETS = 1 << 20  # of the hashes of words and of character n-grams
LEAST_DOCS = 3  # documents of the sample that a word or n-gram is in, to have an embedding; what few have is learned by heart
GRAMS = (3, 4, 5, 6)  # characters, with marks at both ends of the word
LONGEST = 40  # characters of a word
FIRST = 0.3  # of how much a feature says, as the first value of its embedding
DEPTH, STATE = 16, 12
TRAIN_PER_LABEL = 2000  # documents of each label that the network is trained on (about)
WINDOWS_PER_DOC = 12  # of each of those
THRESHOLD = 0.3
FALSE_ALARM = 2  # misses that a false alarm weighs as much as, where the cut is set
LEAST_CHECKED = 5  # documents of either label for the cut to be set by them
AT_A_TIME = 512  # windows that the driver scores at a time while it trains, so that it needs little memory
CACHE = 16_384  # words whose features a task keeps
TASK_WINDOWS, TASK_WORDS = 256, 2048  # windows that a task scores at a time, and new words whose n-grams it has at a time
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Features:
    """Buckets of words and of their character n-grams, for many words at once.

    ``word``: a bucket each; ``gram``: the buckets of all n-grams, word by word; ``size``: how many each word has.
    """

    def __init__(self, words: list[str]) -> None:
        plain = [EDGES.sub("", w.lower()) for w in words]
        self.word = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in plain), np.int64, len(words)) % BUCKETS
        marked = [f"<{w}>" for w in plain]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, marked), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(chars))  # characters from here to the end of the word
        grams, owners, h = [], [], np.zeros(len(chars), np.uint64)
        for k in range(min(max(GRAMS), len(chars))):
            shifted = np.zeros_like(chars)
            shifted[: len(chars) - k] = chars[k:]
            h = (h ^ (shifted + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in GRAMS:
                fits = left > k
                grams.append((h[fits] >> np.uint64(20)).astype(np.int64) % BUCKETS)
                owners.append(owner[fits])
        of = np.concatenate(owners)
        order = np.argsort(of, kind="stable")
        self.gram, self.size = np.concatenate(grams)[order], np.bincount(of, minlength=len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and both passes. Gates stand in the order update, reset, candidate."""

    def __init__(self, features: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, seed: int = 3) -> None:
        """``features``: buckets of words and n-grams that have an embedding, with its first value; others share row 0, zero."""
        rng = np.random.default_rng(seed)
        f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p, self.row = {}, {}
        for k in ("word", "gram"):
            known, first = (features or {}).get(k, (np.zeros(0, np.int64), np.zeros(0)))
            self.row[k] = np.zeros(BUCKETS, np.int32)
            self.row[k][known] = 1 + np.arange(len(known))
            self.p[k] = np.zeros((len(known) + 1, DEPTH), np.float32)
            self.p[k][1:, 0] = FIRST * first
        self.p |= {"attend": f32(2 * STATE, scale=0.3), "out": f32(2 * STATE, scale=0.3), "bias": np.full(1, -1, np.float32)}
        for d in ("f", "b"):
            self.p |= {f"w{d}": f32(DEPTH, 3 * STATE, scale=0.3), f"u{d}": f32(STATE, 3 * STATE, scale=0.3), f"c{d}": np.zeros(3 * STATE, np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        x = self.p["word"][self.row["word"][f.word]]
        some = f.size > 0
        if some.any():
            rows, first = self.row["gram"][f.gram], (np.cumsum(f.size) - f.size)[some]
            x[some] += np.add.reduceat(self.p["gram"][rows], first) / self.known(f)[some][:, None]
        return x

    def known(self, f: Features) -> np.ndarray:
        """How many n-grams of each word have an embedding, 1 at least."""
        out, some = np.ones(len(f.size), np.float32), f.size > 0
        if some.any():
            out[some] = np.maximum(1, np.add.reduceat((self.row["gram"][f.gram] > 0).astype(np.float32), (np.cumsum(f.size) - f.size)[some]))
        return out

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.p[f"w{d}"] + self.p[f"c{d}"]

    def read(self, g: np.ndarray, d: str, there: np.ndarray) -> tuple[np.ndarray, list]:
        """States of one direction over gate inputs (time x batch x 3 STATE); where a word isn't there, the state stays."""
        u, s = self.p[f"u{d}"], STATE
        steps = range(len(g)) if d == "f" else range(len(g) - 1, -1, -1)
        h = np.zeros((g.shape[1], s), np.float32)
        states, kept = np.empty((len(g), g.shape[1], s), np.float32), []
        for t in steps:
            zr = sigmoid(g[t, :, : 2 * s] + h @ u[:, : 2 * s])
            z, r = zr[:, :s], zr[:, s:]
            c = np.tanh(g[t, :, 2 * s :] + (r * h) @ u[:, 2 * s :])
            new = np.where(there[t][:, None], h + z * (c - h), h)
            kept.append((t, h, z, r, c))
            states[t] = h = new
        return states, kept

    def pool(self, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.where(there, states @ self.p["attend"], -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        return a, pooled, sigmoid(pooled @ self.p["out"] + self.p["bias"])

    def score(self, gf: np.ndarray, gb: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Scores of windows of word ids (batch x WINDOW, -1 where there is none) over the gate inputs of each word."""
        ids = ids.T
        there = ids >= 0
        states = np.concatenate([self.read(gf[ids], "f", there)[0], self.read(gb[ids], "b", there)[0]], 2)
        return self.pool(states, there)[2]

    def backward(self, words: Features, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch; embeddings' gradients are by row: (rows, values)."""
        p, s = self.p, STATE
        x = self.inputs(words)
        ids = ids.T
        there = ids >= 0
        (sf, kf), (sb, kb) = (self.read(self.gates(x, d)[ids], d, there) for d in "fb")
        states = np.concatenate([sf, sb], 2)
        a, pooled, q = self.pool(states, there)
        dz = (q - y) / len(y)
        grads = {"out": pooled.T @ dz, "bias": dz.sum(keepdims=True)}
        dpool = dz[:, None] * p["out"]
        da = (states * dpool).sum(2)
        da = a * (da - (a * da).sum(0))
        grads["attend"] = np.einsum("tb,tbh->h", da, states)
        dstates = a[:, :, None] * dpool + da[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for d, kept, part in (("f", kf, dstates[:, :, :s]), ("b", kb, dstates[:, :, s:])):
            u = p[f"u{d}"]
            du, dg_all = np.zeros_like(u), np.zeros((len(ids), ids.shape[1], 3 * s), np.float32)
            dh = np.zeros((ids.shape[1], s), np.float32)
            for t, h, z, r, c in reversed(kept):
                dh = dh + part[t]
                live = there[t][:, None]
                dnew = np.where(live, dh, 0)
                dc = dnew * z * (1 - c * c)
                dzg = dnew * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * s :].T
                drg = drh * h * r * (1 - r)
                dzr = np.concatenate([dzg, drg], 1)
                du[:, : 2 * s] += h.T @ dzr
                du[:, 2 * s :] += (r * h).T @ dc
                dg_all[t] = np.concatenate([dzr, dc], 1)
                dh = np.where(live, dnew * (1 - z) + drh * r + dzr @ u[:, : 2 * s].T, dh)
            grads[f"u{d}"] = du
            flat, at = dg_all.reshape(-1, 3 * s), ids.reshape(-1)
            gw = np.zeros((len(x), 3 * s), np.float32)
            np.add.at(gw, at[at >= 0], flat[at >= 0])
            grads[f"w{d}"], grads[f"c{d}"] = x.T @ gw, gw.sum(0)
            dx += gw @ p[f"w{d}"].T
        grads["word"] = (self.row["word"][words.word], dx)
        grads["gram"] = (self.row["gram"][words.gram], np.repeat(dx / self.known(words)[:, None], words.size, 0))
        loss = float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())
        return loss, grads


def words_of(text: str) -> list[str]:
    """Words between white space; longer ones in pieces of LONGEST characters, so overlapping that no n-gram is lost."""
    step = LONGEST - max(GRAMS) + 1
    out: list[str] = []
    for w in text.split():
        if len(w) <= LONGEST or len(EDGES.sub("", w)) <= LONGEST:
            out.append(w)
        else:
            out += [w[i : i + LONGEST] for i in range(0, len(w) - max(GRAMS) + 1, step)]
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """First and end word of every window of a text of ``n`` words."""
    return [(i, min(n, i + WINDOW)) for i in range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


def batch_ids(rows: list[list[str]]) -> tuple[list[str], np.ndarray]:
    seen: dict[str, int] = {}
    ids = np.full((len(rows), WINDOW), -1, np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)] = [seen.setdefault(w, len(seen)) for w in r]
    return list(seen), ids


def telling(counts: np.ndarray, toxic: np.ndarray, docs: int, bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that LEAST_DOCS documents have, and how much each says: the signed root of its likelihood ratio, shrunk.

    ``counts`` and ``toxic``: documents and toxic documents that have each bucket. Of many buckets some look telling by
    chance, so the root loses what the largest of so many would have by chance.
    """
    known = np.flatnonzero(counts >= LEAST_DOCS)
    n, k, p = counts[known].astype(float), toxic[known].astype(float), (bad + 0.5) / (docs + 1)
    ratio = k * np.log(np.maximum(k / n, 1e-12) / p) + (n - k) * np.log(np.maximum((n - k) / n, 1e-12) / (1 - p))
    root = np.sqrt(2 * np.maximum(0, ratio))
    return known, np.sign(k / n - p) * np.maximum(0, root - np.sqrt(2 * np.log(len(known) + 1)))


def features_of(bags: list[tuple[list[list[str]], int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of words and of n-grams, what ``telling`` says."""
    counts = {k: np.zeros((2, BUCKETS), np.int32) for k in ("word", "gram")}
    for windows_, y in bags:
        f = Features(sorted({w for ws in windows_ for w in ws}))
        for k, found in (("word", f.word), ("gram", f.gram)):
            counts[k][0][np.unique(found)] += 1
            counts[k][1][np.unique(found)] += y
    return {k: telling(*c, len(bags), sum(y for _, y in bags)) for k, c in counts.items()}


def window_scores(net: Network, bags: list[tuple[list[list[str]], int]]) -> list[np.ndarray]:
    rows, scores = [w for ws, _ in bags for w in ws], []
    for at in range(0, len(rows), AT_A_TIME):
        words, ids = batch_ids(rows[at : at + AT_A_TIME])
        x = net.inputs(Features(words))
        scores.append(net.score(net.gates(x, "f"), net.gates(x, "b"), ids))
    return np.split(np.concatenate(scores), np.cumsum([len(ws) for ws, _ in bags])[:-1])


def offset(scores: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """What to add before the logistic function, so that ``threshold`` is the best cut; a false alarm weighs like FALSE_ALARM misses."""
    if min(y.sum(), (1 - y).sum()) < LEAST_CHECKED:
        return 0.0
    z = np.log(np.clip(scores, 1e-7, 1 - 1e-7))
    z -= np.log1p(-np.clip(scores, 1e-7, 1 - 1e-7))
    order = np.argsort(z)
    missed = np.concatenate(([0], np.cumsum(y[order]))) / y.sum()
    alarms = 1 - np.concatenate(([0], np.cumsum(1 - y[order]))) / (1 - y).sum()
    best = int(np.argmin(missed + FALSE_ALARM * alarms))
    edges = np.concatenate(([z.min()], z[order], [z.max()]))
    return float(np.log(threshold / (1 - threshold)) - (edges[best] + edges[best + 1]) / 2)


def calibrated(bags: list[tuple[list[list[str]], int]], threshold: float) -> Network:
    """A network of all documents; its cut is set by one of four fifths of them on the last fifth."""
    rest, aside = [b for i, b in enumerate(bags) if i % 5 != 4], bags[4::5]
    move = 0.0
    if rest and aside:
        move = offset(np.array([q.max() for q in window_scores(train(rest), aside)]), np.array([y for _, y in aside]), threshold)
    net = train(bags)
    net.p["bias"] += np.float32(move)
    return net


def train(bags: list[tuple[list[list[str]], int]], least_steps: int = 260, batch: int = 64, seed: int = 11) -> Network:
    """``bags``: windows and label of each document. From the second epoch on, a document is its highest window.

    A toxic document need not be toxic all over, so the window that the network already scores highest stands for it;
    for the other documents that is the window most in need of correction.
    """
    rng, net = np.random.default_rng(seed), Network(features_of(bags))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    epochs = max(4, -(-least_steps // -(-len(bags) // batch)))  # few documents are gone through more often
    steps, step = epochs * -(-len(bags) // batch), 0
    for epoch in range(epochs):
        if epoch:
            chosen = [ws[int(np.argmax(q))] for (ws, _), q in zip(bags, window_scores(net, bags), strict=True)]
        else:
            chosen = [ws[rng.integers(len(ws))] for ws, _ in bags]
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick, step = order[at : at + batch], step + 1
            words, ids = batch_ids([chosen[i] for i in pick])
            _, grads = net.backward(Features(words), ids, np.array([bags[i][1] for i in pick], np.float32))
            rate = 0.02 * (1 - step / (steps + 1))
            for k, g in grads.items():
                q, a, b = net.p[k], first[k], second[k]
                if isinstance(g, tuple):  # Adagrad on the rows that the batch has
                    some = g[0] > 0
                    rows_, inverse = np.unique(g[0][some], return_inverse=True)
                    total = np.zeros((len(rows_), DEPTH), np.float32)
                    np.add.at(total, inverse, g[1][some])
                    b[rows_] += total * total
                    q[rows_] -= rate * total / (np.sqrt(b[rows_]) + 1e-6)
                else:
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> Network | None:
    """Train on about TRAIN_PER_LABEL documents of each label and WINDOWS_PER_DOC windows of each; None without any.

    A document with several labels counts as toxic if one of them is 1. The sample's ids, twice TRAIN_PER_LABEL or so
    at any size of the corpus, are broadcast, so no texts are shuffled.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = labelled_sample(known, "toxic", TRAIN_PER_LABEL, "doc_id")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, y in zip(b["doc_id"], b["text"], b["toxic"], strict=True):
                words = words_of(t)
                ws = windows(len(words))
                pick = np.random.default_rng(len(words)).permutation(len(ws))[:WINDOWS_PER_DOC]
                rows += [(d, int(j), " ".join(words[ws[j][0] : ws[j][1]]), y) for j in sorted(pick)]
            yield pd.DataFrame(rows, columns=["doc_id", "j", "words", "toxic"])

    rows = sorted((r.doc_id, r.j, r.words, r.toxic) for r in texts.mapInPandas(cut, "doc_id long, j int, words string, toxic int").collect())
    bags: dict[int, tuple[list[list[str]], int]] = {}
    same: dict[str, str] = {}  # one string for each word, however often it occurs
    for d, _, words, y in rows:
        bags.setdefault(d, ([], y))[0].append([same.setdefault(w, w) for w in words.split(" ")])
    del rows
    return calibrated(list(bags.values()), threshold) if bags else None


def scorer(net: Network | None, threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with its rows: ``score`` and ``predicted`` of each; new words and windows some at a time, so that memory is bounded."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        gf, gb = (np.zeros((TASK_WORDS, 3 * STATE), np.float32) for _ in "fb")  # rows of known words, and room for more
        done = 0  # rows that are filled
        for b in batches:
            best = np.zeros(len(b))
            owner: list[int] = []
            held: list[list[int]] = []
            fresh: list[str] = []

            def flush() -> None:
                nonlocal gf, gb, done
                while done + len(fresh) > len(gf):
                    gf, gb = (np.concatenate([g, np.zeros_like(g)]) for g in (gf, gb))
                for at in range(0, len(fresh), TASK_WORDS):
                    x = net.inputs(Features(fresh[at : at + TASK_WORDS]))
                    gf[done : done + len(x)], gb[done : done + len(x)] = net.gates(x, "f"), net.gates(x, "b")
                    done += len(x)
                fresh.clear()
                if held:
                    ids = np.full((len(held), WINDOW), -1, np.int64)
                    for i, r in enumerate(held):
                        ids[i, : len(r)] = r
                    np.maximum.at(best, owner, net.score(gf, gb, ids))
                    held.clear()
                    owner.clear()

            for i, t in enumerate(b["text"] if net is not None else ()):
                words = words_of(t) if t else []
                for start, end in windows(len(words)):
                    ids = []
                    for w in words[start:end]:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = len(known)
                            fresh.append(w)
                        ids.append(k)
                    held.append(ids)
                    owner.append(i)
                    if len(held) >= TASK_WINDOWS:
                        flush()
                if len(known) > CACHE:
                    flush()
                    known.clear()
                    done = 0
            flush()
            yield b.assign(score=best, predicted=(best >= threshold).astype("int32"))

    return apply


def score(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 if the score is ``threshold`` or more).

    Defined cases: null texts and texts without words score 0, as do all texts where there was nothing to learn from;
    equal texts score alike; a long text's windows are all scored, some at a time; an empty table gives an empty
    result; columns of ``docs`` with the names of results are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    rows = docs.select(*keep, held_out("doc_id").alias("held_out"))
    schema = rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInPandas(scorer(net, threshold), schema)
