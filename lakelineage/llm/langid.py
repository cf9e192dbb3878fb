"""Language of a text, by a byte convolutional network trained here in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's maximum over the window
feeds a softmax. A text's windows overlap so that every run of bytes that a filter can see lies in one of them; the
text's prediction is the mean of its windows' log probabilities, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.sampling import held_out, labelled_sample

LENGTH, WIDEST = 260, 5  # of a window, in bytes; LENGTH is a multiple of WIDEST
STEP = LENGTH - WIDEST + 1
WIDTHS = (2,) * 4 + (3,) * 8 + (4,) * 10 + (5,) * 10  # of the filters
DEPTH = 8  # of the byte embedding
TRAIN_PER_LANG = 1200  # documents that the network is trained on, of each language at most (about)
WINDOWS_PER_DOC = 3  # of each of those
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDEST * DEPTH x filters; rows beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray  # filters x langs
    out_bias: np.ndarray

    def peaks(self, x: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each window (rows of bytes).

        For each r below WIDEST, the filters at positions r, r + WIDEST, ... are one matrix product over a reshaped
        view of the embedded bytes, without copies.
        """
        n, k = len(x), len(self.bias)
        flat = self.embed[x.reshape(-1)].reshape(-1)
        each = LENGTH // WIDEST
        best = None
        for r in range(WIDEST):
            part = flat[r * DEPTH :]
            part = part[: len(part) // (WIDEST * DEPTH) * WIDEST * DEPTH].reshape(-1, WIDEST * DEPTH) @ self.filters
            if r:  # the last position of each window would reach into the next window
                part = np.concatenate([part, np.zeros((n * each - len(part), k), np.float32)]).reshape(n, each, k)[:, : each - 1]
            else:
                part = part.reshape(n, each, k)
            m = part.max(1)
            best = m if best is None else np.maximum(best, m)
        return np.maximum(best + self.bias, 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.peaks(x) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(data: bytes) -> np.ndarray:
    """All overlapping windows of a text, the last padded with zeros."""
    n = max(1, -(-(len(data) - WIDEST + 1) // STEP)) if data else 1
    x = np.zeros((n - 1) * STEP + LENGTH, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)[: len(x)]
    return np.lib.stride_tricks.as_strided(x, (n, LENGTH), (STEP, 1))


def train(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 900, batch: int = 96, seed: int = 5) -> Network:
    """Adam on softmax cross entropy; gradients pass through each filter's maximum only."""
    rng = np.random.default_rng(seed)
    k = len(WIDTHS)
    mask = np.zeros((WIDEST * DEPTH, k), np.float32)
    for j, w in enumerate(WIDTHS):
        mask[: w * DEPTH, j] = 1
    f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    net = Network(langs, f32(256, DEPTH, scale=0.5), f32(WIDEST * DEPTH, k, scale=0.2) * mask, np.zeros(k, np.float32), f32(k, len(langs), scale=0.3), np.zeros(len(langs), np.float32))
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        i = rng.integers(0, len(x), batch)
        xb = x[i].copy()
        xb[np.arange(LENGTH) >= np.maximum(12, rng.integers(0, 2 * LENGTH, batch))[:, None]] = 0  # short texts too
        e = net.embed[xb]
        patches = np.lib.stride_tricks.sliding_window_view(e, WIDEST, 1).transpose(0, 1, 3, 2).reshape(batch, STEP, -1)
        h = patches @ net.filters
        at = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0] + net.bias, 0)
        z = top @ net.out + net.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y[i]] -= 1
        dz = p / batch
        dtop = (dz @ net.out.T) * (top > 0)
        seen = patches[np.arange(batch)[:, None], at]  # batch x filters x WIDEST * DEPTH
        dfilters = np.einsum("bk,bkd->dk", dtop, seen) * mask
        dpatch = (dtop[:, :, None] * net.filters.T[None]).reshape(batch, k, WIDEST, DEPTH)
        dembed = np.zeros_like(net.embed)
        np.add.at(dembed, xb[np.arange(batch)[:, None, None], at[:, :, None] + np.arange(WIDEST)], dpatch)
        rate = 0.01 * (1 - step / (steps + 1))
        for q, g, a, b in zip(params, [dembed, dfilters, dtop.sum(0), top.T @ dz, dz.sum(0)], first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame) -> Network | None:
    """Train on about TRAIN_PER_LANG documents of each language, WINDOWS_PER_DOC windows of each; None without any."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                if LETTER.search(t):
                    w = windows(t.encode("utf-8", "replace"))
                    pick = np.random.default_rng(len(t)).permutation(len(w))[:WINDOWS_PER_DOC]
                    rows += [(d, int(j), w[j].tobytes(), lang) for j in sorted(pick)]
            yield pd.DataFrame(rows, columns=["doc_id", "j", "x", "lang"])

    sample = labelled_sample(known, "lang", TRAIN_PER_LANG, "doc_id").mapInPandas(cut, "doc_id long, j int, x binary, lang string")
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.j, bytes(r.x)))
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(-1, LENGTH)
    return train(x, np.array([langs.index(r.lang) for r in rows]), langs)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (mean probability of that language) of each row.

    Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where there was
    nothing to learn from; equal texts get equal predictions; long texts are scored to their end, some windows at a
    time; an empty table gives an empty result; other columns are not used.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if net is not None and t is not None and LETTER.search(t)]
            sums = np.zeros((len(texts), len(net.langs) if net else 1))
            sizes = np.zeros(len(texts))
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush() -> None:
                if not held:
                    return
                p = net.log_probs(np.concatenate([h[1] for h in held]))
                weight = np.concatenate([h[2] for h in held])
                owner = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
                np.add.at(sums, owner, p * weight[:, None])
                np.add.at(sizes, owner, weight)
                held.clear()

            waiting = 0
            for i in todo:
                data = texts[i].encode("utf-8", "replace")
                w = windows(data)
                weight = np.minimum(LENGTH, len(data) - STEP * np.arange(len(w))).clip(1).astype(float)
                for at in range(0, len(w), 512):
                    held.append((i, w[at : at + 512], weight[at : at + 512]))
                    waiting += len(held[-1][1])
                    if waiting >= 512:
                        flush()
                        waiting = 0
            flush()
            for i in todo:
                p = np.exp(sums[i] / sizes[i])
                p /= p.sum()
                lang[i], score[i] = net.langs[int(p.argmax())], float(p.max())
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInPandas(apply, "doc_id long, held_out boolean, lang_pred string, score double")
