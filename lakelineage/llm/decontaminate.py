"""Documents that hold a benchmark item, exactly or with edits.

The CGK embedding walks along a text: at output step ``t`` it emits the current character and moves on by one or not, as
a random bit of (``t``, character) says. Texts at a small edit distance walk together for most of the way, so their
outputs have a small Hamming distance, and sampling a few output positions is a locality-sensitive hash for edit
distance. In each of REPEATS embeddings every word of an item, and of a document, starts a walk; its key is hashed from
SAMPLES of its STEPS outputs. A document's key that is one of an item's is a vote for the item, at the place at which it
would begin. Votes are counted over item-sized windows: those for one place, give or take the edits that the item allows.
VOTES of them make a candidate, which is verified by the exact edit distance between the item and the best-fitting
stretch of the document.

Items of fewer than FEW_CHARS characters have too few walks for that. All their grams of GRAM characters (2 for the
shortest) vote instead, counted over the same windows: k edits change k * GRAM grams at most, so a stretch within them
has the others, and none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
REPEATS = 4  # embeddings
STEPS = 24  # outputs of a walk that positions are sampled from
SAMPLES = 10  # output positions in a key
CHECKED = (4, 6, 8)  # sampled positions after which walks that are no item's are left off
VOTES = 2  # of an item's walks, for a candidate, at least
WORDS_A_VOTE = 6  # words of an item for each vote that it needs
SIMILARITY = 0.8  # 1 - edit distance / characters of the item
FEW_CHARS = 72  # items of fewer characters are found by their grams
GRAM, LEAST_CHARS = 3, 20  # characters of a gram; of items for which grams of 2 are too many to be changed by their edits
MAX_ITEM_BYTES = 256 << 20  # of keys, maps and texts of items that are sent to every task at a time
MOST_BITS = 22  # of the places in a map of key prefixes
BYTES_A_CHAR = 64  # of an item's keys and texts, at most
FEW = 48  # candidates that are verified one by one; more are verified side by side
SIDE = 512  # candidates that are verified at a time
COUNTERS = 1 << 20  # of votes, before they are told apart
TEXTS_AT_A_TIME = 3_000_000  # characters of texts whose votes are counted together, but for longer ones
WITH_GRAMS = 300_000  # the same where grams vote, of which there are many
CHUNK = 1 << 15  # walks at a time, so that they stay in a core's cache

_rng = np.random.default_rng(6)
POSITIONS = np.sort(np.stack([_rng.permutation(STEPS)[:SAMPLES] for _ in range(REPEATS)]), 1)
MOVES = _rng.integers(0, 2, (REPEATS, STEPS, 256)).astype(np.uint8)  # by embedding, step and character
TIMES, SPREAD = (_rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def plain(text: str | None) -> str:
    """Lower-case words joined by one space."""
    return " ".join(WORD.findall(text.lower())) if text else ""


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each UTF-16 unit of a plain text, and the units at which its words start."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    starts = np.flatnonzero(units == 32) + 1
    return (units ^ (units >> 8)).astype(np.uint8), np.concatenate(([0], starts)) if len(units) else starts


def edits(chars: np.ndarray | int, similarity: float) -> np.ndarray:
    """Edits that an item of so many characters allows; a tenth is a tenth, whatever its binary form."""
    return np.floor((1 - similarity) * chars + 1e-9).astype(np.int64)


def gram_size(chars: int) -> int:
    return min(chars, 2 if chars < LEAST_CHARS else GRAM)


def grams_of(chars: np.ndarray, size: int) -> np.ndarray:
    """A number for each stretch of ``size`` units of a coded text."""
    code = np.full(max(0, len(chars) - size + 1), size, np.int64)
    for k in range(size):
        code = code << 8 | chars[k : len(chars) - size + 1 + k]
    return code


def walk_keys(chars: np.ndarray, starts: np.ndarray, repeat: int, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Which walks from ``starts`` over ``chars`` (which end in STEPS zeros) go on to the end, and their keys.

    ``keep(j, keys)`` says which of them go on after ``j`` sampled positions; the others are left off.
    """
    which, at, key, j = np.arange(len(starts)), starts.astype(np.int32), np.zeros(len(starts), np.uint64), 0
    for t in range(STEPS):
        x = chars[at]
        if t == POSITIONS[repeat, j]:
            key *= TIMES
            key += x
            j += 1
            if keep is not None and (j in CHECKED or j == SAMPLES):
                ok = np.flatnonzero(keep(j, key))
                which, at, key, x = which[ok], at[ok], key[ok], x[ok]
            if j == SAMPLES or not len(which):
                break
        at += MOVES[repeat, t][x]
    return which, key


class Items:
    """Keys of all items' walks. Bitmaps of key prefixes tell most other walks off early."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids, self.texts = [r[0] for r in rows], [plain(r[1]) for r in rows]
        self.bits = min(MOST_BITS, max(18, 4 + sum(map(len, self.texts)).bit_length()))
        self.stages = {j: n for n, j in enumerate((*CHECKED, SAMPLES))}
        self.maps = np.zeros((REPEATS, len(self.stages), 1 << self.bits), bool)
        self.chars = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in self.texts], np.int64)
        self.words = np.array([len(t.split()) for t in self.texts], np.int64)
        self.letters, self.rows = self.alphabet() if self.texts else np.zeros(0, np.uint32), {}
        self.few = (self.chars > 0) & (self.chars < FEW_CHARS)
        short: dict[int, list[np.ndarray]] = {}  # code, item and place of each gram, by the size of grams
        found: list[list[np.ndarray]] = [[] for _ in range(REPEATS)]
        for i, t in enumerate(self.texts):
            if not t:
                continue
            chars, starts = coded(t)
            if self.few[i]:
                code = grams_of(chars, gram_size(len(chars)))
                short.setdefault(gram_size(len(chars)), []).append(np.stack([code, np.full(len(code), i), np.arange(len(code))], 1))
                continue
            padded = np.concatenate([chars, np.zeros(STEPS, np.uint8)])
            for r in range(REPEATS):

                def mark(j: int, key: np.ndarray, r: int = r) -> np.ndarray:
                    self.maps[r, self.stages[j], self.place(key)] = True
                    return np.ones(len(key), bool)

                _, key = walk_keys(padded, starts, r, mark)
                found[r].append(np.stack([key, np.full(len(key), i, np.uint64), starts.astype(np.uint64)], 1))
        self.keys = []
        for f in found:
            k = np.concatenate(f) if f else np.zeros((0, 3), np.uint64)
            k = k[np.argsort(k[:, 0], kind="stable")]
            self.keys.append((k[:, 0].copy(), k[:, 1].astype(np.int32), k[:, 2].astype(np.int32)))

        self.short = {size: (x := np.concatenate(rows))[np.argsort(x[:, 0], kind="stable")] for size, rows in short.items()}

    def needed(self, similarity: float) -> np.ndarray:
        """Votes that a candidate of each item has at least."""
        size = np.array([gram_size(int(n)) for n in self.chars], np.int64)
        grams = self.chars - size + 1 - size * edits(self.chars, similarity)
        return np.where(self.few, np.maximum(1, grams), np.maximum(VOTES, self.words // WORDS_A_VOTE))

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ key >> np.uint64(32)) * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, texts: list[str], similarity: float) -> list[tuple[int, int, int, int]]:
        """(text, item, first and last unit) of the stretches of plain texts in which items may be."""
        both = [coded(t) for t in texts]
        gap = np.zeros(STEPS, np.uint8)
        chars = np.concatenate([x for c, _ in both for x in (c, gap)])
        begin = np.concatenate(([0], np.cumsum([len(c) + STEPS for c, _ in both])))
        starts = np.concatenate([s + b for (_, s), b in zip(both, begin, strict=False)])
        at, item, place, walk = [], [], [], []  # unit of the vote, item, unit of the item's word, embedding
        for r in range(REPEATS):
            keys, items, places = self.keys[r]
            keep = lambda j, key, r=r: self.maps[r, self.stages[j], self.place(key)]
            for lo in range(0, len(starts) if len(keys) else 0, CHUNK):
                some = starts[lo : lo + CHUNK]
                which, key = walk_keys(chars, some, r, keep)
                first, n = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = n - first
                each = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at.append(np.repeat(some[which], n))
                item.append(items[each])
                place.append(places[each])
                walk.append(np.full(len(each), r, np.int8))
        for size, rows in self.short.items():
            code = grams_of(chars, size)
            first, n = np.searchsorted(rows[:, 0], code, "left"), np.searchsorted(rows[:, 0], code, "right")
            n = n - first
            where = np.flatnonzero(n)
            first, n = first[where], n[where]
            each = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            at.append(np.repeat(where, n))
            item.append(rows[each, 1])
            place.append(rows[each, 2])
            walk.append(np.full(len(each), REPEATS, np.int8))
        if not at:
            return []
        at, item, place, walk = map(np.concatenate, (at, item, place, walk))
        text = np.searchsorted(begin, at, "right") - 1  # at is sorted but for each embedding, so this is quick
        item, place = item.astype(np.int64), place.astype(np.int64)
        # Two votes for one stretch are for places that differ by the edits that the item allows, or less.
        slack = edits(self.chars, similarity) + 1
        width = int(begin[-1]) + int(self.chars.max()) + 4
        cell = (at - place + self.chars[item]) // slack[item]
        code = (text * len(self.ids) + item) * width + cell
        needed = self.needed(similarity)
        # Most votes stay alone. Counters that several stretches share can only count too many, so no candidate goes.
        slot = (code & (COUNTERS - 1)).astype(np.int32)
        count = np.bincount(slot, minlength=COUNTERS)
        most = count + np.maximum(np.roll(count, 1), np.roll(count, -1))
        some = np.flatnonzero(most[slot] >= needed[item])
        if not len(some):
            return []
        code, at, item, place, walk = (x[some] for x in (code, at, item, place, walk))
        code, votes = np.unique(code, return_inverse=True)
        # A word that is there many times has one vote: the lesser number of different words on either side counts.
        by = [np.bincount(np.unique(votes * span + x * (REPEATS + 1) + walk) // span, minlength=len(code)) for x, span in ((at, (int(begin[-1]) + 1) * (REPEATS + 1)), (place, (int(self.chars.max()) + 1) * (REPEATS + 1)))]
        votes = np.minimum(*by)
        item = code // width % len(self.ids)
        follows = np.append(code[1:] == code[:-1] + 1, False)
        enough = votes + np.where(follows, np.append(votes[1:], 0), 0) >= needed[item]
        out = []
        for c, i, two in zip(code[enough], item[enough], follows[enough], strict=True):
            k, first = int(c // width // len(self.ids)), int(c % width * slack[i] - self.chars[i])
            last = first + int((2 if two else 1) * slack[i] + self.chars[i])
            out.append((k, int(i), first - int(slack[i]) - int(begin[k]), last + int(slack[i]) - int(begin[k])))
        return out

    def alphabet(self) -> np.ndarray:
        return np.unique(np.concatenate([points(t) for t in self.texts]))

    def matches(self, i: int) -> np.ndarray:
        """Bits at which item ``i`` has each character of the alphabet, in words of 64; the last row is of other characters."""
        if i not in self.rows:
            at = np.searchsorted(self.letters, points(self.texts[i]))
            bits = np.zeros((len(self.letters) + 1, -(-len(at) // 64)), np.uint64)
            np.bitwise_or.at(bits, (at, np.arange(len(at)) // 64), np.uint64(1) << (np.arange(len(at)) % 64).astype(np.uint64))
            self.rows[i] = bits
        return self.rows[i]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fitting_distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``, and where that stretch ends.

    Myers' bit-parallel recurrence on one integer of len(item) bits.
    """
    m = len(item)
    match: dict[str, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = match.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        hp, hn = down | ~(d | up) & full, up & d
        if hp & top:
            now += 1
        elif hn & top:
            now -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | ~(d | hp) & full, hp & d
        if now < best:
            best, end = now, j + 1
    return best, end


def fitting_distances(items: Items, which: list[int], stretches: list[str]) -> list[tuple[int, int]]:
    """``fitting_distance`` of many items and stretches, side by side: the same recurrence on arrays of 64-bit words."""
    bits = [items.matches(i) for i in which]
    words, a = max(b.shape[1] for b in bits), len(items.letters) + 1
    slots = {i: k for k, i in enumerate(dict.fromkeys(which))}
    match = np.zeros((words, len(slots) * a), np.uint64)
    for i, k in slots.items():
        match[: items.rows[i].shape[1], k * a : (k + 1) * a] = items.rows[i].T
    n, steps = len(which), max(map(len, stretches))
    text = np.full((steps, n), a - 1, np.int64)
    for k, t in enumerate(stretches):
        c = points(t)
        at = np.searchsorted(items.letters, c)
        at[at == a - 1] = 0
        text[: len(c), k] = np.where(items.letters[at] == c, at, a - 1)
    text += np.array([slots[i] * a for i in which])
    size = np.array([len(items.texts[i]) for i in which])
    top, high = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    each, length = np.arange(n), np.array(list(map(len, stretches)))
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    now, best, end = size.copy(), size.copy(), np.zeros(n, np.int64)
    one, last = np.uint64(1), np.uint64(63)
    for j in range(steps):
        x = match[:, text[j]]
        x |= down
        add, carry = x & up, None
        for w in range(words):
            a_, u = add[w], up[w]
            total = a_ + u
            over = total < a_
            if carry is not None:
                total += carry
                over |= total < carry
            carry, add[w] = over.astype(np.uint64), total
        add ^= up
        add |= x  # cells that equal the one diagonally before
        hp = add | up
        np.invert(hp, out=hp)
        hp |= down
        hn = up & add
        now += ((hp[top, each] >> high) & one).astype(np.int64)
        now -= ((hn[top, each] >> high) & one).astype(np.int64)
        better = np.flatnonzero((now < best) & (j < length))
        best[better], end[better] = now[better], j + 1
        for h in (hp, hn):
            out = h[:-1] >> last
            h <<= one
            h[1:] |= out
        down = hp & add
        hp |= add
        np.invert(hp, out=hp)
        hp |= hn
        up = hp
    return list(zip(best.tolist(), end.tolist(), strict=True))


def leaks_in(texts: list[str | None], items: Items, similarity: float) -> list[tuple[int, int, int, int]]:
    """(text, item, edit distance, word at which it begins, roughly) of each item that each text holds."""
    plain_, best = [plain(t) for t in texts], {}
    found = []
    for k, i, first, last in items.candidates(plain_, similarity) if items.ids and texts else ():
        text, first, last = plain_[k], max(0, first), max(0, last)
        if not text.isascii() and max(text) > "\uffff":  # units aren't characters
            units = text.encode("utf-16-le", "surrogatepass")
            first, last = (len(units[: 2 * x].decode("utf-16-le", "ignore")) for x in (first, last + 1))
        found.append((k, i, first, text[first:last]))
    size = lambda x: (len(items.texts[x[1]]) - 1) // 64
    found = sorted((x for x in found if x[3]), key=lambda x: (size(x), len(x[3])))
    cuts = [0, *[n for n in range(1, len(found)) if size(found[n]) != size(found[n - 1])], len(found)]
    for lo, hi in [(at, min(at + SIDE, end)) for start, end in zip(cuts, cuts[1:], strict=False) for at in range(start, end, SIDE)]:
        some = found[lo:hi]
        if len(some) < FEW:
            results = [fitting_distance(items.texts[i], t) for _, i, _, t in some]
        else:
            results = fitting_distances(items, [i for _, i, _, _ in some], [t for _, _, _, t in some])
        for (k, i, first, _), (d, end) in zip(some, results, strict=True):
            place = max(0, first + end - len(items.texts[i]))
            if d <= edits(len(items.texts[i]), similarity) and (d, place) < best.get((k, i), (d + 1, 0)):
                best[k, i] = (d, place)
    return [(k, i, d, plain_[k].count(" ", 0, p)) for (k, i), (d, p) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and ``at_word`` for every benchmark item that a document holds.

    Texts are compared as lower-case words (``\\w+``) joined by one space, so that case, punctuation and spacing don't
    count. A document holds an item if some stretch of it is within (1 - ``similarity``) * characters of the item.

    Defined cases: null, empty and wordless texts hold nothing, and such items are held by nothing; repeated rows give
    repeated results; items with one text are all reported; empty tables give an empty result; other columns are not
    used. Items of any length are compared whole. What goes to every task are at most MAX_ITEM_BYTES, maps of key prefixes
    included; a larger benchmark is looked up in parts, each over all documents.
    """
    items_ = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    (chars,) = items_.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    maps = REPEATS * (len(CHECKED) + 1) << MOST_BITS
    parts = max(1, -(-chars * BYTES_A_CHAR // (MAX_ITEM_BYTES - maps)))
    some = [items_.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.unionByName, [_leaks(docs, part, similarity) for part in some])


def _leaks(docs: DataFrame, part: DataFrame, similarity: float) -> DataFrame:
    items = Items(sorted((r.item_id, r.text) for r in part.collect()))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(items))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = cloudpickle.loads(shared.value)
        for b in batches:
            ids, texts, rows = list(b["doc_id"]), list(b["text"]), []
            part = np.cumsum([len(t or "") for t in texts]) // (WITH_GRAMS if items.short else TEXTS_AT_A_TIME)
            for n in np.unique(part):
                at, end = np.searchsorted(part, [n, n + 1])
                rows += [(ids[at + k], items.ids[i], d, p) for k, i, d, p in leaks_in(texts[at:end], items, similarity)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "at_word"])

    return docs.select("doc_id", "text").mapInPandas(apply, "doc_id long, item_id long, distance long, at_word long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    gone = find_leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
