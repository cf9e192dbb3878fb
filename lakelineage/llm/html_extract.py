"""Main text of web pages, with a suffix array over the pages of a host.

A page becomes a stream of blocks. Blocks inside an ``article`` or ``main`` element (less the menus, adverts, forms
and comments within) are its main text. All blocks outside go, as token streams, into suffix arrays of their host:
runs of tokens that repeat across distinct pages are boilerplate, and what they don't cover is unique. A page without
an ``article`` or ``main`` element keeps its unique runs, less what its markup names as menu, footer, advert, form,
notice or comments.

A host's streams are dealt into lots, each with a suffix array. Runs are counted over all lots of the host, so what is
boilerplate doesn't depend on how a host is dealt.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.common import checkpoint

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
UNFINISHED = re.compile(r"<[A-Za-z/!?][^>]*\Z")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "button"}
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that stay open until their end tag; the others may lack one.
HOLDS = BLOCK - {"p", "li", "dd", "dt", "td", "th", "tr", "hr", "html", "body", "tbody", "thead", "tfoot"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Words of class, id and role values that name something other than main text.
NOISE = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright discussion disqus "
    "footer form masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related replies responses search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar".split()
)
LONG = 6  # tokens that a repeated run has at least
PAGES = 3  # distinct pages that it is in at least
LOT = 200_000  # tokens of a host that share a suffix array, about; a page is never split
TIMES = np.uint64(0x9E3779B97F4A7C15)


def blocks_of(page: str) -> tuple[list[str], list[tuple[str, bool]], bool]:
    """Blocks inside the main element, blocks outside with whether markup names them as noise, whether there is a main element."""
    inside: list[str] = []
    outside: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # of elements that hold others: name, is noise, is main
    text: list[str] = []
    noisy, within, found, odd_p, at, n = 0, 0, False, False, 0, len(page)

    def flush() -> None:
        if text:
            if block := " ".join(entities.unescape("".join(text)).split()):
                if within and not noisy and not odd_p:
                    inside.append(block)
                else:
                    outside.append((block, bool(noisy or odd_p or within)))
            text.clear()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text.append(UNFINISHED.sub("", page[at:]))
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
            continue
        if name in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name not in BLOCK and name != "head":
            continue
        flush()
        odd_p = False
        if m[1]:
            if any(x[0] == name for x in stack):
                while True:
                    top, was_noise, was_main = stack.pop()
                    noisy, within = noisy - was_noise, within - was_main
                    if top == name:
                        break
            continue
        words = {w for v in NAMED.findall(m[3]) for w in re.split(r"[^a-z0-9]+", "".join(v).lower())} if m[3] else set()
        noise = name in CHROME or name == "header" and not within or bool(words & NOISE) or bool(m[3] and HIDDEN.search(m[3]))
        if name in HOLDS or name == "head":
            is_main = name in ("article", "main") and not noise and not noisy
            found |= is_main
            if not m[3].rstrip().endswith("/"):
                stack.append((name, noise, is_main))
                noisy, within = noisy + noise, within + is_main
        else:
            odd_p = noise
    flush()
    return inside, outside, found


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer array, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n:
        second = np.full(n, -1, np.int64)
        second[:-k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.empty(n, np.int64)
        a, b = rank[order], second[order]
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k > 4 * LONG:  # runs are looked for by their first LONG tokens, so a deeper order isn't needed
            break
    return order


class Streams:
    """Token streams of distinct pages, one after another with a separator after each."""

    def __init__(self, pages: list[list[str]]) -> None:
        ids: dict[str, int] = {}
        tokens: list[int] = []
        page: list[int] = []
        self.at: list[list[int]] = []  # first token of each block of each page
        for p, blocks in enumerate(pages):
            self.at.append([])
            for block in blocks:
                self.at[-1].append(len(tokens))
                words = block.split(" ")
                tokens += [ids.setdefault(w, len(ids)) for w in words]
                page += [p] * len(words)
            tokens.append(-1 - p)
            page.append(-1)
        self.tokens, self.page = np.array(tokens, np.int64), np.array(page, np.int64)
        digest = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids] or [0], np.uint64)
        word = digest[np.maximum(self.tokens, 0)]
        n = max(len(tokens) - LONG + 1, 0)
        self.inside = np.ones(n, bool)  # starts of LONG tokens of one page
        self.run = np.zeros(n, np.uint64)  # hash of those tokens
        for j in range(LONG):
            self.inside &= self.tokens[j : j + n] >= 0
            self.run = (self.run ^ word[j : j + n]) * TIMES
            self.run ^= self.run >> np.uint64(32)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of LONG tokens and the number of pages of each.

        Suffixes that share LONG tokens stand together in the suffix array. A longer run is covered by those that begin
        at each of its tokens, so no run of LONG tokens or more is left out.
        """
        if not self.inside.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        order = suffix_array(self.tokens)
        order = order[order < len(self.inside)]
        order = order[self.inside[order]]
        same = np.ones(len(order) - 1, bool)
        for j in range(LONG):
            x = self.tokens[order + j]
            same &= x[1:] == x[:-1]
        group = np.concatenate(([0], np.cumsum(~same)))
        pairs = np.unique(np.stack([group, self.page[order]], 1), axis=0)
        return self.run[order[np.concatenate(([True], ~same))]], np.bincount(pairs[:, 0], minlength=group[-1] + 1)

    def covered(self, often: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run whose hash is in ``often``."""
        out = np.zeros(len(self.tokens), bool)
        start = np.flatnonzero(self.inside & np.isin(self.run, often))
        for j in range(LONG):
            out[start + j] = True
        return out


def main_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [blocks_of(h or "") for h in b["html"]]
        found = [f for _, _, f in rows]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": ["\n\n".join(i) for i, _, _ in rows]})[found]


def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks outside main elements; equal streams of blocks have equal digests."""
    for b in batches:
        rows = [(o, f) for _, o, f in (blocks_of(h or "") for h in b["html"])]
        same = [xxhash.xxh3_128_hexdigest("\n".join("01"[x] + t for t, x in o).encode("utf-8", "surrogatepass")) for o, _ in rows]
        yield pd.DataFrame(
            {"page_id": b["page_id"], "url": b["url"], "host": b["host"], "found": [f for _, f in rows], "digest": same, "n": [sum(t.count(" ") + 1 for t, _ in o) for o, _ in rows]}
            | {"blocks": [[t for t, _ in o] for o, _ in rows], "noise": [[x for _, x in o] for o, _ in rows]}
        )


def evidence(lot: pd.DataFrame) -> pd.DataFrame:
    """Every run of a lot with the number of its pages, up to PAGES."""
    run, n = Streams(list(lot["blocks"])).repeats()
    return pd.DataFrame({"host": lot["host"].iloc[0], "lot": lot["lot"].iloc[0], "run": run.view(np.int64), "n": np.minimum(n, PAGES)})


def unique_runs(lot: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
    """What repeated runs leave of each stream of a lot. ``often``: runs that repeat over the lots of the host."""
    texts = []
    if len(lot):
        all_ = Streams(list(lot["blocks"]))
        run, n = all_.repeats()
        cover = all_.covered(np.union1d(run[n >= PAGES], often["run"].to_numpy(np.int64).view(np.uint64)))
        for at, blocks, noise in zip(all_.at, lot["blocks"], lot["noise"], strict=True):
            kept = []
            for i, block, odd in zip(at, blocks, noise, strict=True):
                words = block.split(" ")
                if not odd and (rest := [w for w, c in zip(words, cover[i : i + len(words)], strict=True) if not c]):
                    kept.append(" ".join(rest))
            texts.append("\n\n".join(kept))
    return pd.DataFrame({"host": lot["host"], "digest": lot["digest"], "text": texts})


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of each row of ``pages`` (``page_id``, ``url``, ``html``).

    Defined cases: a null or empty html gives an empty text; pages with a null url share the empty host; repeated rows
    give repeated results, and equal streams count as one page where runs are counted; an empty table gives an empty
    result; further columns are not used. A page is parsed whole, whatever its length.

    Each distinct stream of a host goes into a lot of about LOT tokens, so no host meets in one task. Hosts whose pages
    all have a main element need no runs. Only what stands outside main elements is written or shuffled; a page's main
    text stays where it was parsed, at the price of parsing twice.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    declared = rows.mapInPandas(main_texts, "page_id long, url string, text string")
    shape = "page_id long, url string, host string, found boolean, digest string, n long, blocks array<string>, noise array<boolean>"
    outside = checkpoint(rows.mapInPandas(streams, shape))
    bare = outside.where(~F.col("found")).select("page_id", "url", "host", "digest")
    distinct = outside.join(bare.select("host").distinct(), "host", "left_semi").dropDuplicates(["host", "digest"])
    lots = distinct.groupBy("host").agg(F.ceil(F.sum("n") / LOT).alias("lots"))
    dealt = distinct.join(lots, "host").withColumn("lot", F.pmod(F.xxhash64("digest"), F.greatest("lots", F.lit(1))))
    # Dealt anew, or the join's partitioning by host alone would serve.
    dealt = checkpoint(dealt.select("host", "lot", "lots", "digest", "blocks", "noise").repartition("host", "lot"))
    runs = dealt.where("lots > 1").groupBy("host", "lot").applyInPandas(evidence, "host string, lot long, run long, n long")
    often = runs.groupBy("host", "run").agg(F.sum("n").alias("_n")).where(F.col("_n") >= PAGES).drop("_n")
    marks = runs.join(often, ["host", "run"]).select("host", "lot", "run")
    rest = dealt.groupBy("host", "lot").cogroup(marks.groupBy("host", "lot")).applyInPandas(unique_runs, "host string, digest string, text string")
    rest = bare.join(rest, ["host", "digest"]).select("page_id", "url", "text")
    return declared.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
