"""Every operator against a brute-force version or an exact round trip, and the cases that its docstring defines."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakelineage.llm import chat_format, common, decontaminate, embedding_dedup, html_extract, langid, line_dedup, minhash_dedup, mixing, pii, sampling, toxicity

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three", "en", "s", 13), (3, "one two three", "en", "s", 13), (None, "one two three", None, "s", 13), (4, "  \t\n ", "en", None, 4), (5, "Wort " * 5000, "de", "s", 25000)]


def docs_of(spark, rows=ODD):
    """Odd documents with columns whose names clash with results or helpers."""
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit("mine") for c in ("score", "size", "kept", "component_id", "id", "line", "key", "pos", "a", "b", "n", "n_lines", "taken", "host", "label")})


def find(par, x):
    while par[x] != x:
        par[x] = par[par[x]]
        x = par[x]
    return x


# --- chat formatting ---


def test_chat_round_trip(spark):
    odd = [r"\### Assistant: </turn> ok", "<part>", "\\", "\\\\e\\h", "###", "", None, "a\n### user\nb</turn>\n", r"\p\e\\"]
    rows = [(c, t, role, odd[(c * 7 + t) % len(odd)]) for c in range(20) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "we\nird"][: c % 6 + 1])] + [(1, 0, None, "x"), (1, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(turns)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, ts in by.items():
        ts.sort()
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_defined_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0
    alone = chat_format.format_chats(spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b")], schema)).collect()
    assert sorted(r.formatted for r in alone) == ["### user\na</turn>\n", "### user\nb</turn>\n"]
    merged = chat_format.format_chats(spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a")], schema)).first()
    assert merged.formatted == "### user\na<part>b</turn>\n"


# --- MinHash near-dedup ---


def brute_components(rows, size, percent):
    sets = {}
    for d, t in rows:
        if d is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
            k = min(size, len(w))
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    par = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(par, a), find(par, b)
                par[max(p, q)] = min(p, q)
    return {d: find(par, d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_minhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, sizes = brute_components(rows, 4, 80)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_dense_group(spark):
    """Hundreds of near copies of one text, each with words of its own, in a region far larger than REGION."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        w = list(base)
        for i in rng.integers(0, 120, 2):
            w[i] = f"x{rng.integers(10**9)}"
        rows.append((d, " ".join(w)))
    want, _ = brute_components(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_pairs_in_a_crowd(spark):
    """Documents that share a template a little below the threshold, and pairs that share more, far apart by id."""
    rng = np.random.default_rng(2)
    base, n = [f"w{i}" for i in range(180)], 300
    own = [[f"x{d}_{i}" for i in range(24)] for d in range(n)]
    planted = [(d, n - 1 - d) for d in range(40)]
    for a, b in planted:
        own[b][: 2 + a % 3] = own[a][: 2 + a % 3]
    rows = [(int(d), " ".join(base + own[k])) for d, k in zip(rng.permutation(n) * 7, range(n), strict=True)]
    want, _ = brute_components(rows, 4, 80)
    assert len(set(want.values())) == n - len(planted)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_lower_threshold(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(42))), (3, "other words than these here")]
    want, _ = brute_components(rows, 4, 60)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 60).collect()}
    assert got == want == {1: 1, 2: 1, 3: 3}


def test_minhash_defined_cases(spark):
    got = minhash_dedup.near_duplicates(docs_of(spark)).collect()
    assert len(got) == len(ODD)
    assert all(r.kept and (r.component_id is None) == (r.doc_id is None) for r in got)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    left = minhash_dedup.drop_near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "A B C d e f"), (3, ""), (None, "x")], "doc_id long, text string"))
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, None]


# --- embedding near-dedup ---


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 10))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.35 * rng.standard_normal(10)], i % 3) for i in range(240)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(4)]
    odd = [(2000, None, 1), (2001, [0.0] * 10, 1), (2002, [float("nan")] + [1.0] * 9, 1), (2003, rows[0][1], None), (2004, [], 1), (2005, [1.0, None], 1), (2006, [float("inf"), 1.0], 1), (2007, rows[0][1][:4], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("mine"), "n": F.lit(1), "rows": F.lit(2)})
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    par, links = {r[0]: r[0] for r in rows}, collections.Counter()
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[i + 1 :]:
            if la == lb and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(par, a), find(par, b)
                par[max(p, q)] = min(p, q)
    assert sum(links.values()) > 100
    assert {k: (r.n_links, r.component_id) for k, r in got.items() if k < 2000} == {r[0]: (links[r[0]], find(par, r[0])) for r in rows}
    assert all(got[k].n_links == 0 and got[k].kept for k, _, _ in odd)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- mixing ---


def test_mix_targets_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    size, taken, target, biggest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for _, s, n, total, t, k in got:
        assert k <= 2 * n and (n == 0 or k % n == 0)
        size[s] += n
        taken[s] += k
        target[s] = t
        biggest[s] = max(biggest[s], n)
    # Water filling, one source at a time.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    want, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in size)


@pytest.mark.parametrize("by_source", [False, True])
def test_mix_is_pareto_order_sampling(spark, by_source):
    """Which documents go in, against plain code: sort by odds of u over odds of p, take until the rest is reached."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    got = {r.doc_id: r for r in mixing.mix(docs, inclusion=F.length("source") * F.lit(2.0) if by_source else None).collect()}
    draws = {r.doc_id: r.h % (1 << 52) for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    by = collections.defaultdict(list)
    for r in got.values():
        by[r.source].append(r)
    longer, certain = [], 0
    for rows in by.values():
        total, target = rows[0].source_size, rows[0].target
        whole = int(target // total)
        rest = target - whole * total
        weight = {r.doc_id: 2.0 * len(r.source) if by_source else r.size**0.5 for r in rows}
        sure = set()
        while True:  # take what reaches 1 for certain, and share the rest anew
            left = rest - sum(got[d].size for d in sure)
            scale = left / sum(r.size * weight[r.doc_id] for r in rows if r.doc_id not in sure) if left > 0 else 0
            new = {r.doc_id for r in rows if r.size and r.doc_id not in sure and scale * weight[r.doc_id] >= 1}
            if not new:
                break
            sure |= new
        certain += len(sure)
        chance = {r.doc_id: 1 if r.doc_id in sure else scale * weight[r.doc_id] for r in rows}
        assert max(chance.values()) <= 1 and sum(r.size * chance[r.doc_id] for r in rows) == pytest.approx(rest)

        def rank(r):
            u = (draws[r.doc_id] + 0.5) / (1 << 52)
            p = min(1 - 1e-9, max(1e-9, chance[r.doc_id]))
            return u / (1 - u) / (p / (1 - p))

        done, inside = 0, set(sure)
        for r in sorted((r for r in rows if r.doc_id not in sure), key=rank):
            if done + r.size / 2 <= left:
                inside.add(r.doc_id)
            done += r.size
        assert {r.doc_id for r in rows if r.size and r.taken > whole * r.size} == {d for d in inside if got[d].size}
        if 0.1 < rest / total < 0.9:
            longer.append(np.mean([r.size for r in rows if r.doc_id in inside]) / np.mean([r.size for r in rows]))
    assert by_source or np.mean(longer) > 1 and certain > 5


def test_mix_shuffles_no_texts(spark, monkeypatch):
    """Targets come to the documents; with more sources than are sent, the mix is the same."""
    docs = docs_of(spark)
    mixed = mixing.mix(docs)
    assert "SortMergeJoin" not in mixed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed.collect()))


def test_mix_defined_cases(spark):
    got = {r.doc_id: r for r in mixing.mix(docs_of(spark)).collect()}
    assert got[1].size == 0 == got[1].taken and got[5].size == 5000
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    rows = mixing.copies(mixing.mix(docs_of(spark)))
    assert rows.groupBy("doc_id").count().where("count > 4").count() == 0


# --- HTML ---


def test_html_against_plain_pattern(spark):
    import html

    got = {r.page_id: r for r in html_extract.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_html_boilerplate_and_cases(spark):
    menu = "<div>home about contact news shop cart login now</div>"
    pages = [(i, "http://h.example/x", f"<html><body>{menu}<p>unique text of page number {i} a{i} b{i}</p></body></html>") for i in range(5)]
    odd = [(10, None, None), (11, "x", ""), (12, "http://h.example/y", "<article><header><h1>T</h1></header><p>a &lt;b&gt;&nbsp; c<div class='comments'>no</div><aside>no</aside>"), (12, "http://h.example/y", "<p")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumns({"host": F.lit("mine"), "text": F.lit("mine"), "found": F.lit(True)})
    rows = html_extract.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 9
    assert all("home about" not in got[i] and f"a{i} b{i}" in got[i] for i in range(5))
    assert got[10] == got[11] == ""
    assert sorted(r.text for r in rows if r.page_id == 12) == ["", "T\n\na <b> c"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_runs_over_the_lots_of_a_host(spark, monkeypatch):
    menu, note = "home about contact news shop cart login now", "terms of use apply to all who read this"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    pages = [(i, "http://big.example/x", f"<div>{menu}</div><p>{note + ' ' if i % 300 == 7 else ''}{body(i)}</p>") for i in range(1200)]
    pages += [(1200 + i, "http://big.example/y", f"<div>{menu}</div><p>{body(5)}</p>") for i in range(4)]  # copies count as one page
    df = spark.createDataFrame(pages, "page_id long, url string, html string")

    def plain() -> dict[int, str]:
        streams = [[w for block in re.findall(r">([^<]+)<", h) for w in block.split()] for _, _, h in pages]
        seen: dict[tuple, set] = {}
        for s in streams:
            for k in range(len(s) - html_extract.LONG + 1):
                seen.setdefault(tuple(s[k : k + html_extract.LONG]), set()).add(tuple(s))
        out = {}
        for (i, _, _), s in zip(pages, streams, strict=True):
            gone = {k + j for k in range(len(s) - html_extract.LONG + 1) if len(seen[tuple(s[k : k + html_extract.LONG])]) >= html_extract.PAGES for j in range(html_extract.LONG)}
            out[i] = " ".join(w for k, w in enumerate(s) if k not in gone)
        return out

    want = plain()
    assert want[7] == body(7) and want[1203] == body(5)
    for lot in (html_extract.LOT, 500):  # in one lot and in about 70
        monkeypatch.setattr(html_extract, "LOT", lot)
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


# --- decontamination ---


def test_leaks_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:60]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plant, truth = [], set()
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    for k, (i, t) in enumerate(items * 3):
        w = t.split()
        for j in rng.permutation(len(w))[: rng.integers(0, max(1, len(w) // 8) + 1)]:
            w[j] = "zzz"
        edited = " ".join(w).upper()
        if decontaminate.fitting_distance(words(t), words(edited))[0] <= 0.2 * len(words(t)):
            plant.append((10_000 + k, "before it " + edited + " after it"))
            truth.add((10_000 + k, i))
    plain = [(d, t) for d, t in docs if not any(words(x) in words(t) for _, x in items)]
    df = spark.createDataFrame(plain + plant, "doc_id long, text string").withColumns({"item_id": F.lit("mine"), "distance": F.lit("mine")})
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(truth - got) <= 0.02 * len(truth)
    assert {d for d, _ in got} <= {d for d, _ in plant}


def test_short_items_inside_longer_text():
    """Items of 1 to 7 words inside longer text: every exact copy, and copies with one letter changed in a word."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = [(i, " ".join(word() for _ in range(1 + i % 7))) for i in range(140)]
    items = decontaminate.Items(rows)
    for at in (None, 0, -1):
        texts = []
        for _, t in rows:
            w = t.split()
            if at is not None and len(w) > 1:
                w[at] = "z" + w[at][1:]
            texts.append(" ".join([word() for _ in range(20)] + w + [word() for _ in range(20)]))
        got = {(k, i) for k, i, _, _ in decontaminate.leaks_in(texts, items, 0.8)}
        assert {(k, k) for k in range(len(rows))} <= got


def test_leaks_defined_cases(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "two words"), (5, "!!")], "item_id long, text string")
    got = decontaminate.find_leaks(docs_of(spark, [(1, None, None, None, None), (2, "", "", "", 0), (3, "here are Two, words!", "", "", 1), (None, "two words", "", "", 1)]), items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(3, 3), (3, 4), (None, 3), (None, 4)], key=str)
    assert decontaminate.drop_leaks(docs_of(spark), items.limit(0)).count() == len(ODD)
    assert decontaminate.find_leaks(docs_of(spark).limit(0), items).count() == 0


def test_fitting_distance():
    def slow(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return min(row)

    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(2))
        assert decontaminate.fitting_distance(a, b)[0] == slow(a, b)
    letters = list("abcdé ")
    texts = ["".join(rng.choice(letters, n)) for n in (1, 5, 63, 64, 65, 130, 200)]
    items = decontaminate.Items(list(enumerate(texts)))
    which = [int(i) for i in rng.integers(0, len(texts), 80)]
    stretches = ["".join(rng.choice([*letters, "z"], rng.integers(1, 60))) + items.texts[i][rng.integers(0, 9) :] + "ab" for i in which]
    which, stretches = zip(*[(i, t) for i, t in zip(which, stretches, strict=True) if items.texts[i]], strict=True)
    assert decontaminate.fitting_distances(items, list(which), list(stretches)) == [decontaminate.fitting_distance(items.texts[i], t) for i, t in zip(which, stretches, strict=True)]


def test_leaks_with_typos_in_every_word():
    """Items of 15 to 59 words with one character changed, put in or taken out in every, every second or third word: recall of 0.9 or more."""
    rng = np.random.default_rng(12)
    table = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in table])
    around = decontaminate.plain(pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).to_pylist()[0]["text"] * 5).split()
    for every in (1, 2, 3):
        texts, truth = [], []
        for k, t in enumerate(items.texts):
            w = t.split()
            for i in range(0, len(w), every):
                x, q = list(w[i]), rng.integers(len(w[i]))
                x[q : q + rng.integers(0, 2)] = [str(rng.choice(list("qxzj")))] * rng.integers(0, 2)
                w[i] = "".join(x) or "q"
            edited = " ".join(w)
            if decontaminate.fitting_distance(t, edited)[0] <= 0.2 * len(t):
                texts.append(" ".join([*around[:30], edited, *around[30:60]]))
                truth.append(k)
        found = {(k, i) for k, i, _, _ in decontaminate.leaks_in(texts, items, 0.8)}
        assert len(truth) > 150 and np.mean([(j, k) in found for j, k in enumerate(truth)]) >= 0.9


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6, 8, 9, 11, 13, 14])
def test_leaks_of_short_items_by_length(size):
    """Stretches of given items as items of ``size`` words, with one typo in every word or one word changed: recall of 0.9 or more."""
    rng = np.random.default_rng(size)
    table = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    around = decontaminate.plain(pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).to_pylist()[0]["text"] * 5).split()
    rows = [(k * 100 + at, " ".join(w[at : at + size])) for k, r in enumerate(table) if (w := decontaminate.plain(r["text"]).split()) for at in (0, 5, 10) if len(w) >= at + size]
    items = decontaminate.Items(rows)
    texts, truth = [], []
    for k, t in enumerate(items.texts):
        for every in (True, False):
            w = t.split()
            for i in range(len(w)) if every else [rng.integers(len(w))]:
                q = rng.integers(len(w[i]))
                w[i] = w[i][:q] + str(rng.choice(list("qxzj"))) + w[i][q + 1 :] if every else "zq"
            if decontaminate.fitting_distance(t, " ".join(w))[0] <= 0.2 * len(t):
                texts.append(" ".join([*around[:30], *w, *around[30:60]]))
                truth.append(k)
    found = {(k, i) for k, i, _, _ in decontaminate.leaks_in(texts, items, 0.8)}
    assert len(truth) > 20 or size < 3
    assert not truth or np.mean([(j, k) in found for j, k in enumerate(truth)]) >= (1.0 if max(items.chars) < decontaminate.FEW_CHARS else 0.9)


def test_benchmark_in_parts(spark, monkeypatch):
    rows = [(i, f"item number {i} holds words of its own such as w{i} x{i} y{i} z{i}") for i in range(30)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(i, "before it " + t.upper() + " and after") for i, t in rows], "doc_id long, text string")
    whole = {tuple(r) for r in decontaminate.find_leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", (4 * 4 << decontaminate.MOST_BITS) + 20_000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} >= {(i, i) for i in range(30)} and {tuple(r) for r in decontaminate.find_leaks(docs, items).collect()} == whole


def test_bytes_of_items_are_bounded():
    rng = np.random.default_rng(5)
    for n, size in ((50, 400), (2000, 120), (3000, 12)):
        rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(size // 6))) for i in range(n)]
        items = decontaminate.Items(rows)
        maps = items.maps.nbytes
        assert maps <= 16 << decontaminate.MOST_BITS
        assert len(decontaminate.cloudpickle.dumps(items)) - maps <= decontaminate.BYTES_A_CHAR * sum(len(t) for _, t in rows) + 100_000


# --- toxicity and language ---


def network_of(words, seed=0):
    """A network with an embedding for every word and n-gram of ``words``."""
    f, rng = toxicity.Features(words), np.random.default_rng(seed)
    net = toxicity.Network({k: (known, rng.standard_normal(len(known))) for k, known in (("word", np.unique(f.word)), ("gram", np.unique(f.gram)))})
    for k in ("word", "gram"):
        net.p[k][1:] += 0.3 * rng.standard_normal(net.p[k][1:].shape).astype(np.float32)
    return net


def test_gradients():
    """Every gradient of the recurrent network against a difference quotient, and its score against a plain loop."""
    words, ids = toxicity.batch_ids([["you", "bad", "dog"], ["fine", "x"]])
    net = network_of(words)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f, y = toxicity.Features(words), np.array([1.0, 0.0])
    _, grads = net.backward(f, ids, y)
    assert set(grads) == set(net.p)
    for k, g in grads.items():
        if isinstance(g, tuple):
            full = np.zeros_like(net.p[k])
            np.add.at(full, g[0], g[1])
            full[0] = 0
            g = full
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[k][at], 1e-5
        net.p[k][at] = old + e
        up = net.backward(f, ids, y)[0]
        net.p[k][at] = old - e
        down = net.backward(f, ids, y)[0]
        net.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=1e-4), k

    p, s, sig = net.p, toxicity.STATE, lambda v: 1 / (1 + np.exp(-v))
    x = net.inputs(f)
    for i, row in enumerate(ids):
        seen = [x[j] for j in row if j >= 0]
        states = []
        for d in "fb":
            h, out = np.zeros(s), []
            for v in seen if d == "f" else seen[::-1]:
                g = v @ p[f"w{d}"] + p[f"c{d}"]
                z, r = (sig(g[k * s : (k + 1) * s] + h @ p[f"u{d}"][:, k * s : (k + 1) * s]) for k in (0, 1))
                c = np.tanh(g[2 * s :] + (r * h) @ p[f"u{d}"][:, 2 * s :])
                h = (1 - z) * h + z * c
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        both = np.array([np.concatenate(v) for v in zip(*states, strict=True)])
        a = np.exp(both @ p["attend"])
        want = sig((a / a.sum()) @ both @ p["out"] + p["bias"])
        got = net.score(net.gates(x, "f"), net.gates(x, "b"), ids)[i]
        assert got == pytest.approx(want[0], rel=1e-4)


def test_telling_features():
    """Buckets of many toxic documents say much, those of a few nothing, and rare ones have no embedding."""
    bags = [([["vile", "tree", f"own{d}"]], 1) if d < 20 else ([["tree", f"own{d}"]], 0) for d in range(200)]
    known, says = toxicity.features_of(bags)["word"]
    at = {w: int(toxicity.Features([w]).word[0]) for w in ("vile", "tree", "own3")}
    assert set(known) == {at["vile"], at["tree"]}
    assert says[list(known).index(at["vile"])] > 3 and abs(says[list(known).index(at["tree"])]) == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.join(labels.where("toxic IS NOT NULL"), "doc_id").select("doc_id", "text", "toxic"), net).where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    bad = [r.predicted for r in rows if r.toxic == 1]
    fine = [r.predicted for r in rows if r.toxic == 0]
    assert len(bad) > 20 and np.mean(bad) >= 0.9 and np.mean(fine) <= 0.05


def test_toxicity_defined_cases(spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (2, None), (1, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs_of(spark), labels)
    rows = toxicity.score(docs_of(spark), net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (1, 2, 4))
    assert toxicity.fit(docs_of(spark), labels.limit(0)) is None
    assert toxicity.score(docs_of(spark), None).where("score > 0").count() == 0
    assert toxicity.score(docs_of(spark).limit(0), net).count() == 0


def test_memory_of_scoring_is_bounded():
    """A task's memory doesn't grow with the different words that it sees."""
    rng = np.random.default_rng(6)
    net = network_of(["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(50)])
    peaks = []
    for n in (100, 200):
        texts = [" ".join("".join(w) for w in rng.choice(list("abcdefghij"), (300, 9))) for _ in range(n)]
        batch = pd.DataFrame({"doc_id": range(n), "text": texts})
        tracemalloc.start()
        assert sum(len(b) for b in toxicity.scorer(net, 0.3)(iter([batch]))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < min(40e6, 1.2 * peaks[0])


def test_long_words_enter_whole(spark):
    """What follows the first 40 characters of a text without spaces enters its score, and no n-gram of it is lost."""
    head, tail = "_".join(["river"] * 10), "_".join(["stone"] * 10)
    texts = [f"{head}_{middle}_{tail}" for middle in ("vile_scum_filth", "tree_cloud_stone")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = network_of([w for t in texts for w in toxicity.words_of(t)])
    scores = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert scores[0] != scores[1]
    rng = np.random.default_rng(5)
    for n in (1, 39, 40, 41, 44, 45, 76, 77, 300):
        text = "".join(rng.choice(list("abcdefg"), n))
        pieces = toxicity.words_of(text)
        grams = lambda t: {t[i : i + k] for k in toxicity.GRAMS for i in range(len(t) - k + 1)}
        assert grams(text) == set().union(*map(grams, pieces)) and all(len(p) <= 40 for p in pieces)


def test_windows_cover_every_word():
    for n in (0, 1, 39, 40, 41, 70, 71, 500):
        ws = toxicity.windows(n)
        assert {i for a, b in ws for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in ws)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) >= 0.95


def test_language_defined_cases(spark):
    net = langid.fit(docs_of(spark))
    rows = langid.predict(docs_of(spark, [*ODD, (9, "123 !?", "en", "s", 6), (10, "é" * 100_000, "fr", "s", 1)]), net).collect()
    got = {r.doc_id: r for r in rows}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 4, 9))
    assert got[10].lang_pred in net.langs
    assert langid.fit(docs_of(spark).limit(0)) is None and langid.predict(docs_of(spark), None).where("lang_pred <> 'und'").count() == 0


def test_network_peaks_are_a_convolution():
    net = langid.train(np.random.default_rng(0).integers(1, 255, (8, langid.LENGTH)).astype(np.uint8), np.arange(8) % 2, ["a", "b"], steps=2, batch=4)
    x = np.random.default_rng(1).integers(0, 255, (3, langid.LENGTH)).astype(np.uint8)
    e = net.embed[x]
    slow = np.stack([[np.max([e[i, t : t + langid.WIDEST].reshape(-1) @ net.filters[:, k] for t in range(langid.STEP)]) for k in range(len(langid.WIDTHS))] for i in range(3)])
    assert np.allclose(net.peaks(x), np.maximum(slow + net.bias, 0), atol=1e-4)


# --- line dedup ---


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdé "), 26)).strip() + str(i) * 3 for i in range(15)]
    rows = []
    for d in range(40):
        ls = []
        for _ in range(5):
            s = list(base[rng.integers(15)])
            for _ in range(rng.integers(0, 4)):
                p = rng.integers(len(s))
                s[p : p + rng.integers(0, 2)] = [str(rng.choice(list("xyz")))] * rng.integers(0, 2)
            ls.append("".join(s))
        rows.append((d, "\n".join([*ls, "short"])))
    occurrences = [(d, p, x.strip(" \t\r")) for d, t in rows for p, x in enumerate(t.split("\n")) if len(x.strip(" \t\r")) >= 20]
    distinct = sorted({x for _, _, x in occurrences})
    par = {x: x for x in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and lev(a, b) <= 2:
                par[find(par, b)] = find(par, a)
    first, gone = {}, set()
    for d, p, x in sorted(occurrences):
        if first.setdefault(find(par, x), (d, p)) != (d, p):
            gone.add((d, p))
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in got.items()} == want and len(gone) > 20
    assert sum(r.n_removed for r in got.values()) == len(gone)


def test_banded_distance_and_segments(spark):
    rng = np.random.default_rng(6)
    words = list({"".join(rng.choice(list("abc"), rng.integers(3, 9))) for _ in range(120)})
    pairs = spark.createDataFrame([(a, b, lev(a, b)) for a in words for b in words[:30]], "a string, b string, d int")
    lines = spark.createDataFrame(list(enumerate(words)), "id long, line string")
    for e in (1, 2):
        assert pairs.where(line_dedup.within(F.col("a"), F.col("b"), e) != (F.col("d") <= e)).count() == 0
        near = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and lev(a, b) <= e and min(len(a), len(b)) > e]
        keys, own = line_dedup.entries(e)
        index, probes = lines.select(F.col("id").alias("a"), F.explode(F.array(*[keys[i] for i in own])).alias("key")), lines.select(F.col("id").alias("b"), F.explode(F.array(*keys)).alias("key"))
        met = {(r.a, r.b) for r in index.join(probes, "key").select("a", "b").collect()}
        assert near and all((i, j) in met or (j, i) in met for i, j in near)
        k = e + 2
        ordered = pairs
        for columns in (line_dedup.by_length("a", "b"), *line_dedup.cores()):
            ordered = ordered.withColumns(columns)
        same = (F.col("_n") == 0) & (F.length("_longer") <= e) | (F.col("_n") > 0) & line_dedup.within(F.col("_longer"), F.col("_shorter"), e)
        assert ordered.where(same != (F.col("d") <= e)).count() == 0
        ordered = pairs.withColumns(line_dedup.by_length("a", "b")).withColumn("_n", F.length("_shorter"))
        assert ordered.where((F.col("d") <= e) & (F.col("_n") >= k) & ~line_dedup.mostly_there(e, k)).count() == 0


@pytest.mark.parametrize("edits,small,short", [(1, 2, 3), (2, 2, 3)])
def test_hot_lines_against_brute_force(spark, monkeypatch, edits, small, short):
    """Every link is one, and links join what brute force joins, in families with edits and repeats of all kinds."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "SHORT", short)
    monkeypatch.setattr(line_dedup, "BLOCKS", 3)
    rng = np.random.default_rng(11 + edits)
    lines = set()
    for base in ("the quick brown fox jumps", "abababababababab", "aaaaaaaaaaaa"):
        for _ in range(90):
            x = list(base)
            for _ in range(rng.integers(0, 5)):
                q = rng.integers(len(x))
                x[q : q + rng.integers(0, 2)] = [str(rng.choice(list("abé")))] * rng.integers(0, 2)
            lines.add("".join(x))
    lines = sorted(x for x in lines if len(x) >= 4)
    par, close = {i: i for i in range(len(lines))}, set()
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if abs(len(a) - len(lines[j])) <= edits and lev(a, lines[j]) <= edits:
                close.add((i, j))
                par[find(par, j)] = find(par, i)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {(r.a, r.b) for r in line_dedup.near_at_hot(df, edits).collect()}
    assert got <= close and len(got) > 50
    mine = {i: i for i in range(len(lines))}
    for i, j in got:
        mine[find(mine, j)] = find(mine, i)
    group = lambda p: {frozenset(i for i in p if find(p, i) == r) for r in {find(p, i) for i in p}}
    assert group(mine) == group(par)


def test_lines_hot_segment(spark, monkeypatch):
    """Far more lines than HOT share a segment; near ones among them are still found."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    rng = np.random.default_rng(9)
    rows = [(d, "the same long beginning of a line " + "".join(rng.choice(list("abc"), 4)) + " and the same long end of a line") for d in range(120)]
    distinct = sorted({t for _, t in rows})
    par = {x: x for x in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if lev(a, b) <= 2:
                par[find(par, b)] = find(par, a)
    want = len({find(par, x) for x in distinct})
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("text <> ''").count() == want


def test_rows_of_a_shared_segment_grow_with_its_lines(spark):
    """Lines that share a segment meet in few rows each, not in all pairs, in groups of any size."""
    rng = np.random.default_rng(12)
    for n in (6, 24, 96):
        rows = [(d, "the same beginnings " + "".join(rng.choice(list("abcdefghijklmnop"), 40))) for d in range(n)]
        lines = line_dedup.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), 20)
        probes, own = line_dedup.entries(2)
        names = [f"k{i}" for i in range(len(probes))]
        keyed = lines.select("id", *[k.alias(c) for k, c in zip(probes, names, strict=True)])
        assert n <= line_dedup.meetings(keyed, names, own).count() <= 2 * n


def test_lines_of_one_text_with_changes(spark, monkeypatch):
    """Copies of one long line with a few edits anywhere, far more than HOT: the groups are those of brute force, with few pairs."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(40)]
    for filler in ("", "ababababababababab"):  # the second repeats itself
        lines = []
        for _ in range(120):
            w = [*words[:20], filler, *words[20:]]
            w[rng.integers(0, 41)] = "".join(rng.choice(list("xyz"), rng.integers(2, 7)))
            x = list(" ".join(w))
            for _ in range(rng.integers(0, 3)):
                q = rng.integers(len(x))
                x[q : q + rng.integers(0, 2)] = ["é"] * rng.integers(0, 2)
            lines.append("".join(x))
        lines += [" ".join([*words[:20], filler, *words[20:]])[k:] for k in range(3)]
        distinct = sorted(set(lines))
        par = {x: x for x in distinct}
        for i, a in enumerate(distinct):
            for b in distinct[i + 1 :]:
                if abs(len(a) - len(b)) <= 2 and lev(a, b) <= 2:
                    par[find(par, b)] = find(par, a)
        got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
        assert got.where("text <> ''").count() == len({find(par, x) for x in distinct}) < len(distinct)


def test_lines_that_differ_in_one_part_alone_are_not_narrowed_down(spark, monkeypatch):
    """Lines with another word in their last part have no edits in two parts, whichever way they are shifted."""
    made, one_edit = [], line_dedup.one_edit

    def counted(nodes):
        made.append(nodes.count())
        return one_edit(nodes)

    monkeypatch.setattr(line_dedup, "one_edit", counted)
    rng = np.random.default_rng(14)
    lines = ["thirty characters of beginning and " + "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12)]
    rows = spark.createDataFrame([(7, i, x, 0, 0) for i, x in enumerate(lines)], "key long, id long, s string, less int, side int")
    assert line_dedup.apart_twice(line_dedup.in_two_parts(rows)).count() == 0
    assert sum(made) == 0


def test_lines_defined_cases(spark):
    got = line_dedup.dedup_lines(docs_of(spark)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.text) for r in got} == {(r[0], r[1]) for r in ODD}
    rows = [(1, "x" * 30 + "\nkeep this"), (2, " " + "x" * 30 + "\r"), (None, "x" * 30)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].text, got[None].text) == (0, "", "")
    assert line_dedup.dedup_lines(docs_of(spark).limit(0)).count() == 0


def test_lines_run_no_python(spark):
    plan = line_dedup.dedup_lines(docs_of(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --- personal data ---

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            luhn = sum(int(c) * (i % 2 + 1) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(d[::-1]))
            return 16 <= len(d) <= 19 and luhn % 10 == 0
        return k == "email" or 8 <= len(d) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in FORMS for m in re.finditer(FORMS[k], t or "") if ok(k, m.group()))


def test_pii_base_spans(spark):
    rng = np.random.default_rng(7)
    texts = ["a@b.c_d@e.f g", "x@y. z@w.q..r", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (383) 555-6083 +4 12-", "é4111111111111111é", None, "", "9" * 20_000, "1 " * 20_000]
    texts += ["".join(rng.choice(list("12 .-+@a(9)4"), 150)) for _ in range(150)] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("key", "base", "kind", "pattern", "spans")})
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), t
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"call me at tel: +1 (383) 555-{1000 + i} soon") for i in range(9)] + [(100, "call me at tel: 0383/5551234, soon"), (101, "the year 1999 was fine"), (102, "tel: word")]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    at = rows[9][1].index("0383")
    assert got[100].spans == f"phone:{at}:{at + 12}" and got[100].n_phone == 0
    assert got[101].spans == got[102].spans == ""


def test_pii_discovers_over_generations(spark):
    """What is found behind one pattern makes another sure that has no seed, and that one discovers more."""
    rows = [(i, f"call tel: +1 (383) 555-{1000 + i} soon") for i in range(90)]
    rows += [(400 + i, f"call tel: +1 (383) 666-{1000 + i} soon") for i in range(90)]
    rows += [(100 + i, f"call tel: 0383/{7000 + i} soon") for i in range(8)] + [(200 + i, f"send by fax line 0383/{7000 + i} today") for i in range(8)]
    rows += [(300, "send by fax line 0999/1234 today"), (301, "in the year 1999 it was"), (302, "in the year 0383/7000 too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert all(got[d].startswith("phone:") for d in (*range(100, 108), *range(200, 208), 300)) and got[301] == got[302] == ""


def test_pii_patterns_of_several_shapes(spark):
    """The word after, one word before words that differ, and secrets, which only a sure pattern adds."""
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("bcdfgh"), 7))
    rows = [(i, f"{word()} {word()} a{i}@b.example is-mailbox {word()}") for i in range(9)] + [(20, f"{word()} {word()} joe-at-b4 is-mailbox {word()}")]
    rows += [(30 + i, f"{word()} ip: 10.0.0.{i} {word()}") for i in range(9)] + [(40, f"{word()} ip: 10-0-0-77 {word()}")]
    rows += [(50 + i, f'{word()} token = "{rng.integers(10**12, 10**13)}abcdef{i}ab"; {word()}') for i in range(6)] + [(60, f'{word()} token = "s3cret" {word()}'), (61, f"{word()} {rng.integers(10**12, 10**13)}abcdefab {word()}")]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    texts = dict(rows)
    span = lambda i, kind, t: f"{kind}:{texts[i].index(t)}:{texts[i].index(t) + len(t)}"
    assert got[20].spans == span(20, "email", "joe-at-b4") and got[20].n_email == 0 and (got[20].n_added, got[20].n_spans) == (1, 1)
    assert got[40].spans == span(40, "ip", "10-0-0-77") and got[60].spans == span(60, "secret", "s3cret")
    assert all(got[50 + i].spans.startswith("secret:") for i in range(6)) and got[61].spans == ""
    assert all((got[i].n_email, got[i].n_added) == (1, 0) for i in range(9))


def test_pii_scores_against_plain_graph(spark):
    rng = np.random.default_rng(14)
    rows = [(f"p{rng.integers(12)}", f"i{rng.integers(90)}") for _ in range(900)]
    kind = {f"i{i}": int(i % 2) for i in range(60)}
    heavy = [("mine", f"i{i}") for i in range(0, 24, 2)] + [("mine", "i70"), ("mine", "i71"), ("next", "i70"), ("next", "i71")] + [("next", f"i{i}") for i in range(0, 30, 2)] + [("mine", "new"), ("next", "other"), ("next", "new")]
    found = [(p, i, kind.get(i)) for p, i in rows + heavy]
    edges = collections.defaultdict(set)
    for p, i, _ in found:
        edges[p].add(i)
    edges = {p: x for p, x in edges.items() if len(x) >= pii.SUPPORT}
    sure = {}
    while True:
        scores = {}
        for p, x in edges.items():
            for k in (0, 1):
                w = [1.0 if kind.get(i) == k else 1 - np.prod([max(1e-9, 1 - s) for (q, kk), s in sure.items() if kk == k and q != p and i in edges[q]]) for i in x]
                scores[p, k] = sum(w) / len(x)
        more = {pk: s for pk, s in scores.items() if s >= pii.SURE}
        if len(more) == len(sure):
            break
        sure = more
    got = {(r.pattern, r.kind): r.score for r in pii.sure_patterns(spark.createDataFrame(found, "pattern string, instance string, kind int")).collect()}
    assert set(got) == set(sure) and len(sure) >= 2
    assert got == pytest.approx({k: scores[k] for k in sure}, abs=1e-6)


def test_pii_runs_no_python(spark):
    plan = pii.digest(pii.find_personal_data(docs_of(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --- shared ---


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    par = {x: x for e in edges for x in e}
    for a, b in edges:
        p, q = find(par, a), find(par, b)
        par[max(p, q)] = min(p, q)
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(par, x) for x in par if find(par, x) != x}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("lang"))
    a = sampling.labelled_sample(rows, "lang", 300, "doc_id")
    n = {r.lang: r["count"] for r in a.groupBy("lang").count().collect()}
    assert n["rare"] == 200 and 200 < n["often"] < 400
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in sampling.labelled_sample(rows.repartition(5), "lang", 300, "doc_id").collect()}
