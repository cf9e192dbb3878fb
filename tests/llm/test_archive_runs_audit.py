"""The archive, periodic runs and the filter audit against brute force and round trips, and their defined cases."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelineage.llm import filter_audit, periodic, queries, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- archive ---

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, None, None), (4, "http://b\r\n/x", ""),
    (None, "http://c", "<p>same</p>"), (None, "http://c", "only here"), (5, "http://d", "body with\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (-6, "http://é", "ünï \U0001f600"),
]


def pages_of(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("mine") for c in ("sha256", "payload", "header", "sha1", "n_bytes", "response_id", "record_type")})


def want_records(rows, min_bytes):
    last = {}
    for i, _, html in rows:
        last[html or ""] = max((x for x in (last.get(html or ""), i) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = last[html or ""]
        revisit = len(data) >= min_bytes and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 1, 100])
def test_archive_gives_records(spark, tmp_path, min_bytes):
    warc.write(pages_of(spark), str(tmp_path / "a"), min_bytes)
    got = sorted((tuple(r) for r in warc.read(spark, str(tmp_path / "a")).collect()), key=repr)
    assert got == want_records(PAGES, min_bytes)
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == stored.select("payload").distinct().count() == len({h or "" for _, _, h in PAGES})


def test_archive_files_round_trip(spark, tmp_path):
    warc.write(pages_of(spark), str(tmp_path / "a"))
    whole = warc.records(spark, str(tmp_path / "a")).collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in whole), key=repr) == sorted(((i, (h or "").encode()) for i, _, h in PAGES), key=repr)
    warc.export(spark, str(tmp_path / "a"), str(tmp_path / "files"), records_per_file=3)
    back = sorted((r.header.encode() + bytes(r.content)) for r in warc.load(spark, str(tmp_path / "files")).collect())
    assert back == sorted(bytes(r.record) for r in whole)
    for r in whole:
        head = r.header.split("\r\n")
        assert head[0] == "WARC/1.1" and r.header.endswith("\r\n\r\n") and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= {x.split(":")[0] for x in head}
        length = int(re.search(r"Content-Length: (\d+)", r.header)[1])
        assert len(r.record) == len(r.header.encode()) + length


def test_archive_notices_wrong_bytes(spark, tmp_path):
    warc.write(pages_of(spark), str(tmp_path / "a"))
    good = spark.read.parquet(str(tmp_path / "a/payloads"))
    bad = good.withColumn("payload", F.when(F.octet_length("payload") == 11, F.encode(F.lit("<p>lame</p>"), "utf-8")).otherwise(F.col("payload")))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not match its address"):
        warc.read(spark, str(tmp_path / "b")).collect()
    good.where("octet_length(payload) <> 11").write.parquet(str(tmp_path / "c/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "c/headers"))
    with pytest.raises(Exception, match="payload is missing"):
        warc.read(spark, str(tmp_path / "c")).collect()


def test_archive_of_nothing(spark, tmp_path):
    warc.write(pages_of(spark, []), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


# --- periodic runs ---


def brute_runs(w, least=24, times=3):
    """Every maximal stretch of every period, by comparing words, with its smallest period tried in turn."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = w[i : i + length]
                if all(any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def noisy(rng):
    n, k = rng.randrange(0, 150), rng.choice([1, 2, 3, 5, 20])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, p = rng.randrange(n + 1), rng.randrange(1, max(2, n // 4))
        for i in range(a, min(n, a + rng.randrange(24, 90))):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_and_lags_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = noisy(rng)
        ids = np.array(w, np.int64)
        assert periodic.find_runs(ids) == brute_runs(w)
        assert periodic.find_runs(ids, 6, 2) == brute_runs(w, 6, 2)
        if len(w) > 3:
            for heavy in (0, 2, 10**6):
                counts = periodic.lag_counts(ids, len(w) // 3, heavy)
                assert counts.tolist() == [0] + [sum(a == b for a, b in zip(w, w[q:], strict=False)) for q in range(1, len(w) // 3 + 1)]


def test_lags_in_blocks(monkeypatch):
    rng = random.Random(2)
    ids = np.array([rng.randrange(4) for _ in range(900)])
    whole = periodic.lag_counts(ids, 300, 10**6)
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert (periodic.lag_counts(ids, 300, 10**6) == whole).all()
    assert (periodic.lag_counts(ids, 300, 0) == whole).all()


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**6 // r[2], -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        digest("".join("{},{},{}\n".format(*r) for r in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_of_texts(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(f"w{x}\x1f " if x % 2 else "ü" * (x + 1) for x in noisy(rng))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \r\n "), (103, "a " * 5000), (103, "a " * 5000), (None, "x y " * 12), (104, "x y " * 11), (105, " ".join(["a b c"] * 9 + ["z"] + ["a b"] * 15))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("runs", "start", "length", "n_runs", "collapsed")})
    got = periodic.detect(docs).drop("runs", "collapsed").collect()
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted((brute_row(*r) for r in rows), key=key)
    assert periodic.detect(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.collapsed for r in periodic.detect(docs.where("doc_id IN (103, 105)")).collect()}
    assert kept == {103: "a", 105: "a b c z a b"}


def looped(doc_id, text):
    """The contract's rule, word by word."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op12_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    small = {i: t for i, t in docs.items() if len(t or "") < 4000}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert set(got) == set(docs) and sum(r[1] > 0 for r in got.values()) >= 10
    for i, t in small.items():
        assert got[i] == brute_row(i, " ".join(looped(i, t)))


def test_loops_follow_the_rule(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(400)] + [(None, "a b"), (5, None)]
    got = queries.with_loops(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [WORD.findall(r.text or "") for r in got[:400]] == [looped(*r) for r in rows[:400]]
    assert [r.text for r in got[400:]] == ["a b", None]


# --- filter audit ---


def test_swaps_visit_every_order():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for i in filter_audit.swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(k)))


def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((part or "", {f for f, x in bad.items() if x}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(queries.op13_filter_audit(spark, DATA)) == brute_audit(docs, labels)


def test_audit_defined_cases(spark):
    long_ = " ".join(f"w{i}" for i in range(300))
    docs = [(1, None, None), (2, "", "s"), (3, long_, "s"), (3, long_, "s"), (9, long_, None), (4, long_ + " A", "s"), (None, long_, "s"), (5, "LOUD $", "t"), (6, "word " * 20000, "")]
    labels = [(3, 1, 0), (3, 0, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (77, 1, 1)]
    made = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("mask", "part", "good", "toxic", "n", "digest", "step", "quality")})
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("mine"))
    found = filter_audit.audit(made, tags)
    assert rows_of(found) == brute_audit(docs, labels)
    assert found.count() == 3 * 120 * 5
    assert filter_audit.audit(made.limit(0), tags).count() == 0
    assert filter_audit.audit(made, tags.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 4), f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"L": F.length("text") > 2}, repeats="R").collect()
    assert len(got) == 2 * 2 * 2
    assert {(r.part, r.filter_order[r.step - 1]): r.shapley for r in got} == {("s0", "L"): 0, ("s0", "R"): 36, ("s1", "L"): 11, ("s1", "R"): 27}
