"""Periodic runs against a search of every lag."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from cohort.llm import periodic_runs
from cohort.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Runs (start, length, period) by start and period: maximal equal stretches of every lag, without those of a smaller period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def made(rng):
    """Random words, with stretches of many periods, some cut short, doubled or continued from what stands before."""
    letters, words = rng.choice([1, 2, 3, 5, 50]), []
    if rng.random() < 0.3:
        return [str(rng.randrange(letters)) for _ in range(rng.randint(0, 200))]
    while len(words) < 260:
        period = rng.choice([1, 2, 3, 7, 11, 15, 16, 17, 31, 32, 33, 40, 63, 64, 65])
        base = words[-period:] if words and rng.random() < 0.3 else [str(rng.randrange(letters)) for _ in range(period)]
        words += [base[i % len(base)] for i in range(rng.randint(1, period * rng.choice([1, 2, 3, 5]) + 1))]
        if rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)):]
    return words[:360]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = [made(rng) for _ in range(60)]
    count, runs, collapsed = periodic_runs._search([" ".join(d).encode() for d in docs], 12)
    want = [brute(d) for d in docs]
    assert count == [len(d) for d in docs] and [[(r["start"], r["length"], r["period"]) for r in x] for x in runs] == want
    assert collapsed == [collapse(d, r) for d, r in zip(docs, want, strict=True)] and sum(map(len, want)) > 100


def test_query_equals_brute_force_on_documents(spark, small, documents):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    assert len(got) == documents.count()
    checked = 0
    for row in documents.collect():
        words, h = WORD.findall(row["text"] or ""), zlib.crc32(str(row["doc_id"]).encode())
        n, g = len(words), h // 10
        if n > 900:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (row["doc_id"], n, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest())
        assert tuple(got[row["doc_id"]]) == want
        checked += h % 10 == 0
    assert checked >= 10


def test_edges(edge, empty):
    rows = periodic_runs.periodic_runs(edge).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and len(got) == 9
    for k in (1, 2, 3):
        assert got[k]["n_words"] == 0 and got[k]["runs"] == [] and got[k]["collapsed"] == ""
    assert [tuple(r) for r in got[7]["runs"]] == [(0, 30000, 1)] and got[7]["collapsed"] == "word"
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 78, 26)] and got[None]["runs"] == [] and got[8]["collapsed"].startswith("émile")
    out = periodic_runs.digest(periodic_runs.periodic_runs(edge)).where("doc_id = 1").first()
    assert out["n_runs"] == 0 and out["start"] is None and out["exponent_milli"] is None and out["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.periodic_runs(empty).count() == 0
    assert edge.select("doc_id", periodic_runs.planted(edge).alias("text")).count() == 10


def test_very_long_text_in_near_linear_time():
    words = [b"x%d" % (i % 20_000) for i in range(100_000)] + [b"y"] * 200_000 + [b"a", b"b"] * 50_000
    began = time.time()
    _, runs, collapsed = periodic_runs._search([b" ".join(words)], 12)
    assert [tuple(r.values()) for r in runs[0]] == [(0, 100_000, 20_000), (100_000, 200_000, 1), (300_000, 100_000, 2)]
    assert len(collapsed[0].split()) == 20_003 and time.time() - began < 30


def test_short_extension_is_exact_at_the_ends():
    ids = np.array([9, 1, 2, 3, 1, 2, 3, 8])
    hashes = [periodic_runs._mix(ids.astype(np.uint64), 0)]
    assert periodic_runs._extend(hashes, np.array([1]), np.array([4]), 1)[0] == 3 and periodic_runs._extend(hashes, np.array([4]), np.array([7]), -1)[0] == 3
