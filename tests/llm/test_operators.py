"""Operators against brute force, round trips, held-out accuracy, and their documented edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohort.llm import byte_bpe, common, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, mixing, quality_rules, substring_dedup, toxicity
from cohort.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_all_queries_are_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_jaccard_join_equals_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(documents).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_of_many_near_copies(spark):
    random = np.random.Generator(np.random.PCG64(3))
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in random.integers(0, 120, 3):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def template(n, changed, seed):
    """Texts that share a template and mostly don't link: changed words of 120 are drawn for each from few others."""
    random = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(120)]
        for k in random.integers(0, 120, changed):
            words[k] = f"x{k}_{random.integers(2)}"
        rows.append((i, " ".join(words)))
    return rows


def watched(monkeypatch, module):
    """Rows of what the module writes, by name."""
    rows, write = defaultdict(list), module.materialise

    def counted(df, name):
        out = write(df, name)
        rows[name].append(out.count())
        return out
    monkeypatch.setattr(module, "materialise", counted)
    return rows


@pytest.mark.parametrize("block", [1024, 40])
def test_jaccard_join_of_a_template_makes_no_row_per_pair(spark, monkeypatch, block):
    rows = template(150, 6, 4) + [(1000 + i, t + " end") for i, t in template(10, 6, 4)]
    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    monkeypatch.setattr(jaccard_join, "links_by_merging", lambda docs, *_: docs.sparkSession.createDataFrame([], "x long, y long"))
    written = watched(monkeypatch, jaccard_join)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 50
    assert sum(written["candidates"]) < 10 * len(rows) and all(got[1000 + i][1] == got[i][1] for i in range(10))


def test_line_links_of_a_template_make_no_row_per_pair(spark, monkeypatch):
    rows = template(200, 6, 6)
    written = watched(monkeypatch, substring_dedup)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.lines(docs, *substring_dedup.tune()).cache()
    classes = found.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("rep"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    cluster = dict(common.components(substring_dedup.line_links(docs, classes), "x", "y").collect())
    key = {r["doc_id"]: cluster.get(r["key"], r["key"]) for r in found.collect()}
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    assert all((key[i] == key[j]) <= (want[i] == want[j]) for i in want for j in want)
    assert sum(written["line-pairs-apart"]) < 20 * len(rows) and "line-pairs-apart" in written


def test_merged_lists_equal_brute_force():
    rows = template(120, 3, 8) + [(200, "alone " * 3), (201, "quite another text than all of these")]
    sets = [np.array(sorted(hash(x) % 2**63 for x in shingle_set(t)), np.uint64) for _, t in rows]
    want = brute_components(rows)
    for block in (None, np.array([i % 2 for i, _ in rows])):
        pairs = jaccard_join.merged(sets, np.arange(len(rows)), block, None)
        top = list(range(len(rows)))
        for x, y in pairs:
            assert block is None or block[x] != block[y]
            a, b = top[x], top[y]
            top = [min(a, b) if t in (a, b) else t for t in top]
        assert len(pairs) < len(rows)
        if block is None:
            assert [rows[t][0] for t in top] == [want[i][1] for i, _ in rows] and 2 < len(set(top)) < 120
    ones = np.zeros((len(rows), 1), np.int64)
    assert not len(jaccard_join.merged(sets, np.arange(len(rows)), None, np.arange(len(rows))[:, None])) and len(jaccard_join.merged(sets, np.arange(len(rows)), None, ones))


def _hashes(text):
    return next(jaccard_join.S.sets(pa.array([text])))[1]


def test_jaccard_join_meets_a_shingle_that_takes_the_place_of_a_long_list(spark, monkeypatch):
    """x lies in y, whose further shingles come first by hash; the phrase that both begin with is in a long list."""
    low, rng = np.uint64(int(0.2 * 2**64)), np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    phrase = next(p for p in (" ".join(word() for _ in range(5)) for _ in range(1000)) if _hashes(p)[0] < low)
    x = next(t for t in (" ".join([phrase, *(word() for _ in range(15))]) for _ in range(5000)) if (_hashes(t) < low).sum() == 1)
    y = x
    for _ in range(4):
        y = next(t for t in (f"{y} {word()}" for _ in range(1000)) if (_hashes(t) < low).sum() > (_hashes(y) < low).sum())
    rows = [(1, x), (2, y)] + [(10 + k, " ".join([phrase, *(word() for _ in range(15))])) for k in range(60)]
    monkeypatch.setattr(jaccard_join, "links_by_merging", lambda docs, *_: docs.sparkSession.createDataFrame([], "x long, y long"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and got[2] == (20, 1)


def test_jaccard_join_with_copies_before_the_one_that_stands_for_them(spark, monkeypatch):
    """The copies' ids, 2**24 more and null, have the bits of ids that stand for a class."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(5 + 2**24, text("a")), (5, text("a")), (6, text("a") + " more"), (None, text("b")), (7, text("b")), (8, text("b") + " more"), (0, text("c"))]
    monkeypatch.setattr(jaccard_join, "links_by_merging", lambda docs, *_: docs.sparkSession.createDataFrame([], "x long, y long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {5 + 2**24: 5, 5: 5, 6: 5, None: 7, 7: 7, 8: 7, 0: 0}


def test_jaccard_join_edges(edge, empty):
    rows = jaccard_join.jaccard_join(edge).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == 10 and got[1] == (0, 1) and got[3] == (0, 3) and got[4] == (1, 4) and got[6][1] == 5
    assert got[7] == (1, 7) and got[None][0] == 6
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_exact_dedup(edge, empty, documents):
    rows = documents.select("doc_id", "text").collect()
    keep, size = {}, Counter()
    for r in rows:
        keep[r["text"]] = max(keep.get(r["text"], -1), r["doc_id"])
        size[r["text"]] += 1
    want = {(r["doc_id"], keep[r["text"]], size[r["text"]], keep[r["text"]] == r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows}
    assert {tuple(r) for r in exact_dedup.exact_dedup(documents, capacity=16).collect()} == want
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(edge).collect()]
    assert (1, 2, 2, False) in got and (2, 2, 2, True) in got and got.count((4, 4, 2, True)) == 2 and (None, None, 1, True) in got and len(got) == 10
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    found = exact_dedup.directory(keys, 100)
    assert sum(2.0 ** -d for d, _ in found) == 1.0
    size = Counter()
    for r in keys.collect():
        size[next((d, p) for d, p in found if (r["key"] & (2**64 - 1)) >> (64 - d) == p)] += 1
    assert max(size.values()) <= 100 and sum(size.values()) == 3000


def test_byte_bpe_equals_tiktoken(edge, empty, documents):
    import tiktoken
    path, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    odd = edge.select("doc_id", "text").unionByName(documents.select("doc_id", "text").limit(60)).collect()
    df = edge.sparkSession.createDataFrame([(k, r["text"]) for k, r in enumerate(odd)] + [(999, "<|endoftext|> it's  \n\n 12345 á \U0001F468‍\U0001F469")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in byte_bpe.encode(df, path, pattern, offsets=True).collect():
        ids = np.frombuffer(r["ids_le"], "<u4").tolist()
        text = texts[r["doc_id"]]
        assert ids == own.encode_ordinary(text) and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert all(a < b for a, b in zip(r["starts"], r["ends"], strict=True)) and (not ids or r["ends"][-1] == len(text))
    coded = byte_bpe.encode(df, path, pattern)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(coded, path, pattern).collect()} == texts
    assert byte_bpe.encode(empty, path, pattern).count() == 0


def test_mixing(edge, empty, documents):
    rows = mixing.mix(documents).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s] + 1e-6 for s in size)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    placed = [r["position"] for r in rows if r["position"] is not None]
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1
    again = {(r["doc_id"], r["taken"], r["position"]) for r in mixing.mix(documents.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"], r["position"]) for r in rows}
    got = mixing.mix(edge).collect()
    assert len(got) == 10 and all(r["taken"] == 0 for r in got if r["size"] == 0) and mixing.mix(empty).count() == 0


def test_targets_share_the_excess():
    assert mixing.shares([10, 0, 90], [1, 2, 3]) == [25.0, 0.0, 75.0]
    assert mixing.shares([1, 1, 98], [1, 2, 1]) == [3.0, 3.0, 94.0]


def brute_quality(text):
    words = WORD.findall(text or "")
    seen = defaultdict(list)
    for k in range(len(words) - 7):
        seen[tuple(words[k:k + 8])].append(k)
    repeat = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_quality_rules(edge, empty, documents):
    both = edge.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).withColumn("i", F.monotonically_increasing_id())
    texts = {r["i"]: r["text"] for r in both.collect()}
    for r in quality_rules.quality_rows(both, "i").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(texts[r["i"]])
        assert not (r["kept"] and r["base_failed"]) and r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    rules = quality_rules.standard_rules()
    one, two = (quality_rules.judge(documents.select("doc_id", "text"), list(x)).select("doc_id", "kept").collect() for x in (rules, rules[::-1]))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert quality_rules.quality_rows(empty).count() == 0 and quality_rules.keep_good(edge).columns == edge.columns


def test_line_dedup(spark, edge, empty):
    rows = [(k, f"own line of text {k}\nthe same line on every site\n  shared by a few sites only ", f"s{k}" if k < 12 else "s0") for k in range(30)]
    rows = [(i, t if i < 5 or i > 11 else t.replace("  shared by a few sites only ", f"only here, number {i}"), s) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.remove_boilerplate(df).collect()}
    assert got == {i: (1, "\n".join(x for x in t.split("\n") if x != "the same line on every site")) for i, t, _ in rows}
    assert line_dedup.remove_boilerplate(edge).count() == 10 and line_dedup.remove_boilerplate(empty).count() == 0


def test_substring_dedup(spark, edge, empty):
    random = np.random.Generator(np.random.PCG64(1))
    prose = lambda n: " ".join(f"v{x}" for x in random.integers(0, 5000, n))
    passage, line = prose(51), prose(60)
    near = line.split()
    near[30] = "other"
    rows = [(k, prose(200)) for k in range(20)]
    rows += [(100 + k, f"{prose(40)} {passage} {prose(40)}") for k in range(3)] + [(200, f"{prose(9)}\n{line}\n{prose(9)}"), (201, f"{prose(9)}\n{' '.join(near)}")]
    rows += [(300, rows[0][1]), (400, f"{prose(30)} {prose(12)}")]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {100, 101, 102, 200, 201, 0, 300}
    assert {r["doc_id"] for r in found if r["removed"]} == {101, 102, 201, 300}
    assert substring_dedup.repeated_passages(empty).count() == 0
    substring_dedup.repeated_passages(edge).collect()


def test_each_passage_of_a_run_keeps_a_copy(spark):
    """5 holds A and B next to each other, 2 holds B, 9 holds A, 10 holds A and B with words of its own between them."""
    random = np.random.Generator(np.random.PCG64(4))
    prose = lambda n: " ".join(f"v{x}" for x in random.integers(0, 10**6, n))
    a, b = prose(60), prose(60)
    docs = [(2, f"{prose(200)} {b}"), (5, f"{a} {b} {prose(200)}"), (9, f"{prose(200)} {a}"), (10, f"{prose(300)} {a} own1 own2 own3 {b}")]
    words = {i: t.split() for i, t in docs}
    left = {i: [True] * len(w) for i, w in words.items()}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r["n_words"] == r["end"] - r["start"]
        for k in range(r["start"], r["end"]) if r["removed"] else ():
            left[r["doc_id"]][k] = False
    kept = {w for i in words for w, there in zip(words[i], left[i], strict=True) if there}
    assert kept == {w for own in words.values() for w in own}
    assert all(left[2]) and all(left[5][:60]) and sum(left[5][60:120]) < 32
    assert sum(left[9][200:]) < 32 and sum(left[10][300:]) < 64 and all(left[10][360:363])


def test_line_links_of_a_template(spark):
    """200 couples of near copies whose lines share a template: a bucket's smallest line and a neighbour are mostly no link."""
    random = np.random.Generator(np.random.PCG64(2))
    rows = []
    for i in range(200):
        words = [f"w{k}" for k in range(100)]
        for k in random.integers(0, 100, 3):
            words[k] = f"x{i}_{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:50], f"y{i}", *words[51:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.lines(docs, *substring_dedup.tune()).cache()
    classes = found.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("rep"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    cluster = dict(common.components(substring_dedup.line_links(docs, classes), "x", "y").collect())
    key = {r["doc_id"]: cluster.get(r["key"], r["key"]) for r in found.collect()}
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    assert all((key[i] == key[j]) == (want[i] == want[j]) for i in want for j in want)


def test_lines_that_meet_no_other_go_no_further_than_their_signatures(spark, monkeypatch):
    random = np.random.Generator(np.random.PCG64(8))
    prose = lambda n: " ".join(f"v{x}" for x in random.integers(0, 10**6, n))
    line = prose(60)
    rows = [(i, prose(40)) for i in range(300)] + [(1000, line), (1001, f"{line} end"), (1002, line), (1003, None)]
    written = watched(monkeypatch, substring_dedup)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["first_doc"], r["removed"]) for r in found} == {(1000, 1000, False), (1001, 1000, True), (1002, 1000, True)}
    assert written["lines"] == [303] and written["line-classes"] == [2] and "windows" not in written
    signed = substring_dedup.lines(docs, *substring_dedup.tune())
    for r in substring_dedup.line_classes(signed).collect():  # what stands for buckets of one class is no bucket
        assert r["rep"]["doc_id"] in (1000, 1001) and 0 < sum(b != r["key"] for b in r["bands"]) <= len(r["bands"])


@pytest.mark.parametrize("key_range", [3, 40])
def test_line_classes_lose_no_bucket_of_two(spark, key_range):
    """Random buckets: what line_links takes from the classes kept is what it takes from all of them."""
    random = np.random.Generator(np.random.PCG64(key_range))
    bands = [[int(b) * 10 + i for i, b in enumerate(random.integers(0, key_range * 20, 4))] for _ in range(40)]
    rows = [(1000 + k, d, 0, 20, 16, bands[k]) for k in range(40) for d in range(k, k + 1 + k % 2)]  # every other class has two lines
    signed = spark.createDataFrame(rows, "key long, doc_id long, start long, words long, n long, bands array<long>")
    met = defaultdict(set)
    for r in rows:
        for b in r[5]:
            met[b].add(r[0])
    want = {(r[0], i, b) for r in rows for i, b in enumerate(r[5]) if len(met[b]) > 1}
    kept = substring_dedup.line_classes(signed).collect()
    assert {(r["key"], i, b) for r in kept for i, b in enumerate(r["bands"]) if b != r["key"]} == want
    assert {(r["key"], r["rep"]["doc_id"], r["n"]) for r in kept} == {(k, min(r[1] for r in rows if r[0] == k), 16) for k in {x[0] for x in want}}


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    spark.sparkContext.setJobGroup("few-links", "components")
    try:
        got = dict(common.components(links, few=common.FEW_LINKS).collect())
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert got == dict.fromkeys(range(201), 0) and len(jobs) <= 10


def test_components_by_rounds_and_in_one_task_agree(spark):
    random = np.random.Generator(np.random.PCG64(3))
    links = [(int(a), int(b)) for a, b in random.integers(-300, 300, (250, 2))] + [(None, 1), (5, 5), (9, None)]
    df, got = spark.createDataFrame(links, "u long, v long"), {}
    for most in (0, 100, 1 << 16):
        got[most] = sorted(map(tuple, common.components(df, few=most).collect()))
    assert got[0] == got[100] == got[1 << 16] and len({c for _, c in got[0]}) > 20


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(50)] + [(7, 7), (None, 3)]
    got = dict(common.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(51)}


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav>{}<footer>&copy; foot</footer></body></html>"


def test_html_extraction(spark):
    pages = [
        (1, "http://a.b/x/1", PAGE.format("<div class='ad'>buy</div><article><h1>Head &amp; Tail</h1><p>One<br>two <b>three\n four</b><p>Five</p></article><div id='comments'><p>hi</p></div>")),
        (2, "http://a.b/x/2", PAGE.format("<p>Template line</p><p>Text of two</p><p>Template end</p>")),
        (3, "http://a.b/x/3", PAGE.format("<p>Template line</p><p>Text of three</p><p>Template end</p>")),
        (4, None, None), (5, "odd", "<p>open <b>text &lt;ok&gt; &#233;"), (5, "odd", "<p>open <b>text &lt;ok&gt; &#233;"),
    ]
    got = defaultdict(list)
    for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == ["Head & Tail\n\nOne two three four\n\nFive"] and got[2] == ["Text of two"] and got[3] == ["Text of three"]
    assert got[4] == [""] and len(got[5]) == 2
    assert html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").where("false")).count() == 0
    assert html_extract.shared_lines(list("abcde"), list("xbyde")) == ({1, 3, 4}, {1, 3, 4})


def test_differencing_decides_outside_the_main_element_and_skips_copies(spark):
    body = "<p>Template</p><p>Intro {0}</p><article><p>Article {0}</p></article><div class=story><p>Box</p></div><p>Template end</p>"
    plain = "<p>Template</p><p>Text {0}</p><p>Template end</p>"
    pages = [(k, f"http://h.a/{k}", body.format(k)) for k in (1, 2)]
    pages += [(k, f"http://h.b/{k}", plain.format(t)) for k, t in ((1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "x"), (5, "x"), (6, "z"))]
    pages += [(1, "http://h.c/1", plain.format("same")), (2, "http://h.c/2", plain.format("same"))]
    rows = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["url"][7:]].append(r["text"])
    assert got["h.a/1"] == ["Intro 1\n\nArticle 1\n\nBox"] and got["h.a/2"] == ["Intro 2\n\nArticle 2\n\nBox"]
    assert [got[f"h.b/{k}"] for k in range(1, 7)] == [["Text x"], ["Text x"], ["Text x"], ["Text y"], ["Text x"] * 2, ["Text z"]]
    assert got["h.c/1"] == got["h.c/2"] == ["Template\n\nText same\n\nTemplate end"] and len(rows) == 11


def test_places_do_not_depend_on_ranges(spark):
    pages = [(k, f"http://h/{k:03}", bytes([k // 7 % 2])) for k in range(100)]
    df = spark.createDataFrame(pages, "row long, url string, digest binary")
    for size in (3, 1000):
        assert {r["row"]: (r["place"], r["couple"]) for r in html_extract.couples(df, size).collect()} == {k: (k // 7, min(k // 14, 6)) for k in range(100)}


def test_articles_in_layout_wrappers():
    def main(html):
        return [t for t, m in html_extract.blocks_of(html) if m]

    text = "<article><p>text</p></article>"
    for name in ("content-sidebar-wrap", "site no-sidebar", "wrapper has-sidebar", "page with-header", "header", "site search", "col side"):
        assert main(f"<div class='{name}'><div>{text}</div></div>") == main(f"<div id='{name}'><main><p>text</p></main></div>") == ["text"]
    assert main(f"<form><header>{text}</header></form>") == ["text"]
    for part in ("nav", "aside", "footer", "div class=comments", "div id='comments'", "div hidden", "div role=navigation", "div class='related'"):
        assert html_extract.blocks_of(f"<{part}><div>{text}</div></{part.split()[0]}>") == []
    for name in ("ad", "cookie-banner", "sidebar widget", "x search"):
        assert html_extract.blocks_of(f"<div class='{name}'>text</div>") == []


def test_main_text_of_the_pages_table(spark, small):
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op2_html_extraction"](spark, small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def brute_phrases(text, learned, piece=language_id.PIECE):
    count = 0
    for at in range(0, len(text), piece):
        part, k = text[at:at + piece], 0
        while k < len(part):
            n = 1
            while k + n <= len(part) and part[k:k + n] in learned:
                n += 1
            count += 1
            k += max(1, n - 1)
    return count


def test_cross_parsing_equals_brute_force():
    learned = (("x", "banana bandana ananas"), ("y", "straße über die straße"))
    parser = language_id.Parser(learned)
    texts = ["bananas and straßen", "zz", "", "über banana " * 60]
    code, bounds = language_id.normalised(texts)
    got = parser.phrases(code, bounds)
    plain = ["".join(map(chr, language_id.normalised([t])[0])) for _, t in learned]
    for k in range(len(texts)):
        own = "".join(map(chr, code[bounds[k]:bounds[k + 1]]))
        for j, p in enumerate(plain):
            assert round(got[k, j] * max(1, len(own)) / parser.bits[j]) == brute_phrases(own, p)


def test_language_id(spark, small, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(edge).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and language_id.identify(empty).count() == 0


def test_toxicity(spark, edge, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.detect(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    # in this table insults of the other languages are made of the syllables of ordinary words
    english = [r for r in rows if r["lang"] == "en"]
    hit = sum(r["predicted"] and r["toxic"] for r in english)
    assert hit / sum(r["predicted"] for r in english) > 0.9 and hit / sum(r["toxic"] for r in english) > 0.9
    assert sum(r["predicted"] and r["toxic"] for r in rows) / sum(r["toxic"] for r in rows) > 0.85
    none = spark.createDataFrame([(1, 1)], "doc_id long, toxic int").where("false")
    assert {r["predicted"] for r in toxicity.detect(edge, none).collect()} == {0} and toxicity.detect(empty, none).count() == 0


def test_kernel_tolerates_inserted_characters():
    one, two, other = (toxicity.subsequences([w]) for w in ("idiot", "idxiot", "garden"))
    assert toxicity.kernel(one, two)[0, 0] > 0.5 > 0.1 > toxicity.kernel(one, other)[0, 0]
    assert toxicity.units("you i d i o t!") >= {"idiot", "you"} and "stupid" in toxicity.units("st*upid")


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    from cohort.llm import shingles
    texts = ["a b c d e f g " * 50, None, "", "x y", "Q w e r t y " * 200]
    whole = [(i, s.tolist()) for i, s in shingles.sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    monkeypatch.setattr(shingles.chunks, "__defaults__", (64,))
    assert [(i, s.tolist()) for i, s in shingles.sets(pa.array(texts))] == whole
