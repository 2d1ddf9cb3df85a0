"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of a text and, so that a passage inside a longer line is met as well, every window of
``WINDOW`` consecutive 8-word shingles.

* Lines of ``LINE_WORDS`` words or more: MinHash signatures over 5-word shingles, cut into bands that are tuned for
  recall; lines that collide in a band are paired with the smallest of the bucket and with their neighbour
  in it, verified by exact Jaccard similarity on whole sets (a second read of the text), and clustered by components.
  Only classes that share a bucket with another go on from the signatures.
* Windows: the MinHash of a window is the least hash of its shingles, one band of one row. Neighbouring windows
  mostly share it, so only changes are kept. A shingle kept in two documents is a verified collision, and so is a
  stretch over a gap between two kept ones. A passage of more than 50 words that two documents share word for word
  keeps shingles over 28 words of it at least.

Spans of a document that come from clusters of two documents or more are merged into runs; runs of ``RUN_WORDS``
words or more are repeated passages. The first document of a cluster keeps its span. The others lose theirs, each
decided by its own cluster, where such spans make a run of ``RUN_WORDS`` words; words in gaps between spans stay.

Cases: A-Z count as a-z; null and empty texts have no paragraphs; a passage that repeats only inside one document
isn't reported; equal lines of ``LINE_WORDS`` words are met from end to end; rows that repeat id and text count as one document;
documents with a null id are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm import shingles as S
from cohort.llm.common import FEW_LINKS, components, discard, map_arrow, materialise
from cohort.llm.jaccard_join import bitmap, crowd_links, crowds, has, live_lists, verified

LINE_WORDS = 20
RUN_WORDS = 28
WORDS, WINDOW_WORDS, WINDOW = 5, 8, 12
#: Words between two spans of one run.
GAP = 12
#: Bits of the bitmap of buckets that hold two classes or more, as a power of two; a wrong bit adds rows, not links.
BUCKET_BITS = 26
PERCENT = 80
RECALL = 0.995


def tune(similarity: float = PERCENT / 100, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(bands, rows) with the fewest collisions at half the similarity among those that reach the recall with at most ``most`` hashes."""
    fit = [(b, r) for r in range(1, 17) for b in range(1, most // r + 1) if 1 - (1 - similarity**r) ** b >= recall]
    return min(fit, key=lambda x: (round(1 - (1 - (similarity / 2) ** x[1]) ** x[0], 6), x[0]))


def _lines(column: pa.Array):
    """For chunks of rows: hashes of words, their rows, and the bounds of the lines as (first word, end word, word in text)."""
    raw, offsets = S.texts_of(column)
    for a, b in S.chunks(offsets):
        h, first, row = S.words(raw, offsets[a:b + 1])
        if not len(h):
            continue
        feeds = np.flatnonzero(raw[offsets[a]:offsets[b]] == 10)
        line = np.searchsorted(feeds, first)
        new = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
        text = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        start_of = np.zeros(b - a, np.int64)
        start_of[row[text]] = text
        yield a, h, row, new, np.r_[new[1:], len(h)], start_of


def _line_sets(column: pa.Array):
    """(row, first word in the text, words, sorted distinct shingle hashes) of every line that is long enough."""
    for a, h, row, new, end, start_of in _lines(column):
        begin, stop = new[end - new >= LINE_WORDS], end[end - new >= LINE_WORDS]
        if not len(begin):
            continue
        hashes = S.windows(h, WORDS)  # of all words at once; a long line takes those that lie in it
        for s, e, i, at in zip(begin.tolist(), stop.tolist(), row[begin].tolist(), (begin - start_of[row[begin]]).tolist(), strict=True):
            own = np.sort(hashes[s:e - WORDS + 1])
            fresh = own[1:] != own[:-1]
            yield a + i, at, e - s, own if fresh.all() else own[np.concatenate(([True], fresh))]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())


def lines(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Rows (key, doc_id, start, words, n, bands) of the lines that are long enough; a bucket's number holds its band's."""
    random = np.random.Generator(np.random.PCG64(11))
    salt = random.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list = []
            for i, start, words, own in _line_sets(batch.column(1)):
                out.append((S.set_keys(own)[0], int(ids[i]), start, words, own))
                if len(out) == 2000:
                    yield signed(out)
                    out = []
            if out:
                yield signed(out)

    def signed(out):
        flat = np.concatenate([x[4] for x in out])
        size = np.array([len(x[4]) for x in out], np.int64)
        at = np.r_[0, np.cumsum(size)[:-1]]
        minima = S.salted_minima(flat, at, salt)
        keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(out), 1))
        for r in range(rows):
            keys = S.mixed(keys * np.uint64(31) + minima[:, r::rows] + np.uint64(r + 1))
        columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)] + [pa.array(size)]
        columns.append(pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "start", "words", "n", "bands"])

    return map_arrow(_source(docs), run, "key long, doc_id long, start long, words long, n long, bands array<long>")


def line_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (key, doc_id, start, hashes) of the long lines of documents whose id has a bit."""
    spread = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(has(spread.value, all_ids.astype(np.int64).view(np.uint64))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list = []
            for i, start, _, own in _line_sets(batch.column(1)):
                out.append((S.set_keys(own)[0], int(ids[i]), start, own.tobytes()))
                if len(out) == 2000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        a, b, c, d = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())],
                                          names=["key", "doc_id", "start", "hashes"])

    return map_arrow(_source(docs), run, "key long, doc_id long, start long, hashes binary")


def line_classes(found: DataFrame) -> DataFrame:
    """Line classes (key, rep, n, bands) that share a bucket with another class; in bands, the key stands for a bucket of one class.

    Buckets are told by their least and largest key, summed up before the shuffle. No row of a bucket of one class is
    sent on but for wrong bits, and no two classes agree on a key.
    """
    shared = found.select("key", F.explode("bands").alias("bucket")).groupBy("bucket").agg(
        F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    spread = found.sparkSession.sparkContext.broadcast(bitmap(shared, "bucket", BUCKET_BITS))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0).to_numpy()
                bands = batch.column(4).flatten().to_numpy().reshape(len(key), -1)
                live = has(spread.value, bands.view(np.uint64))
                bands = np.where(live, bands, key[:, None])
                columns = [*batch.columns[:4], pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), bands.shape[1]).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(live.any(axis=1)))

    rows = map_arrow(found.select("key", "doc_id", "start", "n", "bands"), run, "key long, doc_id long, start long, n long, bands array<long>")
    return rows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("rep"), F.max("n").alias("n"), F.max("bands").alias("bands"))


def line_links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (x, y) between line classes (key, rep: struct of doc_id and start, n, bands) that collide in a band.

    A few pairs of each bucket join early what belongs together; then all pairs of a bucket that lie in different
    components are verified, whatever its size: those of crowded buckets in blocks of lines, without a row per pair.
    """
    rows = classes.select("key", "rep", "n", F.posexplode("bands").alias("band", "bucket")).where("bucket <> key")
    ahead = Window.partitionBy("band", "bucket").orderBy(F.xxhash64("band", "key"))
    crowded = rows.groupBy("band", "bucket").agg(F.min(F.struct("key", "rep", "n")).alias("low"), F.count("*").alias("m")).where("m > 1")
    live = materialise(rows.join(crowded, ["band", "bucket"]).select("band", "bucket", "key", "rep", "n", "low"), "line-buckets")
    star = live.select("key", "rep", "n", F.col("low").alias("to"))
    # neighbours within sub-buckets, so that no window holds a whole hot bucket
    part = live.withColumn("bucket", F.xxhash64("bucket", F.shiftright("n", 2)))
    chain = part.withColumn("to", F.lag(F.struct("key", "rep", "n")).over(ahead)).where(F.col("to").isNotNull()).select("key", "rep", "n", "to")
    pairs = star.unionByName(chain).where((F.col("key") != F.col("to.key")) & (100 * F.least("n", "to.n") >= percent * F.greatest("n", "to.n")))
    a, b = F.struct("key", "rep"), F.struct(F.col("to.key").alias("key"), F.col("to.rep").alias("rep"))
    pairs = materialise(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().select(
        F.col("a.key").alias("x"), F.col("a.rep").alias("rx"), F.col("b.key").alias("y"), F.col("b.rep").alias("ry")), "line-pairs")
    early = materialise(_verified(docs, pairs, percent), "line-links")

    placed = live.drop("low").join(components(early, "x", "y", FEW_LINKS), F.col("key") == F.col("node"), "left").select(
        "band", "bucket", "key", "rep", "n", F.coalesce("component", "key").alias("comp"))
    short, crowded = live_lists(materialise(placed, "line-buckets-placed"), ["band", "bucket"])
    left = short.select("band", "bucket", F.col("key").alias("x"), F.col("rep").alias("rx"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
    right = short.select("band", "bucket", F.col("key").alias("y"), F.col("rep").alias("ry"), F.col("n").alias("ny"), F.col("comp").alias("cy"))
    near = (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    rest = left.join(right, ["band", "bucket"]).where(near).select("x", "rx", "y", "ry").distinct()
    rest = materialise(rest.join(pairs.select("x", "y"), ["x", "y"], "left_anti"), "line-pairs-apart")
    crowd = crowds(crowded.select("band", "bucket", F.col("key").alias("cls"), "rep", "n", "comp"), ["band", "bucket"], FEW_LINKS)
    crowd = crowd.join(classes.select(F.col("key").alias("cls"), F.col("bands").alias("marks")), "cls")
    sets = materialise(_sets(docs, _ends(rest).unionByName(crowd.select(F.col("rep.doc_id").alias("r")))), "line-sets")
    return early.unionByName(verified(docs, rest, percent=percent, sets=sets)).unionByName(crowd_links(crowd, sets, percent))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("rx.doc_id").alias("r")).unionByName(pairs.select(F.col("ry.doc_id").alias("r")))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets, as verified() takes them, of the lines of documents whose ids are in r."""
    return line_sets(docs, bitmap(ids, "r")).select(F.col("key").alias("cls"), F.struct("doc_id", "start").alias("doc_id"), "hashes")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, rx, y, ry) of line classes, those (x, y) that link on their whole sets."""
    return verified(docs, pairs, percent=percent, sets=_sets(docs, _ends(pairs)))


def windows(docs: DataFrame) -> DataFrame:
    """Rows (key, doc_id, start, words): the least shingle of each window of a text, each once, and stretches over gaps.

    Where two that follow each other leave words between them, the stretch from the first to the second has a row too;
    its key holds a third shingle over the gap, so that equal keys are equal words throughout.
    """
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = S.texts_of(batch.column(1))
            for a, b in S.chunks(offsets):
                h, _, row = S.words(raw, offsets[a:b + 1])
                if len(h) < WINDOW_WORDS + WINDOW - 1:
                    continue
                count = len(h) - WINDOW_WORDS + 1
                total = h[:count] * S._STEP[0]
                for k in range(1, WINDOW_WORDS):
                    total = total + h[k:count + k] * S._STEP[k]
                total = S.mixed(total)
                least = np.lib.stride_tricks.sliding_window_view(total, WINDOW).argmin(axis=1) + np.arange(count - WINDOW + 1)
                inside = row[:count - WINDOW + 1] == row[WINDOW + WINDOW_WORDS - 2:]
                at = np.unique(least[inside])
                far = at[1:] - at[:-1]
                open_ = np.flatnonzero((row[at[:-1]] == row[at[1:]]) & (far > WINDOW_WORDS))
                low, far = at[open_], far[open_]
                over = S.mixed(total[low] * S._STEP[0] + total[low + WINDOW_WORDS] * S._STEP[1] + total[low + far] * S._STEP[2] + far.astype(np.uint64))
                key, begin = np.r_[total[at], over], np.r_[at, low]
                size = np.r_[np.full(len(at), WINDOW_WORDS, np.int64), far + WINDOW_WORDS].astype(np.int64)
                first = np.searchsorted(row, row[begin])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a + row[begin]]), pa.array((begin - first).astype(np.int64)),
                                                  pa.array(size)], names=["key", "doc_id", "start", "words"])

    return map_arrow(_source(docs), run, "key long, doc_id long, start long, words long")


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows (doc_id, start, end, n_words, first_doc, removed): stretches of repeated passages without a gap.

    start and end count words; first_doc is the smallest document that shares a paragraph of the stretch.
    """
    bands, rows = tune()
    signed = materialise(lines(docs, bands, rows), "line-signatures")
    classes = materialise(line_classes(signed), "line-classes")
    found = materialise(signed.select("key", "doc_id", "start", "words"), "lines")
    discard(signed)
    cluster = components(line_links(docs, classes), "x", "y", FEW_LINKS)
    placed = found.select("key", "doc_id", "start", (F.col("start") + F.col("words")).alias("end")).join(cluster, F.col("key") == F.col("node"), "left")
    placed = placed.withColumn("cluster", F.coalesce("component", "key"))
    spread = placed.groupBy("cluster").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc < last").select("cluster", "first_doc")
    line_spans = placed.join(spread, "cluster").select("doc_id", "start", "end", "first_doc")

    # one shuffle: the least and largest document of a key are told where its rows meet, not sent for and joined
    met = Window.partitionBy("key")
    kept = windows(docs).select("*", F.min("doc_id").over(met).alias("first_doc"), F.max("doc_id").over(met).alias("last")).where("first_doc < last")
    window_spans = kept.select("doc_id", "start", (F.col("start") + F.col("words")).alias("end"), "first_doc")

    spans = line_spans.unionByName(window_spans)
    # a run of all spans is a passage; in it, runs of spans that earlier documents hold are removed if they are long enough themselves
    runs = _runs(spans.withColumn("later", F.col("first_doc") < F.col("doc_id")), ["doc_id"], "run", GAP)
    passages = runs.withColumn("long", _extent("doc_id", "run") >= run_words).where("long")
    parts = _runs(passages, ["doc_id", "run", "later"], "part", GAP)
    decided = parts.withColumn("removed", F.col("later") & (_extent("doc_id", "run", "later", "part") >= run_words))
    pieces = _runs(decided, ["doc_id", "run", "removed"], "piece", 0).groupBy("doc_id", "run", "removed", "piece").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"))
    return pieces.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "first_doc", "removed")


def _runs(spans: DataFrame, by: list[str], name: str, gap: int) -> DataFrame:
    """spans with the number of their run: spans of a run follow each other with at most ``gap`` words between."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("reached", reached).withColumn("new", (F.col("reached").isNull() | (F.col("start") > F.col("reached") + gap)).cast("int"))
    return marked.withColumn(name, F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("reached", "new")


def _extent(*by: str) -> Column:
    """Words from the first to the last of a run."""
    own = Window.partitionBy(*by)
    return F.max("end").over(own) - F.min("start").over(own)
