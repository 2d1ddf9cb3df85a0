"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; per tree (source) the leaves ascend by key, runs of ``FAN`` consecutive nodes become their parent
until one node, the subroot, is left; the subroots, ordered by tree, become the root in the same way.

Nodes are labelled by tree, position and level, and are processed in the order of labels. A node sends its digest to its
parent as a message; a priority queue ordered by the receiver's label delivers it. The queue lives outside: what goes
to a later range of labels is a row that Spark writes, sorts by label and merges into the task that owns the
range (``FAN ** LEVELS`` leaves of one tree, so that a hot source is spread), where a small heap delivers the
rest. Each sweep climbs LEVELS levels. Then the same is swept in reverse: parents send their proof, that is the
siblings on the way to the root, down to their children; the message meets the nodes of its range in the sorted stream.

Cases: null fields are written as ``-``; null keys come first in their tree, a null tree is one of its own and comes
first; equal keys are ordered by leaf digest, repeated rows are leaves of their own; a lone leaf is its
tree's subroot, a lone subroot the root; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.llm.common import map_arrow, materialise

#: Children of a node at most.
FAN = 16
#: Levels that one sweep climbs: a task's range is a multiple of FAN ** LEVELS leaves.
LEVELS = 2
RANGE = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, idx long, n long, digest binary"


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels that a sweep climbs in a tree of n nodes."""
    return 0 if n == 1 else min(LEVELS, next(k for k in range(1, LEVELS + 1) if FAN**k >= n or k == LEVELS))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with tree) and idx, the position in the tree by ``order``, and n, the tree's number of rows.

    Rows are range-sorted over tree and order; counts per partition and tree give the offsets.
    """
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftrightunsigned("at", 33)
    counts = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
                           F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    met = placed.withColumn("part", part).join(counts, ["tree", "part"])
    return met.withColumn("idx", F.col("offset") + F.col("at") - F.col("first")).drop("part", "at", "first", "offset")


def _up(batches):
    """Nodes come by label; messages to parents go through a heap, which holds FAN times LEVELS of them at most."""
    queue: list[tuple] = []
    now, turn, out = None, 0, []
    for batch in batches:
        for tree, idx, n, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "n", "digest")), strict=True):
            if (tree, idx // RANGE) != now:
                now, turn = (tree, idx // RANGE), turn + 1
            top = height(n)

            def send(level: int, at: int, value: str, top=top, n=n, turn=turn) -> None:
                """To the parent, whose label is the last leaf below it and its level."""
                if level == top:
                    out.append((now[0], now[1], -(-n // RANGE), bytes.fromhex(value)))
                else:
                    last = min((at // FAN + 1) * FAN ** (level + 1), n) - 1
                    heapq.heappush(queue, (turn, last, level + 1, at, value))

            send(0, idx, digest.hex())
            while queue and queue[0][1] <= idx:
                _, last, level, at, value = heapq.heappop(queue)
                values = [value]
                while queue and queue[0][:3] == (turn, last, level):
                    values.append(heapq.heappop(queue)[4])
                send(level, at // FAN, h("".join(values)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             names=["tree", "idx", "n", "digest"])
            out.clear()


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each sweep (the first: ``nodes``), and one row per tree with the digest of what remains."""
    sweeps, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        owned = sweeps[-1].select("tree", "idx", "n", "digest", F.floor(F.col("idx") / RANGE).alias("part"))
        rows = owned.repartition("tree", "part").sortWithinPartitions("tree", "part", "idx").drop("part")
        up = materialise(map_arrow(rows, _up, NODE), "merkle-nodes")
        most = -(-most // RANGE)
        if most <= 1:
            return sweeps, up
        sweeps.append(up)


def siblings(proof: str) -> list[tuple[int, str]]:
    """Of a proof, level by level from the leaf on: the node's place in its run and the digests of the run's others."""
    return [(int(at), others) for at, _, others in (x.partition(":") for x in proof.split("/") if x)]


def fold(digest: str, proof: str) -> str:
    """The root that a leaf's digest and its proof lead to."""
    return reduce(lambda d, x: h(x[1][:64 * x[0]] + d + x[1][64 * x[0]:]), siblings(proof), digest)


def _proofs(digests: list[str], top: int, proof: str) -> list[str]:
    """Reverse sweep of one range: parents, in descending order of labels, deliver their proof to their children."""
    levels = [digests]
    for _ in range(top):
        levels.append([h("".join(levels[-1][k:k + FAN])) for k in range(0, len(levels[-1]), FAN)])
    queue, got = [(-top, 0, proof)], [""] * len(digests)
    while queue:
        level, at, proof = heapq.heappop(queue)
        if not level:
            got[at] = proof
            continue
        run = levels[-level - 1][FAN * at:FAN * (at + 1)]
        for k in range(len(run)):
            heapq.heappush(queue, (level + 1, FAN * at + k, f"{k}:{''.join(run[:k] + run[k + 1:])}/{proof}"))
    return got


def _down(batches, finish):
    """Each range's message comes first (idx -1), then its nodes; ``finish`` makes rows of (tree, idx, key, digest, claimed, subroot, proof)."""
    held, message, n = [], None, 0

    def flush():
        digests = [x[3].hex() for x in held]
        return [(*row[:3], digest, row[4], message[0], proof) for row, digest, proof in zip(held, digests, _proofs(digests, height(n), message[1]), strict=True)]

    for batch in batches:
        out = []
        for tree, idx, total, key, digest, claimed, subroot, proof in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if idx < 0:
                if held:
                    out += flush()
                held, message = [], (subroot, proof)
            else:
                n = total
                held.append((tree, idx, key, digest, claimed))
        if out:
            yield finish(out)
    if held:
        yield finish(flush())


def unfold(sweeps: list[DataFrame], messages: DataFrame, key: str, finish, schema: str) -> DataFrame:
    """Proofs from the top sweep down to the first; ``messages`` (tree, part, subroot, proof) are those to the top's ranges."""
    def halfway(rows):
        tree, idx, _, digest, _, subroot, proof = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(idx, pa.int64()), pa.array(subroot, pa.string()), pa.array(proof, pa.string())],
                                          names=["tree", "part", "subroot", "proof"])

    for k in range(len(sweeps) - 1, -1, -1):
        nodes = sweeps[k]
        if k:
            nodes = nodes.withColumns({"key": F.lit(None).cast(key), "claimed": F.lit(None).cast("binary")})
        nodes = nodes.select("tree", F.floor(F.col("idx") / RANGE).alias("part"), "idx", "n", "key", "digest", "claimed", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("proof"))
        sent = messages.select("tree", "part", F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(key).alias("key"),
                               F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("claimed"), "subroot", "proof")
        rows = nodes.unionByName(sent).repartition("tree", "part").sortWithinPartitions("tree", "part", "idx").drop("part")
        end, kind = (halfway, "tree string, part long, subroot string, proof string") if k else (finish, schema)
        messages = map_arrow(rows, lambda batches, end=end: _down(batches, end), kind)
        if k:
            messages = materialise(messages, "merkle-proofs")
    return messages


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "source", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None, proofs: bool = True) -> DataFrame:
    """Rows (key, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]), one per row of docs.

    ``claimed`` is the leaf digest that a holder of the data presents (null, or left out: the true one): ``folded_root``
    is the root that it leads to with the true proof, ``verified`` whether that is the root. ``proof`` has, for every level
    from the leaf on, the node's place in its run, ``:``, the digests of the others, ``/``.
    """
    kind = docs.schema[key].dataType
    label = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))
    claim = F.lit(None).cast("string") if claimed is None else claimed
    leaves = materialise(docs.select(label.alias("tree"), F.col(key).alias("key"), F.unhex(leaf([F.col(c) for c in fields])).alias("digest"),
                                     F.unhex(claim).alias("claimed"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    nodes = materialise(numbered(leaves, ["key", "digest", "row"]).drop("row"), "merkle-leaves")
    sweeps, tops = build(nodes)
    subroots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("binary").alias("claimed"))
    upper = materialise(numbered(subroots, ["key"]), "merkle-subroots")
    upper_sweeps, top = build(upper)
    found = top.first()
    root = found["digest"].hex() if found else ""

    def to_trees(rows):
        _, _, name, digest, _, _, proof = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array(digest, pa.string()), pa.array(proof, pa.string())],
                                          names=["tree", "part", "subroot", "proof"])

    first = top.select("tree", F.lit(0).cast("long").alias("part"), F.lit("").alias("subroot"), F.lit("").alias("proof"))
    messages = materialise(unfold(upper_sweeps, first, "string", to_trees, "tree string, part long, subroot string, proof string"), "merkle-proofs")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def to_leaves(rows):
        _, _, keys, digests, claims, subroot, proof = zip(*rows, strict=True)
        shown = [h("".join(others for _, others in siblings(p))) for p in proof]
        folded = [fold(c.hex() if c else d, p) for d, c, p in zip(digests, claims, proof, strict=True)]
        columns = [pa.array(keys, arrow), *(pa.array(x, pa.string()) for x in (digests, subroot, [root] * len(rows), shown, folded)), pa.array([f == root for f in folded], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(proof, pa.string())] * proofs, names=names)

    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * proofs
    schema = f"`{key}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * proofs
    return unfold(sweeps, messages, kind.simpleString(), to_leaves, schema)


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered(docs: DataFrame, key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """Leaf digest of every fifth row by the CRC of its key with its text's A-Z in lower case; null for the others."""
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in fields]
    return F.when(F.crc32(F.col(key).cast("string")) % 5 == 0, leaf(changed))


def _climb(levels: int, tree: str) -> str:
    """CTEs ``{tree}1 ...``: nodes of each level from ``{tree}0`` (tree, i, d, n, run)."""
    return "".join(f"""
{tree}{k + 1} AS (SELECT tree, i // {FAN} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
      (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {tree}{k} GROUP BY tree, i // {FAN}),
{tree}r{k} AS (SELECT tree, i // {FAN} AS i, any_value(n) AS n, list(d ORDER BY i) AS run FROM {tree}{k} GROUP BY tree, i // {FAN}),""" for k in range(levels))


def _fold(levels: int, tree: str, start: str) -> str:
    """CTEs that follow each leaf of ``start`` (row, tree, i, d, proof) up ``levels`` levels."""
    return "".join(f"""
{tree}f{k + 1} AS (SELECT f.row, f.tree, f.i // {FAN} AS i,
      CASE WHEN r.n = 1 THEN f.d ELSE sha256(array_to_string(r.run[:f.i % {FAN}], '') || f.d || array_to_string(r.run[f.i % {FAN} + 2:], '')) END AS d,
      CASE WHEN r.n = 1 THEN f.proof ELSE f.proof || array_to_string(r.run[:f.i % {FAN}], '') || array_to_string(r.run[f.i % {FAN} + 2:], '') END AS proof
      FROM {tree}f{k} f JOIN {tree}r{k} r ON f.tree = r.tree AND f.i // {FAN} = r.i),""" for k in range(levels)).replace(f"{tree}f0 f", f"{start} f")


def _leaf_sql(text: str) -> str:
    parts = [c if c != "text" else text for c in FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in parts) + "))"


#: Levels of a source's tree and of the sources' tree that the SQL unrolls.
SQL_LEVELS = (6, 3)
#: CRC-32 bit by bit: the polynomial is the standard's, reflected.
CRC = """(4294967295 - list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * len(CAST(doc_id AS VARCHAR)))),
      lambda c, k: CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, CAST(ord(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE c END) & 1 = 1
                     THEN xor((CASE WHEN k % 8 = 0 THEN xor(c, CAST(ord(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE c END) >> 1, 3988292384::BIGINT)
                     ELSE (CASE WHEN k % 8 = 0 THEN xor(c, CAST(ord(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE c END) >> 1 END))"""
ORACLE = f"""
WITH docs AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {CRC} % 5 = 0 AS tampered, {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS other FROM documents),
leaves AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '-') AS tree, leaf, CASE WHEN tampered THEN other ELSE leaf END AS claimed,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM docs),
s0 AS (SELECT tree, i, leaf AS d, n FROM leaves),{_climb(SQL_LEVELS[0], 's')}
t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n, tree AS name FROM s{SQL_LEVELS[0]}),{_climb(SQL_LEVELS[1], 't')}
sf AS (SELECT row, tree, i, claimed AS d, '' AS proof FROM leaves),{_fold(SQL_LEVELS[0], 's', 'sf')}
tf AS (SELECT f.row, '' AS tree, t0.i, f.d, f.proof FROM sf{SQL_LEVELS[0]} f JOIN t0 ON f.tree = t0.name),{_fold(SQL_LEVELS[1], 't', 'tf')}
root AS (SELECT d AS root FROM t{SQL_LEVELS[1]})
SELECT doc_id, leaf, t0.d AS subroot, root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM leaves JOIN tf{SQL_LEVELS[1]} f ON leaves.row = f.row JOIN t0 ON t0.name = leaves.tree CROSS JOIN root
"""
