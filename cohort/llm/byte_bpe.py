"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The rank file gives the vocabulary; the merge of each token is the last one that builds it from lower ranks.
Every byte is mapped to one printable character, so that the library merges bytes; each match of the split
pattern is encoded separately. Distinct pieces of a batch are encoded once. Decoding looks up the bytes of each
id; a character whose bytes lie in two tokens comes back whole because bytes, not characters, are joined.

Cases: a null or empty text has no ids and decodes to no bytes; text that spells a special token is ordinary
text; very long texts are encoded whole; repeated rows give equal rows; an empty table gives an empty result;
columns of the input that are not asked for are left out, so that names cannot clash.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohort.llm.common import map_arrow

#: Pieces that a worker meets in one turn of its memory; it holds those of this turn and the last.
REMEMBERED = 200_000


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves, others for 256 and up, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for k, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + k)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the token's own merge joins; None if merging lower ranks doesn't lead to two parts."""
    limit, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Coder:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        shown = byte_characters()
        self.table = {b: ord(c) for b, c in shown.items()}
        spell = lambda token: "".join(shown[b] for b in token)
        merges = [(spell(m[0]), spell(m[1])) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := merge_of(t, ranks))]
        self.model = Tokenizer(BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
        self.whole = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids of pieces, little-endian; those met since the last turn
        self.older: dict[str, bytes] = {}  # those of the turn before
        top = max(ranks.values()) + 1
        self.bytes_of = [b""] * top
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.length_of = np.array([len(t) for t in self.bytes_of], np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet, all in one call of the library."""
        rest = []
        for piece in pieces:
            raw = piece.encode()
            if (ids := self.whole.get(raw)) is not None:
                self.known[piece] = ids
            else:
                rest.append((piece, raw.decode("latin-1").translate(self.table)))
        for (piece, _), code in zip(rest, self.model.encode_batch([x for _, x in rest], add_special_tokens=False), strict=True):
            self.known[piece] = np.array(code.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the pieces that are new to the memory are encoded in one call of the library."""
        pieces = [self.find(text) for text in texts]
        if len(self.known) > REMEMBERED:  # pieces that aren't met again in a turn are dropped at its end
            self.older, self.known = self.known, {}
        get = self.known.get
        new = {p for part in pieces for p in part if get(p) is None}
        if new:
            met = {p: ids for p in new if (ids := self.older.get(p)) is not None}
            self.known.update(met)
            self.learn(new.difference(met))
        return [np.frombuffer(b"".join([self.known[p] for p in part]), "<u4") for part in pieces]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of each id; ids that share a character all cover it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.length_of[ids])
        return char_of[end - self.length_of[ids]], char_of[end - 1] + 1


def _slices(batch, most: int = 1_000_000):
    """Rows of a batch whose texts have about ``most`` bytes together; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    yield batch.slice(at)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """Rows (key, n_tokens, ids_le, decoded) per row of docs: ids as little-endian 32-bit, and the bytes decoded from them.

    ``offsets`` adds ``starts`` and ``ends``: for each id the characters of the text that it covers.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_le binary, decoded binary" + ", starts array<long>, ends array<long>" * offsets

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = own.encode(texts)
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
                           pa.array([own.decode(x.tolist()) for x in ids], pa.binary())]
                names = [key, "n_tokens", "ids_le", "decoded"]
                if offsets:
                    spans = [own.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    columns += [pa.array([s.tolist() for s, _ in spans], pa.list_(pa.int64())), pa.array([e.tolist() for _, e in spans], pa.list_(pa.int64()))]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(key, text), run, schema)


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids_le") -> DataFrame:
    """Rows (key, decoded) from ids as little-endian 32-bit binary; null ids decode to no bytes."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            out = [own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return map_arrow(rows.select(key, ids), run, f"`{key}` {kind}, decoded binary")
