"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against an
automaton into phrases, each the longest match from where the last ended; the fewer phrases, the closer the text is
to the sample. Phrases are normalised to bits a character (phrases times the logarithm of the sample's length, over
the text's length); the language with the fewest wins, ties going to the first by code point.

A text is lower-cased; every run of other characters than letters counts as one space. It is parsed in pieces of
``PIECE`` characters, a phrase ending with its piece, so that many pieces advance together in numpy.

The sample of a language is the text of its documents in the order of a hash of their ids, ``SAMPLE_DOCS`` documents
at most, up to ``SAMPLE_CHARS`` characters: a documented bound, independent of the size of the corpus.

Cases: null texts and texts without a letter are ``und`` with score 0; texts of any length are parsed whole; a
null lang is never learned; without any labelled text everything is ``und``; rows that repeat get equal results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import map_arrow

SAMPLE_DOCS, SAMPLE_CHARS = 60, 20_000
PIECE = 256
UNKNOWN = "und"
_COUNT = 1 << 30


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself lower-cased if it is a letter (or a mark), else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, normalised, one after another, and their bounds; every text starts with a space."""
    code = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    low = _letters()[code]
    space = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bounds[:-1]] = True
    place = np.r_[0, np.cumsum(keep)]
    return low[keep], place[bounds]


def suffix_automaton(text) -> list[dict]:
    """Transitions of the suffix automaton of a sequence; state 0 is its start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new, p = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """Automata of all languages as tables: (state, class of character) -> next state, counting where a phrase begins."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in samples]
        coded = [normalised([text])[0] for _, text in samples]
        known = np.unique(np.concatenate(coded)) if coded else np.empty(0, np.uint32)
        self.class_of = np.full(0x110000, len(known), np.int32)  # the last but one class: letters in no sample
        self.class_of[known] = np.arange(len(known))
        self.width = width = len(known) + 2  # the last class fills up short pieces
        self.tables, self.bits = [], []
        for text in coded:
            steps = suffix_automaton(self.class_of[text].tolist())
            start = np.full(width, _COUNT, np.int32)  # a character that the sample doesn't have is a phrase of its own
            for c, to in steps[0].items():
                start[c] = to | _COUNT
            table = np.tile(start, (len(steps), 1))  # no match: a phrase begins here
            for s, out in enumerate(steps[1:], 1):
                for c, to in out.items():
                    table[s, c] = to
            table[:, -1] = np.arange(len(steps))
            self.tables.append(table.ravel())
            self.bits.append(np.log2(max(2, len(text))))

    def phrases(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of each text against each automaton, in bits a character."""
        sizes = np.diff(bounds)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        first = np.repeat(bounds[:-1], pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(first + PIECE, np.repeat(bounds[1:], pieces))
        order = np.argsort(first - end, kind="stable")  # longest first: pieces that have ended are left out
        first, end, owner = first[order], end[order], owner[order]
        cls = self.class_of[code]
        out = np.zeros((len(sizes), len(self.langs)))
        alive = np.array([np.count_nonzero(end - first > k) for k in range(PIECE)]) if len(first) else []
        for lang, (table, bits) in enumerate(zip(self.tables, self.bits, strict=True)):
            state, count = np.zeros(len(first), np.int32), np.zeros(len(first), np.int64)
            for k in range(PIECE):
                n = alive[k] if len(first) else 0
                if not n:
                    break
                got = table[state[:n] * np.int64(self.width) + cls[first[:n] + k]]
                count[:n] += got >> 30
                state[:n] = got & (_COUNT - 1)
            out[:, lang] = np.bincount(owner, count, len(sizes)) * bits / np.maximum(1, sizes)
        return out


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def samples(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(lang, text) of each language of labelled (doc_id, text, lang), at most ``chars`` characters of ``docs`` documents."""
    own = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    keys = own.select("lang", F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    langs = sorted(r["lang"] for r in keys.select("lang").distinct().collect())
    if not langs:
        return ()
    few = [keys.where(F.col("lang") == lang).orderBy("h", "id").limit(docs) for lang in langs]
    chosen = reduce(DataFrame.unionByName, few).select(F.col("lang").alias("l_"), "id", "h").distinct()  # at most docs rows a language
    rows = own.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l_"))).select(
        "lang", "h", F.substring("text", 1, chars).alias("text")).collect()
    out = []
    for lang in langs:
        texts = [t for _, t in sorted((r["h"], r["text"]) for r in rows if r["lang"] == lang)]
        out.append((lang, "\n".join(texts)[:chars]))
    return tuple(out)


def predict(docs: DataFrame, learned: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per row of docs; score: by how much the runner-up needs more phrases."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = parser(learned)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores, at = [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                    size += len(texts[end])
                    end += 1
                code, bounds = normalised(texts[at:end])
                letters = np.add.reduceat((code != 32).astype(np.int64), bounds[:-1])
                need = own.phrases(code, bounds)
                for k in range(end - at):
                    if not letters[k] or not own.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(need[k].argmin())
                    rest = np.delete(need[k], best)
                    langs.append(own.langs[best])
                    scores.append(float(1 - need[k][best] / rest.min()) if len(rest) else 1.0)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score): learned from the documents that aren't held out, predicted for all."""
    docs = docs.select("doc_id", "text", "lang")
    learned = samples(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
