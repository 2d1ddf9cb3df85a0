"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a rejection test over statistics of the text, with a cost model (work per document). A bounded
sample gives the mean cost of each rule and which documents it rejects; rules are then ordered greedily by
rejections per cost among the documents that the rules before them let pass. The ordered cascade is one CASE
expression, so a rule is evaluated only for documents that no earlier rule has rejected. The order changes
the time, never the verdict: a document is kept if no rule rejects it.

Cases: a null text has no words and is treated like an empty one (all statistics 0); texts of any length are
read whole; rows that repeat get equal verdicts; an empty table gives no rows and any order of rules; input
columns other than the key and the text are ignored by :func:`quality_rows` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import SPACE, WORD, let, word_count

#: Rows of the sample, on average.
SAMPLE_ROWS = 1000
WINDOW = 8


def words_of(text: Column) -> Column:
    """Words of a text as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def window_keys(words: Column, n: int = WINDOW) -> Column:
    """64-bit key of each window of n words; n is a power of two: keys of n words are built from pairs of n/2."""
    def doubled(width: int):
        # the window at i with the one after it; the last windows, which have no partner, fall away
        def join(k: Column) -> Column:
            left = F.greatest(F.array_size(k) - width, F.lit(0))
            return F.zip_with(F.slice(k, 1, left), F.slice(k, width + 1, left), lambda a, b: F.xxhash64(a, b))
        return join

    keys, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < n:
        keys, width = let(keys, doubled(width)), 2 * width
    return keys


def repeated_words(keys: Column, n: int = WINDOW) -> Column:
    """Words that lie in windows whose key occurs twice or more."""
    def covered(ordered: Column) -> Column:
        size = F.array_size(ordered)
        same = lambda a, b: F.element_at(ordered, a)["k"] == F.element_at(ordered, b)["k"]
        hits = F.filter(ordered, lambda x, i: ((i > 0) & same(F.greatest(i, F.lit(1)), i + 1))
                        | ((i + 1 < size) & same(i + 1, F.least(i + 2, size))))
        starts = F.array_sort(F.transform(hits, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(
            F.zip_with(s, F.slice(s, 2, F.greatest(F.array_size(s), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(n)), F.lit(n))),
            F.lit(0).cast("long"), lambda total, x: total + x.cast("long")))

    order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.array_size(F.array_distinct(keys)) == F.array_size(keys), F.lit(0).cast("long")).otherwise(let(order, covered))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    # the keys are a column of their own, computed once: four expressions read them
    return docs.withColumn("__keys", window_keys(words_of(t))).withColumns({
        "n_words": word_count(t),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.array_size(x) - F.array_size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__keys")),
    }).drop("__keys")


@dataclass(frozen=True)
class Rule:
    """``rejects``: a test of a document; ``work``: its cost model; both are columns over the base columns and ``text``."""
    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column]


def _chars() -> Column:
    return F.char_length(F.coalesce("text", F.lit(""))).cast("double")


def standard_rules() -> list[Rule]:
    """Rules whose limits leave ordinary prose alone."""
    t = F.coalesce(F.col("text"), F.lit(""))
    letters = lambda: F.regexp_count(t, F.lit(r"\p{L}"))
    capitals = lambda: F.regexp_count(t, F.lit(r"\p{Lu}"))
    lines = lambda: F.size(F.split(t, "\n"))
    few = lambda: F.lit(1.0)
    return [
        Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")), few),
        Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words"), few),
        Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 3 * lines(), lambda: 1.0 * _chars()),
        Rule("exclamations", lambda: 10 * F.regexp_count(t, F.lit("[!?]{2,}")) > F.col("n_words"), lambda: 2.0 * _chars()),
        Rule("few_letters", lambda: 2 * letters() < F.col("word_chars"), lambda: 6.0 * _chars()),
        Rule("capitals", lambda: 2 * capitals() > letters(), lambda: 12.0 * _chars()),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejections per cost on a sample, each given those chosen before.

    One job: the sample is grouped by which rules reject (2**rules groups at most), with the mean work of each rule.
    """
    total = docs.count()
    sample = base_columns(docs.sample(min(1.0, sample_rows / max(1, total)), seed))
    seen = sample.select(*[r.rejects().alias(f"r{k}") for k, r in enumerate(rules)], *[r.work().alias(f"w{k}") for k, r in enumerate(rules)])
    groups = seen.groupBy(*[f"r{k}" for k in range(len(rules))]).agg(F.count("*").alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(rules))]).collect()
    left, order = list(range(len(rules))), []
    while left:
        alive = [g for g in groups if not any(g[f"r{k}"] for k in order)]
        gain = {k: sum(g["n"] for g in alive if g[f"r{k}"]) / (sum(g[f"w{k}"] for g in alive) or 1.0) for k in left}
        best = max(left, key=lambda k: (gain[k], -k))
        order.append(best)
        left.remove(best)
    return [rules[k] for k in order]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none; later rules are not evaluated once one has rejected."""
    verdict = F.when(rules[0].rejects(), rules[0].name)
    for rule in rules[1:]:
        verdict = verdict.when(rule.rejects(), rule.name)
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs (with a column ``text``) with the base columns, base_failed, rejected_by and kept."""
    rules = order_rules(docs, standard_rules() if rules is None else rules)
    rows = base_columns(docs).withColumn("base_failed", base_failed())
    rows = rows.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(rules)))
    return rows.withColumn("kept", F.col("rejected_by").isNull())


def quality_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by)."""
    got = judge(docs.select(key, F.col(text).alias("text")))
    return got.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of docs that no rule rejects, with the columns of docs."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return judge(packed).where("kept").select("row.*")
