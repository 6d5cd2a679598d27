"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a Boolean column over the text's counts that is true for texts to reject. Its selectivity and
its cost are estimated on a bounded sample, and the rules are tried in the order of rejection per cost;
the first that rejects ends the cascade for that row (a CASE), so dear counts are made for few rows.
The order changes only the time: the verdict is whether any rule rejects.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import materialize, text_of
from kickframe.llm.exprs import let, words_of

#: Words to a window of the repeated-words count.
WINDOW = 8
#: Rows at most from which costs and selectivities are estimated, and the longest text of them in bytes; the estimates only order the rules.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 100_000
#: How often a rule is timed, and how often each row is judged in that time.
TIMES, REPEATS = 3, 2
#: Share of rows in that sample before the bound.
SAMPLE_SHARE = 0.02


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes, from the counts by name, the condition that a text to reject fulfils."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


#: Base rules: too few words, and more than 30 in 100 words in repeated windows.
BASE = (
    Rule("few_words", lambda c: c["n_words"] < 20),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
)
#: The cascade's own rules, with published heuristic limits set so that plain prose of any language passes.
MORE = (
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 40 * c["n_words"])),
    Rule("repeated_lines", lambda c: 2 * c["n_dup_lines"] > c["n_lines"]),
    Rule("few_letters", lambda c: 10 * c["n_letter_words"] < 6 * c["n_words"]),
)


def _next_to(values: Column, by: int) -> Column:
    """For each entry that has one, the hash of it and the entry ``by`` places on."""
    n = F.size(values) - by
    return F.zip_with(F.slice(values, 1, n), F.slice(values, by + 1, n), lambda a, b: F.xxhash64(a, b))


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words found twice or more in the text, the first included.

    A window's key is a 64-bit hash made by doubling (1, 2, 4, 8 words); keys are sorted only where one repeats.
    """

    def covered(keys: Column) -> Column:
        # sorted by key, then place: equal keys are neighbours
        sorted_keys = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def places(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<k:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
            after = F.concat(F.slice(s, 2, F.size(s) - 1), F.array(F.lit(None).cast("struct<k:bigint,i:int>")))
            near = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
            twice = F.filter(near, lambda x: x["s"]["k"].eqNullSafe(x["b"]["k"]) | x["s"]["k"].eqNullSafe(x["a"]["k"]))
            return F.sort_array(F.transform(twice, lambda x: x["s"]["i"]))

        def total(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x).cast("bigint")

        return let(let(sorted_keys, places), total)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    keys = let(let(let(hashes, lambda h: _next_to(h, 1)), lambda h: _next_to(h, 2)), lambda h: _next_to(h, 4))
    counted = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("bigint"))


def _parts(text: Column) -> Column:
    """struct(text, words, lines): what the counts read; lines are those with a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))


def _counts(parts: Column) -> dict[str, Column]:
    """The counts that rules read, all longs, as expressions over ``parts``; each is made only where it is asked for."""
    text, words, lines = parts["text"], parts["words"], parts["lines"]
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
    }
    return {k: v.cast("bigint") for k, v in counts.items()}


#: The counts that ``judge`` returns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rejects(rule: Rule, parts: Column) -> Column:
    return rule.rejects(_counts(parts))


def plan_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", share: float = SAMPLE_SHARE, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``rows`` rows of at most SAMPLE_BYTES, best first.

    The sample is written to the shared folder, so no text reaches the driver. Each rule runs alone over it:
    its rejections give the selectivity; its cost is the least time of several runs, in turn with the other
    rules, less that of a run without a rule. The sample only orders the rules; with none (an empty table,
    say) they stay as given.
    """
    texts = docs.select(text_of(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    sample = materialize(texts.sample(fraction=share, seed=seed).limit(rows)).coalesce(1)
    again = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("n"))
    jobs = [F.lit(False), *[let(_parts(F.concat("text", F.repeat(F.lit(" "), F.col("n")))), partial(_rejects, r)) for r in rules]]
    took, rejected = [float("inf")] * len(jobs), [None] * len(jobs)
    for _ in range(TIMES):
        for k, job in enumerate(jobs):
            began = time.perf_counter()
            rejected[k] = again.agg(F.avg(job.cast("double"))).first()[0]
            took[k] = min(took[k], time.perf_counter() - began)
    if rejected[0] is None:
        return list(rules)
    worth = {r.name: rejected[k] / max(took[k] - took[0], 1e-4) for k, r in enumerate(rules, 1)}
    return sorted(rules, key=lambda r: -worth[r.name])


def _verdict(ordered: list[Rule], counts: Mapping[str, Column]) -> Column:
    """The name of the first rule that rejects, else null; rules after it are not evaluated."""
    return F.coalesce(*[F.when(r.rejects(counts), F.lit(r.name)) for r in ordered])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = MORE, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text", share: float = SAMPLE_SHARE) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ``base_failed``, ``rejected_by``, ``kept``):
    one row per row of ``docs``, other columns ignored.

    The five counts are made for every row; what else the rules read is made within the cascade, where a rule
    before has not rejected. ``rejected_by`` is the first rule of the cascade to reject, or null; which of
    several rejecting rules that is depends on the order chosen, ``kept`` does not. Empty and null texts have
    no words and are rejected; very long texts are counted whole; rows without id and repeated rows are
    judged like others; an empty table gives no rows.
    """
    ordered = plan_order(docs, base + rules, text_col, share)
    parts = docs.select(F.col(id_col), _parts(text_of(text_col)).alias("__parts"))
    lazy = _counts(F.col("__parts"))
    measured = parts.select(id_col, "__parts", *[lazy[k].alias(k) for k in COUNTS])
    named = {**lazy, **{k: F.col(k) for k in COUNTS}}
    failed = F.lit(False)
    for r in base:
        failed = failed | r.rejects(named)
    judged = measured.withColumn("base_failed", failed).withColumn("rejected_by", _verdict(ordered, named))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("__parts")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = MORE, base: tuple[Rule, ...] = BASE, text_col: str = "text", share: float = SAMPLE_SHARE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``.

    Counts are made inside the cascade, so a row pays for the rules up to the one that rejects it. Null and
    empty texts go, an empty table stays empty; ids are not read, so null and repeated ones do not matter.
    """
    ordered = plan_order(docs, base + rules, text_col, share)
    return docs.where(let(_parts(text_of(text_col)), lambda p: _verdict(ordered, _counts(p))).isNull())
