"""Secret scan with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean trigram query: alternatives, each a set of trigrams that
a match must contain. The index holds, per trigram and block of document ids, the sorted posting list.
Posting lists are intersected within a block and united over alternatives; only the documents found are
verified with the expression itself. A rule without mandatory trigrams scans every text. Only trigrams
that some rule asks for are indexed, so the index is a small part of the text.

Postings are grouped by block of ids, so a group holds at most ``block`` ids for each trigram however
common the trigram is; texts move once, to meet their candidate rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser  # the expression trees of the standard library

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm._common import text_of
from kickframe.llm.exprs import let, sums_before

#: Ids to a block of posting lists.
BLOCK = 4096
#: Alternatives that a trigram query may have before it counts as no query.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read alike in Java and Python; ``group`` of a match has ``least`` characters or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False


#: Fixed values. The last two demand the length in the pattern: a run that is too short has no long enough part.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def _products(prefixes: list[str], more: list[str]) -> list[str]:
    return sorted({a + b for a in prefixes for b in more})


def _strings(tree) -> tuple[list[list[str]], list[str] | None]:
    """(required, whole) of a sequence: sets of strings of which each match contains one, and all its matches if those are few."""
    required: list[list[str]] = []
    run, whole = [""], True
    for op, arg in tree:
        name, few = str(op), None
        if name == "LITERAL":
            few = [chr(arg)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            few = sorted({chr(a) for _, a in arg})
        elif name == "SUBPATTERN":
            inner, few = _strings(arg[3])
            required += inner if few is None else []
        elif name == "BRANCH":
            parts = [_strings(x)[1] for x in arg[1]]
            few = None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            _, few = _strings(arg[2])
            few = few and sorted({*few, *([""] if arg[0] == 0 else [])})
        if few is not None and len(run) * len(few) <= MOST_ALTERNATIVES:
            run = _products(run, few)
        else:
            required.append(run)
            run, whole = few or [""], False
    return ([] if whole else [*required, run]), (run if whole else None)


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams, in lower case; a matching text has all of one alternative. Empty: no such query."""
    required, whole = _strings(_parser.parse(pattern))
    best: list[frozenset[str]] = []
    for strings in [whole] if whole is not None else required:
        grams = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() in grams:
            continue
        grams = {g for g in grams if not any(h < g for h in grams)}
        if not best or min(map(len, grams)) > min(map(len, best)):
            best = sorted(grams, key=sorted)
    return [sorted(g) for g in best]


def build_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(block, gram, ids): the sorted ids in each block of the texts that contain each gram, in either case."""
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("low"))
    has = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return (
        low.select("id", F.explode(has).alias("gram"))
        .groupBy(F.expr(f"id div {block}").alias("block"), "gram")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )


def candidates(index: DataFrame, queries: dict[int, list[list[str]]], id_col: str = "doc_id") -> DataFrame:
    """(id, rules): for each document that satisfies a trigram query, the numbers of such rules."""
    none = F.array().cast("array<bigint>")
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    found = []
    for number, alternatives in queries.items():
        ids = none
        for grams in alternatives:
            both = F.coalesce(F.col("lists")[grams[0]], none)
            for g in grams[1:]:
                both = F.array_intersect(both, F.coalesce(F.col("lists")[g], none))
            ids = F.array_union(ids, both)
        found.append(F.arrays_zip(ids.alias("id"), F.array_repeat(F.lit(number), F.size(ids)).alias("rule")))
    hits = lists.select(F.explode(F.concat(*found)).alias("x")).select("x.id", "x.rule")
    return hits.groupBy(F.col("id").alias(id_col)).agg(F.collect_set("rule").alias("rules"))


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches in code points, left to right without overlap: the text between matches is what split() leaves."""
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
    lengths = lambda a: F.transform(a, lambda s: F.char_length(s).cast("bigint"))

    def spans(m: Column) -> Column:
        steps = F.zip_with(lengths(m["gaps"]), lengths(m["all"]), lambda gap, one: gap + F.coalesce(one, F.lit(0)))
        ends = F.zip_with(sums_before(steps), steps, lambda before, step: before + step)
        kept = F.zip_with(
            F.arrays_zip(m["all"].alias("all"), m["part"].alias("part")),
            F.slice(ends, 1, F.size(m["all"])),
            lambda x, end: F.struct(
                (end - F.char_length(x["all"])).alias("start"),
                F.lit(order).alias("order"),
                end.alias("end"),
                F.lit(rule.kind).alias("kind"),
                (F.char_length(x["part"]) >= rule.least).alias("ok"),
            ),
        )
        return F.filter(kept, lambda s: s["ok"])

    pieces = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("part"),
    )
    return F.when(text.rlike(pattern), let(pieces, spans))


_SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string,ok:boolean>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every secret of every whole text.

    Returns (id, spans) and the columns in ``keep``: one row per input row, ``spans`` an array of
    (start, order, end, kind, ok) by start and then by the rules' order, in code points, end exclusive.
    Several rules may have one kind. Ids are integers. A null or empty text has no spans; very long texts are
    scanned whole. A row without id is not in the index and is verified against all rules;
    repeated ids are verified together if any row of them is a candidate, so each row has its own spans.
    Other columns of ``docs`` are ignored, whatever their names. An empty table gives no rows.
    """
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for alternative in q for g in alternative})
    rows = docs.select(F.col(id_col), *[c for c in keep if c not in (id_col, text_col)], text_of(text_col).alias(text_col))
    none = F.array().cast(_SPANS)
    if grams:
        marked = candidates(build_index(docs, grams, id_col, text_col), queries, id_col).withColumnRenamed(id_col, "__id")
        rows = rows.join(marked.hint("shuffle_hash"), rows[id_col] == marked["__id"], "left").drop("__id")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    found = []
    for n, r in enumerate(rules):
        asked = F.lit(True) if n not in queries else F.col(id_col).isNull() | F.coalesce(F.array_contains("rules", n), F.lit(False))
        found.append(F.coalesce(F.when(asked, _found(F.col(text_col), r, n)), none))
    return rows.select(F.col(id_col), *[c for c in (*keep,) if c != id_col], F.sort_array(F.concat(*found)).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret span replaced by ``mask``, overlapping spans by one; same columns and rows.

    Texts without secrets, null ones too, stay as they are; rows without id and repeated rows are masked like
    others, and an empty table stays empty. ``length_col`` is counted anew where a text changed.
    """
    names = docs.columns
    rest = F.struct(*[F.col(c) for c in names if c != text_col], F.col(text_col).isNull().alias("__null"), text_of(text_col).alias("__text"))
    hidden = docs.select(F.col(id_col).alias("__key"), rest.alias("__rest"))
    found = scan(hidden.withColumn("__body", F.col("__rest.__text")), rules, "__key", "__body", keep=("__rest",))
    text = F.col("__rest.__text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    changed = F.size("spans") > 0
    new = {text_col: F.when(changed, whole).when(~F.col("__rest.__null"), text)}
    if length_col in names:
        # the text is made anew where its length is asked for, but only in the few rows that changed
        new[length_col] = F.when(changed, F.length(whole).cast(docs.schema[length_col].dataType)).otherwise(F.col("__rest")[length_col])
    return found.select(*[new.get(c, F.col("__rest")[c]).alias(c) for c in names])


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
