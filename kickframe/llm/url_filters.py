"""URL filters by a path-template tree per host, learned from labelled urls.

Distinct paths are counted once and then move down the tree a level at a time, all hosts together. At each
node the next segments are counted; a segment that holds enough of the node's urls stays as it is, of which
a node has at most SPREAD, and all others become one wildcard. Sibling branches whose labels do not differ
significantly are merged, neighbours in the order of their share of bad urls, and go on as one node, so that
what lies below them is counted together. Each node's share is smoothed by that of the node above it, the
host's by that of all urls; a path is rejected if the share at its end reaches the limit.

Totals are added up before they are shuffled and joined to the paths afterwards; what is brought together for a
node is only its literal segments and its wildcard. Everything is made of DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.llm._common import materialize

#: A segment stays literal with so many urls at least, and with one in SPREAD of its node's.
SUPPORT, SPREAD = 2, 20
#: Levels of the tree; what lies deeper is one tail.
DEPTH = 4
#: Labelled urls that a branch needs to be merged, and the squared normal deviate up to which shares count as equal.
LABELLED, DEVIATE = 5, 3.84
#: Urls that the share of the node above counts for, and the share from which a path is rejected.
STRENGTH, LIMIT = 10.0, 0.5


@dataclass(frozen=True)
class Rule:
    """``verdict`` for all urls of ``where``'s host and its subdomains whose path begins with ``where``'s, from the slash on."""

    verdict: str
    where: str


def address(url: Column) -> tuple[Column, Column]:
    """(host, path): from the first ``://`` to ``/``, ``?`` or ``#``, A-Z lowered, and from there to ``?`` or ``#``; else empty."""
    found = F.locate("://", url)
    rest = F.when(found > 0, F.substring(url, found + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(where, verdict) of the longest rule that fits, of equal ones that with the longer host; else null."""
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r.where), -r.where.index("/"), r.where)):
        of, slash, below = rule.where.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + below)
        cases.append((fits, rule))
    pick = lambda name: F.coalesce(*[F.when(fits, F.lit(getattr(rule, name))) for fits, rule in cases], F.lit(None).cast("string"))
    return pick("where"), pick("verdict")


def _branches(active: DataFrame) -> DataFrame:
    """(host, node, member, label, rate): what becomes of each literal segment below a node, and of its wildcard (member ``*``)."""
    totals = [F.sum(c).alias(c) for c in ("n", "k", "b")]
    node = active.groupBy("host", "node").agg(*totals, F.max("rate").alias("rate"))
    children = active.groupBy("host", "node", "seg").agg(*totals)
    all_n = node.select("host", "node", F.col("n").alias("all_n"))
    literal = materialize(children.join(all_n, ["host", "node"]).where((F.col("n") >= SUPPORT) & (F.col("n") * SPREAD >= F.col("all_n"))).drop("all_n"))
    kept = literal.groupBy("host", "node").agg(*[F.sum(c).alias(f"kept_{c}") for c in ("n", "k", "b")])
    left = lambda c: (F.col(c) - F.coalesce(f"kept_{c}", F.lit(0))).alias(c)
    wild = node.join(kept, ["host", "node"], "left").select("host", "node", F.lit("*").alias("seg"), left("n"), left("k"), left("b"))
    siblings = literal.unionByName(wild).join(node.select("host", "node", "rate"), ["host", "node"])
    # from here on a node has at most SPREAD + 1 rows
    order = Window.partitionBy("host", "node", "judged").orderBy(F.col("b") / F.greatest("k", F.lit(1)), "seg")
    before = lambda c: F.lag(c).over(order)
    rows = siblings.withColumn("judged", F.col("k") >= LABELLED)
    rows = rows.withColumn("differs", ~F.col("judged") | F.coalesce(_differs(before("b"), before("k"), F.col("b"), F.col("k")), F.lit(True)))
    rows = rows.withColumn("of", F.sum(F.col("differs").cast("int")).over(order))
    group = Window.partitionBy("host", "node", "judged", "of")
    members = F.sort_array(F.collect_list("seg").over(group))
    label = F.when(F.size(members) == 1, F.col("seg")).otherwise(F.concat(F.lit("("), F.array_join(members, "|"), F.lit(")")))
    rate = (F.sum("b").over(group) + STRENGTH * F.col("rate")) / (F.sum("k").over(group) + STRENGTH)
    return materialize(rows.select("host", "node", F.col("seg").alias("member"), label.alias("label"), rate.alias("rate")))


def _differs(b1: Column, k1: Column, b2: Column, k2: Column) -> Column:
    """Whether two shares of bad urls differ significantly."""
    b1, k1, b2, k2 = (c.cast("double") for c in (b1, k1, b2, k2))
    apart = b1 * k2 - b2 * k1
    return apart * apart * (k1 + k2) > DEVIATE * k1 * k2 * (b1 + b2) * (k1 + k2 - b1 - b2)


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, path, template, rate) from (host, path, n, k, b): distinct paths with their urls, labelled and bad ones."""
    every = paths.agg(F.sum("k"), F.sum("b")).first()
    rate = every[1] / every[0] if every[0] else 0.0
    # characters that templates use for themselves are written as in urls
    escaped = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), "*|()", F.col("path"))
    start = paths.withColumn("segs", F.filter(F.split(escaped, "/"), lambda s: s != ""))
    hosts = paths.groupBy("host").agg(((F.sum("b") + STRENGTH * rate) / (F.sum("k") + STRENGTH)).alias("rate"))
    now = materialize(start.join(hosts, "host").withColumn("node", F.lit("")))
    done = []
    for level in range(depth):
        done.append(now.where(F.size("segs") <= level))
        active = now.where(F.size("segs") > level).withColumn("seg", F.col("segs")[level])
        if active.isEmpty():
            break
        branches = _branches(active)
        literal = branches.where("member <> '*'").select("host", "node", F.col("member").alias("seg"), F.col("label").alias("own"), F.col("rate").alias("own_rate"))
        wild = branches.where("member = '*'").select("host", "node", F.col("label").alias("any"), F.col("rate").alias("any_rate"))
        joined = active.drop("rate").join(literal, ["host", "node", "seg"], "left").join(wild, ["host", "node"])
        node = F.concat("node", F.lit("/"), F.coalesce("own", "any"))
        now = materialize(joined.select("host", "path", "n", "k", "b", "segs", node.alias("node"), F.coalesce("own_rate", "any_rate").alias("rate")))
    else:
        done.append(now.withColumn("node", F.when(F.size("segs") > depth, F.concat("node", F.lit("/**"))).otherwise(F.col("node"))))
    return reduce(DataFrame.unionByName, [d.select("host", "path", F.col("node").alias("template"), "rate") for d in done])


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = (), limit: float = LIMIT, depth: int = DEPTH, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, rate): one row per row of ``pages``; other columns are not read.

    ``labelled`` has (url, bad boolean); rows without either teach nothing, repeated ones count each. ``rule`` is
    the longest rule that fits and its verdict holds; else ``verdict`` is block where the smoothed share of bad
    urls of the path's template reaches ``limit``, and allow elsewhere. A null url, or one without ``://``, has an
    empty host and path, and is judged as such. Segments below ``depth`` are one tail ``**``; empty segments are
    passed over. Null ids and repeated rows are judged like others; an empty table gives no rows, and with no
    labels at all every share is 0.
    """
    host, path = address(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    host, path = address(F.col("url"))
    seen = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(host.alias("host"), path.alias("path"), F.lit(0).alias("n"), F.lit(1).alias("k"), F.col("bad").cast("int").alias("b"))
    counted = rows.select("host", "path", F.lit(1).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("b")).unionByName(seen)
    paths = materialize(counted.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "k", "b")]))
    found = rows.join(templates(paths, depth), ["host", "path"])
    rule, verdict = _ruled(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("rate") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "rate")
