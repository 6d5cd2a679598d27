"""Spelling variants by wildcard groups, without a pair of words ever being made within a group.

Runs of letters are counted where they lie, a few of them with one letter left out (seeded by document and
run), and become a vocabulary. A word of L letters stands in L groups (position, prefix, suffix), written as
the word with a star in that position; two words share a group exactly if they differ in that one letter.
Its L deletions are looked up among the words themselves, which finds pairs that differ by a letter more or
less. All of these keys go through one shuffle. A group gives each member its size less one and its best
other member, so its two best words are all that is kept of it, and a word adds up what its groups say.

A group has at most one word for each letter, and a word at most one insertion for each place and letter, so
no group grows with the data. Words are known by ids that ascend in code-point order, so rows of the shuffle
are short whatever a word's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, materialize, text_of

#: Letters of a word at least, and times that it occurs at least.
LETTERS, TIMES = 7, 2
#: A form occurs this many times as often as the word.
FACTOR = 10
#: One run in so many, by its checksum, loses a letter; 0 for none.
DAMAGE = 31
#: Distinct words, and bytes of them, that a task counts before it hands its counts on.
HELD, HELD_BYTES = 200_000, 8 << 20
#: Keys of more letters are replaced by their digest.
LITERAL = 64


def _runs(letters: int) -> re.Pattern[bytes]:
    """Maximal runs of ASCII letters in lower case and U+00C0 to U+00FF, in UTF-8, of at least so many code points."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % letters)


def _damaged(run: bytes, checksum: int) -> bytes:
    text = run.decode("utf-8")
    at = checksum % len(text)
    return (text[:at] + text[at + 1 :]).encode("utf-8")


def count_words(docs: DataFrame, letters: int = LETTERS, damage: int = DAMAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of at least ``letters`` letters over all texts, only A-Z lowered.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``damage`` loses the letter at that checksum modulo its
    length. A null id is written as nothing, a null text has no runs; repeated rows count each.
    """
    ddl = "word string, n bigint"
    schema = arrow_schema(ddl)
    pattern = _runs(letters)

    def handed(held: Counter) -> pa.RecordBatch:
        long = re.compile(rb"(?:[^\xc3]|\xc3.){%d}" % letters, re.DOTALL)
        words = [(w, n) for w, n in held.items() if long.match(w)]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.binary()).cast(pa.string()), pa.array([n for _, n in words], pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                start = zlib.crc32(b"%s:" % (doc.as_py() or "").encode("utf-8"))
                for run, n in Counter(pattern.findall(text.as_py().lower())).items():
                    checksum = zlib.crc32(run, start)
                    if damage and not checksum % damage:
                        run = _damaged(run, checksum)
                    if run not in held:
                        size += len(run)
                    held[run] += n
                if len(held) >= HELD or size >= HELD_BYTES:
                    yield handed(held)
                    held.clear()
                    size = 0
        yield handed(held)

    rows = docs.select(F.col(id_col).cast("string").alias("doc"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, ddl).groupBy("word").agg(F.sum("n").alias("n"))


def _key(text: Column) -> Column:
    """Short keys as they are, which no digest can be, since words hold no digits."""
    return F.when(F.char_length(text) <= LITERAL, text).otherwise(F.sha2(text, 256))


def _keys(words: DataFrame) -> DataFrame:
    """(key, star, own, id, n): a row for each word's wildcards, its distinct deletions and itself."""
    size = F.char_length("word")
    rows = words.select("word", "id", "n", size.alias("size"), F.explode(F.sequence(F.lit(1), 2 * size + 1)).alias("i"))
    at = F.when(F.col("i") <= F.col("size"), F.col("i")).otherwise(F.col("i") - F.col("size"))
    rows = rows.withColumn("at", at.cast("int")).withColumn("star", F.col("i") <= F.col("size")).withColumn("own", F.col("i") == 2 * F.col("size") + 1)
    letter = lambda by: F.substring(F.col("word"), F.col("at") + by, F.lit(1))
    # of equal neighbours only the last is left out: the others give the same deletion
    rows = rows.where(F.col("star") | F.col("own") | (F.col("at") == F.col("size")) | (letter(0) != letter(1)))
    before, after = F.substring(F.col("word"), F.lit(1), F.col("at") - 1), F.substring(F.col("word"), F.col("at") + 1, F.col("size"))
    key = F.when(F.col("own"), F.col("word")).when(F.col("star"), F.concat(before, F.lit("*"), after)).otherwise(F.concat(before, after))
    return rows.select(_key(key).alias("key"), "own", "star", "id", "n")


def _said(words: DataFrame) -> DataFrame:
    """(id, n, near, best): what each group says of each of its members; ``best`` is struct(least: -n of a near word, id)."""
    group = Window.partitionBy("key")
    order = group.orderBy(F.col("own").desc(), F.col("n").desc(), "id")
    kept = _keys(words).select(
        "*",
        F.row_number().over(order).alias("place"),
        F.count("*").over(group).alias("size"),
        F.first(F.struct("own", (-F.col("n")).alias("less"), "id")).over(order).alias("first"),
        F.lead(F.struct((-F.col("n")).alias("less"), "id")).over(order).alias("next"),
    )
    first = F.struct(F.col("first")["less"].alias("less"), F.col("first")["id"].alias("id"))
    # of a wildcard's group every member is near every other; of a plain key only the word itself and its insertions are
    alone = ~F.col("star") & ~F.col("first")["own"]
    near = F.when(F.col("star") | F.col("own"), F.col("size") - 1).otherwise(F.lit(1))
    best = F.when(F.col("place") == 1, F.col("next")).otherwise(first)
    return kept.where(F.col("own") | (F.col("size") > 1) & ~alone).select("id", "n", near.alias("near"), best.alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): forms are followed in doubling steps until none has a further one.

    Each step of a form raises n by FACTOR, so a chain is no longer than the digits of the largest count.
    """
    now = forms.select("id", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.select("id", "root")


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, factor: int = FACTOR, damage: int = DAMAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of at least ``letters`` letters that occurs at least ``times``.

    Words are near if one inserted, deleted or replaced letter turns one into the other; ``n_near`` counts them.
    ``form`` is the near word of largest n, of equal ones the first in code-point order, if that n is at least
    ``factor`` times the word's; else it and ``form_n`` are null. ``root`` is the end of the chain of forms, the
    word itself if it has none.

    Null and empty texts have no words, rows without id and repeated rows count like others, other columns are
    not read, and an empty table or one without such words gives no rows. Long texts are read whole; a run of
    letters of any length is a word, at a cost of the square of its length in hashing.
    """
    counted = count_words(docs, letters, damage, id_col, text_col).where(F.col("n") >= times)
    words = materialize(counted.orderBy("word").select("word", "n", F.monotonically_increasing_id().alias("id")))
    said = _said(words).groupBy("id", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best")["less"] >= factor * F.col("n")
    judged = materialize(said.select("id", "n", "n_near", F.when(has, F.col("best")["id"]).alias("form"), F.when(has, -F.col("best")["less"]).alias("form_n")))
    formed = judged.where("form IS NOT NULL")
    named = lambda as_id, as_word: words.select(F.col("id").alias(as_id), F.col("word").alias(as_word))
    found = formed.select("id", F.col("form").alias("form_id"), "form_n").join(_roots(formed.select("id", "form")).withColumnRenamed("root", "root_id"), "id")
    found = found.join(named("form_id", "form"), "form_id").join(named("root_id", "root"), "root_id").select("id", "form", "root", "form_n")
    rows = words.join(judged.select("id", "n_near"), "id").join(found, "id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
