"""The secret scan and the quality rules: expressions only."""

import pytest
from pyspark.sql import functions as F

from kickframe.llm import quality_rules, queries, secret_scan
from tests.llm import plain
from tests.llm.conftest import SF


def test_secret_query(spark, documents, same):
    same(queries.op1_secret_scan(spark, SF), [plain.secret_row(*d) for d in documents])


def test_secrets_of_odd_rows(odd, none, same):
    found = secret_scan.scan(odd).select("doc_id", secret_scan.digest(F.col("spans")).alias("spans"))
    rows = odd.select("doc_id", "text").collect()
    same(found, [(i, plain.secret_row(i, t)[-1]) for i, t in rows])
    assert secret_scan.scan(none).count() == 0


def test_redact(odd, same):
    got = secret_scan.redact(odd)
    assert got.columns == odd.columns
    want = []
    for r in odd.collect():
        text = plain.redacted(r.text)
        want.append(tuple({**r.asDict(), "text": text, "n_chars": r.n_chars if text == r.text else len(text)}.values()))
    same(got, want)


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("AKIA[A-Z0-9]{16,}") == [["aki", "kia"]]
    assert len(q("(password|token)=")) == 2
    assert {"pas", "ass", "rd="} <= set(q("(password|token)=")[0]) and "en=" in q("(password|token)=")[1]
    assert q("[0-9a-f]{24,}") == [] and q("a?b?c?") == [] and q("ab") == []
    assert q("x[ab]cde") and all("cde" in grams for grams in q("x[ab]cde"))
    # the shorter alternative covers the longer, and the kana pass as they are
    assert q("(secret|secrets)") == [sorted({"sec", "ecr", "cre", "ret"})]


@pytest.mark.parametrize("pattern", ["ab+c=[0-9]+", "(foo|ba(r|z)x)-?[0-9]{2}", "k[ei]y=.", "[0-9]{3}", "(abc)?def", "a(bc|d)e?fgh"])
def test_index_finds_what_a_scan_finds(spark, pattern, same):
    import re

    texts = ["ab", "abbc=12", "abc=1 abbbc=22", "foo-11", "barx22bazx", "kiy=x", "key=yy", "123 4567", "abcdef", "def", "abcefgh adfgh", "ABC=1", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secret_scan.scan(rows, (secret_scan.Rule("r", pattern),)).select("doc_id", F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("s"))
    got = {r.doc_id: [tuple(s) for s in r.s] for r in found.collect()}
    assert got == {i: [m.span() for m in re.finditer(pattern, t or "")] for i, t in enumerate(texts)}


def test_quality_query(spark, documents):
    got = {r.doc_id: tuple(r) for r in queries.op7_quality_rules(spark, SF).collect()}
    for i, text in documents:
        want = plain.quality_row(i, text)
        assert got[i] == (*want, not (want[-1] or plain.other_rules(text)))


def test_quality_of_odd_rows(odd, none):
    judged = quality_rules.judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = [(*(w := plain.quality_row(r.doc_id, r.text)), not (w[-1] or plain.other_rules(r.text))) for r in odd.collect()]
    assert sorted(map(tuple, judged.collect()), key=repr) == sorted(want, key=repr)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(kept.toPandas().doc_id) == sorted(w[0] for w in want if w[-1])
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_the_order_of_rules_changes_no_verdict(spark, documents):
    rows = spark.createDataFrame(documents, "doc_id bigint, text string")
    rules = quality_rules.BASE + quality_rules.MORE
    one = quality_rules.plan_order(rows, rules, share=1.0)
    assert {r.name for r in one} == {r.name for r in rules}
    kept = [{r.doc_id for r in quality_rules.keep_good(rows, base=b, rules=m).collect()} for b, m in ((rules[:2], rules[2:]), (rules[::-1], ()))]
    assert kept[0] == kept[1]


def test_no_python_in_native_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (secret_scan.scan(docs), secret_scan.redact(docs), quality_rules.judge(docs), quality_rules.keep_good(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_rules_of_one_kind_are_all_searched(spark):
    rules = (secret_scan.Rule("key", "abc[0-9]+"), secret_scan.Rule("key", "xyz[0-9]+"))
    rows = spark.createDataFrame([(1, "abc12"), (2, "xyz34"), (3, "xyz5 abc6"), (4, "none")], "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_scan.scan(rows, rules).collect()}
    assert got == {1: [(0, 5)], 2: [(0, 5)], 3: [(0, 4), (5, 9)], 4: []}


def test_the_cascade_makes_dear_counts_late(spark):
    """What only the cascade reads is not made in a projection before the verdict."""
    judged = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"))
    assert "n_letter_words" not in judged.columns and "n_letter_words" not in judged._jdf.queryExecution().optimizedPlan().toString()
