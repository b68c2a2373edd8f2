import hashlib
import random
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tesselark.llm import pii

WRITTEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(WRITTEN)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, expression in WRITTEN.items():
        for m in re.finditer(expression, text or ""):
            digits = re.sub(r"\D", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                spans.append((m.start(), KINDS.index(kind), kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


CASES = [
    None, "", "plain words", "a@b.c_d@e.f", "x.@y.z.", "@a.b", "a@b", "a@b..c", "é a+b@c-d.é", "\U0001f600 me@x.org \U0001f600 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "1.2.3", "1.2.3.999 9.9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
    "4111  1111 1111 1111", "12345678901234567890123", "x4111111111111111x", "5-5 5", "+1 (443) 555-5793 la", "+1 2", "+12 34 56 78 90 12 34 56",
    "+1 (443) 555-5793 4111111111111111", "++1 443 555 5793.", "a" * 5000 + "@b.c", "1" * 5000, "1 " * 3000, "1.1.1.1 " * 200, "a@b.c" * 300,
]


def test_base_spans_match_the_written_expressions(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text")
    every = docs.unionByName(real)
    found = {r.doc_id: r for r in pii.digests(pii.find_personal_data(every)).collect()}
    for r in every.collect():
        want = brute(r.text)
        got = found[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, want, got.spans)
        assert set(want) <= set(got.spans.split(",")) or not want
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]


def test_trusted_contexts_add_unseen_identifiers(spark):
    rows = [(i, f"filler{i} words then call me at +1 (555) 010-{1000 + i} please thanks{i} bye") for i in range(12)]
    rows.append((100, "here one can call me at 555-010-1234567 please or not"))
    rows.append((101, "the year was 1999-2000 and nothing else"))
    seeds = [(200 + i, f"a{i} customer id number 4111111111111111 today b{i}") for i in range(3)]
    docs = spark.createDataFrame(rows + seeds, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digests(pii.find_personal_data(docs, least_share=0.5)).collect()}
    assert found[101].spans == ""
    assert len(found) == 17
    assert found[100].spans == "phone:24:39" and found[100].n_phone == 0
    assert all(found[i].spans.count("phone") == 1 for i in range(12))


def test_scores_rise_with_seeds(spark):
    edges = [("p1", f"s{i}", "phone", "9-9") for i in range(8)] + [("p1", "new", None, "9-9"), ("p2", "s1", "phone", "9-9")] + [("p2", f"n{i}", None, "a9") for i in range(9)]
    got = pii.score_patterns(spark.createDataFrame(edges, "pattern string, instance string, seed string, shape string")).collect()
    assert [(r.pattern, r.kind) for r in got] == [("p1", "phone")]
    assert got[0].confidence > 0.9


def test_empty_tables_nulls_repeats_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(empty).count() == 0
    docs = spark.createDataFrame([(None, "a@b.c", "x"), (1, "a@b.c", "y"), (1, "a@b.c", "y"), (2, None, None)], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.spans) for r in pii.digests(pii.find_personal_data(docs)).collect())
    assert got == [("1", "email:0:5"), ("1", "email:0:5"), ("2", ""), ("None", "email:0:5")]


def test_redaction_keeps_the_rest_of_the_text(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c or 10.0.0.1 now", "en"), (2, None, "en"), (3, "none", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in pii.redact(docs, pii.find_personal_data(docs)).collect()}
    assert got[1].text == "mail <email> or <ip> now"
    assert got[2].text is None and got[3].text == "none"
    assert got[1].lang == "en"


def test_candidates_that_overlap_base_spans_go(spark):
    rng = random.Random(4)
    kind = "array<struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>>"
    rows = []
    for i in range(60):
        at, spans = 0, []
        for _ in range(rng.choice((0, 3, 1500 if i == 0 else 20))):
            at += rng.randint(0, 5)
            spans.append(("", at, at + rng.randint(1, 6), "m", "", ""))
            at = spans[-1][2]
        rows.append((i, spans, [("email", a, a + rng.randint(1, 9), "m", "", "") for a in rng.choices(range(max(1, at)), k=rng.choice((0, 2, 9)))]))
    docs = spark.createDataFrame(rows, f"i int, c {kind}, b {kind}")
    for r in docs.select("*", pii._apart(F.col("c"), F.col("b")).alias("left")).collect():
        assert r.left == [s for s in r.c if not any(b.start < s.end and b.end > s.start for b in r.b)]


def test_masks_across_pieces_of_a_text(spark):
    rng = random.Random(2)
    words = ["a@b.c", "\U0001f600", "10.0.0.1", "é", "word", "+1 (443) 555-5793", "x" * 3000]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 40, 900, 5000)] + ["y" * 4096 + " a@b.c", "y" * 4090 + " a@b.c" + "z" * 4096, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id a@b.c")], "doc_id long, text string")
    found = pii.find_personal_data(docs)
    spans = {r.doc_id: sorted((s.start, -s.end, s.kind) for s in r.spans) for r in found.collect()}
    for r in pii.redact(docs, found).collect():
        text, out, at = texts[r.doc_id] if r.doc_id is not None else "null id a@b.c", [], 0
        for start, end, kind in spans[r.doc_id]:
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, -end)
        assert r.text == "".join(out) + text[at:]


def test_redaction_of_empty_tables_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.c", 5, "s"), (1, "a@b.c", 5, "s"), (None, "a@b.c", 6, None)], "doc_id long, text string, __id long, `_a spans` string")
    got = pii.redact(docs, pii.find_personal_data(docs))
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(doc_id=1, text="<email>", __id=5, **{"_a spans": "s"})] * 2 + [Row(doc_id=None, text="<email>", __id=6, **{"_a spans": None})]))
    assert pii.redact(docs.where("false"), pii.find_personal_data(docs.where("false"))).count() == 0
    with pytest.raises(ValueError):
        pii.score_patterns(docs, rounds=0)


def test_a_text_with_very_many_matches_takes_linear_time(spark):
    text = "mail u1@b.c or 10.0.0.1, " * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = pii.find_personal_data(docs)
    assert found.selectExpr("size(base) as n").first().n == 20_000
    assert pii.redact(docs, found).first().text == "mail <email> or <ip>, " * 10_000
    assert time.time() - began < 120


@pytest.mark.parametrize("kind", KINDS)
def test_expressions_have_no_capturing_groups(kind):
    assert re.search(r"(?<!\\)\((?!\?)", re.sub(r"\[[^\]]*\]", "", pii.EXPRESSIONS[kind])) is None


def test_context_is_the_text_around_a_match(spark):
    texts = ["Phone: 0171-5551234 thanks", "call 1 at 2 or 3", "x9 me@a.bc 1.2.3.4 b7", "word " * 30 + "room 12 b3 " + "more " * 30, "z" * 90 + " 55 end"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", pii._spans(F.col("text"), pii.CANDIDATE, "").alias("s")).collect():
        assert r.s
        for s in r.s:
            left = r.text[max(0, s.start - pii.CONTEXT - 1) : s.start]
            want = re.sub(r"^\S+\s", " ", left) if len(left) > pii.CONTEXT else left
            assert (s.before, s.after, s.m) == (want, r.text[s.end : s.end + pii.CONTEXT], r.text[s.start : s.end])


def test_identifiers_near_the_start_and_beside_others_are_found(spark):
    seeds = [f"Phone: +1 443 555 57{i:02} thanks" for i in range(12)] + [f"see b7 dial +1 443 666 57{i:02} now" for i in range(12)]
    texts = [*seeds, "Phone: 0171-5551234 thanks", "see b7 dial 0171-5559876 now", "c3 dial 0171-5550000 now"]
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert got[24] == [("phone", 7, 19)] and got[25] == [("phone", 12, 24)] and got[26] == [("phone", 8, 20)]
