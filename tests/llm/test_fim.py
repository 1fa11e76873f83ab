"""Fill-in-middle against a plain model: cuts, forms, digests, and texts rebuilt."""

import hashlib
import re

from spindrift.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def model(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "a", " a b ", "one  two\tthree\r\nfour", "has <P> inside", "<S>", "<M", "a<", "P>b <", "x\x0b\x0cy\x1fz\xa0w　v", "𝒳 𝒴𝒵 é́ 漢字 　x", "  \n ", "w " * 30_000, "\n" * 5_000, "<<P <S >M>"]


def rows():
    return [(i * 7 + k, t) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "a b c d"), (5, "again"), (5, "again")]


def test_against_the_model(spark):
    made = fim.arranged(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3))
    digest = fim.round_trip(spark.createDataFrame(rows(), "doc_id long, text string"))
    want = [(doc_id, *model(doc_id, text)) for doc_id, text in rows()]
    key = repr
    assert sorted([tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()], key=key) == sorted(want, key=key)
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = [(doc_id, *model(doc_id, text)[:4], sha(model(doc_id, text)[4]), sha(text)) for doc_id, text in rows()]
    assert sorted(map(tuple, digest.collect()), key=key) == sorted(want, key=key)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_every_form_is_restored(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 8)], "doc_id long, text string")
    for rate, spm_rate, form in ((100, 100, "spm"), (100, 0, "psm"), (0, 50, "plain")):
        made = fim.arranged(docs, rate=rate, spm_rate=spm_rate)
        back = made.select("text", fim.restored(made.output, made.form).alias("back"), "form").collect()
        assert all((r.text or "") == r.back for r in back)
        assert form in {r.form for r in back}


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", "yours", 3.0)], "doc_id long, text string, form string, whole string, n double")
    made = fim.arranged(docs)
    assert made.columns == ["doc_id", "text", "whole", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.first().whole == "yours" and made.first().n == 2
    assert fim.round_trip(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fim.round_trip(spark.createDataFrame(rows(), "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
