import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tactus.llm import catalog, fim
from tests.oracle import compare

D = "/root/testdata/sf0.001"


def brute(text, key):
    """Token by token."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexed = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", "a", "ab", "1", " a", "a ", "ab cd", "<", "<P", "P>", "<P><", "x<S>y", "<M>", "é", "ÀB", "𝒳y𝒵", "\n\n", "a1b2", "[`{@", "İ", "\x00"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join), st.integers(-(2**63), 2**63 - 1))
def test_transformed_equals_brute_force(text, key):
    assert fim.transformed(text, str(key)) == brute(text, key)


@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join))
def test_every_cut_is_where_the_units_say(text):
    runs, units = fim.Runs(text), re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert runs.units == len(units)
    assert [runs.place(c) for c in range(len(units) + 1)] == [len("".join(units[:c])) for c in range(len(units) + 1)]


def test_odd_rows(spark):
    rows = [(None, "null id"), (None, None), (1, None), (1, ""), (2**53 + 1, "a b c d"), (2**53 + 1, "a b c d"), (-(2**63), "x<S>y"), (7, "word " * 200_000), (8, "z" * 1_000_000)]
    rows += [(k, t * 3) for k, t in enumerate(ODD, 100)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, output string")
    out = df.select("doc_id", "text", fim.fill_in_middle("text", "doc_id").alias("f"))
    out = out.select("doc_id", "text", "f.*", fim.restored("f.output", "f.form").alias("back")).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted((str(i), t or "") for i, t in rows)
    for r in out:
        want = brute(r.text, "" if r.doc_id is None else r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.back == (r.text or "")


def test_all_forms_come_and_parameters_hold(spark):
    df = spark.range(400).select(F.col("id"), F.lit("one two three").alias("text"))
    forms = lambda **kw: {r.form: r["count"] for r in df.select(fim.fill_in_middle("text", "id", **kw).form.alias("form")).groupBy("form").count().collect()}
    assert set(forms()) == {"plain", "psm", "spm"}
    assert set(forms(cut_percent=0)) == {"plain"}
    assert set(forms(cut_percent=100, suffix_first=100)) == {"spm"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert df.select(fim.fill_in_middle("text", "doc_id").alias("f")).select("f.*").collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_its_oracle(spark, size):
    d = D.replace("sf0.001", size)
    compare(catalog.QUERIES["op13_fill_in_middle"](spark, d), catalog.ORACLES["op13_fill_in_middle"], d)
