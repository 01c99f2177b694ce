from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import test_mixing, test_quality, test_sharding_secrets, test_simhash

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        source = {r["doc_id"]: r["source"] for r in docs.collect()}
        out = stage(spark, docs, D)
        if number < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = docs.collect()
        texts = dict(before)
        if number == 0:
            assert all(texts[r["doc_id"]] == r["text"] and not test_quality.brute(r["text"])[5] for r in after)
            failed = {d for d, t in before if test_quality.brute(t)[5]}
            assert len(after) >= 0.8 * (len(before) - len(failed))
        elif number == 1:
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in test_simhash.brute(before)})
        elif number == 2:
            assert len(after) == len(before)
            for r in after:
                spans = test_sharding_secrets.brute(texts[r["doc_id"]])
                assert ("[SECRET]" in r["text"]) >= bool(spans)
                assert not test_sharding_secrets.brute(r["text"]) and r["n_chars"] == len(r["text"])
        elif number == 3:
            size = {d: len(t.encode().split()) for d, t in before}
            by_source = defaultdict(int)
            for d in size:
                by_source[source[d]] += size[d]
            want, taken, copies = test_mixing.targets(by_source), Counter(), Counter(r["doc_id"] for r in after)
            for r in after:
                assert set(r["text"].split()) <= set(texts[r["doc_id"]].split())
                taken[r["source"]] += len(r["text"].encode().split())
            assert max(copies.values()) <= 3
            assert all(abs(taken[s] - want[s]) <= 128 for s in want)
        else:
            assert sum(r["piece"] == 0 for r in after) == len(before)
            assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(d for d, _ in before)


def test_run_and_empty_table(spark):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, D)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 100
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.collect() == []


def test_ids_stay_exact_beside_a_null(spark):
    table = [r for r in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect() if 300 < len(r["text"]) < 3000][:60]
    ids = [None if k % 5 == 0 else (2**53 + 1 + 2 * k) * (-1) ** k for k in range(len(table))] + [-(2**63)]
    own = {r["text"]: i for r, i in zip(table, ids, strict=False)}
    docs = spark.createDataFrame([(own[t], t, "en", "web", len(t)) for t in own], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        schema, seen = (out := stage(spark, docs, D)).schema, out.collect()
        assert {r["doc_id"] for r in seen} <= {*own.values()}
        if number < 2:
            assert seen and all(own[r["text"]] == r["doc_id"] for r in seen)
        docs = spark.createDataFrame(seen, schema).coalesce(1)
    assert len({r["doc_id"] for r in seen} - {None}) > 10 and None in {r["doc_id"] for r in seen}


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"word{k}" for k in range(30_000)) + "."
    text = "A plain line of prose that says something new about the river.\nAnother line tells of the hills and of the people there."
    rows = [(1, text), (1, text), (1, text.replace("river", "ocean and the sea beyond the far islands of the south")), (None, text + " No id."), (None, None), (2, None), (3, ""), (4, long)]
    rows += [(5, "Key: password = hunter2secret here with more than ten words in the line, as it is.")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc int, _spans string, row int, q string, found int, turn int, fp int"
    docs = spark.createDataFrame([(d, t, "en", None if d == 4 else "web", len(t or ""), 7, "s", 8, "q", 9, 10, 11) for d, t in rows], schema)
    extra = lambda df: {tuple(r)[5:] for r in df.collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, D)
    assert kept.dtypes == docs.dtypes and extra(kept) == {(7, "s", 8, "q", 9, 10, 11)}
    assert Counter(r["text"] for r in kept.collect()) == Counter(t for _, t in rows if t)
    alone = corpus_pipeline.near_duplicates(spark, docs, D)
    assert alone.dtypes == docs.dtypes and Counter(r["text"] or None for r in alone.collect()) == Counter({t or None for _, t in rows})
    clean = corpus_pipeline.secret_scans(spark, docs, D)
    assert clean.dtypes == docs.dtypes and extra(clean) == {(7, "s", 8, "q", 9, 10, 11)}
    assert [r["text"] for r in clean.collect() if r["doc_id"] == 5 and "[SECRET]" in r["text"]] and sum(r["text"] is None for r in clean.collect()) == 2
    mixed = corpus_pipeline.source_mix(spark, docs, D)
    assert mixed.dtypes == docs.dtypes and extra(mixed) == {(7, "s", 8, "q", 9, 10, 11)}
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    packed = corpus_pipeline.best_fit_packing(spark, docs, D).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows)
