import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stranda.llm import common, encoders, langid, line_dedup, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, __text string"


def documents(spark):
    rng = random.Random(20)
    parts = {"aa": ["ka", "lo", "mi", "sen", "tur"], "bb": ["ster", "ung", "ach", "vel", "bro"]}
    words = {c: ["".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(600)] for c, p in parts.items()}
    rows = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        text = "\n".join(" ".join(rng.choice(words[lang]) for _ in range(30)) for _ in range(4))
        if i % 10 == 0:
            text += "\nall rights reserved"
        rows.append((i, text, lang))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)]  # exact copies
    rows += [(300, rows[7][1].replace("\n", "  "), "aa"), (400, None, "aa"), (401, "", None), (402, "x # " * 80, "aa"), (403, "123 " * 100, "aa"), (None, rows[3][1], None), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(i, t, c, "s", len(t or ""), 1, "clash") for i, t, c in rows], SCHEMA)


def test_each_stage_does_what_its_operator_says(spark):
    docs = documents(spark).cache()
    seen = docs
    for name, stage in P.STAGES:
        out = common.save(stage(spark, seen, ""), "stage").cache()
        if name != "packing":
            assert out.columns == docs.columns, name
        if name == "quality rules":
            model = quality.QualityModel.train(seen)
            want = model.find_bands(s := model.scored(seen)).verdicts(s).filter("kept").select("doc_id")
            assert sorted(map(str, out.select("doc_id").collect())) == sorted(map(str, want.collect()))
            assert {400, 401, 402, 403}.isdisjoint(r.doc_id for r in out.collect())
        if name == "language ID":
            found = langid.predictions(seen, langid.learn(seen)).filter("lang_pred <> 'und' and score >= 0.5")
            assert out.count() == found.count() > 100
        if name == "line dedup":
            assert out.count() == seen.count()
            texts = [r.text for r in out.collect()]
            count = {}
            for r in seen.collect():
                for k in {line_dedup.line_key(x) for x in r.text.encode().split(b"\n")} - {b""}:
                    count[k] = count.get(k, 0) + 1
            assert b"all rights reserved" in [k for k, n in count.items() if n >= 10] and not any("all rights" in t for t in texts)
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id is not None and r.doc_id % 10 == 0)
        if name == "SimHash near-dedup":
            groups = {r.component_id for r in simhash.near_duplicates(seen).collect()}
            assert out.count() == len(groups) and {r.doc_id for r in out.collect()} == groups
            assert not {r.doc_id for r in out.collect()} & {None, 300, *range(200, 210)}
        seen = out
    assert seen.agg(F.sum("length")).first()[0] > 0


def test_run_and_empty_tables(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    documents(spark).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:4]])
def test_stages_keep_odd_rows_from_crashing(spark, name):
    rows = [(None, None, None, None, None, None, None), (1, "", "", "", 0, 0, ""), (1, "", "", "", 0, 0, ""), (2, "w " * 60_000, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = dict(P.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns and out.count() <= 4


def test_workers_let_go_of_encoders_that_their_tasks_no_longer_use():
    encoders.encoder(encoders.default_path("byte_bpe_50k.json"), False)
    common.end_task()
    assert encoders._made  # the task used it
    common.end_task()
    assert not encoders._made
