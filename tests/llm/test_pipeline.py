"""The pipeline's stages, each against brute force on a small set of planted documents."""

import random

import corpus_pipeline
from dawnframe.llm import decontaminate, langid, secrets, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(12)
    sounds = {"aa": ("th", "en", "ing", "ou"), "bb": ("sch", "ung", "ei", "ö")}
    word = lambda g: "".join(rng.choice(sounds[g]) for _ in range(3))
    rows = []
    for i in range(160):
        g = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(word(g) for _ in range(70)), g, f"s{i % 4}"))
    items = [(1, " ".join(word("aa") for _ in range(30)))]
    rows += [(200, rows[3][1], "bb", "s1"), (201, rows[4][1] + " ende", "aa", "s1")]  # an exact and a near copy
    rows += [(210, rows[6][1] + " " + items[0][1], "aa", "s2")]  # a leak
    rows += [(220, rows[8][1].replace("e", "ou") + " password = hunter2hunter2 end", "aa", "s3")]  # a secret
    rows += [(230, "1234 !!", None, "s0"), (231, None, None, None)]  # no language
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = corpus(spark, folder)
    text = {r[0]: r[1] for r in rows}
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder)
        after = {r.doc_id: r for r in docs.collect()}
        seen.append(name)
        if name == "language_id":
            assert set(before) - set(after) == {230, 231}
        elif name == "near_dedup":
            prints = {i: simhash.fingerprint(text[i]) for i in before}
            near = {i for i in before if any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in before)}
            assert 200 in near and set(after) == set(before) - near
        elif name == "decontamination":
            index = decontaminate.Index(items)
            assert set(before) - set(after) == {i for i in before if index.search(text[i])} == {210}
        elif name == "secret_scan":
            assert set(after) == set(before)
            assert after[220].text.endswith("<SECRET> end") and after[220].n_chars == len(after[220].text)
            assert all(after[i].text == text[i] for i in after if i != 220)
        else:
            assert set(after) <= set(before) and len(after) > 40
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing_weights"]


def test_run_on_whole_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "some")
    corpus(spark, folder)
    assert corpus_pipeline.run(spark, folder).count() > 40
    empty = str(tmp_path / "none")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_masking_handles_nulls_and_touching_spans(spark):
    docs = spark.createDataFrame([(1, "token = " + "0f" * 20, None, None, 1), (2, None, None, None, 1), (3, "plain", None, None, 5)], COLUMNS)
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {1: "<SECRET>", 2: None, 3: "plain"}


def test_language_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "en", None, 3, "x")], COLUMNS + ", score string")
    assert langid.keep_identified(docs, langid.fit(docs)).columns == docs.columns
