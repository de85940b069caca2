"""Empty tables, repeated rows, ties and clashing columns of the text operators."""

import collections

from dawnframe.llm import decontaminate, langid, pii, quality, simhash, toxicity

CLASH = "doc_id long, text string, lang string, spans string, n_email int, item_id int, similarity string, score string, predicted int, held_out string, kept int, posterior string, pii int"
TEXT = "one two three four five six seven eight nine ten, mail a@b.co now"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2, "y", "z", 3, "h", 4, "p", 5) for i, t, g in rows], CLASH)


def test_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert pii.report(none).count() == pii.personal_data(none).count() == pii.redact(none).count() == 0
    assert decontaminate.contaminations(none, items).count() == decontaminate.keep_uncontaminated(none, items).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == langid.keep_identified(none, langid.fit(none)).count() == 0
    assert simhash.keep_one_of_each(none).count() == 0


def test_repeated_rows_are_answered_one_by_one_and_columns_may_clash(spark):
    rows = docs(spark, [(1, TEXT, "en"), (1, TEXT, "en"), (2, None, None), (2, None, None), (None, TEXT, None)])
    items = spark.createDataFrame([(7, TEXT, "c"), (7, TEXT, "c")], "item_id long, text string, doc_id string")
    labels = spark.createDataFrame([(1, 0, 1, "x"), (2, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    ids = lambda frame: collections.Counter(r.doc_id for r in frame.collect())
    every = collections.Counter([1, 1, 2, 2, None])
    assert ids(quality.judge(rows)) == ids(pii.report(rows)) == ids(toxicity.score(rows, toxicity.fit(rows, labels))) == ids(langid.identify(rows, langid.fit(rows))) == every
    assert ids(decontaminate.contaminations(rows, items)) == collections.Counter([1, 1, None])
    assert ids(decontaminate.keep_uncontaminated(rows, items)) == collections.Counter([2, 2])
    assert decontaminate.keep_uncontaminated(rows, items).columns == rows.columns
    assert [sorted(len(r.pii) for r in pii.personal_data(rows).collect())] == [[0, 0, 1, 1, 1]]


def test_ties(spark):
    """Two equal windows: the first; two items of the same text: both; a text between two languages: the first in order."""
    item = "alpha beta gamma delta epsilon zeta"
    items = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    found = decontaminate.contaminations(docs(spark, [(5, f"x {item} y {item}", None)]), items).collect()
    assert sorted((r.item_id, r.first_word, r.n_words, r.similarity) for r in found) == [(1, 1, 6, 1.0), (2, 1, 6, 1.0)]
    same = docs(spark, [(i, "la la la", ("bb", "aa")[i % 2]) for i in range(80)])
    model = langid.fit(same)
    assert set(model["langs"]) == {"aa", "bb"}
    assert {r.lang_pred for r in langid.identify(same, model).collect()} == {"aa"}
