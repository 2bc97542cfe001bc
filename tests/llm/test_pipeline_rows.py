"""Rows of the pipeline's first stages against brute force, with repeated and null ids."""

import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _kept(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and name[i] != name[j]:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    least = {}
    for i, r in enumerate(rows):
        place = (r[0] is None, r[0] or 0, i)
        least[name[i]] = min(least.get(name[i], place), place)
    return sorted(repr(tuple(rows[place[2]][:2])) for place in least.values())


def test_one_row_of_each_class_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near, other = base + " x", "other words " * 9 + "end"
    texts = [(3, base), (5, near), (5, other), (7, "one text of its own here"), (7, "and another text with this id"), (None, "copy of nobody else at all"), (None, "copy of nobody else at all"),
             (None, base), (8, "twice the same id and text"), (8, "twice the same id and text"), (9, None), (9, None), (None, ""), (10, " ")]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in texts]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(repr(tuple(r)[:2]) for r in out) == _kept(rows)


def test_no_labels_no_loss(spark):
    rows = [(k, f"some text number {k}", None, "a", 18) for k in range(9)]
    assert corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 9
