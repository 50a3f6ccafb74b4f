"""Similarity with the row before against brute force: whole texts, ids with gaps."""

import collections

from docloom.operators import catalogue


def dice(a, b):
    grams = [collections.Counter([t] if not t else [t[i : i + n] for i in range(len(t) - n + 1)]) for t in (a, b) for n in (1 if len(t) < 8 else 2,)]
    return round(2 * sum((grams[0] & grams[1]).values()) / sum(sum(g.values()) for g in grams), 9)


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_dice_takes_whole_texts_and_the_row_before(spark, tmp_path):
    """Texts that differ after 200 characters only, ids with gaps, short, empty and null texts."""
    texts = ["same opening " * 20 + f"tail {i} " * (5 * i) for i in range(12)] + ["", "a", "ab", "abcdefg", "abcdefgh", None, "after a null", "\U0001f600 smile \U0001f600", "ÉTÉ été"] + [f"word{i * i}" * (i % 7) for i in range(300)]
    rows = [(7 * i + i % 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["dice"] for r in catalogue.queries()["char_ngram_dice_whole"](spark, documents(spark, tmp_path, rows)).collect()}
    want = {k: None if t is None else dice(t.lower(), before.lower()) for (_, before), (k, t) in zip(rows, rows[1:]) if before is not None}
    assert got == want


def test_both_names_take_whole_texts(spark, tmp_path):
    rows = [(3 * i * i, f"text number {i} " * 30) for i in range(40)]
    got = {r["doc_id"]: r["dice"] for r in catalogue.queries()["char_ngram_dice"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {k: dice(t, before) for (_, before), (k, t) in zip(rows, rows[1:])}
