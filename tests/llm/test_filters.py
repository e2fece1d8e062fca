from itertools import permutations

import pytest
from pyspark.sql import functions as F
from tests.llm.util import assert_same

from verdigris.llm import filters
from verdigris.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, good string, mask int, n long, id string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        yield doc, lang or "", "".join(
            name
            for name, bad in zip(
                "ABCDE",
                [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), doc is not None and first[text] < doc],
                strict=True,
            )
            if bad
        )


def by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    found = list(fails(rows))
    out = {}
    shapley = {}
    for part in {p for _, p, _ in found}:
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                row = [0] * 6
                for doc, p, bad in found:
                    if p != part:
                        continue
                    before, now = any(x in bad for x in order[: step - 1]), name in bad
                    row[0] += not before and not now
                    row[1] += now and not before
                    row[2] += now and before
                    row[3] += bad == name
                    row[4] += now and not before and doc in good
                    row[5] += now and not before and doc in toxic
                out[part, "".join(order), step] = row
                shapley[part, name] = shapley.get((part, name), 0) + row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_rows():
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(1, long, "en"), (2, long, "fr"), (2, long, "fr"), (None, long, "en"), (3, None, None), (4, "", "en"), (5, "AB $", "en"), (6, "the\tthe\x0bthe the the", ""), (7, long.upper(), "fr"), (5, "other", "fr"), (None, None, None)]
    rows += [(8, ("a b " * 300_000), "en"), (9, "é" * 10 + "\xa0" + "Á", "en")]
    return [(*r, "x", 7, 8, "y") for r in rows]


LABELLED = [(1, 1, 0), (2, 1, 1), (2, None, None), (3, 0, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)]


def test_cases_by_hand(spark):
    rows = odd_rows()
    found = filters.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(LABELLED, LABELS))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == by_hand(rows, LABELLED)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert filters.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    rows = odd_rows()[:3]
    some = filters.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))
    assert some.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_words_as_the_expression_says(spark):
    text = "a\tb\n\nc\x0bd \x0c e\rf\xa0g h  "
    assert spark.createDataFrame([(text,)], "t string").select(filters.word_list(F.col("t"))).first()[0] == ["a", "b", "c", "d", "e", "f\xa0g h"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_as_sql(spark, sf):
    assert_same(QUERIES["op12_filters"](spark, sf), ORACLE_SQL["op12_filters"], sf)
