"""Parts of texts against plain Python, and who is sent to the driver when tokens are resolved: never the people's exploded starts or runs."""

import random

import pytest

from medialake.operators import filters, search_form, substrings
from medialake.storage import stored


@pytest.mark.parametrize(("few", "run"), [(0, 6), (100_000, 3), (3, 1)])
def test_parts_are_held_as_plainly(spark, monkeypatch, few, run):
    monkeypatch.setattr(substrings.sized, "__defaults__", (few,))
    rnd = random.Random(few + run)
    word = lambda least, most: "".join(rnd.choice("ab-é") for _ in range(rnd.randint(least, most)))
    texts = [(i, word(0, 14), i % 3 == 0) for i in range(120)] + [(120, None, True), (121, "aaaaaaaaaaaaaaaaaaab", False)]
    parts = [(word(0, 9), i % 2 == 0) for i in range(120)] + [(None, True), ("aaaaaaaaab", False), ("aaaaaaaaab", False), ("zz", True)]
    got = substrings.holding(spark.createDataFrame(parts, "part string, side boolean"), spark.createDataFrame(texts, "id long, x string, side boolean"), run).collect()
    want = {(p, s, i) for p, s in parts for i, x, side in texts if p and x is not None and side == s and p in x}
    assert len(got) == len(want) and {(r.part, r.side, r.id) for r in got} == want
    assert substrings.holding(spark.createDataFrame([], "part string, side boolean"), spark.createDataFrame(texts, "id long, x string, side boolean")).collect() == []


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    """Of 3,000 people each has dozens of starts and runs; more tokens than a broadcast may have are sorted and merged."""
    monkeypatch.setattr(substrings.sized, "__defaults__", (10,))
    people = spark.range(3000).selectExpr("concat('c-', id) id", "concat('Customer#', lpad(id, 9, '0')) name", "array(concat('Nick ', id)) aliases")
    tokens = people.selectExpr("CASE WHEN hash(id) % 3 = 0 THEN name WHEN hash(id) % 3 = 1 THEN substr(name, 13) ELSE concat('zz', id) END token").distinct()
    for found in (filters.resolved(tokens, people), search_form.resolve_people(tokens, people)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() >= 3000


def test_a_name_that_nobody_has_broadcasts_no_people(spark, monkeypatch):
    """The form's two persons: a start of many names, and an unknown one, which is looked for in all texts."""
    monkeypatch.setattr(substrings.sized, "__defaults__", (-1,))
    people = spark.range(3000).selectExpr("concat('c-', id) id", "concat('Customer#', lpad(id, 9, '0')) name", "array('') aliases")
    found = search_form.resolve_people(spark.createDataFrame([("Customer#00000000",), ("NOBODY",)], "token string"), people)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.token, r.tier or 0) for r in found.collect()) == [("Customer#00000000", 2)] * 10 + [("NOBODY", 0)]


def test_people_of_one_file_unfold_in_many_tasks(spark, monkeypatch):
    """A small file is one task; people are dealt anew before their starts and runs are made."""
    plans = {}

    def kept(df, name="t"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    people = spark.range(50).coalesce(1).selectExpr("concat('c-', id) id", "concat('Customer#', id) name", "array('') aliases")
    tokens = spark.createDataFrame([("NOBODY",)], "token string")
    for module, table in ((filters, "named"), (search_form, "known")):
        monkeypatch.setattr(module, "stored", kept)
        (filters.resolved if module is filters else search_form.resolve_people)(tokens, people)
        assert "RepartitionByExpression [id" in plans[table]
