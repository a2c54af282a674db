"""Answers of services kept between runs."""

from pyspark.sql import functions as F

from graphloom.operators import valueset


def test_answers_are_kept_bounded_and_versioned(spark, tmp_path):
    asked_for = []

    def service(asked, tables):
        rows = [r.request for r in asked.select("request").collect()]
        asked_for.append(sorted(list(r.values())[0] for r in rows))
        value = F.element_at(F.map_values("request"), 1)
        return asked.withColumn("result", F.when(value != "none", F.create_map(F.lit(""), F.upper(value))))

    ask = lambda *values: spark.createDataFrame([(k, {"": v}) for k, v in enumerate(values)], "id long, request map<string,string>")
    run = lambda store, *values, tables=(): {r.id: (r.result or {}).get("") for r in store.wrap(service)(ask(*values), tables).collect()}
    store = valueset.Answers(spark, str(tmp_path / "s"))
    assert run(store, "a", "b", "a", "none") == {0: "A", 1: "B", 2: "A", 3: None}
    assert run(store, "b", "c", "none") == {0: "B", 1: "C", 2: None}  # that there is no answer is known too
    assert run(valueset.Answers(spark, str(tmp_path / "s")), "a", "c") == {0: "A", 1: "C"}
    assert asked_for == [["a", "b", "none"], ["c"]]
    assert run(store, "a", tables=["t"]) == {0: "A"} and asked_for[-1] == ["a"]  # other sets, another question
    assert run(valueset.Answers(spark, str(tmp_path / "s"), "2"), "a") == {0: "A"} and len(asked_for) == 4
    small = valueset.Answers(spark, str(tmp_path / "m"), most=3)
    run(small, "a", "b"), run(small, "c", "d"), run(small, "c")
    assert small.known().count() == 2 and asked_for[4:] == [["a", "b"], ["c", "d"]]
    assert run(small, "a") == {0: "A"} and asked_for[-1] == ["a"]
