"""Problems of metadata: known answers, and each document is parsed a fixed number of times however many checks there are."""

import json

from plumbline.sources import artifacts as A


def document():
    def node(**more):
        return {"resource_type": "model", "name": "m", "fqn": ["p", "staging", "m"], "meta": {}, **more}

    return json.dumps({
        "sources": {"source.a": {"name": "a", "meta": {"criticality": "odd", "colour": "red", "age": "3"}, "columns": {
            "id": {"meta": {"critical": "true", "cde_category": "unheard", "size": "2"}}, "plain": None}}},
        "nodes": {"model.b": node(fqn=["p", "else", "b"], columns={"id": {"meta": {"critical": "true"}, "config": {"meta": {"cde_category": "status"}}}}),
                  "model.c": node(fqn=None, config={"meta": {"criticality": "low", "audience": "x"}}), "test.d": {"resource_type": "test", "meta": {"x": "y"}}},
        "exposures": {"exposure.e": {"name": "e", "meta": {"domain": "d"}, "columns": {"z": {"meta": {"odd": "1"}}}}}})


def test_problems_once(spark):
    rows = [("p", document()), ("q", json.dumps({"nodes": {}})), ("r", None), (None, document())]
    found = A.problems(spark.createDataFrame(rows, "project string, text string"))
    expected = [("exposure.e", "unknown keys domain"), ("model.b", "model outside the layer folders"), ("model.c", "model outside the layer folders"),
                ("model.c", "unknown keys audience"), ("source.a", "bad criticality odd"), ("source.a", "unknown keys age,colour"),
                ("source.a.id", "critical column without a category"), ("source.a.id", "unknown keys size")]
    got = found.collect()
    for project in ("p", None):
        assert sorted((r.unique_id, r.problem) for r in got if r.project == project) == expected
    assert len(got) == 2 * len(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
