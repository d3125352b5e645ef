import numpy as np

from quaver import catalog_queries as cq
from quaver import schema
from quaver.operators import graph


def event(query, sequence, kind, level, accepted=None):
    considered = None if accepted is None else [(i, 0.1, a, None, 0) for i, a in enumerate(accepted)]
    return (query, sequence, kind, level, 0, 0.0, None, considered, None, 1)


def search_beats(events):
    """The reference's rule, written out over one trace."""
    chosen = {}
    entry = next((i for i, e in enumerate(events) if e["type"] == "enter"), -1)
    if entry >= 0:
        chosen[entry] = "entry"
    x = [i for i, e in enumerate(events) if e["type"] == "expand" and any(c["accepted"] for c in e["considered"] or [])]
    if x:
        chosen[x[0]] = "branch"
        lowest = min(events[i]["level"] for i in x)
        local = [i for i in x if events[i]["level"] == lowest]
        down = [i for i, e in enumerate(events) if i > entry and e["type"] == "enter" and e["level"] == lowest]
        if down:
            chosen[down[0]] = "descent"
        for i in (0, (len(local) - 1) // 2, len(local) - 1):
            chosen[local[i]] = "branch"
    chosen[len(events) - 1] = "results"
    return chosen


def test_beats_of_small_traces(spark):
    yes, no = [False, True], [False]
    whole = [event(1, 0, "enter", 1), event(1, 1, "expand", 1, yes), event(1, 2, "descend", 1), event(1, 3, "enter", 0), event(1, 4, "expand", 0, no)]
    whole += [event(1, 5 + i, "expand", 0, yes) for i in range(4)] + [event(1, 9, "stop", 0), event(1, 10, "results", 0)]
    none = [event(2, 0, "enter", 0), event(2, 1, "expand", 0, no), event(2, 2, "results", 0)]
    cut = [event(3, 0, "enter", 0), event(3, 1, "expand", 0, yes)]
    got = {}
    for r in graph.beats(spark.createDataFrame(whole + none + cut, graph.TRACE)).collect():
        got.setdefault(r["query"], {})[r["sequence"]] = r["kind"]
    assert got[1] == {0: "entry", 1: "branch", 3: "descent", 5: "branch", 6: "branch", 8: "branch", 10: "results"}
    assert got[2] == {0: "entry", 2: "results"}
    assert got[3] == {0: "entry", 1: "results"}


def test_beats_follow_the_reference_on_the_whole_trace(spark, small):
    traces, got = {}, {}
    for r in cq.QUERIES["g01_traced_search"](spark, small).orderBy("query", "sequence").collect():
        traces.setdefault(r["query"], []).append(r)
    for r in cq.QUERIES["g10_trace_beats"](spark, small).collect():
        got.setdefault(r["query"], {})[r["sequence"]] = r["kind"]
    assert got == {q: search_beats(e) for q, e in traces.items()}
    edges = {(r["query"], r["sequence"]) for r in cq.QUERIES["g11_beat_edges"](spark, small).collect()}
    assert edges and all(s in got[q] for q, s in edges)


def test_projection_quality(spark, small):
    v = schema.vectors(spark, small).orderBy("row").collect()
    x = np.array([r["embedding"] for r in v], float)
    asked = [i for i, r in enumerate(v) if r["row"] % 20 == 0]
    beyond, shares = 0, []
    for i in asked:
        far = np.clip(1 - np.cumsum(x * x[i], axis=1)[:, -1], 0, 2)
        far[i] = np.inf
        high = np.argsort(far, kind="stable")
        near = ((x[:, :2] - x[i, :2]) ** 2).sum(1)
        near[i] = np.inf
        low = np.argsort(near, kind="stable")[:8]
        place = {r: n + 1 for n, r in enumerate(high)}
        beyond += sum(max(0, place[r] - 8) for r in low)
        shares.append(len(set(high[:8]) & set(low)) / 8)
    got = cq.QUERIES["v18_projection_quality"](spark, small).first()
    assert (got["mean"], got["minimum"]) == (np.mean(shares), min(shares))
    assert abs(got["trustworthiness"] - (1 - 2 * beyond / (len(asked) * 8 * (2 * len(v) - 25)))) < 1e-12
