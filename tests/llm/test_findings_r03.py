"""What the reviews of round 3 found in corpus operators, on small inputs."""

import time

import numpy as np
import pyarrow as pa

from platelab.llm import common, components, gru, quality_rules, recurrent_lm, repeats


def test_repeats_shuffle_texts_once(spark, plain_docs, plain, tmp_path):
    spark.createDataFrame([(r[0], r[1]) for r in plain], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = repeats.repeats(docs)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and got == sorted(map(tuple, repeats.repeats(plain_docs).collect()))


def test_words_are_listed_without_a_scalar_for_each():
    words = pa.array([b"w%d" % (i * 7919 % 100_003) for i in range(200_000)] + [b"", b"\x00", "é".encode()], pa.binary())
    took = {}
    for name, f in (("fast", recurrent_lm._listed), ("plain", pa.Array.to_pylist)):
        start = time.process_time()
        took[name] = f(words), time.process_time() - start
    assert took["fast"][0] == took["plain"][0] and type(took["fast"][0][0]) is bytes and took["fast"][1] < took["plain"][1] / 2
    counts = words.value_counts().field(1)
    assert recurrent_lm._listed(counts) == counts.to_pylist() and recurrent_lm._listed(words.slice(0, 0)) == []


def test_a_small_graph_takes_no_rounds_and_parts_of_a_large_one_agree(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(200)] + [(500 + 7 * k % 90, 500 + 11 * k % 90) for k in range(60)] + [(3, 3)]
    near: dict[int, set[int]] = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
    want, at = {}, 0
    for node in sorted(n for n in near if near[n] - {n}):
        seen = [node] if node not in want else []
        while seen:
            if (at := seen.pop()) not in want:
                want[at] = node
                seen += near[at]
    graph = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for together in (components.TOGETHER, 20):
        monkeypatch.setattr(components, "TOGETHER", together)
        group = f"components-{together}"
        spark.sparkContext.setJobGroup(group, group)
        found = components.connected_components(graph)
        spark.sparkContext.setJobGroup("other", "other")
        assert {r["node"]: r["root"] for r in found.collect()} == want
        if together > 20:
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 6


def test_a_worker_holds_what_one_operator_remembers(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    monkeypatch.setattr(common, "_turned", [])
    dropped = []
    common.turn_to("one", lambda: dropped.append("one"))
    common.turn_to("one", lambda: dropped.append("one"))
    assert dropped == []
    common.turn_to("two")
    common.turn_to("one", lambda: dropped.append("again"))
    assert dropped == ["one"]
    assert list(common.freeing(lambda rows: (2 * r for r in rows))(iter([1, 2]))) == [2, 4]


def test_a_pass_of_the_quality_rules_measures_a_text_once(plain_docs):
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (quality_rules.keep(plain_docs), quality_rules.measures(plain_docs).where("not base_failed"))]
    assert [p.split("Initial Plan")[0].count("ArrowEvalPython") for p in plans] == [1, 1]


def test_the_last_documents_run_next_to_the_long_ones():
    lengths = [10, recurrent_lm.LONG + 1, 20, recurrent_lm.LONG + 2, 30]
    codes = [np.full(n, n % 7, "<i2").tobytes() for n in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(range(5))], ["codes", "uid"])
    groups = list(recurrent_lm._together([batch]))
    assert len(groups) == 1 and sorted((len(c), row.column(0)[0].as_py()) for c, row in groups[0]) == sorted(zip(lengths, range(5), strict=True))


def test_sums_of_powers_of_any_size():
    rng = np.random.default_rng(3)
    for most in (1, 60, 200, 5000):
        x = (rng.random((40, 9)) * 2 - 1).astype(np.float32) * most
        top = x.max(axis=1).astype(np.float64)
        want = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        assert np.allclose(gru._log_sum(x, np.empty_like(x)), want, rtol=1e-5, atol=1e-5)
        low = np.full((3, 4), -most, np.float32)
        assert np.allclose(gru._log_sum(low, np.empty_like(low)), np.log(4) - most, rtol=1e-5)
