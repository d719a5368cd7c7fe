"""The training order of op3 against the schedule inverted by bisection."""

import os

import pytest

from meterframe.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def first_position(r):
    """Time at which target * (t + slope * (t^2 - t)) reaches the words before the document; None where it is not trained on."""
    if r["size"] == 0 or r["begin"] >= int(r["target"]):
        return None
    lo, hi = 0.0, 1.0
    for _ in range(60):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if r["target"] * (t + r["slope"] * (t * t - t)) < r["begin"] else (lo, t)
    return hi


def test_documents_come_in_training_order(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    at = {r["doc_id"]: first_position(r) for r in mixing.plan(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    got = [at[r["doc_id"]] for r in queries.op3_mix_sources(spark, SF).collect()]
    assert len(got) == len(at) and None in got
    trained = [p for p in got if p is not None]
    assert got == trained + [None] * (len(got) - len(trained))
    assert all(b >= a - 1e-9 for a, b in zip(trained, trained[1:]))


def test_rows_of_one_id_in_any_partitioning(spark):
    rows = [(d % 3, " ".join(["w"] * (1 + (7 * d) % 41)) + f" {d}", "src") for d in range(300)] + [(None, f"n {k}" * (k % 5), "src") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(((r["doc_id"], r["size"], r["begin"], r["taken"]) for r in mixing.plan(frame.repartition(n)).collect()), key=str) for n in (1, 3, 11)]
    assert runs[0] == runs[1] == runs[2]
