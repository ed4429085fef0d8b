from __future__ import annotations

import threading
import time

from pyspark.sql import functions as F

from shelfseek.operators import inference as M

def _prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("prompt_id"), F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)


def test_groups(spark):
    def make():
        return lambda rows: [f"{len(rows)}" for _ in rows]

    sizes = [r["response"] for r in M.run_prompts(_prompts(spark, 70), make).orderBy("prompt_id").collect()]
    assert sizes == ["30"] * 60 + ["10"] * 10


def test_retries(spark):
    def make():
        calls = {"n": 0}

        def model(rows):
            (row,) = rows
            calls["n"] += 1
            if row["prompt_id"] == 0 and calls["n"] == 1:
                raise M.ModelError(503)
            if row["prompt_id"] == 1:
                raise M.ModelError(429)
            if row["prompt_id"] == 2:
                raise M.ModelError(400)
            if row["prompt_id"] == 3:
                raise M.ModelError(0)
            return [row["prompt"]]

        return model

    answers = M.run_prompts(_prompts(spark, 5), make, group_size=1, pause=lambda seconds: None)
    got = {r["prompt_id"]: (r["response"], r["status"], r["attempts"]) for r in answers.collect()}
    assert got == {
        0: ("p0", "ok", 2),
        1: ("Error: failed (status 429)", "error", 5),
        2: ("Error: failed (status 400)", "error", 1),
        3: ("Error: no connection", "error", 1),
        4: ("p4", "ok", 1),
    }
    assert {r["prompt_id"] for r in M.unanswered(_prompts(spark, 5), answers).collect()} == {1, 2, 3}


def test_one_bad_prompt_in_a_group_fails_alone(spark):
    def make():
        def model(rows):
            if any(row["prompt_id"] == 4 for row in rows):
                raise M.ModelError(400)
            if any(row["prompt_id"] == 9 for row in rows):
                raise TimeoutError("too late")
            return [ValueError("no") if row["prompt_id"] == 12 else row["prompt"] for row in rows]

        return model

    answers = M.run_prompts(_prompts(spark, 40), make, group_size=10, pause=lambda seconds: None).collect()
    failed = {r["prompt_id"]: r["response"] for r in answers if r["status"] == "error"}
    assert failed == {4: "Error: failed (status 400)", 9: "Error: TimeoutError", 12: "Error: ValueError"}
    assert sorted(r["response"] for r in answers if r["status"] == "ok") == sorted(f"p{i}" for i in range(40) if i not in failed)


def test_pauses_double():
    waited = []

    def model(rows):
        raise M.ModelError(429)

    assert M._ask(model, [{}], waited.append, M.Window(1))[0][2] == 5
    assert waited == [1, 2, 4, 8]


def test_settings(spark):
    df = spark.createDataFrame([(1, 0.2, None), (2, None, 9)], "prompt_id int, temperature double, max_output_tokens int")
    rows = M.effective_settings(df, {"top_p": 0.9}).orderBy("prompt_id").collect()
    assert [(r["temperature"], r["max_output_tokens"], r["top_p"], r["top_k"]) for r in rows] == [(0.2, 2048, 0.9, 1.0), (1.0, 9, 0.9, 1.0)]


def test_concurrency_bounds_the_tasks(spark):
    answers = M.run_prompts(_prompts(spark, 50), lambda: lambda rows: ["x"] * len(rows), concurrency=3)
    assert answers.rdd.getNumPartitions() <= 3
    assert answers.count() == 50


def test_fifty_calls_in_flight_keep_their_order(spark):
    """No call is answered before fifty wait: a task with fewer in flight would fail at the barrier."""

    def make():
        together = threading.Barrier(50, timeout=20)

        def model(rows):
            together.wait()
            time.sleep(0.2 if rows[0]["prompt_id"] % 7 == 0 else 0)
            return [row["prompt"] for row in rows]

        return model

    answers = M.run_prompts(_prompts(spark, 100), make, group_size=1, in_flight=50).collect()
    assert [(r["prompt_id"], r["response"], r["status"]) for r in answers] == [(i, f"p{i}", "ok") for i in range(100)]


def test_a_refusal_narrows_the_window(spark):
    """A service that takes six calls at once, asked by sixty threads: everything is answered in the end."""

    def make():
        lock, running = threading.Lock(), [0]

        def model(rows):
            with lock:
                running[0] += 1
                full = running[0] > 6
            try:
                time.sleep(0.02)
                if full:
                    raise M.ModelError(429)
                return [row["prompt"] for row in rows]
            finally:
                with lock:
                    running[0] -= 1

        return model

    pause = lambda seconds: time.sleep(0.1 * seconds)
    answers = M.run_prompts(_prompts(spark, 300), make, group_size=1, in_flight=60, pause=pause).collect()
    assert [r["prompt_id"] for r in answers] == list(range(300))
    assert {r["status"] for r in answers} == {"ok"}
    assert any(r["attempts"] > 1 for r in answers)


def test_window_halves_once_per_round():
    window = M.Window(8)
    began = [window.enter() for _ in range(8)]
    for one in began:
        window.refused(one)
    assert window.limit == 4
    for _ in range(8):
        window.leave()
    window.refused(window.enter())
    assert window.limit == 2
    for _ in range(100):
        window.answered()
    assert window.limit == 8


def test_an_error_of_the_task_ends_it(spark):
    """What is not a failure of the model is not swallowed by the threads."""

    def broken(group):
        raise RuntimeError("no")

    groups = iter([[1], [2], [3]])
    try:
        list(M._in_order(groups, broken, 2))
    except RuntimeError as error:
        assert str(error) == "no"
    else:
        raise AssertionError("the error was lost")
