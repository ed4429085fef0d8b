"""Run a text model over a table of prompts, with settings, retries and a status per row."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_SIZE = 30
MAX_TRIES = 5
# The settings of a prompt that names none.
DEFAULTS = {"temperature": 1.0, "max_output_tokens": 2048, "top_p": 1.0, "top_k": 1.0}
# The status codes worth another try.
RETRYABLE = (429, 503)

_ANSWER = "prompt_id bigint, response string, status string, attempts int, error string"

Model = Callable[[list[dict]], list]


class ModelError(Exception):
    """A failed call, with the status code of the service (0: it could not be reached)."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def effective_settings(prompts: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Fill the settings a prompt leaves open."""
    given = {**DEFAULTS, **(defaults or {})}

    def setting(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in prompts.columns else F.lit(default)

    return prompts.withColumns({name: setting(name, default) for name, default in given.items()})


class Window:
    """How many calls of a task may run at once.

    Starts at ``most``. A retryable refusal halves it, once for all calls that began before the last halving; a
    window's worth of answers widens it by one call again.
    """

    def __init__(self, most: int):
        self.most = most
        self.limit = float(most)
        self._halvings = 0
        self._running = 0
        self._changed = threading.Condition()

    def enter(self) -> int:
        """Wait for a place; returns what ``refused`` wants to know."""
        with self._changed:
            self._changed.wait_for(lambda: self._running < int(self.limit))
            self._running += 1
            return self._halvings

    def leave(self) -> None:
        with self._changed:
            self._running -= 1
            self._changed.notify_all()

    def refused(self, began: int) -> None:
        with self._changed:
            if began == self._halvings:
                self.limit = max(1.0, self.limit / 2)
                self._halvings += 1

    def answered(self) -> None:
        with self._changed:
            self.limit = min(float(self.most), self.limit + 1 / self.limit)
            self._changed.notify_all()


def _try(
    model: Model, rows: list[dict], pause: Callable[[float], None], window: Window
) -> tuple[list, int, Exception | None]:
    """(answers, attempts, what went wrong). An answer may itself be an exception, for its prompt alone.

    A call that waits before its next attempt holds no place in the window.
    """
    for attempt in range(1, MAX_TRIES + 1):
        began = window.enter()
        try:
            answers = list(model(rows))
            if len(answers) != len(rows):
                raise ValueError(f"{len(answers)} answers to {len(rows)} prompts")
            window.answered()
            return answers, attempt, None
        except Exception as error:  # noqa: BLE001  any failure of a model is a row with its reason
            retryable = getattr(error, "status", None) in RETRYABLE
            if retryable:
                window.refused(began)
            if not retryable or attempt == MAX_TRIES:
                return [], attempt, error
        finally:
            window.leave()
        pause(2 ** (attempt - 1))
    raise AssertionError("unreachable")


def _reason(error: Exception) -> str:
    if isinstance(error, ModelError):
        return f"Error: failed (status {error.status})" if error.status else "Error: no connection"
    return f"Error: {type(error).__name__}"


def _ask(
    model: Model, rows: list[dict], pause: Callable[[float], None], window: Window
) -> list[tuple[str, str, int, str | None]]:
    """(response, status, attempts, error) of every prompt.

    A group that fails is asked again prompt by prompt, as is a prompt that fails within a group, so that one
    bad prompt does not spoil its neighbours; attempts count from there.
    """
    answers, attempts, error = _try(model, rows, pause, window)
    if error is not None and len(rows) > 1:
        return [result for row in rows for result in _ask(model, [row], pause, window)]
    if error is not None:
        return [(_reason(error), "error", attempts, str(error))]
    results = []
    for row, answer in zip(rows, answers, strict=True):
        if not isinstance(answer, Exception):
            results.append((answer, "ok", attempts, None))
        elif len(rows) > 1:
            results += _ask(model, [row], pause, window)
        else:
            results.append((_reason(answer), "error", attempts, str(answer)))
    return results


def _in_order(
    groups: Iterator[pd.DataFrame], ask: Callable[[pd.DataFrame], list], in_flight: int
) -> Iterator[tuple[pd.DataFrame, list]]:
    """Every group with its answers, in the order of the groups, ``in_flight`` of them asked at once.

    One more window of groups is read ahead, so that a slow call does not hold up the calls behind it.
    """
    if in_flight == 1:
        yield from ((group, ask(group)) for group in groups)
        return
    waiting: deque[tuple[pd.DataFrame, Future]] = deque()
    pool = ThreadPoolExecutor(in_flight)
    try:
        for group in groups:
            waiting.append((group, pool.submit(ask, group)))
            if len(waiting) == 2 * in_flight:
                done, answers = waiting.popleft()
                yield done, answers.result()
        while waiting:
            done, answers = waiting.popleft()
            yield done, answers.result()
    finally:
        pool.shutdown(cancel_futures=True)


def run_prompts(
    prompts: DataFrame,
    make_model: Callable[[], Model],
    group_size: int = GROUP_SIZE,
    concurrency: int | None = None,
    pause: Callable[[float], None] = time.sleep,
    in_flight: int = 1,
) -> DataFrame:
    """(prompt_id, response, status, attempts, error) for every prompt.

    ``make_model`` runs once per task. A call gets up to ``group_size`` prompts; a failed call is
    repeated for the retryable codes, then tried prompt by prompt. What still fails, with any exception, is a
    row whose response says so. At most ``concurrency`` tasks call the model at once, each with up
    to ``in_flight`` calls (then the model must allow calls from several threads); a refusal narrows the task's
    window of calls, see ``Window``, and only the refused call waits. Answers keep the order of the prompts. Write
    the answers to a table before using them twice: each use of the plan calls the model.
    """
    spread = prompts.repartition(concurrency, "prompt_id") if concurrency else prompts
    columns = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, window = make_model(), Window(in_flight)

        def ask(part: pd.DataFrame) -> list:
            rows = [dict(zip(columns, values)) for values in part.itertuples(index=False, name=None)]
            return _ask(model, rows, pause, window)

        groups = (
            frame.iloc[start : start + group_size] for frame in frames for start in range(0, len(frame), group_size)
        )
        for part, results in _in_order(groups, ask, in_flight):
            response, status, attempts, error = zip(*results, strict=True)
            yield pd.DataFrame(
                {
                    "prompt_id": part["prompt_id"].to_numpy(), "response": response, "status": status,
                    "attempts": attempts, "error": error,
                }
            )

    return spread.mapInPandas(run, _ANSWER)


def unanswered(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """The prompts to run again: those without a successful answer."""
    return prompts.join(answers.where("status = 'ok'").select("prompt_id"), "prompt_id", "left_anti")
