"""Requests that end: keyed state with a timer, late chunks, live outcomes.

The state of an open request is a handful of numbers (and, if asked for, its
pieces of text). It is dropped when the usage or the error chunk arrives, or when
the event time of the stream has passed the last chunk by ``timeout``. Rows are
put out once, in append mode, so a stream that never ends keeps the open
requests alone.

Requests are dealt by hash into shares, whose number belongs to the stream. A
share's open requests are one map with one timer: requests that begin and
end within a batch, most of them, never touch the store and are summed as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, NumericType, StringType, StructField, StructType

from plumbline.operators.pairing import KEYS, NO_RESPONSE, apply_failures
from plumbline.streaming.live import DELAY, UNNAMED_ERROR

TIMEOUT = "1 hour"

# Shares of the requests of a stream: its greatest parallelism. It cannot change
# between runs of one stream.
SHARES = 128

# How a request ended. Chunks of a request without a dispatch are late.
DONE, FAILED, UNANSWERED, LATE = "done", "error", "timeout", "late"

_STATE = "sent bigint, first bigint, last bigint, prompt bigint, completion bigint, usage_at bigint, error string, chunks bigint, pieces bigint"
_RESULT = {
    "sent": "bigint",
    "first": "bigint",
    "last": "bigint",
    "prompt_tokens": "bigint",
    "completion_tokens": "bigint",
    "text": "string",
    "error": "string",
    "outcome": "string",
    "num_chunks": "bigint",
}
_COLUMNS = ["request_id", "at", "seq", "kind", "content", "prompt_tokens", "completion_tokens"]
_TIMES = ("sent", "first", "last")
# Later than any time.
_NEVER = np.iinfo(np.int64).max


class _Request:
    """What is known of a request; times are microseconds of event time."""

    def __init__(self, known: tuple | None = None):
        self.sent, self.first, self.last, self.prompt, self.completion, self.usage_at, self.error, self.chunks, self.stored = (
            known or (None, None, None, 0, 0, None, None, 0, 0)
        )
        self.pieces: list[tuple[int, str]] = []

    def add(self, r) -> None:
        """One more chunk, a row of ``_COLUMNS``."""
        self.chunks += 1
        self.last = r.at if self.last is None else max(self.last, r.at)
        if r.kind == "dispatch":
            self.sent = r.at if self.sent is None else min(self.sent, r.at)
        elif r.kind == "usage":
            if self.usage_at is None or r.at >= self.usage_at:
                self.usage_at, self.prompt, self.completion = r.at, r.prompt_tokens or 0, r.completion_tokens or 0
        elif r.kind == "error":
            told = UNNAMED_ERROR if r.content is None else r.content
            self.error = told if self.error is None else max(self.error, told)
        elif r.content:
            self.first = r.at if self.first is None else min(self.first, r.at)
            self.pieces.append((r.seq, r.content))

    @property
    def ended(self) -> bool:
        return self.sent is not None and (self.usage_at is not None or self.error is not None)

    def state(self) -> tuple:
        numbers = (self.sent, self.first, self.last, self.prompt, self.completion, self.usage_at)
        return (*numbers, self.error, self.chunks, self.stored)


class Requests(StatefulProcessor):
    """State of one share: its open requests, their pieces, and when the first is due."""

    def __init__(self, timeout_ms: int, with_text: bool, key: str, names: tuple[str, ...]):
        self.timeout_ms, self.with_text, self.key, self.names = timeout_ms, with_text, key, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", f"id {self.key}", _STATE)
        self.pieces = handle.getMapState("pieces", f"id {self.key}, no bigint", "seq bigint, content string")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat([r[_COLUMNS][r["named"]] for r in rows], ignore_index=True)
        if chunks.empty:
            return
        if chunks["at"].isna().any():
            raise TypeError("a chunk has no time")
        of, ids = pd.factorize(chunks["request_id"])
        ids = ids.tolist()
        order = np.argsort(of, kind="stable")
        chunks, of = chunks.take(order), of[order]
        chunks["content"] = chunks["content"].astype(object).where(chunks["content"].notna(), None)
        bounds = np.searchsorted(of, np.arange(len(ids) + 1))
        ended, table = _summed(chunks, of, bounds, self.with_text)
        stored = self.open.exists()
        kept = {i for i, id_ in enumerate(ids) if self.open.containsKey((id_,))} if stored else set()
        # Most requests begin and end here; the others meet their state one by one.
        whole = ended.copy()
        whole[list(kept)] = False
        if whole.any():
            done = table[whole]
            done.insert(0, "request_id", pd.Series([i for i, w in zip(ids, whole) if w], index=done.index))
            yield done[list(self.names)]
        first_due, out = None, []
        met = {i: _Request(tuple(self.open.getValue((ids[i],))) if i in kept else None) for i in np.flatnonzero(~whole).tolist()}
        rest = ~whole[of]
        for i, r in zip(of[rest].tolist(), chunks[rest].itertuples(index=False)):
            met[i].add(r)
        for i, request in met.items():
            id_ = ids[i]
            if request.ended:
                out.append(self._end(id_, request, DONE if request.error is None else FAILED))
                if i in kept:
                    self._drop(id_, request)
            else:
                if self.with_text:
                    for piece in request.pieces:
                        self.pieces.updateValue((id_, request.stored), piece)
                        request.stored += 1
                self.open.updateValue((id_,), request.state())
                due = self._deadline(request)
                first_due = due if first_due is None else min(first_due, due)
        if out:
            yield self._frame(out)
        if first_due is not None:
            self._wake(first_due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        now, next_due, over = timerValues.getCurrentWatermarkInMs(), None, []
        for (id_,), state in list(self.open.iterator()):
            request = _Request(tuple(state))
            due = self._deadline(request)
            if due <= now:
                over.append((id_, request))
            else:
                next_due = due if next_due is None else min(next_due, due)
        out = []
        for id_, request in over:
            out.append(self._end(id_, request, LATE if request.sent is None else UNANSWERED))
            if next_due is not None:
                self._drop(id_, request)
        if next_due is None:
            # Nothing is left open, nor any piece of text.
            self.open.clear()
            self.pieces.clear()
        if out:
            yield self._frame(out)
        if next_due is not None:
            self._wake(next_due)

    def _wake(self, due: int) -> None:
        """One timer for the share; later deadlines are found when it fires."""
        set_ = self.due.get()[0] if self.due.exists() else None
        if set_ is None or due < set_:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def _deadline(self, request: _Request) -> int:
        return -(-request.last // 1000) + self.timeout_ms

    def _drop(self, id_, request: _Request) -> None:
        self.open.removeKey((id_,))
        if self.with_text:
            for no in range(request.stored):
                self.pieces.removeKey((id_, no))

    def _end(self, id_, request: _Request, outcome: str) -> tuple:
        text = ""
        if self.with_text and outcome == DONE:
            before = [tuple(self.pieces.getValue((id_, no))) for no in range(request.stored)]
            text = "".join(content for _, content in sorted([*before, *request.pieces]))
        error = NO_RESPONSE if outcome == UNANSWERED else request.error
        numbers = (request.sent, request.first, request.last, request.prompt, request.completion)
        return id_, *numbers, text, error, outcome, request.chunks

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(self.names))
        return out.astype(dict.fromkeys(_TIMES, "Int64"))


def _summed(chunks: pd.DataFrame, of: np.ndarray, bounds: np.ndarray, with_text: bool) -> tuple[np.ndarray, pd.DataFrame]:
    """Which requests ended, and their results (without ids), as ``_Request`` tells them one by one.

    ``of`` is the number of each chunk's request, ascending; that of request ``i`` begin at ``bounds[i]``.
    """
    starts, n = bounds[:-1], len(bounds) - 1
    at, kind, content = chunks["at"].to_numpy(np.int64), chunks["kind"], chunks["content"]
    is_sent, is_usage, is_error = ((kind == k).to_numpy(bool) for k in ("dispatch", "usage", "error"))
    has_content = ~is_sent & ~is_usage & ~is_error & content.notna().to_numpy() & (content != "").to_numpy(bool)
    sent = np.minimum.reduceat(np.where(is_sent, at, _NEVER), starts)
    first = np.minimum.reduceat(np.where(has_content, at, _NEVER), starts)
    prompt, completion, used = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    # Of each request the latest usage stays, of equal ones the last to arrive.
    usage = np.flatnonzero(is_usage)
    usage = usage[np.lexsort((at[usage], of[usage]))]
    used[of[usage]] = True
    prompt[of[usage]], completion[of[usage]] = (chunks[c].to_numpy(np.int64)[usage] for c in ("prompt_tokens", "completion_tokens"))
    errors = np.full(n, None, object)
    for i, told in zip(of[is_error].tolist(), content[is_error]):
        told = UNNAMED_ERROR if told is None else told
        errors[i] = told if errors[i] is None else max(errors[i], told)
    failed = np.array([e is not None for e in errors], bool)
    ended = (sent != _NEVER) & (used | failed)
    texts = np.full(n, "", object)
    if with_text:
        wanted = np.flatnonzero(has_content & (ended & ~failed)[of])
        seq, said = chunks["seq"].to_numpy(np.int64), content.to_numpy(object)
        wanted = wanted[np.lexsort((seq[wanted], of[wanted]))]
        whose, number, said = of[wanted], seq[wanted], said[wanted]
        ends = np.searchsorted(whose, np.arange(n + 1))
        tied = np.zeros(n, bool)
        tied[whose[1:][(whose[1:] == whose[:-1]) & (number[1:] == number[:-1])]] = True
        for i in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(ends[i], ends[i + 1])
            # Pieces of one number go by their content.
            texts[i] = "".join(c for _, c in sorted(zip(number[own], said[own]))) if tied[i] else "".join(said[own])
    known = lambda x: pd.array(x, "Int64") if (x != _NEVER).all() else pd.array(np.where(x == _NEVER, None, x.astype(object)), "Int64")
    table = pd.DataFrame(
        {
            "sent": known(sent),
            "first": known(first),
            "last": pd.array(np.maximum.reduceat(at, starts), "Int64"),
            "prompt_tokens": prompt,
            "completion_tokens": completion,
            "text": texts,
            "error": errors,
            "outcome": np.where(failed, FAILED, DONE),
            "num_chunks": np.diff(bounds),
        }
    )
    return ended, table


def ended_requests(
    chunks: DataFrame, *, timeout: str = TIMEOUT, delay: str = DELAY, with_text: bool = True, shares: int = SHARES
) -> DataFrame:
    """One row per request of a stream of chunks, when it ends; for append mode.

    ``chunks`` are those of ``live.request_metrics``; rows without a
    ``request_id`` only move the event time on. ``outcome`` tells how a request
    ended: ``done`` by its usage, ``error`` by its error, ``timeout`` when
    nothing came for ``timeout`` after its last chunk; such a request has the
    error "no response". Chunks that come after the end, or whose dispatch
    never came, are one row ``late`` with their number when their time is up.
    The stream needs ``stateful`` sessions (``live.drain`` sees to that).
    """
    spark = chunks.sparkSession
    wait = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01' + interval {timeout})").first()[0]
    kind = chunks.schema["request_id"].dataType
    fields = [StructField(n, DataType.fromDDL(t)) for n, t in _RESULT.items()]
    schema = StructType([StructField("request_id", kind), *fields])
    # Rows without an id are dropped by the processor: a filter would move below the watermark.
    # Numbers are never NULL, so that pandas keeps them whole.
    whole = lambda c, none: F.coalesce(F.col(c).cast("bigint"), F.lit(none)).alias(c)
    no_id = F.lit(0).cast(kind) if isinstance(kind, (NumericType, StringType)) else F.lit(None)
    rows = chunks.withWatermark("ts", delay).select(
        F.coalesce("request_id", no_id).alias("request_id"), F.col("request_id").isNotNull().alias("named"),
        "ts", F.unix_micros("ts").alias("at"), whole("seq", -(2**63)), "kind", "content",
        whole("prompt_tokens", 0), whole("completion_tokens", 0),
        F.pmod(F.xxhash64("request_id"), F.lit(shares)).alias("_share"),
    )
    ended = rows.groupBy("_share").transformWithStateInPandas(
        Requests(wait // 1000, with_text, kind.simpleString(), tuple(schema.names)), schema, "append", "eventTime"
    )
    started = F.col("outcome") != LATE
    return ended.select(
        "request_id",
        F.timestamp_micros("sent").alias("start_ts"),
        F.when(started, (F.col("first") - F.col("sent")) / 1e6).alias("ttft_seconds"),
        F.when(started, (F.col("last") - F.col("sent")) / 1e6).alias("total_latency_seconds"),
        "prompt_tokens",
        "completion_tokens",
        *(["text"] if with_text else []),
        "error",
        "outcome",
        "num_chunks",
    )


def score_requests(
    requests: DataFrame,
    samples: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Outcomes of samples as their requests end, with the failure rules of the batch.

    ``requests`` are ``ended_requests`` with ``keys``; every sample that was
    dispatched gets one row: scored, failed, or "no response" after the timeout.
    Late chunks belong to no outcome and are left out.
    """
    answered = requests.filter(F.col("outcome") != LATE).withColumn("response", F.coalesce("text", F.lit("")))
    paired = answered.join(samples, list(keys)).withColumn("paired", F.col("outcome") != UNANSWERED)
    return apply_failures(score(paired))
