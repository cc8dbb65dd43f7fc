"""Answers of models: replayed from a table, or asked for by a given client."""

from __future__ import annotations

import json
import math
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "id string, text string, error string, input_tokens int, output_tokens int, elapsed_seconds double"


def replayed(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Recorded answers by id; prompts without one get an error row."""
    return prompts.join(answers, "id", "left").withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("no recorded answer"))))


def replayed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, answer: user turns and the assistant's next turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    next_role, next_text = F.lead("role").over(order), F.lead("text").over(order)
    return conversations.select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.when(next_role == "assistant", next_text).alias("answer")).filter("role = 'user'").drop("role")


def allotted(wants: list[int], tokens: float) -> list[int]:
    """Whole tokens for each, no more than it wants, else in equal shares; the same on every worker."""
    out, left = [0] * len(wants), int(tokens)
    while left and any(w > o for w, o in zip(wants, out, strict=True)):
        open_ = [k for k, w in enumerate(wants) if w > out[k]]
        each = max(left // len(open_), 1)
        for k in open_:
            got = min(each, wants[k] - out[k], left)
            out[k] += got
            left -= got
    return out


class Asker(threading.Thread):
    """Answers rows one after the other, a token for each try."""

    def __init__(self, ask: Callable[[str], tuple[str, int, int]], tries: int, fatal: tuple[type[Exception], ...]):
        super().__init__(daemon=True)
        self.ask, self.tries, self.fatal = ask, tries, fatal
        self.rows: deque = deque()
        self.done: deque = deque()
        self.tokens, self.used, self.busy, self.over, self.change = 0, 0, False, False, threading.Condition()

    def wait_for(self, test: Callable[[], bool]) -> bool:
        self.change.wait_for(lambda: self.over or test())
        return not self.over

    def run(self) -> None:
        while True:
            with self.change:
                if not self.wait_for(lambda: self.rows):
                    return
                (key, prompt), self.busy = self.rows.popleft(), True
            self.done.append(self.answer(key, prompt))
            with self.change:
                self.busy = False

    def answer(self, key: str, prompt: str) -> tuple:
        text, error, n_in, n_out, began = None, None, None, None, None
        for t in range(self.tries):
            with self.change:
                if not self.wait_for(lambda: self.tokens > 0):
                    break
                self.tokens, self.used = self.tokens - 1, self.used + 1
            began = began or time.time()
            try:
                text, n_in, n_out = self.ask(prompt)
                error = None
                break
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if isinstance(e, self.fatal) or t + 1 == self.tries:
                    break
                time.sleep(random.uniform(0, min(60.0, 2.0**t)))
        return key, text, error, n_in, n_out, time.time() - (began or time.time())


def asked(prompts: DataFrame, client: Callable[[], Callable[[str], tuple[str, int, int]]], per_minute: float, workers: int = 4, tries: int = 10, fatal: tuple[type[Exception], ...] = (), every: float = 1.0) -> DataFrame:
    """(id, prompt) -> answers.  client: makes, within a task, the function that
    answers a prompt.  Failures are retried with jittered, doubling pauses unless fatal,
    and end as error rows.

    The workers are the tasks of one barrier stage and share nine tenths of the rate.
    At each beat (``every`` seconds or more) they tell each other how many more requests
    they can use, and deal out the beat's, so what a slow worker, or one without prompts,
    doesn't need goes to the others.  A request under way never holds the beat up.  No
    more is asked in all than the rate allows, and no more than two beats' worth at once.  All workers need a core at the
    same time; a lost one makes the stage begin anew.
    """
    rate = 0.9 * per_minute / 60.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        rows = ((key, prompt) for batch in batches for key, prompt in zip(batch.id, batch.prompt, strict=True))
        asker, more, can, pool, clock, beat = Asker(client(), tries, fatal), True, 1 << 20, 0.0, None, every
        asker.start()
        try:
            while True:
                began = time.time()
                while more and len(asker.rows) < max(2, math.ceil(rate * beat)) * 2:
                    row = next(rows, None)
                    more = row is not None
                    if more:
                        with asker.change:
                            asker.rows.append(row)
                            asker.change.notify_all()
                with asker.change:
                    held, used, asker.used = asker.tokens, asker.used, 0
                    waiting = len(asker.rows) + asker.busy
                    at_work = bool(more or waiting or asker.done)
                # one that has tokens left keeps them and gets as many as it used; others may do more
                can = max(1, used + held) if held else max(can, 2 * used, 1)
                said = [json.loads(x) for x in context.allGather(json.dumps([at_work, max(min(can, waiting) - held, 0), time.time()]))]
                if not any(s[0] for s in said):
                    break
                # the first worker's clock is everyone's, as a beat may take longer
                clock, beat = said[0][2], every if clock is None else max(said[0][2] - clock, 0.0)
                pool = min(pool, rate * beat) + rate * beat
                shares = allotted([s[1] for s in said], pool)
                pool -= sum(shares)
                with asker.change:
                    asker.tokens += shares[context.partitionId()]
                    asker.change.notify_all()
                found = [asker.done.popleft() for _ in range(len(asker.done))]
                if found:
                    yield pd.DataFrame(found, columns=["id", "text", "error", "input_tokens", "output_tokens", "elapsed_seconds"]).astype({"input_tokens": "Int32", "output_tokens": "Int32"})
                time.sleep(max(0.0, began + every - time.time()))
        finally:
            with asker.change:
                asker.over = True
                asker.change.notify_all()

    return prompts.select("id", "prompt").repartition(workers).mapInPandas(run, ANSWER, barrier=True)
