"""Threads of a conversation by topic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.vector import cosine, hash_vector

SIMILARITY, GAP = 0.7, 5


class _Thread:
    def __init__(self, number: int, at: int, vector: np.ndarray):
        self.number, self.at, self.topic = number, [at], vector.copy()

    def add(self, at: int, vector: np.ndarray) -> None:
        """The topic is a moving average, newer messages weighing more, of unit length."""
        self.at.append(at)
        alpha = 2 / (len(self.at) + 1)
        topic = (1 - alpha) * self.topic + alpha * vector
        self.topic = topic / (np.sqrt(topic @ topic) or 1)


def _like(a: np.ndarray, b: np.ndarray) -> float:
    norm = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / norm) if norm else 0.0


def fold(texts: list[str | None], vectors: list[np.ndarray], similarity: float = SIMILARITY, gap: int = GAP) -> list[tuple[int | None, np.ndarray | None]]:
    """Thread and topic of every message: each message is in one thread at most.

    A message goes on with the current thread if it is similar to its topic;
    else the most similar of the last three other threads that ended three
    messages ago or more resumes; else a thread starts. Messages under ten
    characters are in none, and more than `gap` of them end the thread. A
    thread of one message joins the one before if it is within five of it.
    """
    threads: list[_Thread] = []
    current, idle = None, 0
    for i, (text, vector) in enumerate(zip(texts, vectors)):
        if not text or len(text) < 10:
            idle += current is not None
            if idle > gap:
                current, idle = None, 0
            continue
        idle = 0
        if current is not None and _like(vector, current.topic) >= similarity:
            current.add(i, vector)
            continue
        best, found = similarity, None
        if current is not None:
            for t in [t for t in threads if t is not current][-3:]:
                if i - t.at[-1] >= 3 and _like(vector, t.topic) > best:
                    best, found = _like(vector, t.topic), t
        if found:
            found.add(i, vector)
            current = found
        else:
            current = _Thread(len(threads), i, vector)
            threads.append(current)
    merged: list[_Thread] = []
    for t in threads:
        if merged and len(t.at) < 2 and t.at[0] - merged[-1].at[-1] < 5:
            for i in t.at:
                merged[-1].add(i, vectors[i])
        else:
            merged.append(t)
    out: list[tuple[int | None, np.ndarray | None]] = [(None, None)] * len(texts)
    for number, t in enumerate(merged):
        for i in t.at:
            out[i] = (number, t.topic)
    return out


def detect(messages: DataFrame, *, similarity: float = SIMILARITY, gap: int = GAP) -> DataFrame:
    """conv_id, turn, thread_id (null: none), topic. The topic depends on all messages before, so a conversation is folded as a group; its vectors are made there, and texts alone are shuffled."""
    rows = messages.select("conv_id", "turn", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        found = fold(pdf["text"].tolist(), [hash_vector(t) for t in pdf["text"]], similarity, gap)
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "turn": pdf["turn"].to_numpy(), "thread_id": pd.array([t for t, _ in found], "Int64"), "topic": [v for _, v in found]})

    return rows.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, thread_id long, topic array<double>")


def single_thread(messages: DataFrame) -> DataFrame:
    """Where there are no vectors: one thread a conversation."""
    return messages.select("conv_id", "turn", F.lit(0).cast("long").alias("thread_id"))


def thread_sizes(threads: DataFrame) -> DataFrame:
    """conv_id, threads, avg_size: how many threads a conversation has, and messages in one; messages in none don't count."""
    of = threads.where("thread_id is not null").groupBy("conv_id", "thread_id").agg(F.count("*").alias("n"))
    return of.groupBy("conv_id").agg(F.count("*").alias("threads"), F.round(F.avg("n"), 4).alias("avg_size"))


def score_threads(threads: DataFrame, query_vector: list[float]) -> DataFrame:
    of = threads.where("thread_id is not null").groupBy("conv_id", "thread_id").agg(F.any_value("topic").alias("topic"), F.count("*").alias("n"))
    return of.withColumn("score", F.round(cosine(F.col("topic"), F.array(*[F.lit(float(x)) for x in query_vector])), 6))


def expand(threads: DataFrame, hit: str, *, before: int = 2, after: int = 1) -> DataFrame:
    """With expanded: within its thread, a hit, one of the `before` messages before a hit or of the `after` messages after one."""
    line = Window.partitionBy("conv_id", "thread_id").orderBy("turn").rowsBetween(-after, before)
    return threads.withColumn("expanded", F.when(F.col("thread_id").isNull(), F.col(hit)).otherwise(F.max(hit).over(line)))
