"""Causal regime detectors: a classifier of each landmark and a state machine over the classes.

Both see only what came before. The state machine is one function over a
group's rows in order and its state, used by the batch and the stream alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cambium.functions.scalars import ratio


def votes(df: DataFrame, keys: list[str], order: str, x: str, strides: tuple[int, ...] = (1, 2, 3), widths: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """For each setting a causal speed (median over a trailing frame of backward differences), long by setting."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df
    for s in strides:
        out = out.withColumn(f"_d{s}", F.abs(ratio(F.col(x) - F.lag(x, s).over(w), F.col(order) - F.lag(order, s).over(w))))
    names = []
    for s in strides:
        for k in widths:
            names.append(f"s{s}w{k}")
            out = out.withColumn(names[-1], F.percentile(F.col(f"_d{s}"), F.lit(0.5)).over(w.rowsBetween(-(k - 1), 0)))
    return out.select(*keys, order, *names).unpivot([*keys, order], names, "setting", "speed")


def classified(long: DataFrame, keys: list[str], order: str, low: float = 0.25, high: float = 0.9, warm: int = 8) -> DataFrame:
    """A class for each landmark by majority of settings, each held against its own quantiles.

    WARMUP for the first rows, UNRESOLVED with under half of the settings,
    FAST_CHANGE or LOW_FLOW if over half say so, else REGULAR.
    """
    q = long.groupBy(*keys, "setting").agg(F.percentile("speed", F.lit(low)).alias("lo"), F.percentile("speed", F.lit(high)).alias("hi"))
    v = long.join(q, [*keys, "setting"]).groupBy(*keys, order).agg(F.count("*").alias("settings"), F.count("speed").alias("known"), F.count_if(F.col("speed") <= F.col("lo")).alias("slow"), F.count_if(F.col("speed") >= F.col("hi")).alias("fast"))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    kind = F.when(row <= warm, "WARMUP").when(F.col("known") * 2 < F.col("settings"), "UNRESOLVED").when(F.col("fast") * 2 > F.col("known"), "FAST_CHANGE").when(F.col("slow") * 2 > F.col("known"), "LOW_FLOW").otherwise("REGULAR")
    return v.withColumn("class", kind)


@dataclass(frozen=True)
class Rule:
    """Stable rows in a row that open a confirmation, and further ones that complete it."""

    persist: int = 3
    confirm: int = 2


#: Stable rows so far, confirming rows so far, whether a confirmation is open, whether it was completed.
State = tuple[int, int, bool, bool]
START: State = (0, 0, False, False)


def advance(state: State, kind: str, rule: Rule) -> tuple[State, str]:
    """One row: only low flow is stable. Any other row, unresolved ones too, resets the run or fails the open confirmation."""
    run, held, open_, stopped = state
    stable = kind == "LOW_FLOW"
    if stopped:
        return state, "STOPPED"
    if not open_:
        run = run + 1 if stable else 0
        return ((run, 0, True, False), "ENTER_CONFIRMATION") if run >= rule.persist else ((run, 0, False, False), "CONTINUE")
    if not stable:
        return START, "CONFIRMATION_FAILED"
    held += 1
    return ((run, held, True, True), "STOP_CONFIRMED") if held >= rule.confirm else ((run, held, True, False), "CONFIRMING")


def _walk(g: pd.DataFrame, order: str, state: State, rule: Rule) -> tuple[pd.DataFrame, State]:
    g = g.sort_values(order, kind="mergesort")
    said = []
    for kind in g["class"]:
        state, word = advance(state, kind, rule)
        said.append(word)
    return g.assign(decision=said), state


def detect(df: DataFrame, keys: list[str], order: str, rule: Rule | None = None) -> DataFrame:
    """The state machine over each group's rows (keys, order, class)."""
    rule = rule or Rule()
    use = df.select(*keys, order, "class")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in use.schema)}, decision string"
    return use.groupBy(*keys).applyInPandas(lambda g: _walk(g, order, START, rule)[0], schema)


def detect_stream(df: DataFrame, key: str, order: str, rule: Rule | None = None) -> DataFrame:
    """The same over a stream: rows of a key arrive in order over the batches, its state is kept between them."""
    rule = rule or Rule()
    use = df.select(key, order, "class")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in use.schema)}, decision string"

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        out, now = _walk(pd.concat(list(frames)), order, now, rule)
        state.update(now)
        yield out

    return use.groupBy(key).applyInPandasWithState(run, schema, "run int, held int, open boolean, stopped boolean", "append", GroupStateTimeout.NoTimeout)
