"""The contextual flow: five channels, context by diffusion, frozen calibration, disjoint batches, until nothing is admissible.

*State.* A node keeps sums of its cells' states, mechanics and covectors; a
relation between two nodes keeps counts and quantile sketches of the
contacts it stands for (KLL sketches, whose medians are exact while a relation has at most ``SKETCH`` contacts).
Both merge, so a step touches only what its merges touch: relations without a
merged end pass on as they are, the others are renamed, united by merging
sketches, and get their distances anew. No step goes back to the contacts.

*Step.* All channels diffuse together, in one table with three columns for each.
Costs are soft maxima of the channels' penalties, over scales and thresholds
that are frozen at level 0. The batch is the best of several greedy orders or,
with few admissible relations, the exact best one.

*Store.* Merges, records, checkpoints and evaluations go to a transactional
store; a run that was killed, also within a step, resumes from its last
manifest and ends with the same ledger. Exact invariants are checked in each step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.scalars import affinity_penalty, clip, finite, log_sum_exp_cost, penalty, ratio, scale_threshold, support
from cambium.operators import graph, selection
from cambium.operators.aggregates import positive_scale
from cambium.operators.hierarchy import replay, terminal_rule
from cambium.operators.vectors import metric_distance, pair_cost
from cambium.scratch import dropped, shared_dir, temporary, written
from cambium.sources.runs import RunStore, committed_ledger

#: Items of a quantile sketch; medians are exact up to so many contacts of a relation.
SKETCH = 4096
CHANNELS = ("molecular", "mechanics", "communication", "geometry", "topology")


@dataclass(frozen=True)
class Config:
    """Parameters of the flow."""

    beta: float = 3.0
    missing: float = 0.35
    weights: tuple[float, ...] = (1.0, 1.0, 0.75, 1.0, 0.4)
    context_share: float = 0.4
    context_trust: float = 0.85
    alpha: float = 0.35
    base_hops: int = 2
    most_hops: int = 8
    low_quantile: float = 0.35
    high_quantile: float = 0.9
    stages: tuple[tuple[float, float], ...] = ((1500, 2e-4), (3000, 5e-4), (5000, 1e-3))
    last_fraction: float = 5e-3
    exact_edges: int = 18
    most_steps: int = 20_000
    checkpoint_every: int = 50
    landmark: float = 5e-3
    terminal: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Metric:
    """Matrices of the states' space: d.d + lam d'Ld for molecular distance, G over state, tension and pressure for geometry."""

    laplacian: np.ndarray
    lam: float
    full: np.ndarray


def first_nodes(cells: DataFrame) -> DataFrame:
    """Nodes of one cell each, from (cell, state, tension, pressure, covector); the two mechanics may be NULL."""
    there = lambda x: F.col(x).isNotNull().cast("long")
    return cells.select(
        F.col("cell").alias("node"), F.lit(1).cast("long").alias("size"), F.col("state").cast("array<double>").alias("state"), F.col("covector").cast("array<double>").alias("covector"),
        F.coalesce(F.col("tension").cast("double"), F.lit(0.0)).alias("tension_sum"), there("tension").alias("tension_n"), F.coalesce(F.col("pressure").cast("double"), F.lit(0.0)).alias("pressure_sum"), there("pressure").alias("pressure_n"),
    )


def _means(nodes: DataFrame) -> DataFrame:
    """(node, state, full, covector): means over a node's cells; ``full`` is NULL without both mechanics."""
    mean = lambda x: F.transform(F.col(x), lambda v: v / F.col("size"))
    t, p = ratio("tension_sum", "tension_n"), ratio("pressure_sum", "pressure_n")
    full = F.when(t.isNotNull() & p.isNotNull(), F.concat(mean("state"), F.array(t, p)))
    return nodes.select("node", mean("state").alias("state"), full.alias("full"), mean("covector").alias("covector"))


def _measured(relations: DataFrame, nodes: DataFrame, metric: Metric) -> DataFrame:
    """Relations with distances between the states of their nodes: ``molecular`` and ``geometry``, the latter NULL where a state is incomplete."""
    at = _means(nodes)
    a, b = (at.select(F.col("node").alias(n), *[F.col(x).alias(f"_{x}{k}") for x in ("state", "full", "covector")]) for n, k in (("super_i", "a"), ("super_j", "b")))
    out = metric_distance(relations.join(a, "super_i").join(b, "super_j"), "_statea", "_stateb", metric.laplacian, metric.lam, "molecular")
    out = pair_cost(out, metric.full, "_fulla", "_fullb", "_covectora", "_covectorb", "geometry")
    return out.drop(*[f"_{x}{k}" for x in ("state", "full", "covector") for k in "ab"])


_SKETCHES = ("tension", "pressure", "comm_ij", "comm_ji")


def first_relations(contacts: DataFrame) -> DataFrame:
    """Relations between cells from (cell_i, cell_j, tension, pressure, comm_ij, comm_ji); several contacts of a pair are one relation.

    Mechanics count by size, where both are known; missing communication is left out.
    """
    flip = F.col("cell_i") > F.col("cell_j")
    e = contacts.where("cell_i <> cell_j").select(
        F.least("cell_i", "cell_j").alias("super_i"), F.greatest("cell_i", "cell_j").alias("super_j"), F.abs(finite("tension")).alias("tension"), F.abs(finite("pressure")).alias("pressure"),
        F.when(flip, F.col("comm_ji")).otherwise(F.col("comm_ij")).cast("double").alias("comm_ij"), F.when(flip, F.col("comm_ij")).otherwise(F.col("comm_ji")).cast("double").alias("comm_ji"),
    )
    both = F.col("tension").isNotNull() & F.col("pressure").isNotNull()
    e = e.withColumns({"tension": F.when(both, F.col("tension")), "pressure": F.when(both, F.col("pressure"))})
    sketches = [F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias(x) for x in _SKETCHES]
    return e.groupBy("super_i", "super_j").agg(F.count("*").alias("n_boundary_edges"), F.count("tension").alias("n_mechanics"), *sketches)


def _median(sketch: str) -> Column:
    """Mean of the two middle items; NULL without any."""
    q = lambda r: F.kll_sketch_get_quantile_double(sketch, F.lit(r))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, (q(0.5) + q(0.500001)) / 2)


def merged_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Nodes after a batch (survivor, removed): sums are added; only merged nodes are computed."""
    gone = nodes.join(batch, nodes["node"] == batch["removed"]).select(F.col("survivor").alias("node"), *[F.col(x).alias(f"_{x}") for x in nodes.columns if x != "node"])
    rest = nodes.join(batch.select(F.col("removed").alias("node")), "node", "left_anti").join(gone, "node", "left")
    add = lambda x: F.when(F.col("_size").isNull(), F.col(x)).otherwise(F.zip_with(x, f"_{x}", lambda u, v: u + v) if x in ("state", "covector") else F.col(x) + F.col(f"_{x}")).alias(x)
    return rest.select("node", *[add(x) for x in nodes.columns if x != "node"])


def merged_relations(relations: DataFrame, nodes: DataFrame, batch: DataFrame, metric: Metric) -> DataFrame:
    """Relations after a batch, from those before and the nodes after it; only relations with a merged end are computed."""
    ends = batch.select(F.explode(F.array(F.struct(F.col("survivor").alias("node"), F.col("survivor").alias("to")), F.struct(F.col("removed").alias("node"), F.col("survivor").alias("to")))).alias("e")).select("e.node", "e.to")
    i, j = (ends.select(F.col("node").alias(n), F.col("to").alias(f"_{n}")) for n in ("super_i", "super_j"))
    marked = relations.join(i, "super_i", "left").join(j, "super_j", "left")
    touched = F.col("_super_i").isNotNull() | F.col("_super_j").isNotNull()
    same = marked.where(~touched).select(*relations.columns)
    to_i, to_j = F.coalesce("_super_i", "super_i"), F.coalesce("_super_j", "super_j")
    turn = to_i > to_j
    moved = marked.where(touched & (to_i != to_j)).select(
        F.least(to_i, to_j).alias("super_i"), F.greatest(to_i, to_j).alias("super_j"), "n_boundary_edges", "n_mechanics", "tension", "pressure",
        F.when(turn, F.col("comm_ji")).otherwise(F.col("comm_ij")).alias("comm_ij"), F.when(turn, F.col("comm_ij")).otherwise(F.col("comm_ji")).alias("comm_ji"),
    )
    united = moved.groupBy("super_i", "super_j").agg(F.sum("n_boundary_edges").alias("n_boundary_edges"), F.sum("n_mechanics").alias("n_mechanics"), *[F.kll_merge_agg_double(x, F.lit(SKETCH)).alias(x) for x in _SKETCHES])
    return same.unionByName(_measured(united, nodes, metric).select(*relations.columns))


def channels(relations: DataFrame) -> DataFrame:
    """Values of the five channels and their reliabilities; what is missing stays missing."""
    t, p = _median("tension"), _median("pressure")
    known = t.isNotNull().cast("int") + p.isNotNull().cast("int")
    mechanics = F.when(known > 0, F.sqrt((F.coalesce(t * t, F.lit(0.0)) + F.coalesce(p * p, F.lit(0.0))) / known))
    ij, ji = _median("comm_ij"), _median("comm_ji")
    comm = F.when(ij.isNotNull() | ji.isNotNull(), support(ij, ji))
    there = lambda x: x.isNotNull().cast("double")
    return relations.select(
        "super_i", "super_j", "n_boundary_edges", finite("molecular").alias("molecular"), there(finite("molecular")).alias("r_molecular"),
        mechanics.alias("mechanics"), clip(F.col("n_mechanics") / F.col("n_boundary_edges") * known / 2, 0.0, 1.0).alias("r_mechanics"),
        comm.alias("communication"), there(comm).alias("r_communication"), finite("geometry").alias("geometry"), there(finite("geometry")).alias("r_geometry"),
        (1 / F.sqrt(F.col("n_boundary_edges").cast("double"))).alias("topology"), F.lit(1.0).alias("r_topology"),
    )


def with_context(scored: DataFrame, hops: int, cfg: Config) -> DataFrame:
    """Effective value ``e_`` and reliability ``er_`` of each channel: local and context blended, context alone where local is missing.

    A node's context is a reliability-weighted mean over its relations, diffused; the 15 columns of the
    five channels' numerators, denominators and supports move in one table.
    """
    w = F.log1p(F.greatest(F.col("n_boundary_edges"), F.lit(1)).cast("double"))
    held = {f"_r_{ch}": F.when(F.col(ch).isNotNull(), clip(F.coalesce(F.col(f"r_{ch}"), F.lit(0.0)), 0.0, 1.0)).otherwise(0.0) for ch in CHANNELS}
    e = scored.withColumn("_w", w).withColumns(held)
    ends = graph.symmetric(e, "super_i", "super_j", "_w", *CHANNELS, *held)
    sums = [F.sum("_w").alias("tot")]
    for ch in CHANNELS:
        sums += [F.sum(F.col("_w") * F.col(f"_r_{ch}") * F.coalesce(ch, F.lit(0.0))).alias(f"num_{ch}"), F.sum(F.col("_w") * F.col(f"_r_{ch}")).alias(f"den_{ch}")]
    node = ends.groupBy(F.col("src").alias("node")).agg(*sums)
    node = node.withColumns({f"sup_{ch}": ratio(f"den_{ch}", F.greatest("tot", F.lit(1e-12))) for ch in CHANNELS})
    moving = [f"{kind}_{ch}" for ch in CHANNELS for kind in ("num", "den", "sup")]
    seen = graph.diffuse(ends.groupBy("src", "dst").agg(F.sum("_w").alias("w")), node.select("node", *moving), moving, hops, cfg.alpha)
    seen = seen.select("node", *[(F.col(f"num_{ch}") / F.greatest(F.col(f"den_{ch}"), F.lit(1e-12))).alias(f"c_{ch}") for ch in CHANNELS], *[F.col(f"sup_{ch}").alias(f"s_{ch}") for ch in CHANNELS])
    a, b = (seen.select(F.col("node").alias(n), *[F.col(x).alias(f"{x}{k}") for x in seen.columns if x != "node"]) for n, k in (("super_i", "_a"), ("super_j", "_b")))
    out = e.join(a, "super_i").join(b, "super_j")
    made = {}
    for ch in CHANNELS:
        context, trust = (F.col(f"c_{ch}_a") + F.col(f"c_{ch}_b")) / 2, clip((F.col(f"s_{ch}_a") + F.col(f"s_{ch}_b")) / 2, 0.0, 1.0)
        made[f"e_{ch}"] = F.when(F.col(ch).isNotNull(), (1 - cfg.context_share) * F.col(ch) + cfg.context_share * context).otherwise(context)
        made[f"er_{ch}"] = clip(F.col(f"_r_{ch}") + (1 - F.col(f"_r_{ch}")) * cfg.context_trust * trust, 0.0, 1.0)
    return out.select(*scored.columns, *[v.alias(k) for k, v in made.items()])


def cost(df: DataFrame, scales: dict[str, float], cfg: Config) -> DataFrame:
    """Adds ``cost``, infinite without evidence, and ``coverage``, the share of the weights that has evidence."""
    terms: list[tuple[Column, Column, float, Column]] = []
    for ch, weight in zip(CHANNELS, cfg.weights, strict=True):
        fn = affinity_penalty if ch == "communication" else penalty
        terms.append((fn(F.col(f"e_{ch}"), F.lit(scales[ch])), F.col(f"er_{ch}"), weight, F.col(f"e_{ch}").isNotNull()))
    held = sum(F.when(ok, r * k).otherwise(0.0) for _, r, k, ok in terms)
    return df.withColumns({"cost": log_sum_exp_cost(terms, cfg.beta, cfg.missing), "coverage": held / sum(cfg.weights)})


def calibrate(effective: DataFrame, cfg: Config) -> dict:
    """Scales of the channels, and the low and high quantile of the cost, of level 0; both are frozen from then on."""
    row = effective.agg(*[positive_scale(f"e_{ch}").alias(ch) for ch in CHANNELS]).first()
    scales = {ch: float(row[ch]) for ch in CHANNELS}
    q = cost(effective, scales, cfg).agg(F.percentile(finite("cost"), F.array(F.lit(cfg.low_quantile), F.lit(cfg.high_quantile))).alias("q")).first()["q"]
    low, high = (float(x) for x in (q or (0.0, 0.0)))
    return {"scales": scales, "low": low, "high": high}


def admissible(relations: DataFrame, mean_size: float, frozen: dict | None, cfg: Config) -> tuple[DataFrame, dict]:
    """The relations' effective channels, costs and whether each is ``allowed``, and the calibration, made here if none is given. A written table."""
    hops = min(cfg.most_hops, cfg.base_hops + max(0, int(mean_size).bit_length() - 1))
    effective = with_context(written(channels(relations), "channels"), hops, cfg)  # the sketches are asked once
    if frozen is None:
        effective = written(effective, "effective")
        frozen = calibrate(effective, cfg)
    tau = scale_threshold(F.lit(frozen["low"]), F.lit(frozen["high"]), F.lit(mean_size))
    out = cost(effective, frozen["scales"], cfg).withColumn("allowed", finite("cost").isNotNull() & (F.col("cost") <= tau))
    return written(out.withColumn("merit", -F.col("cost")), "scored"), frozen


def choose(allowed: DataFrame, n_allowed: int, cap: int, cfg: Config) -> tuple[str, DataFrame]:
    """The batch (survivor, removed, cost) of at most ``cap`` disjoint relations, and how it was found. A written table."""
    if n_allowed <= cfg.exact_edges:
        best = selection.exact_matching([tuple(r) for r in allowed.select("super_i", "super_j", "cost").collect()], cap)  # at most ``exact_edges`` rows
        mode, batch = "exact", allowed.sparkSession.createDataFrame(best, "super_i long, super_j long, cost double")
    else:
        # Merit is the cost's negative, so the five routes have two orders.
        routes = {k: selection.ROUTES[k] for k in ("cost", "boundary")}
        mode, batch = selection.batch_by_routes(allowed.select("super_i", "super_j", "cost", "merit", "n_boundary_edges"), cap, routes)
    return mode, written(batch.select(F.least("super_i", "super_j").alias("survivor"), F.greatest("super_i", "super_j").alias("removed"), "cost"), "batch")


def _totals(nodes: DataFrame, relations: DataFrame) -> dict:
    """What a batch must keep: cells, nodes and contacts, and the relations that break the order of their ends."""
    n = nodes.agg(F.count("*").alias("nodes"), F.sum("size").alias("cells"), F.count_distinct("node").alias("names")).first()
    r = relations.agg(F.count("*").alias("relations"), F.sum("n_boundary_edges").alias("contacts"), F.count_if(F.col("super_i") >= F.col("super_j")).alias("bad")).first()
    return {k: int(v or 0) for row in (n, r) for k, v in row.asDict().items()}


def checked(before: dict, after: dict, merges: int, inside: int) -> None:
    """An error unless a batch removed one node a merge, kept all cells, and lost just the contacts that came to lie ``inside`` a node."""
    wrong = [
        what for what, bad in (
            ("nodes", after["nodes"] != before["nodes"] - merges), ("names", after["names"] != after["nodes"]), ("cells", after["cells"] != before["cells"]),
            ("contacts", after["contacts"] != before["contacts"] - inside), ("ends", after["bad"] != 0),
        ) if bad
    ]
    if wrong:
        raise RuntimeError(f"a batch broke {', '.join(wrong)}: {before} -> {after}, {merges} merges, {inside} contacts inside")


def observed(scored: DataFrame, nodes: DataFrame, cells: int) -> DataFrame:
    """One row of a landmark: medians of the channels' effective values and of cost and coverage, largest and mean mass, entropy of the masses."""
    q = scored.agg(*[F.percentile(finite(f"e_{ch}"), F.lit(0.5)).alias(ch) for ch in CHANNELS], F.percentile(finite("cost"), F.lit(0.5)).alias("cost"), F.percentile("coverage", F.lit(0.5)).alias("coverage"))
    p = F.col("size") / cells
    m = nodes.agg((F.max("size") / cells).alias("phi"), F.avg("size").alias("mean_mass"), F.sum(-p * F.ln(p)).alias("entropy"))
    return q.crossJoin(m)  # one row each


def speeds(evaluations: DataFrame) -> DataFrame:
    """By landmark: the relative change of each channel's median, cost and coverage for each unit of ``removed``."""
    w = Window.partitionBy("run").orderBy("removed")
    du = F.col("removed") - F.lag("removed").over(w)
    return evaluations.withColumns({f"speed_{x}": ratio(F.abs(F.col(x) - F.lag(x).over(w)), (F.abs(F.col(x)) + F.abs(F.lag(x).over(w))) / 2 * du) for x in (*CHANNELS, "cost", "coverage")})


def run(contacts: DataFrame, cells: DataFrame, metric: Metric, store: RunStore, cfg: Config | None = None, stop: Callable[[int, str], None] | None = None) -> dict:
    """Contract until no relation is admissible, a terminal rule confirms or ``most_steps`` are made; returns the run's state.

    ``contacts`` as in ``first_relations``, ``cells`` as in ``first_nodes``, one
    row a cell. A store with a manifest resumes. With ``cfg.terminal`` (arguments of
    ``terminal_rule``) the landmarks' speeds are blocks of that rule. ``stop`` is
    called at the places where tests let a run die. ``state["why"]`` says why a run ended:
    ``exhausted``, ``terminal``, ``step_limit``. An empty table of cells is exhausted at once.
    """
    cfg = cfg or Config()
    spark = contacts.sparkSession
    parts = ["merges", "records", "evaluations", "nodes", "relations"]
    last = store.resume(parts)
    stop = stop or (lambda step, where: None)
    if last is None:
        nodes = store.put("nodes", 0, first_nodes(cells))
        relations = store.put("relations", 0, _measured(first_relations(contacts), nodes, metric))
        totals = _totals(nodes, relations)
        state = {"cells": totals["cells"], "frozen": None, "landmark": 0.0, "why": None, "totals": totals, "config": str(asdict(cfg))}
        store.commit(0, state)
        step = 0
    else:
        step, state = last
        nodes, relations = store.part("nodes", step), store.part("relations", step)
    records: list[dict] = []
    kept = step
    while state["why"] is None:
        if step >= cfg.most_steps:
            state["why"] = "step_limit"
        step += 1
        with temporary(spark) as stay:
            nodes, relations, record = _step(store, state, nodes, relations, metric, cfg, step, stop, stay) if state["why"] is None else (nodes, relations, None)
        if record:
            records.append(record)
        ended = state["why"] is not None
        if ended or step % cfg.checkpoint_every == 0:
            if records:
                store.put("records", step, spark.createDataFrame([tuple(r.values()) for r in records], "microstep int, nodes_before long, relations long, admissible long, threshold double, mode string, merges long, nodes_after long, contacts_inside long"))
                records = []
            old = nodes, relations
            nodes, relations = store.put("nodes", step, nodes), store.put("relations", step, relations)
            stop(step, "checkpoint")
            store.commit(step, state)
            for name in ("nodes", "relations"):
                store.drop(name, kept)
            kept = step
            for df in old:
                if hasattr(df, "_scratch"):
                    dropped(df)
    return state


def _step(store: RunStore, state: dict, nodes: DataFrame, relations: DataFrame, metric: Metric, cfg: Config, step: int, stop: Callable[[int, str], None], stay: list) -> tuple[DataFrame, DataFrame, dict]:
    """One microstep; sets ``state`` anew and returns the nodes, the relations and a record."""
    before = state["totals"]
    mean_size = state["cells"] / max(before["nodes"], 1)
    scored, state["frozen"] = admissible(relations, mean_size, state["frozen"], cfg)
    allowed = scored.where("allowed")
    n_allowed = allowed.count()
    tau = min(state["frozen"]["high"], state["frozen"]["low"] * (1 + 0.4 * float(np.log1p(max(0.0, mean_size - 1)))))
    record = {"microstep": step, "nodes_before": before["nodes"], "relations": before["relations"], "admissible": n_allowed, "threshold": tau}
    if not n_allowed:
        state["why"] = "exhausted"
        stay += [df for df in (nodes, relations) if hasattr(df, "_scratch")]
        return nodes, relations, record | {"mode": "exhausted", "merges": 0, "nodes_after": before["nodes"], "contacts_inside": 0}
    cap = selection.batch_cap(before["nodes"], selection.schedule(step - 1, list(cfg.stages), cfg.last_fraction))
    mode, batch = choose(allowed, n_allowed, cap, cfg)
    stop(step, "chosen")
    store.put("merges", step, batch.select("survivor", "removed", "cost"))
    inside = relations.join(batch.select(F.col("survivor").alias("super_i"), F.col("removed").alias("super_j")), ["super_i", "super_j"], "left_semi").agg(F.count("*"), F.sum("n_boundary_edges")).first()
    merges, contacts_inside = int(inside[0]), int(inside[1] or 0)
    old = nodes, relations
    nodes = written(merged_nodes(nodes, batch), "nodes")
    relations = written(merged_relations(relations, nodes, batch, metric), "relations")
    stay += [nodes, relations]
    state["totals"] = _totals(nodes, relations)
    checked(before, state["totals"], merges, contacts_inside)
    for df in old:
        if hasattr(df, "_scratch"):
            dropped(df)
    removed = (state["cells"] - state["totals"]["nodes"]) / state["cells"]
    if removed >= state["landmark"] + cfg.landmark:
        state["landmark"] = removed
        tag = observed(scored, nodes, state["cells"]).select(F.lit(store.root).alias("run"), F.lit(step).alias("microstep"), F.lit(removed).alias("removed"), "*")
        store.put("evaluations", step, tag)
        if cfg.terminal and _rested(store, cfg):
            state["why"] = "terminal"
    stop(step, "merged")
    return nodes, relations, record | {"mode": mode, "merges": merges, "nodes_after": state["totals"]["nodes"], "contacts_inside": contacts_inside}


def _rested(store: RunStore, cfg: Config) -> bool:
    """Whether the terminal rule confirms at the last landmark; one row a landmark, at most 1 / ``landmark`` of them."""
    rows = store.spark.read.option("basePath", f"{store.root}/evaluations").parquet(*[f"{store.root}/evaluations/step={s:08d}" for s in store.steps("evaluations")])
    moving = speeds(rows)
    seen = terminal_rule(moving, ["run"], "removed", [x for x in moving.columns if x.startswith("speed_")], ["phi", "mean_mass"], **cfg.terminal)
    return bool(seen.orderBy(F.desc("removed")).select("confirmed").first()[0])


def contextual_flow(contacts: DataFrame, cells: DataFrame, metric: Metric, cfg: Config | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(cell, node) at the end, the records of all steps, and the run's state; the store is a folder of its own and is deleted."""
    spark = contacts.sparkSession
    store = RunStore(spark, f"{shared_dir(spark)}/cambium/run-{uuid.uuid4().hex}")
    try:
        state = run(contacts, cells, metric, store, cfg)
        labels = cells.select("cell", F.col("cell").alias("node"))
        ledger = committed_ledger(store)
        labels = written(labels if ledger is None else replay(labels, ledger), "labels")
        records = written(store.parts("records"), "records")
    finally:
        store.delete()
    return labels, records, state


def relation_costs(contacts: DataFrame, cells: DataFrame, metric: Metric, cfg: Config | None = None) -> DataFrame:
    """Level 0 of the flow: every relation's effective channels, cost, coverage and whether it is allowed."""
    cfg = cfg or Config()
    with temporary(contacts.sparkSession) as stay:
        nodes = written(first_nodes(cells), "nodes")
        relations = written(_measured(first_relations(contacts), nodes, metric), "relations")
        out, _ = admissible(relations, 1.0, None, cfg)
        stay.append(out)
    return out
