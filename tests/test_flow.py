"""The contextual flow against a plain NumPy flow, and runs that are killed and resumed."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from cambium.operators import flow
from cambium.operators.hierarchy import replay
from cambium.operators.vectors import block_metric
from cambium.sources.runs import RunStore, committed_ledger

DIM = 4
LAPLACIAN = np.array([[1.0, -1, 0, 0], [-1, 2, -1, 0], [0, -1, 2, -1], [0, 0, -1, 1]])
METRIC = flow.Metric(LAPLACIAN, 0.3, block_metric(LAPLACIAN, 0.3, 2.0, 0.5))


def small(seed, n=36):
    r = random.Random(seed)
    cells = []
    for i in range(n):
        state = [r.random() for _ in range(DIM)]
        cells.append((i, state, r.choice([None, r.random()]) if i % 3 else r.random(), None if r.random() < 0.2 else r.random(), [r.uniform(-0.1, 0.1) for _ in range(DIM + 2)]))
    pairs = {(i, j) for i in range(n) for j in r.sample(range(n), 3) if i < j}
    contacts = []
    for i, j in sorted(pairs):
        for _ in range(r.choice([1, 1, 2])):
            a, b = (i, j) if r.random() < 0.5 else (j, i)
            contacts.append((a, b, r.choice([None, r.gauss(0, 1)]), r.gauss(0, 1), r.choice([None, r.random()]), r.random()))
    return cells, contacts


def frames(spark, cells, contacts):
    return (
        spark.createDataFrame(contacts, "cell_i long, cell_j long, tension double, pressure double, comm_ij double, comm_ji double"),
        spark.createDataFrame(cells, "cell long, state array<double>, tension double, pressure double, covector array<double>"),
    )


def greedy(edges, key, cap):
    used, out = set(), []
    for e in sorted(edges, key=lambda e: (*key(e), e["i"], e["j"])):
        if e["i"] not in used and e["j"] not in used:
            used |= {e["i"], e["j"]}
            out.append(e)
    return out[:cap]


def best_few(edges, cap):
    edges = sorted(edges, key=lambda e: (e["i"], e["j"], e["cost"]))
    best = None
    for k in range(1, min(cap, len(edges)) + 1):
        for some in combinations(edges, k):
            if len({x for e in some for x in (e["i"], e["j"])}) == 2 * k:
                score = (-k, sum(e["cost"] for e in some), max(e["cost"] for e in some), [(e["i"], e["j"], e["cost"]) for e in some])
                if best is None or score < best[0]:
                    best = (score, some)
    return list(best[1])


def plain(cells, contacts, cfg):
    """(step, survivor, removed) by regrouping all contacts in every step."""
    label = {c[0]: c[0] for c in cells}
    frozen, out = None, []
    for step in range(1, cfg.most_steps + 1):
        members = {}
        for c in cells:
            members.setdefault(label[c[0]], []).append(c)
        mean = lambda xs: float(np.mean(xs)) if xs else math.nan
        state = {k: np.mean([c[1] for c in m], axis=0) for k, m in members.items()}
        full = {k: np.append(state[k], [mean([c[2] for c in m if c[2] is not None]), mean([c[3] for c in m if c[3] is not None])]) for k, m in members.items()}
        beta = {k: np.mean([c[4] for c in m], axis=0) for k, m in members.items()}
        groups = {}
        for a, b, t, p, ij, ji in contacts:
            i, j = label[a], label[b]
            if i != j:
                groups.setdefault((min(i, j), max(i, j)), []).append((t, p, ij, ji) if i < j else (t, p, ji, ij))
        edges = []
        for (i, j), g in sorted(groups.items()):
            both = [(abs(t), abs(p)) for t, p, _, _ in g if t is not None and p is not None]
            mid = lambda xs: float(np.median(xs)) if xs else math.nan
            ij, ji = mid([x[2] for x in g if x[2] is not None]), mid([x[3] for x in g if x[3] is not None])
            mech = math.sqrt((mid([x[0] for x in both]) ** 2 + mid([x[1] for x in both]) ** 2) / 2) if both else math.nan
            comm = math.nan if math.isnan(ij) and math.isnan(ji) else max(0, 0 if math.isnan(ij) else ij) + max(0, 0 if math.isnan(ji) else ji)
            d, v = state[j] - state[i], full[j] - full[i]
            geometry = math.nan if np.isnan(v).any() else math.sqrt(v @ METRIC.full @ v) + 0.5 * (beta[i] - beta[j]) @ v
            x = [math.sqrt(d @ d + METRIC.lam * d @ LAPLACIAN @ d), mech, comm, geometry, 1 / math.sqrt(len(g))]
            edges.append({"i": i, "j": j, "n": len(g), "x": np.array(x), "r": np.array([1.0, len(both) / len(g) if both else 0.0, 0.0 if math.isnan(comm) else 1.0, 0.0 if math.isnan(geometry) else 1.0, 1.0])})
        if not edges:
            break
        nodes = sorted(members)
        at = {k: n for n, k in enumerate(nodes)}
        size = len(cells) / len(nodes)
        hops = min(cfg.most_hops, cfg.base_hops + int(math.floor(math.log2(size))))
        w = np.array([math.log1p(e["n"]) for e in edges])
        ii, jj = np.array([at[e["i"]] for e in edges]), np.array([at[e["j"]] for e in edges])
        P = np.eye(len(nodes))
        np.add.at(P, (ii, jj), w)
        np.add.at(P, (jj, ii), w)
        P /= P.sum(1, keepdims=True)
        e_, er = np.zeros((len(edges), 5)), np.zeros((len(edges), 5))
        for ch in range(5):
            x, r = np.array([e["x"][ch] for e in edges]), np.array([e["r"][ch] for e in edges])
            r = np.where(np.isnan(x), 0, r)
            num, den, tot = (np.zeros(len(nodes)) for _ in range(3))
            for side in (ii, jj):
                np.add.at(num, side, w * r * np.nan_to_num(x))
                np.add.at(den, side, w * r)
                np.add.at(tot, side, w)
            sup = den / np.maximum(tot, 1e-12)
            for _ in range(hops):
                num, den, sup = (0.65 * y + 0.35 * P @ y for y in (num, den, sup))
            node = num / np.maximum(den, 1e-12)
            context, trust = (node[ii] + node[jj]) / 2, np.clip((sup[ii] + sup[jj]) / 2, 0, 1)
            e_[:, ch] = np.where(np.isnan(x), context, 0.6 * x + 0.4 * context)
            er[:, ch] = np.clip(r + (1 - r) * 0.85 * trust, 0, 1)
        if frozen is None:
            scales = [float(np.median(c[c > 0])) if (c > 0).any() else 1.0 for c in e_.T]
        weights = er * np.array(cfg.weights)
        pen = np.log1p(np.maximum(e_, 0) / scales if frozen is None else np.maximum(e_, 0) / frozen[0])
        pen[:, 2] = np.exp(-np.maximum(e_[:, 2], 0) / (scales if frozen is None else frozen[0])[2])
        total = weights.sum(1)
        cost = np.log((weights * np.exp(3 * pen)).sum(1) / total) / 3 + 0.35 * (1 - total / sum(cfg.weights))
        if frozen is None:
            frozen = (scales, *np.quantile(cost, [cfg.low_quantile, cfg.high_quantile]))
        tau = min(frozen[2], frozen[1] * (1 + 0.4 * math.log1p(max(0, size - 1))))
        allowed = [e | {"cost": float(c)} for e, c in zip(edges, cost, strict=True) if c <= tau]
        if not allowed:
            break
        cap = min(max(1, math.ceil(len(nodes) * cfg.last_fraction)), max(1, len(nodes) // 2))
        if len(allowed) <= cfg.exact_edges:
            batch = best_few(allowed, cap)
        else:
            routes = {"cost": lambda e: (e["cost"],), "merit": lambda e: (e["cost"],), "cost_then_merit": lambda e: (e["cost"],), "boundary": lambda e: (-e["n"], e["cost"]), "merit_then_cost": lambda e: (e["cost"],)}
            tried = [(greedy(allowed, k, cap), name) for name, k in routes.items()]
            batch = min(tried, key=lambda b: (-len(b[0]), round(sum(e["cost"] for e in b[0]), 12), max(e["cost"] for e in b[0]), b[1]))[0]
        for e in batch:
            out.append((step, e["i"], e["j"]))
            label = {c: e["i"] if n == e["j"] else n for c, n in label.items()}
    return out


CFG = flow.Config(stages=(), last_fraction=0.06, most_steps=10, checkpoint_every=3, landmark=0.05)


def merges(store):
    return sorted((r.microstep, r.survivor, r.removed) for r in committed_ledger(store).collect())


def test_ten_steps_equal_the_plain_flow(spark, tmp_path):
    cells, contacts = small(1)
    store = RunStore(spark, str(tmp_path / "run"))
    flow.run(*frames(spark, cells, contacts), METRIC, store, CFG)
    want = plain(cells, contacts, CFG)
    assert merges(store) == sorted(want) and len({s for s, _, _ in want}) == 10
    records = store.parts("records").orderBy("microstep").collect()
    assert [r.microstep for r in records] == list(range(1, 11)) and all(r.nodes_before - r.merges == r.nodes_after for r in records)
    assert store.parts("evaluations").count() >= 3


class Killed(Exception):
    pass


@pytest.mark.parametrize("where", ["merged", "checkpoint"])
def test_a_killed_run_resumes_to_the_same_ledger(spark, tmp_path, where):
    cells, contacts = small(3, 14)
    cfg = flow.Config(stages=(), last_fraction=0.1, checkpoint_every=2, landmark=0.1, high_quantile=0.36)
    data = frames(spark, cells, contacts)
    whole = RunStore(spark, str(tmp_path / "whole"))
    state = flow.run(*data, METRIC, whole, cfg)
    assert state["why"] == "exhausted"
    store = RunStore(spark, str(tmp_path / "killed"))

    def die(step, place):
        if step >= 3 and place == where:
            raise Killed

    with pytest.raises(Killed):
        flow.run(*data, METRIC, store, cfg, stop=die)
    assert store.latest()[0] == 2 and max(store.steps("merges"), default=0) >= 3
    again = flow.run(*data, METRIC, store, cfg)
    assert merges(store) == merges(whole) and again["totals"] == state["totals"]
    for name in ("records", "evaluations"):
        mine, theirs = (s.parts(name).drop("run", "step").orderBy("microstep").collect() for s in (store, whole))
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):
            assert [pytest.approx(v) if isinstance(v, float) else v for v in b] == list(a)
    assert flow.run(*data, METRIC, store, cfg) == again
    labels = replay(data[1].select("cell", data[1]["cell"].alias("node")), committed_ledger(store))
    assert labels.select("node").distinct().count() == again["totals"]["nodes"]


def test_a_broken_batch_is_an_error():
    before = {"nodes": 10, "names": 10, "cells": 20, "contacts": 30, "bad": 0}
    flow.checked(before, before | {"nodes": 8, "names": 8, "contacts": 27}, 2, 3)
    for change in ({"nodes": 9}, {"names": 7}, {"cells": 19}, {"contacts": 28}, {"bad": 1}):
        with pytest.raises(RuntimeError):
            flow.checked(before, before | {"nodes": 8, "names": 8, "contacts": 27} | change, 2, 3)


def test_empty_and_isolated(spark):
    cells, contacts = small(4, 5)
    c, n = frames(spark, cells, contacts)
    labels, records, state = flow.contextual_flow(c.limit(0), n, METRIC)
    assert state["why"] == "exhausted" and labels.count() == 5 and records.count() == 1
    labels, _, state = flow.contextual_flow(c.limit(0), n.limit(0), METRIC)
    assert state["why"] == "exhausted" and labels.count() == 0
