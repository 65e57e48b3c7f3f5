"""Tests of the findings of round 3, third session."""

from __future__ import annotations

import random
from collections import Counter

from cambium.llm import ngram_join


def test_differences_leave_out_what_one_member_alone_has(spark, monkeypatch):
    """pipeline: a family's tables hold no token that no other member has, for no pair needs it; links are as before."""
    r, rows, seen = random.Random(1), [], []
    for i in range(60):
        t = [f"b{k}" for k in range(200)]
        for k in r.sample(range(200), 3 + i % 9):
            t[k] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    described, level = ngram_join.Join.described, ngram_join.Level(3, 9, 10)
    monkeypatch.setattr(ngram_join.Join, "described", lambda self, many: seen.append(described(self, many)) or seen[0])
    diffs: list = []
    centre = ngram_join.Join.centre_links
    monkeypatch.setattr(ngram_join.Join, "centre_links", lambda self, d: diffs.extend(d.select("cid", "n", "w", "diff").collect()) or centre(self, d))
    got = {x.doc_id: x.component_id for x in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), level, links=False).collect()}
    times = Counter(t for d in diffs for t in d["diff"])
    alone = sum(n == 1 for n in times.values())
    assert len(diffs) > 30 and alone < len(diffs)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 10 * len(a & b) >= 9 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
        if all(least[least[i]] == least[i] for i in range(len(rows))):
            break
    assert got == dict(enumerate(least))
