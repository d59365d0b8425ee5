"""The filter audit against a run of the filters one after another."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import interaction_audit as audit
from tests.llm.helpers import awkward, frame, plain, words

LABELS = "doc_id long, quality int, toxic int"


def brute(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    docs = []
    for i, text, _, source, _ in rows:
        t, w = text or "", words(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows),
        }
        good, toxic = (any(b[0] == i is not None and b[k] == 1 for b in labels) for k in (1, 2))
        docs.append((source or "", fails, good, toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                kept = [d for d in left if not d[1][f]]
                lost = [d for d in left if d[1][f]]
                removed_in_all[f] += len(lost)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                redundant = sum(d[1][f] for d in mine) - len(lost)
                steps.append((part, "".join(order), step, len(kept), len(lost), redundant, unique, sum(d[2] for d in lost), sum(d[3] for d in lost)))
                left = kept
        out += [(*s, removed_in_all[s[1][s[2] - 1]]) for s in steps]
    return out


def test_brute_force(spark):
    rows = awkward()
    rows += [(200 + i, "Wort%d & more" % (i % 3) * (1 + i % 2), "en", ["s0", None, "", "x y"][i % 4], 1) for i in range(20)]
    rows += [(300 + i, " ".join(f"w{j}" for j in range(190 + i)), "en", "s1", 1) for i in range(20)]  # about the least number of words
    rows += [(330 + i, " ".join(f"w{j % (95 + i)}" for j in range(200)), "en", "s1", 1) for i in range(10)]  # about half of them distinct
    rows += [(350 + i, "A" * i + "b" * (200 - i), "en", "s2", 1) for i in range(8)]  # about two capitals in a hundred
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 360)] + [(5, None, None), (6, 1, 1), (7, 0, None), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = audit.digest(frame(spark, rows, clashes=True).repartition(3), spark.createDataFrame(labels, LABELS))
    assert plain(got.collect()) == plain(brute(rows, labels))
    assert got.dtypes[:4] == [("part", "string"), ("filter_order", "string"), ("step", "int"), ("kept", "bigint")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit.digest(frame(spark, []), none).count() == 0
    assert audit.digest(frame(spark, awkward()), none).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_walk_meets_every_set(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(0, 9, (3, 1 << n, 2))
    states = audit.gray_walk(counts, n)
    for chosen in range(1 << n):
        passing = [m for m in range(1 << n) if not m & chosen]
        assert (states[:, chosen] == counts[:, passing].sum(axis=1)).all()
