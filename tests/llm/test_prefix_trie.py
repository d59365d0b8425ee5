"""The prefix trie against brute force, over any number of shards."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm import prefix_trie
from tests.llm.helpers import CLASHES, plain

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = defaultdict(list)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    out = []
    for path, ms in members.items():
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below[path] if p)
        ends = ",".join(map(str, sorted(c for c in ms if paths[c] == path)))
        out.append((
            min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), children[path],
            sum(not children[p] for p in below[path]), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def conversations(seed: int, n: int = 260) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = rng.random() < 0.4  # copies of one conversation, and of its start
        for turn in range(6 if hot else rng.randrange(1, 9)):
            text = f"hot {turn}" if hot or rng.random() < 0.3 else rng.choice(["yes", "no", "", f"t{rng.randrange(40)} 😀"])
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(2)]  # some lose all their turns
    rows += [(500, None, None, None), (500, 3, None, "x"), (500, 3, "user", "x"), (500, 3, "user", "x"), (None, 1, "user", "x")]
    rows += [(700, t, "user", f"long {t}") for t in range(900)] + [(800, t, "user", f"long {t}") for t in range(900)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_brute_force(spark, shards, monkeypatch):
    rows = conversations(shards)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    turns = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({c: F.lit(c) for c in CLASHES if c != "path"})
    got = prefix_trie.trie(prefix_trie.rebuild(turns), shards)
    assert tuple(got.columns) == prefix_trie.COLUMNS
    assert plain(got.collect()) == plain(brute(rows))


def test_negative_ids_and_heads_without_a_family(spark):
    rows = [(c, t, "user", f"{t}") for c in (-205, 3, 107, 107, 2**40) for t in range(7)]
    own = {-205: -200, 3: 0, 107: 100}
    got = prefix_trie.digest(spark.createDataFrame(rows, TURNS)).collect()
    assert not set(own.values()) & {r["conv_id"] for r in got}
    assert next(r for r in got if r["depth"] == 0)["n_convs"] == 4


def test_empty_tables(spark):
    assert prefix_trie.digest(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.digest(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_a_skeleton_that_is_too_large_is_thinned_out(monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_TURNS", 10)
    splitters = sorted((bytes([i]) * 16 * 3, i) for i in range(20))
    skeleton = prefix_trie.Skeleton(splitters)
    assert 1 <= len(skeleton.splitters) <= 3 and len(skeleton.parent) <= 10
    assert prefix_trie.Skeleton([(b"x" * 16 * 11, 1)]).splitters == []
    assert [skeleton.shard(p, i) for p, i in skeleton.splitters] == list(range(1, len(skeleton.splitters) + 1))


def test_splitters_cut_a_group_of_copies(spark):
    paths = spark.range(4000).select(
        F.col("id").alias("conv_id"), F.lit(b"k" * 32).alias("path"), F.array(F.lit(1), F.lit(2)).alias("lens")
    )
    splitters = prefix_trie.choose_splitters(paths, 8, 4000)
    assert 5 <= len(splitters) <= 9 and len({p for p, _ in splitters}) == 1
    ids = [-1, *[c for _, c in splitters], 3999]
    assert max(b - a for a, b in zip(ids, ids[1:])) < 1500
    root = prefix_trie.trie(paths, 8).where("depth = 2").first()
    assert root["n_convs"] == 4000 and root["n_leaves"] == 1
    assert root["ends_sha256"] == hashlib.sha256(",".join(map(str, range(4000))).encode()).hexdigest()
