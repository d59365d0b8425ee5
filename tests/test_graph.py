from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import graph, similarity


def vectors(spark, x, groups=None):
    rows = [(i, [float(v) for v in r], int(groups[i]) if groups is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, emb array<float>, g long")


def brute(x, tau, groups=None, inclusive=False):
    x = np.asarray(x, dtype=np.float32).astype(float)
    out = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            d = np.sqrt(((x[i] - x[j]) ** 2).sum())
            if (d <= tau if inclusive else d < tau) and (groups is None or groups[i] == groups[j]):
                out[(i, j)] = d
    return out


def found(edges):
    rows = edges.collect()
    got = {(r["src"], r["dst"]): r["dist"] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("tau", [0.05, 0.6, 2.5])
@pytest.mark.parametrize("chunk", [7, 1024])
def test_global_graph(spark, tau, chunk):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5))
    x[:50] = x[0] + rng.normal(size=(50, 5)) * 0.02  # a crowded cell
    got, expected = found(graph.eps_edges(vectors(spark, x), tau, chunk=chunk)), brute(x, tau)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("chunk", [5, 1024])
def test_grouped_graph(spark, chunk):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    edges = graph.eps_edges(vectors(spark, x, g), 1.5, ["g"], chunk=chunk)
    assert found(edges).keys() == brute(x, 1.5, g).keys()


def test_boundary_is_exclusive_by_default(spark):
    x = [[0.0, 0.0], [3.0, 4.0], [0.0, 0.0]]
    df = vectors(spark, x)
    assert set(found(graph.eps_edges(df, 5.0, ["g"]))) == {(0, 2)}
    assert set(found(graph.eps_edges(df, 5.0, ["g"], inclusive=True))) == {(0, 1), (0, 2), (1, 2)}
    assert set(found(graph.eps_edges(df, 5.0, inclusive=True))) == {(0, 1), (0, 2), (1, 2)}


def edge_frame(spark):
    return spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], "src long, dst long, dist double")


def test_softmax_sums_to_one(spark):
    both = graph.symmetric(edge_frame(spark), ["dist"]).withColumn("score", -F.col("dist"))
    weights = graph.softmax_weights(both, "score")
    sums = weights.groupBy("dst").agg(F.round(F.sum("weight"), 12).alias("s")).collect()
    assert {r["dst"]: r["s"] for r in sums} == {0: 1.0, 1: 1.0, 2: 1.0}
    w = {(r["src"], r["dst"]): r["weight"] for r in weights.collect()}
    assert np.isclose(w[(0, 1)], 1 / (1 + np.exp(-1.0)))


@pytest.mark.parametrize("rounds", [1, 3])
def test_normalised_sum(spark, rounds):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4, 3)).astype(np.float32)
    a = np.eye(4)
    for i, j in [(0, 1), (1, 2)]:
        a[i, j] = a[j, i] = 1
    d = a.sum(1)
    m = a / np.sqrt(np.outer(d, d))
    expected = np.linalg.matrix_power(m, rounds) @ x
    out = graph.normalised_sum(edge_frame(spark), vectors(spark, x), rounds).collect()
    assert np.allclose(np.array([r["emb"] for r in sorted(out, key=lambda r: r["id"])]), expected)


def test_self_loops_degrees_and_isolated(spark):
    nodes = spark.range(4)
    edges = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (9, 0)], "src long, dst long")
    assert graph.remove_self_loops(edges).count() == 3
    loops = graph.add_self_loops(edges, nodes)
    assert loops.where("src = dst").count() == 4
    known = graph.known_edges(edges, nodes)
    assert {tuple(r) for r in known.select("src", "dst").collect()} == {(0, 1), (2, 0)}
    assert {r["id"]: r["degree"] for r in graph.degrees(known, nodes).collect()} == {0: 2, 1: 1, 2: 1, 3: 0}
    weighted = known.withColumn("w", F.lit(1.5))
    assert {r["id"]: r["w"] for r in graph.with_isolated(weighted, nodes, "w").collect()} == {0: 1.5, 1: 0.0, 2: 1.5, 3: 0.0}


def test_topk_with_a_hub(spark):
    edges = spark.range(1, 200).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), (F.col("id") * 1.0).alias("dist"))
    top = graph.topk(edges.unionByName(edge_frame(spark).where("src = 1")), 3, [F.col("dist"), F.col("dst")])
    assert sorted((r["src"], r["dst"]) for r in top.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2)]


def test_mean_pool(spark):
    rows = [("a", i, [float(i), 1.0]) for i in range(5)] + [("b", 0, [1.0, 1.0]), ("b", 1, [2.0, 2.0])]
    out = graph.mean_pool(spark.createDataFrame(rows, "id string, pos int, vec array<float>")).collect()
    assert {r["id"]: r["pooled"] for r in out} == {"a": [2.0, 1.0], "b": None}


def test_profiles_read_training_positives_only(spark):
    rel = [("d1", "t1", 1, "train"), ("d1", "t1", 1, "train"), ("d1", "t2", 1, "train"), ("d1", "t3", 1, "test"), ("d2", "t1", 0, "train")]
    emb = spark.createDataFrame([("t1", [1.0, 0.0]), ("t2", [3.0, 2.0]), ("t3", [9.0, 9.0])], "prot_id string, emb array<float>")
    drugs = spark.createDataFrame([("d1",), ("d2",)], "drug_id string")
    schema = "drug_id string, prot_id string, label int, split string"
    out = graph.cross_side_mean(spark.createDataFrame(rel, schema), drugs, emb, "drug_id", "prot_id", 2)
    expected = {"d1": [2.0, 1.0], "d2": [0.0, 0.0]}
    assert {r["drug_id"]: r["profile"] for r in out.collect()} == expected
    flipped = [(d, t, 1 - y if s == "test" else y, s) for d, t, y, s in rel]
    again = graph.cross_side_mean(spark.createDataFrame(flipped, schema), drugs, emb, "drug_id", "prot_id", 2)
    assert {r["drug_id"]: r["profile"] for r in again.collect()} == expected


def sets_of(texts, n=3):
    return [{t[i : i + n] for i in range(len(t) - n + 1)} for t in texts]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_similar_sets_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcd é"), 60)) for _ in range(12)]
    texts = base + [t[:k] + "zz" + t[k:] for t in base for k in (5, 30)] + [base[0]] * 8 + ["ab", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found_sets = similarity.similar_sets(similarity.shingles(df, "id", "text", 3), "id", threshold)
    grams = sets_of(texts)
    reps = {}
    for i, g in enumerate(grams):
        if g:
            reps.setdefault(frozenset(g), []).append(i)
    first = sorted((ids[0], g) for g, ids in reps.items())
    expected = {}
    for x, (i, a) in enumerate(first):
        for j, b in first[x + 1 :]:
            s = len(a & b) / len(a | b)
            if s >= threshold:
                expected[(i, j)] = s
    got = {(r["a"], r["b"]): r["sim"] for r in found_sets.edges.collect()}
    assert got.keys() == expected.keys()
    assert all(np.isclose(got[k], expected[k]) for k in got)
    assert {r["rep"]: r["n"] for r in found_sets.members.collect()} == {ids[0]: len(ids) for ids in reps.values()}

    size = {ids[0]: len(ids) for ids in reps.values()}
    total = sum(2 * s * size[i] * size[j] for (i, j), s in expected.items()) + sum(n * (n - 1) for n in size.values())
    mean = similarity.mean_similarity(found_sets, len(texts)).first()[0]
    assert np.isclose(mean, total / len(texts) ** 2)


def test_sets_of_any_items(spark):
    df = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y", "x"]), (3, ["x", "y", "z"])], "id long, bits array<string>")
    found_sets = similarity.similar_sets(similarity.hashed_sets(df, "id", "bits"), "id", 0.5)
    assert [tuple(r) for r in found_sets.edges.collect()] == [(1, 3, 2 / 3)]
    assert {r["rep"]: r["n"] for r in found_sets.members.collect()} == {1: 2, 3: 1}


def test_vocabulary(spark):
    df = spark.createDataFrame([(0, "banana"), (1, ""), (2, "né😀b")], "row long, t string")
    vocab = similarity.vocabulary(df, "t", "row")
    assert [tuple(r) for r in vocab.orderBy("ix").collect()] == [
        ("b", 2, 2), ("a", 3, 3), ("n", 3, 4), ("é", 1, 5), ("😀", 1, 6)]
    codes = similarity.encode_tokens(df, "row", "t", vocab)
    assert {r["row"]: r["codes"] for r in codes.collect()} == {0: "2 3 4 3 4 3", 1: "", 2: "4 5 6 2"}


def test_capped_lists(spark):
    links = spark.createDataFrame([(g, d) for g in range(2) for d in range(4 + g)], "g int, d int")
    tokens = spark.createDataFrame([(d, [d, d + 100]) for d in range(6)], "d int, tokens array<int>")
    out = graph.capped_neighbour_lists(links, tokens, "g", "d", 3, -F.col("d"))
    assert {r["g"]: r["tokens"] for r in out.collect()} == {0: [3, 103, 2, 102, 1, 101], 1: [4, 104, 3, 103, 2, 102]}
    bounded = graph.capped_neighbour_lists(links, tokens, "g", "d", 3, -F.col("d"), min_len=6)
    assert bounded.count() == 0


def test_near_pairs_prune_by_pivot(spark):
    """Exact, and comparisons per vector fall far below all of them where groups lie apart."""
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (40, 8))
    x = np.concatenate([c + rng.normal(0, 0.2, (50, 8)) for c in centres])
    got = {(int(a), int(b)) for i, j, _ in graph.near_pairs(x, x, 1.0) for a, b in zip(i, j)}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d < 1.0))}
    pivot = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    at = np.sort(np.sqrt(((x - pivot) ** 2).sum(1)))
    per_vector = np.mean(np.searchsorted(at, at + 1.0) - np.searchsorted(at, at - 1.0))
    assert per_vector < len(x) / 4


def test_one_item_in_every_set(spark):
    from pairloom.operators import similarity

    rows = [(i, ["everywhere", *[f"i{(i // 2 * 7 + j) % 900}" for j in range(9)], *([f"own{i}"] if i % 2 else [])]) for i in range(300)]
    sets = similarity.hashed_sets(spark.createDataFrame(rows, "id long, items array<string>"), "id", "items")
    monkey, similarity.POSTINGS = similarity.POSTINGS, 16
    try:
        got = {(r["a"], r["b"]) for r in similarity.similar_sets(sets, "id", 0.8).edges.collect()}
    finally:
        similarity.POSTINGS = monkey
    plain = [(i, frozenset(s)) for i, s in rows]
    expected = {(i, j) for i, a in plain for j, b in plain if i < j and len(a & b) / len(a | b) >= 0.8}
    assert got == expected and len(expected) >= 150


def test_near_pairs_in_short_numbers():
    """Vectors far from the origin, just within and beyond the limit: short numbers screen, whole ones decide."""
    rng = np.random.default_rng(11)
    for shift in (0.0, 30.0, 1e14):
        x = rng.normal(0, 0.5, (300, 16)) + shift
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        tau = float(np.sort(d.ravel())[4000])
        for inclusive in (False, True):
            got = [(a, b) for i, j, _ in graph.near_pairs(x, x, tau, inclusive) for a, b in zip(i.tolist(), j.tolist())]
            near = d <= tau if inclusive else d < tau
            assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))
