"""Operators over whole tables: exact, line and near dedup, mixing, packing, the classifier."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import classifier, exact_dedup, line_dedup, mixing, packing, simhash
from tests.llm.helpers import CLASHES, DOCS, SPACES, awkward, frame, plain, prose, words


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact dedup ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_exact_dedup_matches_brute_force(spark, block):
    rows = [r for r in awkward() if block > 1 or len(r[1] or "") < 400]
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(SPACES, "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    expected = []
    for norm, members in groups.items():
        best = min(members)
        kept = False
        for m in sorted(members):
            first = m == best and not kept
            kept |= first
            expected.append((m[3], best[3], len(members), first, sha(norm)))
    got = exact_dedup.mark_duplicates(frame(spark, rows), block_chars=block).collect()
    assert plain(got) == plain(expected)


def test_exact_dedup_keeps_one_row_of_each(spark):
    rows = awkward()
    kept = exact_dedup.dedup(frame(spark, rows, clashes=True)).collect()
    assert len(kept) == len({re.sub(SPACES, "", r[1] or "") for r in rows})
    assert all(r[c] == f"<{c}>" for r in kept for c in CLASHES)
    assert exact_dedup.mark_duplicates(frame(spark, [])).count() == 0


# --- line dedup -------------------------------------------------------------------------------------------------------


def test_line_dedup_matches_brute_force(spark):
    long = ["shared line number %d which is long enough to count as one" % i for i in range(6)]
    rows = []
    for i in range(30):
        mine = [long[j] if (i + j) % 3 else "  " + long[j].upper() + "\t" for j in range(6) if i % (j + 2) == 0]
        rows.append((i, "\n".join([f"own line {i} " + "x" * 40, *mine, "short", *mine[:1]]), "en", "s", 0))
    rows += [(40, long[0], "en", "s", 0)] * 2 + [(None, long[0], "en", "s", 0), (41, None, "en", "s", 0), (41, long[1], "en", "s", 0)]
    rows += awkward()
    holders, owner = defaultdict(set), {}

    def key(line):
        return re.sub(f"^{SPACES}+|{SPACES}+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    owner = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    expected = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        expected.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    out = line_dedup.drop_common_lines(frame(spark, rows, clashes=True))
    assert plain(out.select("doc_id", "n_lines", "n_dropped", "text").collect()) == plain(expected)
    assert sum(e[2] for e in expected) > 20
    assert all(r[c] == f"<{c}>" for r in out.collect() for c in CLASHES)
    assert line_dedup.drop_common_lines(frame(spark, [])).count() == 0


# --- SimHash ----------------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def components(codes: list[int], distance: int) -> list[int]:
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(codes))]


def test_simhash_matches_brute_force(spark):
    rows = awkward()
    codes = [fingerprint(r[1]) for r in rows]
    root, least = components(codes, 2), {}
    for r, (i, *_) in zip(root, rows):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    expected = [(r[0], f"{c:016x}", least[x]) for r, c, x in zip(rows, codes, root)]
    assert plain(simhash.digest(frame(spark, rows)).collect()) == plain(expected)
    kept = simhash.near_dedup(frame(spark, rows, clashes=True)).collect()
    assert len(kept) == len(set(root))
    assert {r["doc_id"] for r in kept} == set(least.values())
    assert simhash.digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("max_node,distance", [(4096, 2), (8, 2), (8, 1), (16, 3)])
def test_near_links_span_all_components(spark, max_node, distance):
    """Dense balls, chains and stray codes, with groups far beyond the size of a node."""
    rng = random.Random(max_node + distance)
    codes = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            code = centre
            for _ in range(rng.randint(0, 5)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    code = rng.getrandbits(64)
    for _ in range(40):  # a chain that wanders
        code ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        codes.add(code)
    codes |= {0, 1, 3, 7, 1 << 63, (1 << 63) | 1} | {rng.getrandbits(64) for _ in range(200)}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(signed)], "fp long, id long")
    got = {r["id"]: r["component_id"] for r in simhash.components(df, distance, max_node).collect()}
    assert [got[i] for i in range(len(codes))] == components(codes, distance)


def near_pairs(codes: np.ndarray, distance: int) -> set:
    """All near pairs of sorted distinct codes, a block of rows at a time."""
    out = set()
    for at in range(0, len(codes), 500):
        a, b = np.nonzero(np.bitwise_count((codes[at : at + 500, None] ^ codes[None, :]).view(np.uint64)) <= distance)
        out |= {(int(codes[at + i]), int(codes[j])) for i, j in zip(a, b) if at + i < j}
    return out


def linked(pairs) -> dict:
    """Smallest code reachable from each linked code."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_tree_prunes_and_spans_all(spark):
    rng = np.random.default_rng(7)
    codes = np.unique(np.concatenate([rng.integers(-(2**63), 2**63, 3000), np.int64(5) ^ (np.int64(1) << np.arange(60, dtype=np.int64))]))
    df = spark.createDataFrame([(c,) for c in codes.tolist()], "fp long")
    report: list = []
    links = [tuple(r) for r in simhash.near_links(df, 2, 16, report).collect()]
    near = near_pairs(codes, 2)
    assert {(min(x), max(x)) for x in links} <= near
    assert linked(links) == linked(near)
    assert len(report) >= 3 and [r["nodes"] for r in report] == sorted(r["nodes"] for r in report)
    assert sum(r["met"] - r["kept"] for r in report) > 0
    assert report[-1]["kept"] < 0.5 * report[-1]["nodes"] * (report[-1]["nodes"] + 1) / 2  # of all pairs of leaves
    leaves = simhash.leaves_of(df, 16).orderBy("node").collect()
    listed = np.concatenate([np.frombuffer(r["codes"], np.int64) for r in leaves]).view(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        listed = listed ^ (listed >> np.uint64(shift))
    assert (np.diff(listed.astype(object)) > 0).all() and len(listed) == len(codes)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are absent")
def test_tree_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    codes = simhash.materialize(simhash.fingerprints(docs, "text").distinct(), "codes")
    report: list = []
    links = [tuple(r) for r in simhash.near_links(codes, 2, report=report).collect()]
    listed = np.array(sorted(r[0] for r in codes.collect()), np.int64)
    assert linked(links) == linked(near_pairs(listed, 2))
    print("nodes and pairs of nodes on sf0.1:", report)
    assert sum(r["nodes"] for r in report) > 40 and sum(r["met"] - r["kept"] for r in report) > 100


# --- mixing -----------------------------------------------------------------------------------------------------------


def water_level(sizes: dict, weights=(3, 1, 2), ratio=1.5, passes=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = {}, ratio * sum(sizes.values()), set(order)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > passes * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: float(passes * sizes[s]) for s in full}
        rest -= sum(passes * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_targets_and_takes(spark):
    rng = random.Random(3)
    sources = ["a"] * 9 + ["b", "c", "d", "é", "Z", None]
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(sources), 0) for i in range(900)] + awkward()
    sizes, size_of = Counter(), {}
    for i, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    target = water_level(sizes)
    df = frame(spark, rows).repartition(5)
    rows_in = df.select(F.col("doc_id").alias("id"), F.lit(0).alias("key"), "source", mixing.word_count(df["text"]).alias("size"))
    out = mixing.plan(rows_in).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    largest = max(len(words(r[1])) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest if s == "s9" else abs(taken[s] - target[s]) <= 130 for s in sizes if s != "s9")
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.plan(rows_in.repartition(3)).collect()
    assert plain(again) == plain(out)


def test_mix_repeats_documents(spark):
    rows = awkward()
    mixed = mixing.mix(frame(spark, rows, clashes=True))
    counts = Counter(tuple(r)[:5] for r in mixed.collect())
    assert set(counts) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in counts.items())
    taken, total = sum(n * len(words(r[1])) for r, n in counts.items()), sum(len(words(r[1])) for r in rows)
    assert taken <= 1.5 * total
    assert mixing.mix(frame(spark, [])).count() == 0
    with_map = frame(spark, rows).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    assert mixing.mix(with_map).count() == sum(counts.values())
    alone = Counter(map(tuple, mixing.mix(frame(spark, rows)).collect()))
    assert alone == counts  # other columns change neither the order nor the cut


# --- packing ----------------------------------------------------------------------------------------------------------


def check_packed(pieces: list[tuple[int, int, int]], capacity: int) -> int:
    """Pieces ``(sequence, offset, length)`` lie gapless from 0; returns the number of sequences."""
    held = defaultdict(list)
    for sequence, offset, length in pieces:
        held[sequence].append((offset, length))
    for members in held.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 97, 2048])
    counts = {size: rng.randint(0, 30) for size in rng.sample(range(1, capacity + 1), min(capacity, 60))}
    runs = packing.plan(counts, capacity)
    placed, used = [], Counter()
    for size, rank, n, first, per, offset in runs:
        assert rank == used[size]
        used[size] += n
        placed += [(first + i // per, offset + i % per * size, size) for i in range(n)]
    assert used == Counter({s: n for s, n in counts.items() if n})
    sequences = check_packed(placed, capacity)
    large = Counter(s for s, _, size in placed if 3 * size > capacity)
    assert not large or max(large.values()) <= 2
    lower = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    assert sequences <= lower * 1.25 + 2


def test_pack_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = awkward() + [(400, "İstanbul ΣΑΣ ﬁ é <|endoftext|> don't x y\x1cz", "en", "s", 0)]
    literals = ["abc <|endoftext|> def", "<|startoftext|>a<|endoftext|>" * 3, "<|ENDOFTEXT|> x", "a<|endoftext|", "x<|endoftext|>y " + rows[0][1]]
    rows += [(410 + i, t, "en", "s", 0) for i, t in enumerate(literals)]
    expected = []
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((i, p, at, len(part), zlib.crc32(part.tobytes())))
    out = packing.digest(frame(spark, rows)).collect()
    assert plain(tuple(r)[:5] for r in out) == plain(expected)
    n = check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in out], 2048)
    assert n <= sum(e[3] for e in expected) // 2048 + 2
    assert packing.digest(frame(spark, [])).count() == 0


def test_pieces_hold_their_ids(spark):
    df = frame(spark, awkward())
    for r in packing.pieces(df, "text", F.col("doc_id"), with_ids=True, capacity=100).collect():
        assert len(r["ids"]) == 4 * r["length"] <= 400 and zlib.crc32(r["ids"]) == r["ids_crc32"]


# --- classifier -------------------------------------------------------------------------------------------------------


def corpus(n: int) -> tuple[list, list]:
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 80) if good else " ".join(f"{w}###" if i % 8 else "spam" for w in prose(i, 80).split())
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good)))
    return rows, labels


def test_classifier_learns_and_holds_out(spark):
    rows, labels = corpus(240)
    docs = frame(spark, rows + [(None, None, None, None, None), (900, "", "en", "s", 0), (5, *rows[5][1:])])
    given = spark.createDataFrame(labels + [(5, 1), (6, None), (7, 9), (None, 1)], "doc_id long, quality int")
    out = classifier.digest(docs, given).collect()
    assert len(out) == 243 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    held = [(r["score"], labels[r["doc_id"]][1]) for r in out if r["held_out"] and (r["doc_id"] or 900) < 900]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    # Labels of held-out rows change nothing.
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    other = classifier.digest(docs, spark.createDataFrame(turned, "doc_id long, quality int")).collect()
    same = classifier.digest(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert plain((r["doc_id"], round(r["score"], 9)) for r in other) == plain((r["doc_id"], round(r["score"], 9)) for r in same)


def test_classifier_without_labels(spark):
    docs, none = frame(spark, awkward()), spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in classifier.digest(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert min(r["score"] for r in classifier.digest(docs, one).collect()) > 0.9
    assert classifier.digest(frame(spark, []), one).count() == 0


def test_isotonic_pooling():
    y, n = np.array([0.0, 2, 1, 0, 3, 4]), np.array([1.0, 2, 2, 1, 4, 4])
    level = classifier.pool(y, n)
    assert (np.diff(level) >= -1e-12).all() and level @ n == pytest.approx(y.sum())
    assert level.tolist() == pytest.approx([0, 0.6, 0.6, 0.6, 0.75, 1])


def test_schema_of_documents_is_the_tables(spark):
    assert frame(spark, []).schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
