"""Joins of near duplicates against brute force, edge cases included."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import chroma, embedding_dedup, jaccard_join
from tarn.llm import common as C

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def groups(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def shingle_set(text):
    words = _WORD.findall((text or "").encode().translate(_LOWER).decode())
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_jaccard(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = groups(len(rows), links)
    out = []
    for i, (k, _) in enumerate(rows):
        own = [r[0] for r, g in zip(rows, label, strict=True) if g == label[i] and r[0] is not None]
        out.append((k, len(sets[i]), min(own) if own else None))
    return sorted(out, key=repr)


def texts(seed=1, n=140):
    """Chains of ever more changed copies, copies of several lengths, common passages, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    out = ["", None, " \n\t", "one", "One", "one two three four", "ONE two three\tfour", "a b c d e", "é ß É", "x " * 3000, "x " * 50]
    for _ in range(n // 10):
        words = [word() for _ in range(rng.choice([6, 12, 40, 200, 700]))]
        for _ in range(6):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([12, 30, 60]))):
                words[rng.randrange(len(words))] = word()
        out.append(passage + " " + " ".join(words[: len(words) // 3]))
        out.append(" ".join(words).upper())
    return out


@pytest.mark.parametrize(("region_bytes", "hot"), [(jaccard_join.REGION_BYTES, 20), (20_000, 2), (4_000, 5)])
def test_jaccard_join(spark, monkeypatch, region_bytes, hot):
    """hot: how many documents make a shingle travel apart."""
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", hot)
    monkeypatch.setattr(jaccard_join, "HOT_PART", 0.001)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts())] + [(None, "one"), (None, "lonely words that nobody else has at all"), (1000, "a b c d e"), (1000, "a b c d e")]
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, key int, comp string")
    got = jaccard_join.join_ngrams(df, region_bytes=region_bytes).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_jaccard(rows)


def star(rng, n, words, edits):
    """A base text and copies with edits of their own: each links to the base, few to each other."""
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(rng.randint(3, 7)))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(words), edits):
            copy[k] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("rounds", "depth"), [(0, 6), (1, 0), (0, 1), (2, 6)])
def test_jaccard_join_of_large_regions(spark, monkeypatch, rounds, depth):
    """One region of many components: by cells of pivots, and by pairs of blocks where cells are cut no further."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    monkeypatch.setattr(jaccard_join._join_regions, "__defaults__", (depth,))
    rng = random.Random(9)
    out = star(rng, 30, 120, 3) + star(rng, 12, 60, 2)
    shared = " ".join(f"p{k}" for k in range(60))
    out += [shared + " " + " ".join(f"q{rng.randrange(9)}x{k}" for k in range(rng.randrange(8, 30))) for _ in range(60)]
    out += [t + " tail" for t in out[::3]]
    rows = list(enumerate(out))
    got = jaccard_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), region_bytes=6_000)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_jaccard(rows)


def test_cells_hold_both_sides_of_every_link():
    """The windows of the triangle inequality against all links of random sets."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        base = [rng.choice(400, 60, replace=False) for _ in range(5)]
        sets = []
        for k in range(70):
            x = base[k % 5].copy()
            x[: int(rng.integers(0, 25))] = rng.integers(0, 400)
            sets.append(np.unique(np.append(x, rng.integers(0, 400, int(rng.integers(0, 12))))).astype(np.uint64))
        sizes = np.array([len(x) for x in sets])
        p = rng.choice(70, 6, replace=False)
        near, among, far = jaccard_join.cells_of(jaccard_join._overlaps(sets, [sets[i] for i in p]), sizes, sizes[p], 80)
        for i in range(70):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                linked = 100 * both >= 80 * (sizes[i] + sizes[j] - both)
                if i in p or j in p:
                    q, o = (i, j) if i in p else (j, i)
                    assert near[o, list(p).index(q)] == linked
                elif linked:
                    assert (among[i] & among[j]).any() or (far[i] and far[j])


def test_colliding_words_do_not_link(spark):
    """Two Thue-Morse words and their texts have nothing in common."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    rows = [(1, a), (2, b), (3, f"{a} {a} {b} {a} {b} {b}"), (4, f"{b} {b} {a} {b} {a} {a}")]
    got = jaccard_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in got) == [(1, 1, 1, 1), (2, 1, 2, 2), (3, 2, 3, 3), (4, 2, 4, 4)]


def test_jaccard_join_random_pairs_at_the_border():
    """Pairs just above and below the threshold, without Spark."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        sets = [np.unique(rng.integers(0, 30, n).astype(np.uint64)) for _ in range(12)]
        sets += [np.unique(np.append(s[: max(1, len(s) - int(rng.integers(0, 3)))], rng.integers(30, 40))) for s in sets]
        sizes = np.array([len(s) for s in sets])
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        got = jaccard_join.pivot_join(sets, sizes, 80)
        want = groups(len(sets), links)
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, None, None), (4, "", "x"), (None, "a b c d e f", "z"), (5, "q", "x"), (5, "q", "x")]
    out = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _nth string"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[2], rows[3], rows[4], rows[5]], key=repr)
    assert out.columns == ["doc_id", "text", "_nth"]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    """Unrelated texts under one id are both kept, copies are not, and a copy of another component's text goes."""
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "a b c d e f g"), (5, "q r s t u v w"), (5, "Q r s t u v w"), (2, near), (5, near + " end"), (7, near), (7, "x y z"), (7, ""), (7, ""), (7, None), (None, near)]
    got = sorted(map(tuple, jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(5, "a b c d e f g"), (5, "Q r s t u v w"), (2, near), (7, "x y z"), (7, ""), (7, None), (None, near)]
    assert got == sorted(want, key=repr)


def test_empty_tables(spark):
    assert jaccard_join.join_ngrams(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embedding_dedup.join_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    prints = chroma.fingerprints(spark.createDataFrame([], "vec_id long, audio binary"), "vec_id", "audio")
    assert chroma.align(prints, F.col("id") % 50 == 0).count() == 0


def test_few_classes_are_dealt(spark, monkeypatch):
    """Only classes that share a leading shingle are dealt whole: here near copies, and texts that a common passage leads."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(400)]
    near = [t + " end" for t in texts[:20]]
    passage = " ".join(word() for _ in range(40))
    common = [f"{passage} {word()}" if k % 2 else f"{passage} {' '.join(word() for _ in range(30))}" for k in range(60)]
    rows = list(enumerate(texts + near + near[:5] + common + ["", None, "a b", "A  b", "a b c"]))
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 10)
    made, masks = jaccard_join._mask, []
    monkeypatch.setattr(jaccard_join, "_mask", lambda *a: masks.append(made(*a)) or masks[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_ngrams(df).collect())
    assert got == sorted(brute_jaccard(rows))
    assert 40 <= int(np.bitwise_count(masks[0]).sum()) <= 110


def brute_cosine(rows, least=0.9):
    unit = []
    for _, v in rows:
        x = None if not v or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        unit.append(x / np.linalg.norm(x) if x is not None and np.isfinite(x).all() and x.any() else None)
    near = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    links = [(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)]
    label, count = groups(len(rows), links), [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return sorted((rows[i][0], count[i], min(r[0] for r, g in zip(rows, label, strict=True) if g == label[i])) for i in range(len(rows)))


@pytest.mark.parametrize("options", [{}, {"interval": 16, "lead": 2}])
def test_embeddings(spark, options):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(9, 5))
    vectors = [(base[rng.integers(9)] + rng.normal(size=5) * 0.3).astype(np.float32).tolist() for _ in range(260)]
    vectors += [vectors[0]] * 20 + [[2 * x for x in vectors[1]], None, [0.0] * 5, [float("nan")] * 5, [float("inf")] * 5, [1.0, None, 2.0, 3.0, 4.0], [], [1.0, 2.0], [1.0, 2.1], [-0.0, 1.0], [0.0, 1.0]]
    rows = list(enumerate(vectors)) + [(5, vectors[5])]
    df = spark.createDataFrame([(k, v, k) for k, v in rows], "vec_id long, embedding array<float>, cid int")
    got = embedding_dedup.join_embeddings(df, **options).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_cosine(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    monkeypatch.setattr(C, "HUBS", 20)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 240)] + [(7, 7)]
    got = {r.node: r.comp for r in C.connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    nodes = sorted({x for e in edges for x in e})
    label = groups(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges])
    for i, k in enumerate(nodes):
        assert got.get(k, k) == nodes[label[i]]


def test_components_of_a_small_graph_take_few_jobs(spark):
    """Each shuffle leaves the driver a thread for a minute: this path took 67 jobs before."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("small-components", "test")
    try:
        got = C.connected_components(edges, "test").agg(F.count("*"), F.max("comp")).first()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("small-components")
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)
    assert tuple(got) == (301, 0) and len(jobs) <= 12
    assert C.connected_components(edges.where("a < 0"), "test").collect() == []


def test_small_tables_are_few_files(spark, tmp_path):
    """A table of many small partitions had a file for each."""
    many, path = spark.range(0, 20_000, 1, 64), str(tmp_path / "many")
    many.write.parquet(path)
    kept = C.materialise(spark.read.parquet(path).repartition(40, "id"), "few")
    assert len(kept.inputFiles()) <= 12 and kept.agg(F.count("*"), F.sum("id")).first() == (20_000, 199_990_000)
    assert C.materialise(kept.where("id < 0"), "none").count() == 0


def test_components_of_arrays():
    rng = np.random.default_rng(5)
    for n, m in ((0, 0), (1, 2), (40, 30), (500, 2000), (4000, 3000)):
        a, b = rng.integers(-n, n + 1, (2, m))
        nodes, comp = C.components_of(a, b)
        at = {x: i for i, x in enumerate(nodes.tolist())}
        label = groups(len(nodes), [(at[x], at[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        assert sorted(at) == sorted({*a.tolist(), *b.tolist()}) and comp.tolist() == [int(nodes[k]) for k in label]


def test_chroma_alignment_of_few_prints(spark):
    """Recordings with fewer prints than VOTES align with their copies and with a longer recording that holds them."""
    some = np.arange(100, 120, dtype="<u4") * np.uint32(2654435761)
    blob = lambda x: bytearray(x.tobytes())
    rows = [(0, blob(some[5:8])), (1, blob(some[5:8])), (50, blob(some[:1] ^ 1)), (100, blob(some)), (150, bytearray())]
    got = {tuple(r) for r in chroma.align(spark.createDataFrame(rows, "id long, prints binary"), F.col("id") % 50 == 0).collect()}
    assert got == {(0, 0, 2, 0, 3, 0.0), (0, 100, 1, -5, 3, 0.0), (50, 50, 1, 0, 1, 0.0), (100, 100, 1, 0, 20, 0.0), (100, 0, 2, 5, 3, 0.0)}


def test_chroma_alignment_at_another_offset(spark):
    """The offset with most votes has too many different bits, another one with votes enough has few."""
    rng = np.random.default_rng(7)
    b = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    a = np.concatenate([b, rng.integers(0, 1 << 32, 120, dtype=np.uint32)])
    b[12:] ^= 1  # 12 equal prints at offset 0, the others with one different bit
    a[70:130:2] = b[::2]  # 30 equal ones at 70, amid random ones
    votes = chroma.offset_votes(a, b)
    want = [int((a[max(0, o) : min(len(a), len(b) + o)] == b[max(0, o) - o : min(len(a), len(b) + o) - o]).sum()) for o in range(1 - len(b), len(a))]
    assert votes.tolist() == want
    rows = [(0, bytearray(a.astype("<u4").tobytes())), (1, bytearray(b.astype("<u4").tobytes()))]
    df = spark.createDataFrame(rows, "id long, prints binary")
    got = {(r.id, r.match_id): r for r in chroma.align(df, F.col("id") == 0).collect()}
    r = got[0, 1]
    assert max(want) == 30 and chroma.bit_error(a, b, 70) > chroma.BIT_ERROR
    assert (r.offset, r.votes, r.bit_error) == (0, 12, chroma.bit_error(a, b, 0))


def test_chroma_alignment_of_runs(spark):
    """Recordings of long runs of few prints (silence, held notes): votes of every offset, against counting pairs of places."""
    rng = random.Random(6)
    make = lambda: np.array([x for _ in range(rng.randint(1, 6)) for x in [rng.choice([7, 7, 9, 4_000_000_000])] * rng.choice([1, 2, 5, 30])], "<u4")
    prints = {k: make() for k in range(24)}
    prints[24] = np.zeros(3_000, "<u4")
    prints[25] = np.zeros(2_000, "<u4")
    df = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in prints.items()], "id long, prints binary")
    got = {(r.id, r.match_id): (r.offset, r.votes) for r in chroma.align(df, F.col("id") % 6 == 0, most=1.0).collect()}
    first = {}
    for k, x in prints.items():
        first.setdefault(x.tobytes(), k)
    want = {}
    for q in range(0, 26, 6):
        for k in first.values():
            a, b = prints[q].astype(int), prints[k].astype(int)
            if len(a) * len(b) > 10**6:
                same = (a[0] == b[0]) * np.minimum(np.minimum(np.arange(1, len(a) + len(b)), len(b)), np.minimum(len(a), np.arange(len(a) + len(b) - 1, 0, -1)))
                count = {o - len(b) + 1: int(v) for o, v in enumerate(same)}
            else:
                x, y = np.nonzero(a[:, None] == b[None, :])
                count = dict(zip(*(v.tolist() for v in np.unique(x - y, return_counts=True)), strict=True))
            best = max(((v, -abs(o), o) for o, v in count.items()), default=(0, 0, 0))
            if best[0] >= min(chroma.VOTES, len(a), len(b)):
                want[q, k] = (best[2], best[0])
    assert got == want and got[24, 24] == (0, 3_000) and got[24, 25] == (0, 2_000)


def test_chroma_alignment_against_brute_force(spark):
    rng = np.random.default_rng(2)
    tone = lambda: (6000 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * np.arange(256) / chroma.RATE)).astype("<i2")
    songs = [np.concatenate([tone() for _ in range(40)]) for _ in range(8)]
    clips = [*songs, songs[0][128 * 6 :], np.concatenate([songs[1][128 * 10 : 128 * 50], songs[2][: 128 * 20]]), songs[3], np.zeros(9000, "<i2"), np.zeros(0, "<i2"), (songs[4] + rng.normal(0, 40, len(songs[4]))).astype("<i2")]
    audio = [bytearray(c.tobytes()) for c in clips] + [None, bytearray(b"\x01")]
    prints = chroma.fingerprints(spark.createDataFrame(list(enumerate(audio)), "vec_id long, audio binary"), "vec_id", "audio").cache()
    own = {r.id: np.frombuffer(bytes(r.prints), "<u4") for r in prints.collect()}
    got = {(r.id, r.match_id): (r.n_rows, r.offset, r.votes, round(r.bit_error, 9)) for r in chroma.align(prints, F.col("id") % 3 == 0).collect()}
    classes = {}
    for k in sorted(own):
        if len(own[k]):
            classes.setdefault(own[k].tobytes(), []).append(k)
    want = {}
    for q in (k for k in own if k % 3 == 0 and len(own[k])):
        for members in classes.values():
            a, b = own[q], own[members[0]]
            best = max(((int((a[max(0, o) : min(len(a), len(b) + o)] == b[max(0, o) - o : min(len(a), len(b) + o) - o]).sum()), -abs(o), o) for o in range(-len(b) + 1, len(a))), default=(0, 0, 0))
            if best[0] >= chroma.VOTES and (e := chroma.bit_error(a, b, best[2])) <= chroma.BIT_ERROR:
                want[q, members[0]] = (len(members), best[2], best[0], round(e, 9))
    assert got == want
    assert (0, 8) in want and want[0, 8][1] == 6 and want[3, 3][0] == 2
