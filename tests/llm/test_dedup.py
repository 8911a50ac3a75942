import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import DOCS, UPPER, groups, jaccard80, odd_documents, shingles, words
from tremora.llm import embedding_dedup, line_dedup, near_dedup
from tremora.llm.common import Words, components, shingle_sets


def test_words_and_shingles_match_the_pattern():
    texts = ["Hello World\nfoo", None, "", "  a b\x0bCé ", "x", "x\u00a0y hello", "\x1f", "Z" * 5000]
    w = Words(pa.array(texts))
    assert [w.text(i) for i in range(len(w.start))] == [x for t in texts for x in words(t)]
    assert w.count.tolist() == [len(words(t)) for t in texts]
    row, _ = shingle_sets(Words(pa.array(["a b a b", "a b", None, "q", "A B"])), 2)
    assert np.bincount(row, minlength=5).tolist() == [2, 1, 0, 1, 1]
    row, h = shingle_sets(Words(pa.array(["a b", "A b", "b a"])), 2)
    assert h[0] == h[1] != h[2]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(150, 160)] + [(5, 5), (9, 8)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 150 for i in [*range(150, 160), 200]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def mutated(rng, base, share):
    w = base.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"w{rng.randrange(10_000)}"
    return " ".join(w)


@pytest.mark.parametrize("n", [2, 5])
def test_near_groups_match_brute_force(spark, n):
    rng = random.Random(n)
    bases = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 80))) for _ in range(12)]
    docs = [(i, mutated(rng, rng.choice(bases), rng.choice([0, 0.02, 0.04, 0.06])), "en", "s", 1) for i in range(120)]
    got = {r["doc_id"]: r for r in near_dedup.near_groups(spark.createDataFrame(docs, DOCS), n=n).collect()}
    sets = {d[0]: shingles(d[1], n) for d in docs}
    want = groups(sorted(sets), lambda a, b: jaccard80(sets[a], sets[b]))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (want[k] == k) for k, r in got.items())


def test_near_groups_on_odd_rows(spark):
    rows = near_dedup.near_groups(odd_documents(spark), n=5).collect()
    assert len(rows) == 14
    by = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(1, 1), (2, 1), (3, 1), (7, 1), (4, 4), (5, 5), (6, 6), (None, None)} <= by
    kept = near_dedup.one_of_each(odd_documents(spark))
    ids = sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 4, 5, 6, 8, 10, 11, 12]
    assert kept.columns == odd_documents(spark).columns
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).count() == 0


def line_set(line):
    k = line_dedup.SHINGLE
    return {line[i:i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


@pytest.mark.parametrize("small", [8, 1])
def test_lines_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    monkeypatch.setattr(line_dedup, "STAR_ROUNDS", 2 if small > 1 else 1)
    rng = random.Random(4)
    bases = [" ".join(f"word{rng.randrange(60)}" for _ in range(rng.randrange(2, 30))) for _ in range(15)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            line = rng.choice(bases)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1:]
            lines.append(rng.choice(["", "  "]) + line if rng.random() < 0.2 else line)
        docs.append((i, "\n".join(lines) if lines else None, "en", "s", 1))
    flat = [(d, n, x.strip().translate(UPPER)) for d, t, *_ in docs for n, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in flat})
    comp = groups(range(len(texts)), lambda a, b: jaccard80(line_set(texts[a]), line_set(texts[b])))
    of = {x: comp[i] for i, x in enumerate(texts)}
    first = {}
    for d, n, x in flat:
        first[of[x]] = min(first.get(of[x], (d, n)), (d, n))
    gone = {(d, n) for d, n, x in flat if first[of[x]] != (d, n)}
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    for r in got:
        text = docs[r["doc_id"]][1]
        n = len(text.split("\n")) if text is not None else 0
        assert (r["n_lines"], r["kept_lines"]) == (n, [i for i in range(n) if (r["doc_id"], i) not in gone])
        assert r["n_kept"] == len(r["kept_lines"])


def test_lines_at_the_threshold_are_found(spark):
    rng = random.Random(8)
    sizes = [n for n in range(10, 51) if n - n // 9 <= 0.85 * (n + n // 9)]
    lines = []
    for i in range(3_000):
        n = sizes[i % len(sizes)]
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + line_dedup.SHINGLE - 1))
        k = n // 9
        lines += [line, line[:-k] + "0" * k]
        assert 0.8 <= len(line_set(lines[-2]) & line_set(lines[-1])) / len(line_set(lines[-2]) | line_set(lines[-1])) <= 0.85
    docs = [(i, x, "en", "s", 1) for i, x in enumerate(lines)]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert [i for i in range(0, len(lines), 2) if (got[i], got[i + 1]) != (1, 0)] == []


def test_lines_on_odd_rows(spark):
    df = odd_documents(spark)
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == 14
    by = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in rows}
    assert by[1] == (1, 1) and by[2] == (1, 0) and by[4] == (0, 0) and by[5] == (1, 1) and by[6] == (2, 2) and by[9] == (401, 1)
    cut = line_dedup.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == 14
    texts = {r["doc_id"]: r["text"] for r in cut.select("doc_id", "text").collect()}
    assert texts[2] == "" and texts[4] is None and texts[9] == "" and len(texts[8]) == 200_000
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_plan_has_no_python(spark):
    plan = line_dedup.dedup_lines(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(15, 8))
    x = (base[rng.integers(0, 15, 200)] + rng.normal(scale=0.17, size=(200, 8))).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [1.0] * 7, 1), (304, [], 1),
             (305, [1.0, None], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, (x[50] * 7).tolist(), 1), (309, [0.95, 0.0], 2), (None, [1.0, 2.0], 3)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {i: np.asarray(v, np.float32).astype(float) for i, v, _ in rows if i is not None and i not in (300, 301, 302, 303, 304, 305)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}

    def linked(a, b):
        return a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95

    ids = sorted(i for i, _, _ in rows if i is not None)
    want = groups(ids, linked)
    for i in ids:
        assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
        assert got[i]["n_links"] == sum(linked(i, j) for j in ids if j != i)
    assert got[None]["kept"] and got[None]["n_links"] == 0
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cosine_is_compared_exactly_at_the_threshold():
    assert embedding_dedup.at_least([3.0, 4.0], [3.0, 4.0], 1.0)
    assert not embedding_dedup.at_least([1.0, 0.0], [-1.0, 0.0], 0.95)
    assert embedding_dedup.at_least([4.0, 3.0], [1.0, 0.0], 0.8) and not embedding_dedup.at_least([4.0, 3.000001], [1.0, 0.0], 0.8)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(i, mutated(rng, base, rng.choice([0.02, 0.05, 0.08])), "en", "s", 1) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(docs, DOCS), n=2).collect()}
    sets = {d[0]: shingles(d[1], 2) for d in docs}
    want = groups(sorted(sets), lambda a, b: jaccard80(sets[a], sets[b]))
    assert got == want and 3 < len(set(want.values())) < 55


def test_texts_not_sets_of_lines_travel(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 300))) for _ in range(40)] + ["abc", "zzzzzzzzzzzzzzzzzzzzzzz"]
    texts += [t[:-2] + "0" for t in texts] + ["é" * 14 + t for t in texts[:8]]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, norm string")
    shared = line_dedup.shared_texts(lines.groupBy("line_id").agg({"norm": "max"}).withColumnRenamed("max(norm)", "norm"))
    sets = [line_set(t) for t in texts]
    assert {r["line_id"]: (r["norm"], r["n"]) for r in shared.collect()} == {i: (t, len(sets[i])) for i, t in enumerate(texts)}
    shuffled = shared._jdf.queryExecution().optimizedPlan().toString() + line_dedup.near_pairs(lines.selectExpr("line_id AS a", "line_id AS b"), shared, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in shuffled and "collect" not in shuffled
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    got = line_dedup.near_pairs(spark.createDataFrame(pairs, "a long, b long"), shared, 80).collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a, b in pairs if jaccard80(sets[a], sets[b])}


def test_shuffle_files_go_with_their_stage(spark):
    from tremora.llm import common

    at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, was = at.getAllFiles().size(), spark.conf.get(common.RELEASE, None)
    common.stage(spark.range(5_000).groupBy("id").count(), "release")
    for _ in range(50):
        if at.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert at.getAllFiles().size() <= before and spark.conf.get(common.RELEASE, None) == was


def test_a_vector_goes_once_to_a_block_however_many_cells_it_visits(spark):
    rng = np.random.default_rng(5)
    x = embedding_dedup.unit(rng.normal(size=(4_000, 16)))
    c = embedding_dedup.unit(rng.normal(size=(300, 16)))
    home, row, cell = embedding_dedup.cells_of(x, c, 0.95)
    assert len(row) > 20 * len(x)  # cells that prune little
    counts = np.bincount(home, minlength=300)
    first, parts, top = embedding_dedup.layout(counts, 500, 0)
    assert (parts[counts == 0] == 0).all() and (parts[counts > 0] >= 1).all() and top <= 17
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000), pa.int64()), pa.array([1] * 4_000, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))],
                                       ["rep", "copies", "embedding"])
    rows = [r for b in embedding_dedup.dealt([batch], c, first, parts, 0.95) for r in b.to_pylist()]
    assert max(b.num_rows for b in embedding_dedup.dealt([batch], c, first, parts, 0.95)) * 300 <= embedding_dedup.ASSIGNED
    assert len(rows) == 4_000 and all(len(r["visits"]) < top for r in rows)
    got = {(r["rep"], k) for r in rows for k in [*r["inner"], *(k for v in r["visits"] for k in v["cells"])]}
    assert got == {(i, k) for i, k in zip(row.tolist(), cell.tolist()) if counts[k]}
    first, parts, _ = embedding_dedup.layout(np.array([700, 0, 3, 5]), 300, 7)
    assert first.tolist() == [7, -1, 10, 10] and parts.tolist() == [3, 0, 1, 1]


def test_products_close_to_the_threshold_are_made_again():
    raw = np.array([[4.0, 3.0], [1.0, 0.0], [4.0, 3.000001], [8.0, 6.0], [4.0, 2.999999]])
    links = embedding_dedup.Links(raw, np.array([1, 5, 1, 1, 1]), 0.8)
    links.meet(np.array([0, 2, 4]), np.array([1]))
    assert links.n.tolist() == [5, 2, 0, 0, 5] and links.label[0] == links.label[1] == links.label[4] != links.label[2]
    links.meet(np.array([0, 3]), np.array([0, 3]), same=True)
    assert links.n.tolist() == [6, 2, 0, 1, 5]
