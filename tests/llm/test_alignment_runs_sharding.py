import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, WORD, odd_documents
from tremora.llm import alignment, queries, runs, sharding

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


# periodic runs

def test_grouping_yields_the_longest_lyndon_word_of_every_place():
    rng = random.Random(3)
    for _ in range(150):
        strings = [[rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 6))]
        want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for s in strings for i in range(len(s))]
        row = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        assert runs.lyndon_array(np.array(sum(strings, [])), row).tolist() == want


def slow_runs(w, length, exponent):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > a and i + q - a >= max(length, exponent * q):
                found.append((a, i + q - a, q))
            i += 1
    return sorted(r for r in found if not any(q < r[2] and a <= r[0] and a + n >= r[0] + r[1] for a, n, q in found))


def rows_with_periods(rng):
    for _ in range(rng.randrange(1, 5)):
        w = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(0, 25))]
        u = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
        yield w[:10] + u * rng.randrange(0, 7) + w[10:] + u[:2] * rng.randrange(0, 5)


@pytest.mark.parametrize("collide", [False, True])
def test_runs_match_brute_force(monkeypatch, collide):
    if collide:  # every block has one hash: only the comparison of words decides
        monkeypatch.setattr(runs.Extensions, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    rng = random.Random(4)
    for _ in range(150):
        rows = list(rows_with_periods(rng))
        for length, exponent in ((6, 4),) if collide else ((6, 4), (2, 2), (4, 3)):
            count = [len(r) for r in rows]
            row, begin = np.repeat(np.arange(len(rows)), count), np.cumsum(count) - count
            got = zip(*runs.runs_of(np.array(sum(rows, []), np.int64), row, length, exponent))
            want = [(r, *x) for r, w in enumerate(rows) for x in slow_runs(w, length, exponent)]
            got = [(int(row[s]), int(s - begin[row[s]]), int(n), int(q)) for s, n, q in got]
            assert got == want
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(3, np.int64), np.zeros(3, np.int64), 2, 1)


def test_word_runs_on_odd_documents(spark):
    extra = [(20, "a b " * 500 + "c", "en", "s", 1), (21, "x  x  x  x  x  x ", "en", "s", 1), (22, "Ab ab " * 3, "en", "s", 1)]
    docs = odd_documents(spark, extra)
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.word_runs(docs).collect()), key=str)
    want = []
    for d in docs.collect():
        w = WORD.findall(d["text"] or "")
        if len(w) > 2000:  # the long text repeats its words 400 times
            found = [(0, len(w), len(w) // 400)]
        else:
            found = slow_runs(w, 6, 4)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((d["doc_id"], found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert dict((k, c) for k, _, c in got)[20] == "a b c"
    assert runs.word_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_run_query_digests(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 60)), "en", "s", 1) for i in range(300)] + [(None, "a " * 9, None, None, 1), (400, None, None, None, 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12(spark, str(tmp_path)).collect()}
    changed = 0
    for key, text, *_ in rows:
        w = (text or "").split()
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            changed += 1
        found = slow_runs(w, 6, 4)
        r = got[key]
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        if found:
            s, n, q = min(found, key=lambda t: (-t[1] / t[2], t[0], t[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
    assert changed > 10


# sharding

def test_one_shard_more_takes_rows_only_into_itself(spark):
    ids = spark.range(1500).selectExpr("id AS doc_id")
    for weights in (None, [2, 1, 0.5, 0, 3, 1, 1, 1, 4]):
        before = None
        for n in range(1, 14) if weights else range(6, 9):
            now = dict(sharding.assign(ids, n, weights=weights, racks=2, width=3).collect())
            if before:
                moved = Counter(now[k] for k in now if now[k] != before[k])
                assert set(moved) <= {n - 1}
                w = (weights or []) + [1.0] * 20
                assert abs(sum(moved.values()) - 1500 * w[n - 1] / sum(w[:n])) < 90
            before = now


def test_shares_follow_weights_and_changes_stay_in_their_subtree(spark):
    ids = spark.range(4000).selectExpr("id AS doc_id")
    weights = [1.0] * 12
    before = dict(sharding.assign(ids, 12, weights=weights, racks=2, width=2).collect())
    heavier = list(weights)
    heavier[5] = 3.0  # rack 2 of region 1
    after = dict(sharding.assign(ids, 12, weights=heavier, racks=2, width=2).collect())
    share = Counter(after.values())
    assert abs(share[5] - 4000 * 3 / 14) < 120 and all(abs(share[s] - 4000 / 14) < 90 for s in range(12) if s != 5)
    for k in before:
        if before[k] != after[k]:
            assert after[k] // 4 == 1  # into the region that grew
            if before[k] // 4 == 1:
                assert after[k] // 2 == 2 and (before[k] // 2 != 2 or after[k] == 5)
    for bad in (dict(n=0), dict(n=2, weights=[0, 0]), dict(n=2, weights=[-1])):
        with pytest.raises(ValueError):
            sharding.assign(ids, **bad)


def test_sharded_rows_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark, [(7, None, "en", "s1", 10)] * 30).withColumnRenamed("bucket", "shard")
    got = sharding.sharded(docs, 6, racks=1, width=2).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (d["doc_id"] or -1, 16 + len((d["text"] or "").encode()), zlib.crc32((d["text"] or "").encode())) for d in docs.collect())
    for s, n in Counter(r["shard"] for r in got).items():
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(n))
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in mine]
        assert keys == sorted(keys)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1 and all(r["grown_shard"] in (r["shard"], 6) and r["law"] == "key" for r in got)
    assert sharding.sharded(spark.createDataFrame([], DOCS), 6).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 6, racks=1, width=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r["shard_"] for r in back.collect()) == Counter(r["shard"] for r in got) and set(docs.columns) < set(back.columns)


def test_sharding_stays_in_the_jvm(spark):
    plan = queries.op13(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# alignment

def slow_alignment(docs):
    a_tool, b_tool = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tool.encode_special_tokens = True
    letter, out, count = alignment.byte_of_letter(), [], Counter()
    for key, text in docs:
        row = (key, 0, 0, [], [])
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            ab = [bytes(letter[c] for c in a_tool.id_to_token(i)) for i in a]
            bb = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                groups, i, j, x, y = [], 0, 0, 0, 0
                while i < len(a):
                    groups.append(([a[i]], [b[j]]))
                    x, y, i, j = x + len(ab[i]), y + len(bb[j]), i + 1, j + 1
                    while x != y:
                        if x < y:
                            groups[-1][0].append(a[i])
                            x, i = x + len(ab[i]), i + 1
                        else:
                            groups[-1][1].append(b[j])
                            y, j = y + len(bb[j]), j + 1
                links = [(p, q) for s, t in groups for p in s for q in t]
                count.update(set(links))
                row = (key, len(a), len(b), groups, links)
        out.append(row)
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    return [(k, a, b, len(g), len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls),
             ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in g)) for k, a, b, g, ls in out]


@pytest.mark.parametrize("chunk, block", [(2 << 20, 2_000_000), (3_000, 200)])
def test_alignment_matches_brute_force(spark, monkeypatch, chunk, block):
    texts = ["a  b\n\n\n  c", "▁x", "<0x41> <|endoftext|> <s> </s>", "café 漢字漢 \U0001F600\U0001F600", "ﬁ ½", "\U0001F600" * 50,
             "漢字" * 70, "\x00 a\x07", " " * 300, "aé " * 20, "aé " * 20]
    docs = odd_documents(spark, [(30 + i, t, "en", "s", 1) for i, t in enumerate(texts)])
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.unionByName(some, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(slow_alignment(rows), key=str)
    if chunk < 2 << 20:  # chunks and blocks cut everywhere, in this process
        monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(alignment, "BLOCK_LINKS", block)
    got = alignment.rate(alignment.align(docs, A, B)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert alignment.rate(alignment.align(spark.createDataFrame([], DOCS), A, B)).count() == 0


def test_byte_pair_ids_equal_the_tokenizer_file():
    tool, other = alignment.Tokens(A, B), Tokenizer.from_file(A)
    other.encode_special_tokens = True
    letters = [chr(i) for i in range(0x3400) if not 0xD800 <= i < 0xE000]
    texts = [f" {a}{b}x {a}  {b}\n{a}{a}1{b}" for a, b in zip(letters, letters[7:] + letters[:7])]
    texts += [" " + t for t in ("<|endoftext|> it's  we'll\t\n \r\n x", "x" * 5000, " " * 999, "\U0001F600" * 300, "漢字かな" * 200, "a\u00a0b\u2003 c\u3000")]
    assert [tool.a.encode_ordinary(t) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        alignment.Tokens(public.path("word_bpe_49k.json"), B)
