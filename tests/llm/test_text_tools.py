import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import DOCS, jaccard80, odd_documents, shingles
from tremora.llm import chat, decontaminate, packing, token_codes, url_rules

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def slow_best_fit(length, source, cluster, capacity):
    bins, out = [], []
    for n, s, c in zip(length, source, cluster):
        fits = [(b["left"] - n, i) for i, b in enumerate(bins) if b["left"] >= n and b["left"] > 0
                and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(1)
    for size in (0, 1, 40, 300):
        items = sorted(((rng.randrange(1, 101), rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(30)])) for _ in range(size)), key=lambda t: -t[0])
        args = [list(c) for c in zip(*items)] if items else [[], [], []]
        assert packing.best_fit(*args, 100) == slow_best_fit(*args, 100)


def test_packing_keeps_every_token_and_no_conflict(spark):
    rows = packing.pack(odd_documents(spark), capacity=64, shard_rows=5).collect()
    bins = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
        assert r["n_tokens"] <= 64
    assert all(sum(r["n_tokens"] for r in b) == b[0]["bin_tokens"] <= 64 for b in bins.values())
    docs = odd_documents(spark).collect()
    source = {r["doc_id"]: r["source"] for r in docs}
    for b in bins.values():
        own = [source[r["doc_id"]] for r in b if source[r["doc_id"]] is not None]
        assert len(own) == len(set(own))
    total = {}
    for r in rows:
        total[(r["doc_id"], r["copy"])] = total.get((r["doc_id"], r["copy"]), 0) + r["n_tokens"]
    assert len(total) == 14 and total[(7, 0)] == total[(7, 1)] == total[(1, 0)] and total[(4, 0)] == 1 and total[(8, 0)] == 2
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_counts_as_the_library_does():
    rng = random.Random(12)
    parts = ["word", " ", "  ", "\n", "é", "\u00a0", "日本", "12", "'s", "!?", "<s>", "</s>", "\U0001F600", "x" * 3_000, " " * 3_000]
    texts = ["", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]]
    count = packing.Counter(TOKENIZER)
    assert count(texts) == [len(count.library.whole(t)) // 4 for t in texts]
    assert any(map(count.plain, texts)) and not all(map(count.plain, texts))


def test_groups_that_share_a_repeated_key_are_one_cluster(spark):
    rows = [(1, 1), (2, 1), (2, 5), (5, 5), (6, 5), (7, 7), (8, 7)]
    got = {r["id"]: r["label"] for r in packing.clusters_of(spark.createDataFrame(rows, "doc_id long, component_id long")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7}


def test_packing_counts_token_ids(spark):
    docs = odd_documents(spark, [(14, "日本語のとても長い文" * 300, "ja", "s3", 1)])
    tool = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: len(tool.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    rows = packing.pack(docs, tokenizer=TOKENIZER).collect()
    total, pieces = {}, {}
    for r in rows:
        assert r["n_tokens"] <= r["bin_tokens"] <= packing.CAPACITY
        total[(r["doc_id"], r["copy"])] = total.get((r["doc_id"], r["copy"]), 0) + r["n_tokens"]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + 1
    assert {k: n for (k, _), n in total.items()} == want and len(total) == 15
    assert pieces[8] > 1 and pieces[14] > 1
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer=TOKENIZER).count() == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    from tremora.llm import queries

    rng = random.Random(12)
    docs = []
    for g in range(6):
        base = [f"w{g}x{rng.randrange(500)}" for _ in range(60)]
        docs += [(10 * g + k, " ".join([*base, *(f"end{k}",)[:k]]), "en", f"s{g}_{k}", 1) for k in range(4)]
    docs += [(100, "Same text", "en", "a", 1), (101, "sameTEXT", "en", "b", 1), (None, "same text", "en", "c", 1)]
    docs.append((0, "another text of a repeated key", "en", "d", 1))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    group = [(r["shard"], r["bin"], -1 if r["doc_id"] is None or r["doc_id"] >= 100 else r["doc_id"] // 10) for r in rows]
    assert len(group) == len(set(group)) and len({g[:2] for g in group}) < len(group)


def slow_distance(pattern, text):
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for ch in text:
        nxt = [0]
        for i, p in enumerate(pattern):
            nxt.append(min(row[i] + (p != ch), row[i + 1] + 1, nxt[i] + 1))
        row, best = nxt, min(best, nxt[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_myers_matches_dynamic_programming(pattern, text):
    assert decontaminate.myers(pattern, text)[0] == slow_distance(pattern, text)


def test_matches_are_those_of_a_search_everywhere(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 40)))) for i in range(12)] + [(50, None), (51, "  "), (52, "!?"), (1, "given twice here as a second text of one id")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(60)]
        if i % 2:
            t = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, 10)):
                at = rng.randrange(len(t))
                t[at:at + 1] = rng.choice([[], ["z"], [t[at], "q"]])
            body[30:30] = ["".join(t).upper() if i % 3 else "".join(t).replace(" ", "\n ")]
        docs.append((i, " ".join(body), "en", "s", 1))
    test = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["distances"])) for r in decontaminate.contaminated(
        spark.createDataFrame(docs, DOCS), test, block_chars=500).collect()}
    plain = [(k, decontaminate.plain(t)) for k, t in items if t and decontaminate.plain(t) not in ("", "!?")]
    hits = 0
    for i, text, *_ in docs:
        flat, want = decontaminate.plain(text), {}
        for k, p in plain:
            d = slow_distance(p, flat)
            if d <= len(p) // decontaminate.CHARS_PER_EDIT:
                want[k] = min(d, want.get(k, d))
        assert got[i] == want
        hits += bool(want)
    assert 5 < hits < 40


def test_decontamination_on_odd_rows(spark):
    test = spark.createDataFrame([(1, "seventeen grey geese watch from a frozen pond"), (None, "fox"), (3, None)], "item_id long, text string")
    rows = decontaminate.contaminated(odd_documents(spark), test).collect()
    assert len(rows) == 14 and {r["doc_id"] for r in rows if not r["kept"]} == {1, 2, 3, 7, 9, None}
    kept = decontaminate.clean(odd_documents(spark), test)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 8, 10, 11, 12] and kept.columns == odd_documents(spark).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd_documents(spark), none).where("kept").count() == 14


CONTROL = st.lists(st.sampled_from([*"<>/s[]INT\\ aé\n:0", "</s>", "[INST]", "[/INST]", "<image:0>"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(CONTROL, CONTROL)
def test_turns_parse_back(role, text):
    piece = f"<s>[INST]{chat.escape(role)}[/INST]{chat.escape(text)}</s>"
    assert chat.parse(piece) == (role, text)
    assert all(c not in chat.escape(text).replace("\\<", "").replace("\\[", "") for c in ("</s>", "[INST]", "[/INST]"))


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <image:0> "), part("image", None, "u1", 28, 14), None, part("audio", None, "u2", s=2.0), part("document", ref="u3", p=2), part("video", "v")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chat(df).first()
    assert r["piece"] == "<s>[INST]user[/INST]see \\<image:0> <image:0><audio:1><document:2>(video)v</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "u1", 2), ("audio", "u2", 50), ("document", "u3", 1024)]
    body = r["piece"][r["body_start"]:r["body_end"]]
    assert [body[a["at"]:].startswith(f"<{a['kind']}:{a['number']}>") for a in r["attachments"]] == [True] * 3
    assert chat.parse(r["piece"]) == ("user", "see <image:0> (video)v")


def test_chat_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 3, "assistant", "é\U0001F600</s>"), (2, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "'p' AS parts")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_sha256"], got[1]["loss_chars"]) == (3, sha("user\na\nassistant\nb\nassistant\nb\n"), sha("bb"), 2)
    assert got[2]["turns_sha256"] == sha("\n\nassistant\n" + "x" * 300_000 + "\n") and got[None]["loss_chars"] == 6
    assert chat.digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_give_any_id(ids):
    ids = np.array(ids, np.uint32)
    f = token_codes.TokenFile(pa.BufferReader(token_codes.pack_file(ids, np.array([7]), np.array([False]), np.array([len(ids)]))))
    assert f.ids().tolist() == ids.tolist()
    assert [f.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()


def test_token_files_match_the_library(spark):
    extra = [(13, "<|endoftext|> <|endoftext|", "en", "s", 1), (14, "日本語 text\r\n\t  x", "en", "s", 1), (-5, "I'll don't 've  two", "en", "s", 1)]
    df = odd_documents(spark, extra)
    files, folder = token_codes.write_tokens(df, TOKENIZER, file_ids=500)
    got = token_codes.read_tokens(files, folder).orderBy("start").collect()
    tool = Tokenizer.from_file(TOKENIZER)
    docs = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    at = 0
    for r, (doc_id, text) in zip(got, docs, strict=True):
        ids = [*tool.encode(text, add_special_tokens=False).ids, token_codes.END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert files.count() > 1
    empty = spark.createDataFrame([], DOCS)
    assert token_codes.read_tokens(*token_codes.write_tokens(empty, TOKENIZER)).count() == 0


def test_url_rules_match_brute_force(spark):
    rng = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "org.com", "", "c.b.com", "EXAMPLE.org", "example.org:80"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12', '/fr/x', '/de/?q', '?a=/es/', '#f', '/es'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "x://y://z/es/", "http://\n/es/", "http://" + "a." * 3000 + "org/", "http://éa.example.org/es/é"]
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("b.com/de/", "block"), ("com/", "block")]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for block in (2, 100):
        got = {r["page_id"]: r for r in url_rules.judge(df, rules, "page_id", block=block).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
            fits = [(len(r), r, v) for r, v in rules for h, p in [url_rules.split_rule(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
            rule, verdict = max(fits)[1:] if fits else (None, "allow")
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert url_rules.judge(df.limit(0), rules, "page_id").count() == 0 and url_rules.judge(df, [], "page_id").where("rule IS NULL").count() == len(urls)


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    for name in ("language_id", "line_dedup"):
        docs = steps[name](spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = steps["minhash_near_dedup"](spark, docs, "/root/testdata/sf0.001")
    assert after.columns == columns
    kept = {r["doc_id"] for r in after.collect()}
    sets = {i: shingles(t, 5) for i, t in before.items()}
    from tests.llm.helpers import groups
    want = groups(sorted(sets), lambda a, b: jaccard80(sets[a], sets[b]))
    assert kept == {i for i, c in want.items() if i == c}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    empty = spark.createDataFrame([], docs.schema)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0


def test_full_word_store_keeps_words_met_again(monkeypatch):
    """Words of two batches stay when the store is full, words of one leave, and ids are those of the library."""
    monkeypatch.setattr(token_codes, "CACHE_WORDS", 5)
    encode = token_codes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode.known.clear(), encode.again.clear()
    batches = [["a river bends here"], ["the river bends again, twice"], ["a calm lake\nand river", "one  gap here"]]
    for texts in batches:
        assert encode(texts) == [encode.whole(t) for t in texts]
    assert {"river", "bends"} <= encode.known.keys() and "again," not in encode.known
    encode.known.clear(), encode.again.clear()


def test_encoder_looks_up_distinct_words_of_a_batch():
    encode = token_codes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []

    class Store(dict):
        def get(self, w, *other):
            asked.append(w)
            return dict.get(self, w, *other)

        def __getitem__(self, w):
            asked.append(w)
            return dict.__getitem__(self, w)

    encode.known = Store()
    texts = ["the river and the lake " * 200, " a lead\nline", "", "one", "café \U0001f600 end ", "two  gaps", "the river"]
    assert encode(texts) == [encode.whole(t) for t in texts]
    assert len(asked) < 40  # the words of the first text number 1,001
