"""Small-table tests of the text operators: brute force, exact round trips, defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postscope.llm import (decontaminate, jaccard_join, kd_shards, language_id, licenses, packing, repair_store,
                           substring_dedup, toxicity)
from postscope.llm.token_ids import TextIds
from postscope.session import scratch_path

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# clashing and extra columns that the operators must ignore
EXTRA = "rid long, words string, size int, cid long, n long"


def frame(spark, rows, more=""):
    """rows: (doc_id, text, ...)."""
    return spark.createDataFrame([(*r, *([7, "x", 3, 9, 1])) for r in rows], f"doc_id long, text string{more}, {EXTRA}")


def sentence(rng, words=60):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(words))


def text_words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(3, 300)) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[i]) for i in range(5)]                               # exact copies
    rows += [(200 + i, base[i + 5] + " tail words here") for i in range(5)]      # near copies
    rows += [(300 + i, sentence(rng, 50) + "\n" + base[20] + " " + base[21] + "\n" + sentence(rng, 50)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, "  \n "), (403, "one"), (404, "one"), (405, "a b c"), (406, "é" * 450),
             (407, "aé" * 300 + "é" * 450), (408, "x" * 1000), (None, base[7]), (3, base[3]), (409, "ab " * 4000)]
    return rows


# -- decontamination ---------------------------------------------------------

def contaminated_by_hand(docs, items):
    windows = {}
    for i, t in items:
        w = text_words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = text_words(t)
        hit, got = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    got |= windows[tuple(w[p:p + n])]
        out.append((d, len(w), len(hit), sorted(got)))
    return sorted(out, key=repr)


def test_contamination_brute_force(spark):
    rng = random.Random(1)
    items = [(i, sentence(rng, n)) for i, n in enumerate([13, 30, 5, 1, 12, 40, 13])] + [(7, None), (8, "!!"), (None, "zz yy xx")]
    docs = [(i, sentence(rng, 80)) for i in range(10)]
    docs += [(20, docs[0][1] + " " + items[0][1].upper() + " q"), (21, items[1][1]), (22, sentence(rng, 20) + ", " + items[2][1]),
             (23, " ".join(items[5][1].split()[3:15])), (24, " ".join(items[5][1].split()[3:16])), (25, items[3][1]),
             (26, None), (27, ""), (28, "zz yy xx"), (28, "zz yy xx"), (None, items[6][1] + " " + items[6][1])]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rid long")
    for bits in (26, 10):        # a full filter lets more candidates through, never fewer
        got = decontaminate.contamination(frame(spark, docs), bench, filter_bits=bits).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == contaminated_by_hand(docs, items)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b"), (2, None)])
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, none).collect()) == [(1, 0), (2, 0)]
    assert decontaminate.contamination(frame(spark, [(1, "a")]).limit(0), none).count() == 0


# -- near duplicates ---------------------------------------------------------

def near_by_hand(docs, n=5, threshold=0.8):
    sets = []
    for _, t in docs:
        w = text_words(t)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((d, min(ids) if ids else None, links[i]))
    return sorted(out, key=repr)


def test_near_duplicates_brute_force(spark, corpus):
    got = jaccard_join.near_duplicates(frame(spark, corpus)).collect()
    want = near_by_hand(corpus)
    # a null id sorts first: its class is named by it
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == sorted(((d, n) for d, _, n in want), key=repr)
    named = {r.doc_id: r.class_id for r in got if r.class_id is not None}
    assert all(named[d] == c for d, c, _ in want if d in named)
    kept = {}
    for r in got:
        kept[(r.class_id, None if r.n_links else r.doc_id)] = kept.get((r.class_id, None if r.n_links else r.doc_id), 0) + r.kept
    assert all(v >= 1 for v in kept.values())


def test_near_duplicates_large_group_and_chain(spark):
    rng = random.Random(3)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(600):          # one group larger than a tile, all different texts
        w = list(base)
        w[i % 190] = f"w{i}"
        rows.append((i, " ".join(w)))
    chain = sentence(rng, 120).split()
    rows += [(1000 + i, " ".join(chain[4 * i:4 * i + 80])) for i in range(10)]   # neighbours link, ends do not
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    want = {d: (c, n) for d, c, n in near_by_hand(rows)}
    assert got == want


def test_near_duplicates_recall_and_few_classes(spark, monkeypatch):
    def missed(runs):
        total = 0.0
        for a in range(65):
            q = 1.0
            for _ in range(jaccard_join.DEPTH):
                q = 1 - (1 - a / 64 * q) ** jaccard_join.FAN
            total += math.comb(64, a) * 0.8 ** a * 0.2 ** (64 - a) * (1 - q) ** runs
        return total

    assert missed(jaccard_join.runs_for()) <= 1e-4
    # a few classes meet whatever the splits are
    monkeypatch.setattr(jaccard_join, "_split", None)
    rng = random.Random(3)
    text = sentence(rng, 60)
    rows = [(1, text), (2, text + " tail"), (3, sentence(rng, 60))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_near_duplicates_empty(spark):
    assert jaccard_join.near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert jaccard_join.runs_for() >= 2


# -- repeated passages -------------------------------------------------------

def repeats_by_hand(docs, span=400):
    body = [(t or "").encode() for _, t in docs]
    seen = {}
    for b in body:
        for s in range(len(b) - span + 1):
            seen[b[s:s + span]] = seen.get(b[s:s + span], 0) + 1
    out = []
    for (d, _), b in zip(docs, body):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if seen[b[s:s + span]] > 1:
                gone[s:s + span] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def passages(spark, docs):
    got = substring_dedup.repeated_passages(frame(spark, docs)).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr)


def test_repeats_brute_force(spark, corpus):
    assert passages(spark, corpus) == repeats_by_hand(corpus)


def test_repeats_cut_at_every_edge(spark):
    rng = random.Random(9)
    passage = sentence(rng, 400)
    rows = [(i, sentence(rng, 30) + passage[rng.randint(0, 300):rng.randint(500, 2000)] + sentence(rng, 30)) for i in range(30)]
    rows += [(50, passage[100:499]), (51, passage[100:500]), (52, passage), (53, passage[:450] * 3), (54, "ab" * 250), (55, "z" * 401)]
    assert passages(spark, rows) == repeats_by_hand(rows)


def test_repeats_empty(spark):
    assert passages(spark, [(1, None)]) == repeats_by_hand([(1, None)])
    assert substring_dedup.repeated_passages(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_kept_text_is_text(spark):
    a = "é" * 300
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(frame(spark, [(1, "x" + a), (2, "yy" + a + "z")])).collect()}
    assert (got[1].kept_text, got[2].kept_text) == ("x", "yyz")


# -- token ids ---------------------------------------------------------------

ODD = ["", " ", "  a", "a  b", "a \n b", "\n", "a\n", " a", "x <|endoftext|> y", "İstanbul is ß Ünï don't I'll 're 12 345.",
       "ªº µm é́ é áb ﬁ", "tab\there  now", "q? !? .. a.b, c", "😀 a 😀b", "ΑΣ ς Σ", "﻿a b", "a\x00b c",
       "<|startoftext|>hi <|endoftext|>", "a　 b", "a b c"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_tokenizer(path):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aB é.,'\n\t 1’ß  s t") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    tok = Tokenizer.from_file(path)
    mine = TextIds(path)
    for t in texts + texts:
        assert mine.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_are_encoded_once_whatever_stands_around_them():
    # every character up to U+00FF beside letters, numbers, marks and spaces, and case within words
    mine, tok = TextIds(WORD), Tokenizer.from_file(WORD)
    texts = [f"{a}{chr(c)}{b}" for c in range(256) for a in ("", "ab", "é ", "1", "!", "'") for b in ("", "Sx", " y", "2", "?")]
    for t in [*texts, "'S don'T 'stop", "<|ENDOFTEXT|>", "a<|endoftext|>B"]:
        assert mine.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    mine = TextIds(WORD)
    t = "Zornig, zornig. ZORNIG!\nzornig:\tzornig?\n\n'Zornig'"
    assert mine.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert "zornig" in mine.words and not mine.parts and sum("zornig" in w.lower() for w in mine.words) == 1


def test_texts_of_a_call_look_each_word_up_once():
    rng = random.Random(8)
    tok, mine = Tokenizer.from_file(WORD), TextIds(WORD)
    narrow = ["".join(rng.choice("aBst'rvel mdé.,\n\t 1²Ø\xa0\x1c\0") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts = ["", *narrow, " ", "'", "don't've'LL 'style", "Ωmega ’s", "<|endoftext|> a", *ODD[:2], None, "x'"]
    texts = [t or "" for t in texts]
    for batch in (texts, [""], [], [" ", "'"], ["Ω"]):
        assert [i.tolist() for i in mine.many(batch)] == [tok.encode(t, add_special_tokens=False).ids for t in batch]

    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return mine._encode_word(word)

    mine.words = Counted()
    mine.many(["Zorn und zorn, UND zorn"] * 500)
    assert Counted.asked == 3


def test_token_files_do_not_depend_on_what_is_encoded_together(corpus, monkeypatch):
    docs = corpus + [(500 + i, t) for i, t in enumerate(ODD)]
    rows = []
    for size in (1, 1 << 22):
        encode = repair_store._encoder(WORD, 1, 500, pa.int64())
        monkeypatch.setattr(repair_store, "TEXT_BYTES", size)
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())],
                                           names=["doc_id", "text"])
        monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))
        rows.append([b.to_pylist() for b in encode(iter([batch]))])
    assert rows[0] == rows[1] and len(rows[0]) > 1


def test_token_files_round_trip(spark, corpus):
    docs = corpus + [(500 + i, t) for i, t in enumerate(ODD)]
    path = scratch_path(spark, "token-test")
    repair_store.write(frame(spark, docs), path, WORD, end_id=1, shard_tokens=500)
    got = repair_store.read(spark, path).collect()
    tok = Tokenizer.from_file(WORD)
    want = sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, i in (
        (d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for d, t in docs)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_grammar_random_access():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.4, 20_000).clip(1, 900).astype(np.uint32)
    ids[5000:9000] = ids[:4000]
    ends = np.append(np.sort(rng.choice(np.arange(1, 20_000), 60, replace=False)), 20_000)
    s = repair_store.Shard(repair_store.compress(ids, ends, rounds=20, min_count=2))
    assert s.rules and len(s.symbols) < 12_000
    assert (s.ids() == ids).all()
    for k in (0, 7, len(ends) - 1):
        assert (s.document(k) == ids[ends[k - 1] if k else 0:ends[k]]).all()
    assert s.size(s.symbols) == 20_000
    with pytest.raises(ValueError):
        repair_store.Shard(b"RPG1" + b"\0" * 24)
    one = np.array([1], np.uint32)
    assert repair_store.Shard(repair_store.compress(one, np.array([1]))).ids().tolist() == [1]


def test_token_files_empty(spark):
    path = scratch_path(spark, "token-test")
    repair_store.write(frame(spark, [(1, "a")]).limit(0), path, WORD, end_id=1)
    assert repair_store.read(spark, path).count() == 0


# -- packing -----------------------------------------------------------------

def test_packing(spark, corpus):
    tok = Tokenizer.from_file(BYTE)
    got = packing.packed(frame(spark, corpus), BYTE, end_id=2).collect()
    want = []
    for d, t in corpus:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(d, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= math.ceil(sum(x[3] for x in want) / 1024) + 3
    assert packing.packed(frame(spark, corpus).limit(0), BYTE, end_id=2).count() == 0


def test_packing_near_the_bound():
    rng = random.Random(4)
    counts = {}
    for _ in range(30_000):
        x = min(1024, int(rng.lognormvariate(5.8, 0.9)) + 1)
        counts[x] = counts.get(x, 0) + 1
    held = {}
    patterns = packing.solve(counts)
    for p in patterns:
        assert sum(p.lengths) <= 1024
        for x in p.lengths:
            held[x] = held.get(x, 0) + p.times
    assert held == counts
    assert sum(p.times for p in patterns) <= 1.005 * sum(x * k for x, k in counts.items()) / 1024 + 2


# -- k-d shards --------------------------------------------------------------

def test_kd_shards(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randint(1, 40)), rng.choice(["s1", "s2", None]), rng.choice(["en", "de"])) for i in range(900)]
    rows += [(2000 + i, "same text " * 12, f"s{i % 4}", None) for i in range(900)]          # a hot group of copies
    rows += [(5000, None, "s", "en"), (5001, "", "s", "en"), (5002, "", None, None), (None, "é", "s", "x"), (1, rows[1][1], "s1", "en")]
    docs = frame(spark, rows, ", source string, lang string")
    got = kd_shards.shard(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    size = [0] * 8
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        size[s] = sum(r.size for r in mine)
    assert max(size) <= 1.1 * min(size)
    assert {r.shard for r in kd_shards.shard(docs, target_bytes=sum(size) // 2 + 1).collect()} == {0, 1}
    assert kd_shards.shard(docs.limit(0)).count() == 0
    # copies stay together unless their group is too large for one shard
    few = frame(spark, [(i, f"text number {i // 3} " * 5, "s", "en") for i in range(3000)], ", source string, lang string")
    text = {}
    for r in kd_shards.shard(few).collect():
        text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(v) == 1 for v in text.values())
    # nor are groups of a tenth to nine tenths of a shard; sizes stay near equal while no group fills half a shard
    for sizes, bound in (([100, 200, 300, 450], 1.25), ([100, 700, 900], 2.0)):
        big = [(i, f"group {k} " + "x" * 92, "s", "en") for i, k in enumerate(k for k, n in enumerate(sizes) for _ in range(n))]
        big += [(10_000 + i, f"single {i:06d} " + "y" * 87, rng.choice("ab"), rng.choice(["en", "de"])) for i in range(8000 - sum(sizes))]
        where, size = {}, [0] * 8
        for r in kd_shards.shard(frame(spark, big, ", source string, lang string")).collect():
            where.setdefault(r.text_crc32, set()).add(r.shard)
            size[r.shard] += r.size
        assert all(len(v) == 1 for v in where.values()) and max(size) <= bound * min(size)


def test_kd_cuts_are_weighted_medians(spark):
    """Two leaves: the cut by the widest dimension is the one nearest to half of the bytes, among all cuts."""
    rng = random.Random(9)
    rows = [(i, "z" * rng.randint(1, 4000) + str(i), "s", "en") for i in range(400)]       # only the size varies
    got = kd_shards.shard(frame(spark, rows, ", source string, lang string"), shards=2).collect()
    total = sum(r.size for r in got)
    low = sum(r.size for r in got if r.shard == 0)
    by_size = sorted(min(4095, int(math.log2(r.size) * 96)) for r in got if r.shard == 0)[-1]
    assert by_size <= min(min(4095, int(math.log2(r.size) * 96)) for r in got if r.shard == 1)
    assert abs(low - total / 2) <= max(r.size for r in got) / 2


# -- language ----------------------------------------------------------------

def sequential_word(word, model):
    """Forward sum over all segmentations, one word, plain Python with decimals."""
    s = language_id.MARK + word
    keys = {int(k): i for i, k in enumerate(model.keys)}
    out = []
    for q in range(len(model.langs)):
        a = [Decimal(1)] + [Decimal(0)] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + model.longest) + 1):
                k = keys.get(int(language_id._piece_hash([s[i:j]])[0]))
                a[j] += a[i] * Decimal(model.probs[k, q] if k is not None else language_id.UNKNOWN if j == i + 1 else 0.0)
        out.append(float(a[-1].ln()))
    return out


def test_language(spark):
    en = "the quick brown fox jumps over the lazy dog and runs through the green field with other animals every morning"
    de = "der schnelle braune fuchs springt über den faulen hund und läuft durch das grüne feld mit anderen tieren"
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices((en if i % 2 else de).split(), k=12)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, en.upper(), None), (104, de * 50, None), (None, "дом", None)]
    docs = frame(spark, rows, ", lang string")
    m = language_id.fit(docs, language_id.vocabulary(PIECES), rounds=2)
    assert m.langs == ["de", "en"]
    long = ["".join(rng.choices(("the", "und", "läuft", "ж", "q", "field"), k=k)) for k in (70, 100, 101, 400)]
    words = ["fox", "läuft", "über", "zzzqqq", "d" * 40, *long, *["ab" * 128 + "c" * k for k in range(18)]]
    assert np.allclose(language_id.word_logprobs(words, m), [sequential_word(w, m) for w in words])
    got = {r.doc_id: r for r in language_id.identify(docs, m).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100].score == 0 and got[None].lang_pred in ("de", "en")
    odd = docs.selectExpr("text", "doc_id score", "lang Lang_Pred", "doc_id `a.b`")
    assert language_id.identify(odd, m).columns == ["a.b", "lang_pred", "score"]
    assert language_id.identify(odd, m, keep={"text": F.lit(1)}).columns == ["text", "lang_pred", "score"]
    nothing = language_id.fit(docs.limit(0), language_id.vocabulary(PIECES))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), m).count() == 0


def test_language_learning_is_expectation_maximisation(spark):
    """Two rounds against plain sums over all segmentations; more rounds never fit worse; long words cost the same."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    texts = [("ab abab ba", "x"), ("abba ab", "x"), ("bb aab", "y"), ("a" * 3, "y"), ("--", "z"), (None, "y")]
    docs = frame(spark, [(i, t, q) for i, (t, q) in enumerate(texts)], ", lang string")

    def cuts(w):
        if not w:
            yield []
        for p in pieces:
            if w.startswith(p):
                yield from ([p, *rest] for rest in cuts(w[len(p):]))

    prob = {q: {p: 1 / len(pieces) for p in pieces} for q in "xy"}
    for _ in range(2):
        for q in "xy":
            total = dict.fromkeys(pieces, 0.05)
            for w in ("▁" + w for t, lang in texts if t and lang == q for w in language_id.words_of(t)):
                ways = [(c, math.prod(prob[q][p] for p in c)) for c in cuts(w)]
                for c, weight in ways:
                    for p in c:
                        total[p] += weight / sum(v for _, v in ways)
            prob[q] = {p: n / sum(total.values()) for p, n in total.items()}
    m = language_id.fit(docs, pieces, rounds=2, gain=0.0)
    assert m.langs == ["x", "y"]
    at = {int(k): i for i, k in enumerate(m.keys)}
    for p in pieces:
        assert np.allclose(m.probs[at[int(language_id._piece_hash([p])[0])]], [prob["x"][p], prob["y"][p]])
    big = "ab" * 200_000
    assert np.isfinite(language_id.word_logprobs([big], m)).all()
    assert language_id.identify(frame(spark, [(1, big, None)], ", lang string"), m).first().lang_pred in ("x", "y")


# -- toxicity ----------------------------------------------------------------

def test_toxicity(spark):
    from pyspark.sql import functions as F
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = sentence(rng, rng.randint(5, 400)).split()
        if bad:
            w[rng.randrange(len(w))] = "scumbag"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(3, None), (None, 1), (7, 0)]
    rows += [(900, None), (901, ""), (902, "scumbag"), (None, "scumbag")]
    docs, marks = frame(spark, rows), spark.createDataFrame([(*x, 2) for x in labels], "doc_id long, toxic int, rid int")
    m = toxicity.fit(docs, marks, F.col("doc_id") < 300)
    got = {r.doc_id: r for r in toxicity.score(docs, m, {"doc_id": F.col("doc_id")}).collect()}
    held = [got[i] for i in range(300, 400)]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 97
    assert got[902].predicted == 1 and got[900].score == got[901].score and 0 <= got[900].score <= 1
    for none in (marks.limit(0), marks.filter("toxic = 0")):
        flat = toxicity.score(docs, toxicity.fit(docs, none, F.lit(True)), {"doc_id": F.col("doc_id")}).collect()
        assert len({r.score for r in flat}) == 1 and flat[0].score < 0.01
    assert toxicity.score(docs.limit(0), m, {"doc_id": F.col("doc_id")}).count() == 0


def test_toxicity_all_features_and_a_rare_class(spark):
    from pyspark.sql import functions as F
    rng = random.Random(19)
    long = sentence(rng, 600)
    rows = [(i, sentence(rng, 30) + (" scumbag " + long if i % 100 == 7 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 100 == 7)) for i, _ in rows], "doc_id long, toxic int")
    docs = frame(spark, rows)
    m = toxicity.fit(docs, labels, F.lit(True), fit_rows=16)
    assert (m.weight != 0).sum() > 2_048
    got = {r.doc_id: r.score for r in toxicity.score(docs, m, {"doc_id": F.col("doc_id")}).collect()}
    assert min(got[i] for i in got if i % 100 == 7) > max(got[i] for i in got if i % 100 != 7)


# -- licences ----------------------------------------------------------------

def test_licenses(spark):
    rng = random.Random(10)
    pad = sentence(rng, 20)
    rows = [(1, pad + "\nThis work is licensed under the GNU General Public License, version 3.\n" + pad),
            (2, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
            (3, "Licensed under CC BY-NC 4.0."), (4, "The license fee is due."), (5, "Use is subject to the Zorblax license of 1997 by Foo."),
            (6, None), (7, ""), (8, sentence(rng, 500) + " released under the MIT License. " + sentence(rng, 500)),
            (9, pad), (9, pad), (None, "RELEASED UNDER THE MIT LICENSE.")]
    got = {}
    for r in licenses.license_families(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.families, r.n_notices))
    assert got[1] == [("gpl", 1)] and got[2] == [("apache,mit", 2)] and got[3] == [("cc-by-nc", 1)] and got[None] == [("mit", 1)]
    assert all(got[i][0][0] == "" for i in (4, 5, 6, 7, 9)) and len(got[9]) == 2
    assert licenses.license_families(frame(spark, rows).limit(0)).count() == 0


def families_of(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.families, r.n_notices, r.n_unknown) for r in licenses.license_families(frame(spark, rows)).collect()}
    return [got[i] for i in range(len(texts))]


def test_licenses_without_trigger_words_and_wrapped(spark):
    rng = random.Random(11)
    pad = sentence(rng, 30)
    got = families_of(spark, [
        pad + "\nAll rights reserved.", "All rights reserved.", "This work is in the public domain.\n\n" + pad, "Released under the GNU GPL v3.",
        pad + "\n# This work is licensed under the GNU\n# General Public\n# License, version 3.\n" + pad,
        "Use is subject to the Zorblax license of 1997 by Foo.", "All the people of the city have the same rights.\n" + pad,
        "You can\nredistribute it under the terms of the GNU Affero General\nPublic License.",
        "und die mit der einheit ist so und des die\nReleased under the MIT License."])
    assert got[0] == got[1] == ("proprietary", 1, 0) and got[2] == ("cc0", 1, 0) and got[3] == ("gpl", 1, 0) and got[4] == ("gpl", 1, 0)
    assert got[5] == ("", 0, 1) and got[6] == ("", 0, 0) and got[7] == ("agpl", 1, 0)
    assert got[8] == ("mit", 1, 0)


def test_licenses_inside_long_lines(spark):
    rng = random.Random(12)

    def inside(notice):
        return sentence(rng, 500) + " " + notice + " " + sentence(rng, 500)

    prose = licenses.PROSE
    got = families_of(spark, [
        inside("released under the MIT License."), inside("Licensed under CC BY-NC 4.0."), inside("Licensed under the Apache License, Version 2.0."),
        f"{prose} released under the MIT License. {prose}", f"{prose} Licensed under CC BY-NC 4.0. {prose}",
        f"{prose} Licensed under the Apache License, Version 2.0. {prose}", f"{prose} {prose}"])
    assert got == [("mit", 1, 0), ("cc-by-nc", 1, 0), ("apache", 1, 0)] * 2 + [("", 0, 0)]
    model = licenses.fit(spark)
    family = {"wid": 0, "kind": 1, "family": "mit", "shared": 1.0, "low": 0, "high": 0}
    alone = "released under the mit license".split()
    pad = [f"zq{i}" for i in range(55)]
    rows = [tuple(family.values()) + (w,) for w in (alone, pad + alone)]
    windows = spark.createDataFrame(rows, "wid int, kind int, family string, shared double, low int, high int, words array<string>")
    p = [r.p for r in licenses._judged(windows, model.weights).collect()]
    assert len(p) == 2 and abs(p[0] - p[1]) < 1e-9 and min(p) >= model.least


# -- the registered queries against their SQL ---------------------------------

def test_queries_equal_their_sql(spark):
    import duckdb

    from postscope.llm.oracle import SQL
    from postscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for key, sql in SQL.items():
        df = QUERIES[key](spark, sf)
        cols = sorted(df.columns)
        res = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})")
        assert sorted(map(repr, res.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect()), key


def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "123 456", None, None, 7), (9003, rows[0].text, "en", None, 1),
                                 (9003, rows[0].text, "en", None, 1)], docs.schema)
    docs = docs.union(odd)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "pipeline-test")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in docs.collect()})
    lang, near, cut, clean = kept
    assert {9001, 9002}.isdisjoint(lang) and set(lang) == set(rows) | {9003}
    want = near_by_hand([(d, r.text) for d, r in lang.items()])
    assert set(near) == {d for d, c, _ in want if d == c}
    whole = {d: r for d, r in ((d, near[d]) for d in near)}
    by_hand = {d: sha for d, _, _, _, sha in repeats_by_hand([(d, r.text) for d, r in whole.items()])}
    assert set(cut) == set(near)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == by_hand[d] for d, r in cut.items() if r.text == near[d].text)
    assert all(r.n_chars == len(r.text) for r in cut.values() if r.text != near[r.doc_id].text)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    marked = {d for d, n, h, _ in contaminated_by_hand([(d, r.text) for d, r in cut.items()], items) if h and 20 * h >= n}
    assert set(clean) == set(cut) - marked and marked
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(clean)
