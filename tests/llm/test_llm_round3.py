"""Chat formatting, hard negatives and collocations against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscope.llm import chat_format, collocations, hard_negatives
from postscope.session import scratch_path

EXTRA = "block int, text_ string, n long, h1 long, kind string, part int"
MORE = (1, "x", 2, 3, "y", 4)

# ---- chat formatting ---------------------------------------------------------

CHUNKS = ["### ", "</turn>", "\\", "\n", " ", "###", "User: ", "### Assistant: ", "é😀", "x", ":", '"', "%000041", "</tur", "n>", "\r"]
ROLES = ["user", "assistant", "system", "User", "", "a\nb", "to:ol", "### ", "ASSISTANT", "tool"]


def test_turns_survive_the_round_trip():
    rng = random.Random(1)
    for _ in range(5000):
        role, text = rng.choice(ROLES), "".join(rng.choices(CHUNKS, k=rng.randint(0, 9)))
        out, s, e = chat_format.format_turn(role, text)
        assert chat_format.parse(out) == [(role, text, s, e)]
        assert chat_format.unescape(out[s:e]) == text
        marks = [m.start() for m in chat_format.CONTROL.finditer(out)]
        assert all(out[i - 1] == "\\" for i in marks if s <= i < e)     # no bare control string inside a text


def test_only_conflicting_content_is_escaped():
    assert chat_format.format_turn("user", "a \\ b # c")[0] == "### User: a \\ b # c\n</turn>\n"
    assert chat_format.format_turn("user", "a ### b")[0] == "### User: a \\### b\n</turn>\n"
    assert chat_format.format_turn("user", "\\</turn>")[0] == "### User: \\\\</turn>\n</turn>\n"


@pytest.mark.parametrize("broken", ["### User: a", "x", "### User: a ### b\n</turn>\n", "### Nobody: a\n</turn>\n",
                                    "### User: a</turn>\n", "### User: a\n</turn> "])
def test_the_grammar_rejects(broken):
    with pytest.raises(chat_format.GrammarError):
        chat_format.parse(broken)


def digests(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        chars = sum(len(chat_format.format_turn(r, t)[0]) for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, *MORE) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")
    path = scratch_path(spark, "chats")
    chat_format.write(df, path)
    return spark.read.parquet(path)


def test_conversations_read_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(ROLES[:3]), "".join(rng.choices(CHUNKS, k=rng.randint(0, 30)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * rng.randint(0, 900)) for t in range(700)]   # many blocks
    rows += [(100, 0, "assistant", "### long </turn> " * 60_000), (100, 1, None, None), (100, None, "system", "first")]
    rows += [(101, 0, "user", "tie b"), (101, 0, "user", "tie a"), (101, 0, "assistant", "z"), (101, 0, "user", "tie a")]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "answer")]
    rng.shuffle(rows)
    blocks = formatted(spark, rows).cache()
    got = {r[0]: tuple(r)[1:] for r in chat_format.conversations(blocks).collect()}
    assert got == digests(rows)
    assert blocks.filter("conv_id = 99").count() > 20 and blocks.agg(F.max(F.length("text"))).first()[0] > 900_000
    hot = chat_format.read_turns(blocks).filter("conv_id = 99").orderBy("part", "seq", "place").collect()
    assert [(r.role, r.text) for r in hot] == [(r, t) for _, _, r, t in sorted(x for x in rows if x[0] == 99)]
    assert all((r.loss_text == r.text) if r.role == "assistant" else r.loss_text is None for r in hot)


def test_no_conversations(spark):
    assert chat_format.conversations(formatted(spark, [])).count() == 0


# ---- hard negatives ----------------------------------------------------------

def mined(rows, every=10, positives=5, negatives=3):
    """rows: (id, label, vector); in whole numbers, one row at a time."""
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (label, [int(np.floor(256 * x)) for x in v])
        ok[i] = min(ok.get(i, key), key)
    out = []
    for a, (label, v) in ok.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, (lab, w) in ok.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, i) for n, i, lab in scored if lab != label and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def answers(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else list(v), lab, *MORE) for i, lab, v in rows],
                               f"vec_id long, embedding array<double>, label int, {EXTRA}")
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more).collect())


def vectors(rng, n, dim, groups):
    centre = rng.normal(size=(groups, dim))
    v = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.2
    return v / np.linalg.norm(v, axis=1)[:, None] * rng.choice([0.3, 1.0, 1.0, 4.0], n)[:, None]


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_MIN", 90)
    monkeypatch.setattr(hard_negatives, "BUCKET", 32)
    monkeypatch.setattr(hard_negatives, "SEED", 40)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(vectors(rng, 400, 12, 6))]
    same = rows[10][2]
    rows += [(1000 + i, i % 3, same) for i in range(150)]                      # one very common vector: ties
    rows += [rows[20], (20, 9, rows[20][2]), (3001, None, same), (3002, 1, None), (3003, 1, [float("nan")] * 12),
             (3004, 1, [None] + same[1:]), (3005, 1, []), (3010, 1, [0.0] * 12), (3011, 2, [1.0] * 5), (3020, 1, [1.0] * 5),
             (3021, 1, [0.9] * 5), (None, 1, same), (-10, 2, same)]
    assert answers(spark, rows) == mined(rows)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.integers(1 << 20, 1 << 21, 6) * 1.0).tolist()) for i in range(60)]      # products near 2^60
    assert answers(spark, rows) == mined(rows)


def test_no_vectors(spark):
    assert answers(spark, []) == []


def test_pruned_search_finds_the_same(monkeypatch):
    """Few rows are verified for anchors with near neighbours, and no row is lost."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * vectors(rng, 3000, 16, 60))
    ids, labels = np.arange(len(v)), np.zeros(len(v), np.int64)
    scores, verified = hard_negatives._scores, []
    monkeypatch.setattr(hard_negatives, "_scores", lambda p, q: verified.append(len(p) * len(q)) or scores(p, q))
    asked = np.arange(0, 3000, 50)
    every = scores(v, v[asked])
    np.put_along_axis(every, asked[:, None], -np.inf, 1)
    bound = np.sort(every, axis=1)[:, -5]
    want = hard_negatives.Wanted(ids[asked], labels[asked], v[asked], [[(None, None, int(b))] for b in bound], 5, True)
    hard_negatives._search(want, ids, labels, v)
    for row, best in zip(every, want.best):
        assert [(-s, i) for s, i in best[0]] == [(row[i], i) for i in np.lexsort((ids, -row))[:5]]
    assert sum(verified) < 0.25 * len(v) * len(asked)


# ---- collocations ------------------------------------------------------------

def by_hand(rows, least, covered, top):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                count.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {}
    cands = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    for p, a in cands.items():
        cuts = [(2_000_000 * a // (count[p[:k + 1]] + count[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        longer = [b for q, b in cands.items() if q[0] == p[0] and len(q) > len(p)
                  and any(q[i:i + len(p) - 1] == p[1:] for i in range(1, len(q)))]
        if not any(100 * b >= covered * a for b in longer):
            found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), count[p[:k + 1]], count[(p[0], *p[k + 1:])]))
    return sorted((lang, n, p.decode(), -a, lo, r, total[lang], -s) for lang, ps in found.items()
                  for n, (s, a, p, lo, r) in enumerate(sorted(ps)[:top], 1))


def phrases(spark, rows, **how):
    df = spark.createDataFrame([(i, t, lang, *MORE) for i, (t, lang) in enumerate(rows)], f"doc_id long, text string, lang string, {EXTRA}")
    out = collocations.collocations(df, **how)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.collect())


def prose(rng, n):
    words = ["the", "Of", "new york", "red", "Ünder", "ünder", "a\x00b", "in", "city", "x" * 40, "river", "s\x0bt"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\t", "\n", " "]) for _ in range(n))


def test_collocations(spark):
    rng = random.Random(6)
    rows = [(prose(rng, rng.randint(0, 120)), rng.choice(["en", "de", None, "", "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("... ,,", "de"), ("word " * 3000 + "end", "en")] + [("one rare phrase here", "fr")] * 9
    how = {"least": 5, "covered": 80, "top": 40}
    assert phrases(spark, rows, **how) == by_hand(rows, **how)
    assert phrases(spark, rows, ranked=6, **how) == by_hand(rows, **how)       # most windows hold a word without a rank


def test_collocations_in_long_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 1 << 12)
    rng = random.Random(7)
    rows = [(prose(rng, 20_000), "en"), ("z" * 700_000 + " zz", "en"), *[(prose(rng, 50), "en") for _ in range(60)]]
    how = {"least": 8, "covered": 80, "top": 100}
    assert phrases(spark, rows, **how) == by_hand(rows, **how)


def test_codes_that_collide_are_replaced(spark, monkeypatch):
    real, tried = collocations.word_table, []

    def first_fails(own, base):
        tried.append(base)
        if len(tried) == 1:
            raise LookupError
        return real(own, base)
    monkeypatch.setattr(collocations, "word_table", first_fails)
    rows = [("to be or not to be", "en")] * 6
    how = {"least": 3, "covered": 80, "top": 9}
    assert phrases(spark, rows, **how) == by_hand(rows, **how) and len(set(tried)) == 2


def test_no_documents(spark):
    assert phrases(spark, []) == []
