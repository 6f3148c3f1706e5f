"""Operators 11 to 13 against brute-force versions and held-out labels, and pages of several articles."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import oracle, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import LOWER, ODD, WORDS, ordered

from ledgerflow.llm import collocations, common, hashing, html_text, prefix_trie, toxicity

# --- 11 ---------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest=5, top=2000, inside=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q in cand for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * own[q] >= inside * own[q[i:j]]}
        scored = []
        for p in cand - gone:
            score, _, l, r = min((1000 * own[p] * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -own[p], " ".join(p).encode(), l, r))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return out


def sentences(rng, n):
    return " ".join(rng.choice(WORDS[:9]) + rng.choice(["", "", "", ",", ".", ";\n"]) for _ in range(n))


@pytest.mark.parametrize("inside, block", [(100, 6 << 20), (60, 200)])
def test_phrases(spark, inside, block):
    rng = random.Random(11)
    rows = [("en", sentences(rng, rng.randint(1, 80))) for _ in range(60)] + [("de", "the  same\tphrase here, the same Phrase"), ("de", "x" * 5000)] * 12
    rows += [(None, t) for t in ODD] + [("", "a b a b")] * 10 + [("und", "one two one two")] * 9 + [("one", "a"), ("one", None)]
    docs = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, id int, key string")
    for least in (6, 1000):
        got = collocations.collocations(docs.repartition(3), least=least, inside=inside, block_bytes=block, top=50)
        assert ordered(map(tuple, got.collect())) == ordered(brute_phrases(rows, least, top=50, inside=inside))
    assert collocations.collocations(docs.where("false")).count() == 0


def test_large_counts_are_exact(spark):
    big = 10**13
    level = spark.createDataFrame([("x", [7, 3 * big, big], [11, 2 * big, big], big, 9 * big)], "phrase string, pre array<long>, suf array<long>, f long, n long")
    cut = level.select(collocations._cuts(3).alias("c")).first().c
    assert (cut.score, cut.k, cut.l, cut.r) == min((1000 * big * 9 * big // (l * r), k, l, r) for k, l, r in ((1, 7, 2 * big), (2, 3 * big, 11)))


# --- 12 ---------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    member = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            member[s[:d]].append(c)
    kids = defaultdict(set)
    for p in member:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, own in member.items():
        below = [q for q in member if q[: len(p)] == p]
        saved = sum((len(member[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in own if len(made[c]) == len(p))))
        out.append((min(own), len(p), min(member[p[:-1]]) if p else None, len(own), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats():
    rng = random.Random(12)
    say = ["hello there", "a  b\nc", "", None, "how are you today"]
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(say)) for c in range(-3, 70) if c % 9 for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(4)] + [(200, t % 5 or None, "r", f"long {t % 3}") for t in range(70)]
    return rows + [(201, None, None, None), (201, None, None, None), (201, 1, "", ""), (None, 1, "user", "lost"), (300, 5, "user", "x"), (300, 5, "user", "x"), (2**62, 0, "user", "far")]


def test_trie(spark):
    rows = chats()
    table = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, node string, depth int")
    got = prefix_trie.conversation_trie(table.repartition(5)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert ordered(map(tuple, got.collect())) == ordered(brute_trie(rows))
    assert prefix_trie.conversation_trie(table.where("false")).count() == 0


def test_trie_of_one_turn(spark):
    rows = [(20, 0, "user", "hi"), (21, 0, "user", "hi"), (22, 3, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert ordered(map(tuple, prefix_trie.conversation_trie(table).collect())) == ordered(brute_trie(rows))


def test_a_conversation_in_many_tasks(spark):
    order = random.Random(9).sample(range(900), 900)
    rows = [(7, i // 3, "u", f"t {i:04d}") for i in order] + [(c, None, None, None) for c in range(60)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    got = {r.pos: bytes(r.token) for r in turns.where("conv_id = 7 AND words = 2").collect()}
    assert got == {i + 1: hashlib.sha256(f"1:ut {i:04d}".encode()).digest() for i in range(900)}  # the turn without a number comes first
    assert turns.count() == len(rows) and turns.where("pos = 0").count() == 60


def test_ids_in_pieces(spark):
    rows = [(bytes([i % 3]), c) for i, c in enumerate(random.Random(1).sample(range(-500, 100_000), 3000))]
    got = prefix_trie.id_digests(spark.createDataFrame(rows, "node binary, conv_id long").repartition(7), piece=64)
    want = {k: hashlib.sha256(",".join(map(str, sorted(c for n, c in rows if n == k))).encode()).hexdigest() for k in {n for n, _ in rows}}
    assert {bytes(r.node): r.sha for r in got.collect()} == want


# --- 13 ---------------------------------------------------------------------------------------------------------------


@given(st.lists(st.text(st.sampled_from("aB \n\té.漢İ-9"), max_size=24), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_and_bags(texts):
    data, offsets = b"".join(t.encode() for t in texts), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    if not data:
        return
    w = toxicity.words_of(np.frombuffer(data, np.uint8), offsets)
    lower = lambda c: c.lower() if len(c.lower()) == 1 else c
    want = [["".join(lower(c) for c in x if c.isalnum()) for x in re.split(r"\s+", t)] for t in texts]
    want = [[x[i : i + toxicity.LONGEST] for x in t for i in range(0, len(x), toxicity.LONGEST)] for t in want]
    assert np.diff(w.texts).tolist() == [len(t) for t in want]
    flat = [x for t in want for x in t]
    assert w.counts.tolist() == [sum(max(len(x) + 3 - n, 0) for n in toxicity.GRAMS) for x in flat]
    assert len(set(w.hashes.tolist())) == len(set(flat))
    for g, n in zip(w.grams, toxicity.GRAMS, strict=True):
        sizes = [int((g[a:b] < toxicity.BUCKETS).sum()) for a, b in zip(w.begins, np.append(w.begins, len(g))[1:], strict=True)]
        assert sizes == [max(len(x) + 3 - n, 0) for x in flat]


def insults(rng, n_clean, n_toxic, forms):
    clean = lambda n: [rng.choice("kolu mira tesk fando breli sopa nuri galt wemo pilo".split()) + rng.choice(["", "n", "ta", "ri", "mo"]) for _ in range(n)]
    out = [(" ".join(clean(rng.randint(3, 300))), 0) for _ in range(n_clean)]
    for _ in range(n_toxic):
        words = clean(rng.randint(8, 120))
        for _ in range(1 + len(words) // 40):
            words.insert(rng.randrange(len(words)), rng.choice(forms))
        out.append((" ".join(words), 1))
    return out


def test_unseen_forms_are_caught(spark):
    rng = random.Random(13)
    roots, ends = ["zwixel", "horgav", "qumpt"], ["", "er", "ing", "s", "ovo", "ak", "ezz", "ly"]
    rows = insults(rng, 500, 260, [r + e for r in roots for e in ends])
    unseen = insults(rng, 200, 60, [r + e for r in roots for e in ("ution", "xxo", "Ki!", "-est")])
    unseen += [(" ".join(["kolu", "mirata", "wemo"] * 6000 + ["zwixelution", "horgavxxo"]), 1), ("breli " * 500, 0)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows + unseen)], "doc_id long, text string, lang int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and (r.score >= 0.7) == r.predicted and 0 <= r.score <= 1 for i, r in got.items())
    hit = Counter((y, got[i].predicted) for i, (_, y) in enumerate(rows + unseen) if i >= len(rows) or got[i].held_out)
    assert hit[1, 1] >= 0.7 * (hit[1, 0] + hit[1, 1]) and hit[0, 1] <= 0.02 * (hit[0, 0] + hit[0, 1])


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(ODD)] + [(None, "null id", "en", 1.0), (3, "one", "x", 0.0)], "doc_id long, text string, held_out string, score double")
    none = spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(ODD) + 2 and {r.score for r in got} == {0.0} and not any(r.predicted for r in got)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_scores_go_by_text_not_by_neighbours():
    rng = random.Random(5)
    rows = insults(rng, 60, 40, ["zwixel", "horgav"])
    model = toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]), np.arange(len(rows)) % 5 == 0, 0.4)
    texts = [t for t, _ in rows] + ODD
    together = np.concatenate([model.scores(d, o) for _, d, o in hashing.slices(pa.array(texts, pa.string()), 1 << 12)])
    alone = [model.scores(d, o)[0] for t in texts for _, d, o in hashing.slices(pa.array([t], pa.string()))]
    assert np.allclose(together, alone, atol=1e-5)


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_articles_beside_one_another():
    weights = {"in p": 1.0, "tag p": -0.3, "tag article": -0.5}
    words = lambda n, w: " ".join([w] * n)
    listed = "".join(f"<article><p>{words(n, w)}</p></article>" for n, w in ((60, "first"), (60, "second"), (2, "third")))
    assert html_text.extract(f"<body><nav>menu</nav>{listed}</body>", weights).split() == ["first"] * 60 + ["second"] * 60 + ["third"] * 2
    assert html_text.extract(f"<body><main>{listed}</main><footer>end</footer></body>", weights).split() == ["first"] * 60 + ["second"] * 60 + ["third"] * 2
    assert html_text.extract(f"<body><div class='widget'><p>{words(50, 'only')}</p></div></body>", weights).split() == ["only"] * 50
    assert html_text.extract(f"<body><div class='widget'><p>{words(50, 'side')}</p></div><p>{words(9, 'text')}</p></body>", weights).split() == ["text"] * 9
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>{words(20, 'text')}</p><footer>end</footer></article></body>"
    assert html_text.extract(page, weights).split() == ["Title"] + ["text"] * 20
