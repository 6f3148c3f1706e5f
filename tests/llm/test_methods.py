"""The dealt methods against plain versions of them, and rows that strain them: hot groups, far ids, damaged files."""

import itertools
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_groups, brute_warc, ordered, text_of, words

from ledgerflow.llm import binary_out, common, decontam, html_text, near_dup, packing, quality, queries, token_scan, url_rules, warc

# --- 8 ----------------------------------------------------------------------------------------------------------------


def linked(x, y, percent):
    both = len(x & y)
    return both * 100 >= percent * (len(x) + len(y) - both)


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_prefixes_meet_whenever_sets_are_linked(percent):
    rng, counts, met = random.Random(percent), np.random.default_rng(1).integers(0, 9, near_dup.COUNTED).astype(np.int32), Counter()
    for _ in range(1500):
        hub = set(rng.sample(range(10**6), rng.randint(3, 120)))
        other = set(rng.sample(range(10**6), 40))

        def copy(base):
            close = rng.random() < 0.6
            out = set(rng.sample(sorted(base), max(1, int(len(base) * rng.uniform(0.95 if close else 0.5, 1)))))
            return out | set(rng.sample(sorted(other), min(40, rng.randint(0, 1 if close else len(base) // 3)))) | set(rng.sample(range(10**6), rng.randint(0, 2)))

        x = copy(hub)
        y = copy(rng.choice([hub, x, x]))
        made = [near_dup.prefix(np.array(sorted(s)), np.array(sorted(hub)), percent, counts) for s in (x, y)]
        (tx, ux, ex, sx, fx), (ty, uy, ey, sy, fy) = made
        assert fx == (not linked(x, hub, percent)) and fy == (not linked(y, hub, percent))
        if linked(x, y, percent) and (fx or fy):
            met[fx, fy] += 1
            if fx and fy:
                tx, ty = tx[:ux], ty[:uy]
            assert set(tx.tolist()) & set(ty.tolist())
            assert min(sx, sy) * (100 + percent) >= ex + ey - (100 - percent) * len(hub)
    assert len(met) >= 2


def test_a_passage_that_thousands_share(spark):
    """Most of each text is one passage; some have copies, one family has a second version of the passage."""
    rng = random.Random(3)
    passage, second = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(12)]
    rows = []
    for i in range(2500):
        own = [f"u{i}x{k}" for k in range(rng.randint(18, 30))]
        rows.append((i, passage + own))
        if i % 100 == 0:
            rows.append((10_000 + i, passage + own[:-1] + ["end"]))
    rows += [(20_000 + i, passage[:28] + second + [f"v{k}" for k in range(20)] + [f"w{i}"]) for i in range(40)]
    rows += [(30_000 + i, [*passage, *(x if rng.random() > 0.04 else f"{x}e{i}" for x in (f"fam{k}" for k in range(30)))]) for i in range(120)]
    rows = [(k, " ".join(w)) for k, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(near_dup.near_duplicates(docs, shingle=4).collect()) == ordered(brute_groups(rows, 4, 80))


def exact_groups(rows, shingle, percent):
    """As ``brute_groups``, with candidates from an index of each set's rarest shingles."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    df, parent, index, links = Counter(t for s in sets for t in s), list(range(len(rows))), defaultdict(list), 0

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        near = set()
        for t in sorted(s, key=lambda t: (df[t], t))[: len(s) - -(-percent * len(s) // 100) + 1]:
            near.update(index[t])
            index[t].append(i)
        for j in near:
            if find(i) != find(j) and linked(s, sets[j], percent):
                parent[find(i)], links = find(j), links + 1
    low = {}
    for i, (key, _) in enumerate(rows):
        low[find(i)] = min(key, low.get(find(i), key))
    return {key: low[find(i)] if sets[i] else key for i, (key, _) in enumerate(rows)}, links


def test_recall_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, links = exact_groups(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in queries.op8_superminhash(spark, "/root/testdata/sf0.1").collect()}
    assert links > 500 and got == want


def test_tables_are_deleted_after_use(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    out = near_dup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g")], "doc_id long, text string"))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before} == {"near-signed", "near-named"}
    assert out.count() == 3


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, text_of(rng, rng.choice([1, 3, 7, 9, 10, 25]))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"{text_of(rng, 8)} {items[i % 40][1]} {text_of(rng, 3)}") for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most in (8 << 20, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
        found.append(ordered(decontam.contamination(docs, bench).collect()))
    from test_llm import brute_contamination

    assert found[0] == found[1] == ordered(brute_contamination([tuple(r) for r in docs.collect()], items))


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_shards_of_far_and_repeated_ids(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", text_of(rng, 30)) for i in range(300)]
    rows += [(7, f"http://h/7/{i}", text_of(rng, 30)) for i in range(300)] + [(None, None, text_of(rng, 30)) for _ in range(200)]
    rows += [(2**63 - 1, "far", "x"), (-(2**63), "low", "y"), (2**62, "mid", text_of(rng, 40))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sharded = warc.sharded(pages, "page_id", "url", "html", 10_000)[0].where("kind = 1")
    sizes = {r.shard: r.bytes for r in sharded.groupBy("shard").agg(F.sum((F.octet_length("html") + 512) * F.col("times")).alias("bytes")).collect()}
    assert len(sizes) > 40 and max(sizes.values()) < 13_000
    # keys of shards don't overlap
    ends = sharded.groupBy("shard").agg(F.min(F.struct("page_id", "place")).alias("a"), F.max(F.struct("page_id", "place")).alias("b")).where("a.page_id IS NOT NULL").orderBy("shard").collect()
    assert all(tuple(x.b) < tuple(y.a) for x, y in itertools.pairwise(ends))
    few = warc.sharded(pages, "page_id", "url", "html", 10_000, most_shards=8)[0].select("shard").distinct().count()
    assert 4 <= few <= 9
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder, shard_bytes=40_000, file_bytes=4_000)
    assert ordered(warc.read_archives(manifest, folder).collect()) == ordered(brute_warc(rows))
    assert any(r.file.endswith("-00001.warc.gz") for r in manifest.collect())


def test_equal_rows_beyond_a_shard(spark, tmp_path):
    text = text_of(random.Random(6), 40)
    rows = [(None, "http://same", text)] * 400 + [(5, None, text)] * 300 + [(6, "", text), (6, None, text), (4, "http://first", text)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.sharded(pages, "page_id", "url", "html", 20_000)[0].where("kind = 1")
    sizes = {r.shard: r.rows for r in made.groupBy("shard").agg(F.sum("times").alias("rows")).collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 60 and sum(sizes.values()) == len(rows)
    names = []
    for k in (1, 5):
        folder = f"file://{tmp_path}/e{k}"
        manifest = warc.write_archives(pages.repartition(k), folder, shard_bytes=20_000, file_bytes=2_000)
        assert ordered(warc.read_archives(manifest, folder).collect()) == ordered(brute_warc(rows))
        names.append({r.file: r.sha256 for r in manifest.collect()})
    assert names[0] == names[1]


# --- 3 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("low, high", [(400, 1100), (300, 1000), (600, 900)])
def test_evolution_beats_best_fit(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 600)
    plain = packing.best_fit(sizes.tolist(), np.argsort(-sizes, kind="stable"), 2048).max() + 1
    first = packing.evolve(sizes, 2048, [], 1, generations=0)
    elite = packing.evolve(sizes, 2048, [], 1, generations=40)
    assert elite.max() + 1 < plain and elite.max() < first.max()
    assert np.bincount(elite, sizes).max() <= 2048 and set(elite) == set(range(elite.max() + 1))


def test_bins_are_filled_whole():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50):
        sizes = rng.integers(1, 60, n)
        bins = packing.filled(sizes, np.arange(n), 60)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sizes[b].sum() <= 60 for b in bins)
    assert packing.filled(np.array([50, 30, 20, 9, 1]), np.arange(5), 60) == [[0, 3, 4], [1, 2]]


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_scores_are_those_of_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 4))
    forest = quality.grow(x, np.ones(4), 1, trees=20, leaves=64)
    for row, score in zip(x[:40], forest.score(x[:40]), strict=True):
        paths = []
        for root in forest.roots:
            at = int(root)
            while forest.feature[at] >= 0:
                at = int(forest.left[at]) + int(row[forest.feature[at]] >= forest.split[at])
            paths.append(forest.path[at])
        assert score == pytest.approx(2 ** -(np.mean(paths) / forest.norm))


def test_verdicts_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [(i % 90, text_of(rng, rng.randint(12, 60)) + (" ### !!! ;;" * 9 if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [ordered(quality.judge(docs.repartition(n), labels, sample=60).select("doc_id", "n_words", "kept", F.round("anomaly", 9)).collect()) for n in (1, 7)]
    assert found[0] == found[1]


# --- 5, 9 -------------------------------------------------------------------------------------------------------------


def test_ids_after_the_last_end(spark, tmp_path):
    np.array([1, 2, 9, 3, 4, 5], "<u2").tofile(tmp_path / "a.ids")
    np.array([1, 9, 9], "<u2").tofile(tmp_path / "b.ids")
    files = lambda *x: spark.createDataFrame([(n,) for n in x], "file string")
    with pytest.raises(ValueError, match="after the last end"):
        token_scan.scan(files("a.ids", "b.ids"), f"file://{tmp_path}", 9)
    assert ordered((r.ordinal, r.start, r.n_tokens) for r in token_scan.scan(files("b.ids"), f"file://{tmp_path}", 9, block_bytes=2).collect()) == [(0, 0, 1), (1, 2, 0)]
    (tmp_path / "c.ids").write_bytes(b"\1\0\t")
    with pytest.raises(Exception, match="within an id"):
        token_scan.scan(files("c.ids"), f"file://{tmp_path}", 9)


def test_ids_that_do_not_fit(spark, tmp_path):
    docs, path = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), queries.tokenizer_file("word_bpe_49k.json")
    assert token_scan.width_of(path, queries.WORD_END) == "<u2" and token_scan.width_of(path, 70_000) == "<u4"
    with pytest.raises(Exception, match="does not fit"):
        token_scan.write_flat(docs, f"file://{tmp_path}/x", path, False, 70_000)
    assert [r.n_tokens for r in token_scan.token_counts(docs, path, False, 70_000).collect()] == [2]
    byte = queries.tokenizer_file("byte_bpe_50k.json")
    assert binary_out.bits_of(byte, 2) == 16 and binary_out.bits_of(byte, 1 << 20) == 21
    with pytest.raises(ValueError):
        binary_out.pack(np.array([70_000], np.uint32), 16)
    with pytest.raises(Exception, match="does not fit"):
        binary_out.write_packed(docs, f"file://{tmp_path}/y", byte, True, 70_000, 16)
    assert [r.n_tokens for r in binary_out.packed_documents(docs, byte, True, 70_000).collect()] == [3]


def test_damaged_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(binary_out, "BLOCK_IDS", 64)
    folder, ids = f"file://{tmp_path}", np.arange(500, dtype=np.uint32)
    writer = binary_out.Writer(folder, "x.lfbp", 13)
    writer.add(list(range(50)), ids, np.full(50, 10))
    writer.close()
    for a, b in ((0, 500), (63, 65), (64, 128), (5, 5), (499, 500), (130, 411)):
        assert binary_out.Reader(folder, "x.lfbp").span(a, b).tolist() == list(range(a, b))
    raw = bytearray((tmp_path / "x.lfbp").read_bytes())
    raw[32 + 64 * 13 // 8 + 3] ^= 1
    (tmp_path / "x.lfbp").write_bytes(raw)
    reader = binary_out.Reader(folder, "x.lfbp")
    assert reader.span(0, 64).tolist() == list(range(64)) and reader.span(128, 200)[0] == 128
    with pytest.raises(ValueError, match="damaged"):
        reader.document(7)


def test_packed_rows_of_one_id_are_dealt(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(400)], "doc_id long, text string")
    folder = common.shared_dir(spark, "packed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = binary_out.write_packed(docs, folder, queries.tokenizer_file("byte_bpe_50k.json"), True, 2, 16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and binary_out.read_packed(manifest, folder).count() == 400


# --- 6 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_rules_are_those_of_all_combinations(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(7)]
    rows = []
    for _ in range(260):
        t = [x for x in names if rng.random() < 0.45]
        bad = rng.random() < (0.9 if {"t0", "t1"} <= set(t) or "t2" in t and "t5" not in t else 0.15)
        rows.append((t, bad))
    least, confidence, lift = 12, 0.6, 1.5
    share = sum(b for _, b in rows) / len(rows)
    sure = {}
    for n in range(1, len(names) + 1):
        for combo in itertools.combinations(names, n):
            own = [b for t, b in rows if set(combo) <= set(t)]
            c = sum(own) / len(own) if own else 0
            if sum(own) >= least and c >= confidence and (c / share >= lift or c >= (1 + share) / 2):
                sure[frozenset(combo)] = c
    want = {(tuple(sorted(k)), round(c, 9)) for k, c in sure.items() if not any(p < k and sure[p] >= c for p in sure)}
    found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.0, confidence, lift, least).collect()
    assert {(tuple(r.tokens), round(r.confidence, 9)) for r in found} == want and len(found) == len(want) > 0


def test_query_keys_are_tokens(spark):
    got = spark.createDataFrame([("http://a.b/x?k=v&k2=&=z#f",)], "u string").select(url_rules.tokens_of(F.col("u")).alias("t")).first().t
    assert sorted(got) == ["fragment", "path=x", "query=k", "query=k2", "scheme=http", "word=a", "word=b"]


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_region_is_the_maximum():
    rng, weights = random.Random(6), {"in p": 1.0, "in div": 1.0, "tag p": -1.0, "tag div": -3.0, "tag b": -0.5, "in a": -1.5, "tag a": -0.5}
    for _ in range(200):
        parts = [rng.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a>", "</a>", "word", "two words", "one two three four"]) for _ in range(rng.randint(1, 25))]
        page = html_text.parse(" ".join(parts))
        scores = [len(v.split()) * weights.get(html_text._kind(e), 1.0) if w == "text" else weights.get("tag " + v, -0.5) for w, v, e in page.parts]
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]
        a, b = html_text.region(page, weights)
        assert sum(scores[a:b]) == pytest.approx(max(sums, default=0))


@pytest.mark.parametrize("page, want", [
    ('<article><p class="x>Hello there world</p><p class="y">Second one of them</p></article>', "Second one of them"),
    ('<article><p>First words of it</p><p class="x>Hello there world</p></article>', "First words of it"),
    ("<article><p title=don't>Whole text of it</p><p>and more</p></article>", "Whole text of it and more"),
    ('<article><p a"b c=\'d>e\' f = "g>h" i=>Whole text</p></article>', "Whole text"),
    ("<article><p>Before it all</p><section class='related-work'><p>Work of others is much like ours.</p></section><p>After it</p></article>", "Before it all Work of others is much like ours. After it"),
])
def test_quotes_and_names(page, want):
    assert html_text.extract(page, {"in p": 1.5, "tag p": -0.1}) == want


def test_nested_holders_take_linear_time():
    def seconds(n):
        page = "<div class=post>" * n + "<p>Text of the story, in full.</p>" + "</div>" * n
        began = time.perf_counter()
        assert html_text.extract(page, {"in p": 1.5, "tag p": -0.1, "tag div": -1.0}) == "Text of the story, in full."
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8_000) < 20 * max(0.02, seconds(1_000))


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_repeated_rows_have_places_of_their_own(spark):
    from ledgerflow.llm import sharding

    rows = spark.createDataFrame([(5, "same")] * 500 + [(i, "x") for i in range(50)], "doc_id long, text string").repartition(6)
    got = sharding.placed(rows, 4).collect()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert len(got) == 550 and all(sorted(p) == list(range(len(p))) for p in places.values()) and len({r.shard for r in got if r.doc_id == 5}) == 1
    assert zlib.crc32(b"same") == next(r.text_crc32 for r in got if r.doc_id == 5)
