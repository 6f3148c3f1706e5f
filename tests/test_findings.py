"""Rows of the findings of a review, by hand."""

import itertools
import os
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import small
from ledgerflow.functions import text as C
from ledgerflow.llm import near_dup, quality
from ledgerflow.operators import brands, classify, corpus, extract, fields, routing
from ledgerflow.plans import queries


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "body string").select(column(F.col("body")).alias("x")).first()["x"]


@pytest.mark.parametrize("body, code, value", [
    ("UMN:cad5ef6712ab@abc", "INR", None), ("UMN:AED12@abc", "INR", None), ("paid £7 UMN:cad5ef@abc", "GBP", "7.00"), ("USD500.Thanks", "USD", "500.00"), ("CAD 5 paid", "CAD", "5.00"), ("USD5k paid", "USD", "5.00"), ("AED1,200.50 spent", "AED", "1200.50"),
])
def test_a_code_within_an_identifier_is_no_currency(spark, body, code, value):
    assert one(spark, body, fields.currency) == code
    assert one(spark, body, fields.amount) == (value and Decimal(value))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_is_read_without_trying_forms_that_do_not_fit(spark):
    df = spark.createDataFrame([("31/12/2020",)], "body string").select(corpus.normal_date(F.col("body"), F.lit("2001-01-01").cast("timestamp")).alias("x"))
    assert plan(df).lower().count("gettimestamp") == 0
    assert plan(df).count("initcap") == 1


def test_amount_type_and_lower_case_are_found_once(spark):
    rows = spark.createDataFrame([("u", "m", "VM-ALPHBK", "Rs.5 debited from A/c XX1234 to SHOP1", None)], "user_id string, msg_id string, sender string, body string, ts timestamp")
    tx = extract.extract_transactions(rows, routing.institutions(spark))
    assert plan(tx).count(fields.RUPEES[0]) == 1
    assert plan(tx).count("lower(body") == 1  # in an explode, which nothing goes below
    assert tx.select("amount", "type", "merchant", "account_last4").first() == (Decimal("5.00"), "EXPENSE", "SHOP1", "1234")


def test_the_threshold_counts_all_labelled_rows(spark):
    """Few rows drawn for the trees, but the score that parts all rows is the same as the one counted by hand."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (3_000, 7)), rng.normal(4, 1, (600, 7))])
    rows = [(i < 3_000, *map(float, v)) for i, v in enumerate(x)]
    forest = quality.fit(spark.createDataFrame(rows, "good boolean, " + ", ".join(f"f{i} double" for i in range(7))).repartition(5), 300)
    score = forest.score(x)
    lost = (score[:3_000] >= forest.threshold).mean()
    assert lost <= quality.MOST_LOST and (score[3_000:] >= forest.threshold).mean() > 0.9
    gains = [(score[3_000:] >= t).mean() - quality.COST * (score[:3_000] >= t).mean() for t in np.unique(np.floor(score * quality.STEPS) / quality.STEPS) if (score[:3_000] >= t).mean() <= quality.MOST_LOST]
    assert abs(max(gains) - ((score[3_000:] >= forest.threshold).mean() - quality.COST * lost)) < 1e-9


def test_similar_words_are_scored_once_and_met_by_several_marks(spark, sf_dir):
    """a filter on the score below the distinct would score repeats; and words of other letters must not meet at all."""
    df = queries.c11_similar_words(spark, sf_dir)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    words = ["".join(c) for c in itertools.permutations("bcdfgh", 6)][:300]
    lists = [next(C._listed(iter([pa.RecordBatch.from_pydict({"word": w})]), lengths, 90)).column("keys").to_pylist() for w, lengths in ((words, [6]), ([w.translate(str.maketrans("bcdfgh", "bvwxyz")) for w in words], None))]
    assert not set().union(*lists[0]) & {k for keys, w in zip(lists[1], words, strict=True) if w[0] != "b" for k in keys}


def test_tasks_count_ngrams_before_any_is_shuffled(spark):
    """no row an n-gram and text leaves a task, for texts of one run a row an n-gram does; n-grams end where a text ends."""
    d = spark.createDataFrame([(i, "pay Rs.5 now" if i % 2 else "now go") for i in range(40)] + [(40, None), (41, "")], "doc_id int, text string").coalesce(1)
    y = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id int, quality int")
    model = classify.train(d, y, "quality", named=True)
    assert "Generate" not in plan(model)
    assert {tuple(r) for r in model.collect()} == {("pay", 0, 20), ("amt", 0, 20), ("now", 20, 20), ("go", 20, 0), ("pay amt", 0, 20), ("amt now", 0, 20), ("pay amt now", 0, 20), ("now go", 20, 0)}
    assert {tuple(r) for r in classify.ngrams(spark.createDataFrame([(1, "a b a b")], "doc_id int, text string")).collect()} == {(1, "a", 2), (1, "b", 2), (1, "a b", 2), (1, "b a", 1), (1, "a b a", 1), (1, "b a b", 1)}


def test_scores_are_the_same_however_few_ngrams_go_to_all_tasks(spark, monkeypatch):
    """what isn't among the commonest n-grams is joined, and none is lost; repeated ids sum up, null texts have the prior."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30) % 60) for _ in range(80)]
    d = spark.createDataFrame([*enumerate(texts), (80, None), (3, "w1 w2")], "doc_id int, text string").repartition(3)
    y = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id int, quality int")
    model, prior = classify.train(d, y, "quality"), classify.priors(y, "quality")
    got = []
    for common in (1 << 20, 20, 0):
        monkeypatch.setattr(classify, "COMMON", common)
        got.append(sorted(tuple(r) for r in classify.score(d, model, prior).select("doc_id", "score", "class").collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 82
    weights = {r.gram: r.w for r in classify.weights(classify.train(d, y, "quality", named=True), prior).collect()}
    hand: dict[int, float] = {}
    for i, text in [*enumerate(texts), (80, ""), (3, "w1 w2")]:
        w = text.split()
        hand[i] = hand.get(i, 0.0) + sum(weights.get(" ".join(w[j : j + n]), 0.0) for n in (1, 2, 3) for j in range(len(w) - n + 1))
    base = prior.first()
    assert all(abs(s - hand[i] - np.log(base.d0 / base.d1)) < 1e-5 for i, s, _ in got[0])


def test_steps_of_near_duplicates_drop_their_shuffle_files(spark, monkeypatch):
    """Disk of op8_superminhash: files of one step don't lie beside those of the next."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    real = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name, **options: (seen.append(spark.conf.get(key, "false")), real(df, name, **options))[1])
    before = spark.conf.get(key, "false")
    rows = [(i, "a b c d e f g h " + ("x" if i < 2 else str(i))) for i in range(4)]
    near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert set(seen) == {"true"} and spark.conf.get(key, "false") == before


def test_bands_are_dropped_before_sets_are_made(spark, monkeypatch):
    """Disk of op8_superminhash: no table with bands lies beside the sets, and buckets are counted in the one shuffle of their rows."""
    real, seen = near_dup.written, {}

    def written(df, name, **options):
        there = {n for n, t in seen.items() if os.path.exists(t.inputFiles()[0].removeprefix("file://"))}
        if name == "near-sets":
            assert {"near-signed", "near-classes"} <= there and not there & {"near-banded", "near-dealing", "near-placed"}
        if name == "near-placed":
            assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        seen[name] = out = real(df, name, **options)
        return out

    monkeypatch.setattr(near_dup, "written", written)
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x " + ("y" if i < 2 else f"{i} z{i} y{i} x{i} w{i} v{i} u{i} t{i} s{i}")) for i in range(4)] + [(4, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4} and "near-sets" in seen and "near-placed" in seen


@pytest.mark.parametrize("longest", [1, 2])
def test_matches_are_not_shuffled_by_their_phrase(spark, longest):
    """F16, F17: all places of a common phrase came into one task; of equal phrases the first by type and norm stays."""
    d = spark.createDataFrame([(1, "the sea of the sea"), (2, None)], "id int, text string")
    k = spark.createDataFrame([("The", "B", "x"), ("the", "A", "z"), ("the", "A", "y"), ("sea", "S", None)], "phrase string, type string, norm string")
    tags = corpus.tag_keywords(d, k, longest)
    assert "SortMergeJoin" not in tags._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tags.collect())) == [(1, 0, 1, "A", "y"), (1, 1, 2, "S", None), (1, 3, 4, "A", "y"), (1, 4, 5, "S", None)]


def test_tasks_that_sort_places_follow_the_bytes_of_the_input(spark, tmp_path, monkeypatch):
    """F16, F17: a task's rows grew with the input, as Spark joins partitions by the bytes of the shuffle."""
    path = str(tmp_path / "a b")
    spark.createDataFrame([(i, f"of the sea {i} of") for i in range(50)], "id int, text string").write.parquet(path)
    d, k = spark.read.parquet(path), spark.createDataFrame([("of the", "P", "p"), ("of", "O", "o"), ("sea", "S", "s")], "phrase string, type string, norm string")
    both = lambda: corpus.merge_spans(corpus.tag_keywords(d, k, 2), corpus.tag_keywords(d, k.where("phrase = 'sea'"), 1))
    before = sorted(map(tuple, both().collect()))
    size = sum(f.stat().st_size for f in tmp_path.glob("a b/*.parquet"))
    monkeypatch.setattr(small, "TASK_BYTES", -(-size // 9))
    assert small.spread(d, "id").rdd.getNumPartitions() == 9
    assert "REPARTITION_BY_NUM" in both()._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, both().collect())) == before
    assert small.spread(spark.createDataFrame([(1,)], "id int"), "id").rdd.getNumPartitions() != 9


def test_tasks_of_nearness_and_captures_follow_the_bytes_of_the_input(spark, tmp_path, monkeypatch):
    """they sort places as merged spans do, in tasks that grew with the input."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"of the {i} sea and x{i} of the shore") for i in range(50)], "id int, text string").write.parquet(path)
    words = corpus.tokens(spark.read.parquet(path))
    spans = words.where("word in ('of', 'the', 'and')").select("id", "pos", F.upper("word").alias("type"))
    for make in (lambda: corpus.near(spans, [(1, "THE", "AND", 3, ()), (2, "AND", "OF", 9, ("THE",))]), lambda: corpus.capture_between(words, ["the"], ["and"])):
        monkeypatch.setattr(small, "TASK_BYTES", 16 << 20)
        before = sorted(map(tuple, make().collect()))
        monkeypatch.setattr(small, "TASK_BYTES", 100)
        assert "REPARTITION_BY_NUM" in make()._jdf.queryExecution().executedPlan().toString()
        assert len(before) == 50 and sorted(map(tuple, make().collect())) == before


def test_similar_words_of_few_letters_are_not_left_out(spark, tmp_path):
    """F2 of round 4: words of documents of up to 4 letters were not looked at."""
    texts, items = ["A ab abc the word werd wodr", "wordy Words an", None, ""], ["a ab acb abcd words then", "teh word wordsmith", None]
    for name, values in (("documents", texts), ("benchmark", items)):
        spark.createDataFrame([(x,) for x in values], "text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    ours, theirs = ({w for x in values if x for w in x.lower().split()} for values in (texts, items))
    want = {(a, b, C.jaro_winkler(a, b)) for a in ours for b in theirs if C.jaro_winkler(a, b) > 0.9}
    assert {tuple(r) for r in queries.c11_similar_words(spark, str(tmp_path)).collect()} == want
    assert {("a", "a"), ("word", "words"), ("the", "then"), ("words", "word")} <= {x[:2] for x in want}


def test_the_wide_row_is_one_projection_and_one_shuffle(spark):
    """F1 of round 4: rows were shuffled by sender, by text and with themselves; rules see a text's lower case once."""
    r = [("u", "m1", "VM-ALPHBK", "Rs.5 debited from A/c XX1234 to SHOP1 on 2020-01-02", None), (None, "m2", None, "Your OTP is 123456. Flight delhi", None), ("u", "m3", "x", "a" * 6_000, None)]
    m = spark.createDataFrame(r, "user_id string, msg_id string, sender string, body string, ts timestamp")
    words = spark.createDataFrame([("otp", "OTP", "otp"), ("flight", "TRAVEL", "f")], "phrase string, type string, norm string")
    known = spark.createDataFrame([("shop1", "One", "A", True, 2), ("shop", None, None, False, 3)], "token string, brand string, category string, online boolean, ord int")
    banks = (spark.createDataFrame([("alphbk", "Alpha", 1)], "alias string, bank string, prio int"), spark.createDataFrame([("x", "xb", 1)], "alias string, raw string, prio int"), spark.createDataFrame([("Xb",)], "name string"))
    out = extract.wide(m, routing.institutions(spark), words, spark.createDataFrame([("ALPHBK", "BILL")], "alias string, category string"), known, banks, None, spark.createDataFrame([("delhi", "DEL")], "word string, code string"))
    got = {x.msg_id: (x.user_id, x.rich_type, x.category, x.tags, x.brand, x.payee, x.origin, x.otp_code, x.bank_name) for x in out.collect()}
    assert got == {"m1": ("u", "EXPENSE", "BILL", None, "One", "One", None, None, "Alpha"), "m2": (None, None, "OTP", {"OTP": ["otp"], "TRAVEL": ["f"]}, None, None, "DEL", "123456", None)}
    simple = extract.wide(m, routing.institutions(spark), None, None, known, banks)
    assert "Exchange hashpartitioning" not in simple._jdf.queryExecution().executedPlan().toString()
    assert len(simple.columns) == len(set(simple.columns))


def test_the_first_brand_is_the_same_however_large_the_dictionary(spark, monkeypatch):
    """F1 of round 4: few tokens are looked up where the texts are, many by a join; both are held against all pairs."""
    rng = np.random.default_rng(4)
    some = lambda n: "".join(rng.choice(list("abéC "), n))
    texts = [(i, None if i % 9 == 0 else some(i % 14), None if i % 7 == 0 else some(i % 20)) for i in range(150)]
    tokens = [(some(i % 6), None if i == 3 else f"b{i}", "c", None if i % 5 == 0 else i % 2 == 0, i // 2) for i in range(40)] + [("zzzz", "z", "c", True, 0), (None, "n", "c", True, 0), ("ab", "x", "c", True, 1)]
    r = spark.createDataFrame(texts, "id int, merchant string, body string").repartition(3)
    k = spark.createDataFrame(tokens, "token string, brand string, category string, online boolean, ord int")
    first = lambda s: min(((o, b or "", c, bool(n)) for t, b, c, n, o in tokens if t and s is not None and t.lower() in s.lower()), default=None)
    want = {i: (lambda h: (h[1] or None, h[2], h[3]) if h else (None, None, False))(first(m) or first(b)) for i, m, b in texts}
    for most in (1 << 24, 0):
        monkeypatch.setattr(small, "MOST_BYTES", most)
        assert {x.id: (x.brand, x.brand_category, x.online) for x in brands.brand_of(r, k, "id").collect()} == want
    empty = brands.brand_of(r, k.where("false"), "id")
    monkeypatch.setattr(small, "MOST_BYTES", 1 << 24)
    assert brands.brand_of(r, k.where("false"), "id").where("brand IS NOT NULL OR online").count() == empty.where("brand IS NOT NULL").count() == 0


def test_guards_of_patterns_lose_no_match(spark):
    """F1 of round 4: what the guards look for is in every text that a pattern matches."""
    bodies = ["auto-debit paid", "autodebited paid", "E-MANDATE sent", "ecs spent", "NACH withdrawn", "standing instruction paid", "Recharged successful", "wallet top-up", "wallet topped", "paid via AEPS", "Salary deposited", "sip paid", "SIP", "refunded", "spent at atm", "UMN: ab1@x", "umn=Q@y.z"]
    low = F.lower("body")
    got = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", fields.rich_type(F.col("body")).alias("t"), fields.rich_type(F.col("body"), low).alias("u"), fields.mandate_id(F.col("body")).alias("m")).collect()
    want = ["AUTO_DEBIT", "AUTO_DEBIT", "AUTO_DEBIT", "AUTO_DEBIT", "AUTO_DEBIT", "AUTO_DEBIT", "RECHARGE", "WALLET_CREDIT", "WALLET_CREDIT", "TRANSFER", "SALARY", "INVESTMENT", None, "INCOME", "ATM_WITHDRAWAL", None, None]
    assert [x.t for x in got] == want == [x.u for x in got] and [x.m for x in got[-2:]] == ["ab1@x", "q@y.z"]
    texts = {"otp": ["otp", "One Time Password", "verification code"], "travel": ["PNR", "flight", "boarding", "train no", "bus no"], "delivery": ["order", "shipment", "package", "parcel", "awb"], "bill": ["bill", "emi", "policy", "recharge", "mandate"], "offer": ["offers", "cashback", "discount", "coupon", "promo"], "telecom": ["data 5 gb", "pack mb", "balance validity"], "holdings": ["nav", "folio", "margin"]}
    for family, each in texts.items():
        rows = spark.createDataFrame([(b,) for b in each], "body string").select(fields.of_family(low, family).alias("x"), low.rlike(fields.PACKS[family][0]).alias("y")).collect()
        assert all(x.x and x.y for x in rows), family
    for bank, pattern in routing.BANK_PATTERNS:
        text = {"Alpha Bank": "ALPHA bank", "Beta Bank": "beta  BANK", "Gamma Card": "Gamma my card", "Sigma Bank": "sigma bk"}[bank]
        one_row = spark.createDataFrame([(text, "x"), ("x", text)], "body string, sender string").select(routing.bank_by_pattern(F.col("body"), F.col("sender")).alias("b")).collect()
        assert [x.b for x in one_row] == [bank, bank], pattern
