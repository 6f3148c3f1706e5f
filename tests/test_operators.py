"""Edge rows by hand: boundaries, ties, traps of keywords, repeated delivery."""

import datetime as dt
import random
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schema
from ledgerflow.functions import small
from ledgerflow.functions import text as C
from ledgerflow.operators import brands, classify, corpus, extract, fields, gates, ledger, recurring, routing
from ledgerflow.sources import messages as M
from ledgerflow.streaming import ingest

NOW = dt.datetime(2024, 6, 30)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "body string").select(column(F.col("body")).alias("x")).first()["x"]


@pytest.mark.parametrize("body, reason", [
    ("Your OTP is 123456", "otp"), ("A special offer, Rs.5 paid back", "promo"), ("X has requested Rs.5", "request"), ("We have received payment of Rs.5", "received_notice"), ("Rs.5 is due", "due"), ("pls pay min of Rs.5", "due"), ("hello", "no_verb"), ("", "empty"), (None, "empty"),
    ("Rs.5 debited; footprint each twin gossip", None), ("Rs.5 paid", None),
])
def test_reject_reason(spark, body, reason):
    assert one(spark, body, gates.reject_reason) == reason


def test_substring_mode_keeps_the_traps(spark):
    assert one(spark, "Rs.5 debited footprint", lambda c: gates.reject_reason(c, "substring")) == "otp"


@pytest.mark.parametrize("body, value", [("Rs.11.8 paid", "11.80"), ("Rs 1,23,456.70", "123456.70"), ("INR 5", "5.00"), ("₹ 7.25", "7.25"), ("Rs. 0", None), ("none", None), ("$12 spent", "12.00")])
def test_amount(spark, body, value):
    got = one(spark, body, fields.amount)
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize("body, code", [("$5 paid", "USD"), ("€5", "EUR"), ("£5", "GBP"), ("¥5", "JPY"), ("₹5", "INR"), ("S$5", "SGD"), ("A$5", "AUD"), ("C$5", "CAD"), ("HK$5", "HKD"), ("NZ$5", "NZD"), ("5 units", "INR"), ("on JAN 5 spent Rs.4", "INR"), ("CHF 5 spent", "CHF"), ("5 euros", "EUR")])
def test_currency(spark, body, code):
    assert one(spark, body, fields.currency) == code


@pytest.mark.parametrize("body, name", [
    ("Photo Grocery Ref 1", None), ("paid to Corner Cafe", "Corner Cafe"), ("paid to Corner Cafe (north)", "Corner Cafe"), ("paid to BIG STORE PVT LTD on 2024-01-01", "BIG STORE"), ("paid to a@b from Baker Ref 12", "Baker"), ("paid to XX1234 at Diner", "Diner"), ("paid to 2024-01-01", None), ("paid to " + "y" * 400, None), ("paid to Tea House - north on 5", "Tea House"),
])
def test_merchant(spark, body, name):
    assert one(spark, body, fields.merchant) == name


def test_balance_sign_and_zero(spark):
    assert one(spark, "Avl Bal Rs.0", fields.balance) == Decimal("0.00")
    assert one(spark, "Avl Bal Rs.5.50 DR", fields.balance) == Decimal("-5.50")


def test_account_tail_is_no_date(spark):
    assert one(spark, "Card XX2024 used", fields.account_tail) == "2024"
    assert one(spark, "seen 12-01-2024", lambda c: F.when(gates.is_account_tail(c, F.lit("2024")), "x")) is None


def test_masked_tail(spark):
    assert one(spark, "XX12", fields.masked_tail) == "xx0012"
    assert one(spark, "****", fields.masked_tail) is None


def test_unicode(spark):
    assert one(spark, "é  x ", C.normalize_sms) == "é x"
    assert one(spark, "café ₹5 中", C.fold_ascii) == "cafe ₹5 "


def messages(spark, *rows):
    return spark.createDataFrame([(u, m, "VM-ALPHBK", b, t) for u, m, b, t in rows], schema.MESSAGE)


def test_repeated_messages(spark):
    day = dt.datetime(2024, 1, 1)
    body = "Rs.5 debited from A/c XX1234 to SHOP"
    tx = extract.extract_transactions(messages(spark, ("u1", "m1", body, day), ("u1", "m2", body, day), ("u2", "m3", body, day), ("u1", "m4", body, day + dt.timedelta(days=1)), ("u1", "m5", "x" * 5001 + " Rs.5 debited", day)), routing.institutions(spark))
    assert tx.schema.fieldNames() == schema.TRANSACTION.fieldNames()
    first = M.insert_new(tx, None)
    assert sorted((r.user_id, r.msg_id) for r in first.collect()) == [("u1", "m1"), ("u2", "m3")]
    assert M.insert_new(tx, first).count() == 0


def test_negation_is_out_of_totals(spark):
    tx = extract.extract_transactions(messages(spark, ("u", "m", "Rs.5 was not debited from A/c XX1234", NOW)), routing.institutions(spark))
    assert tx.first().flow == "none" and ledger.monthly_totals(tx, "type").count() == 0


def test_validation(spark):
    rows = spark.createDataFrame([("u", "1", "s", "b", NOW), ("u", "2", "", "b", NOW), ("u", "3", "s", None, NOW), ("u", "4", "s", "b", None)], schema.MESSAGE)
    ok, bad = M.validate_messages(rows)
    assert [r.msg_id for r in ok.collect()] == ["1"]
    assert {r.msg_id: r.reject_reason for r in bad.collect()} == {"2": "no_sender", "3": "no_body", "4": "bad_timestamp"}


def test_dictionary_contract(spark):
    kind = T.StructType([T.StructField("k", T.StringType()), T.StructField("p", T.StringType())])
    make = lambda *r: spark.createDataFrame(list(r), "k string, p string")
    assert M.load_dictionary(make(("a", "x+"), ("b", "y")), kind, ("k",), ("p",)).count() == 2
    for bad in (make(("a", "x"), ("a", "y")), make(("", "x")), make((None, "x"))):
        with pytest.raises(ValueError):
            M.load_dictionary(bad, kind, ("k",))
    with pytest.raises(ValueError):
        M.load_dictionary(make(("a", "x")).where("false"), kind, ("k",))
    with pytest.raises(ValueError):
        M.load_dictionary(make(("a", "x")).select("k"), kind, ("k",))
    with pytest.raises(Exception):
        M.load_dictionary(make(("a", "(")), kind, ("k",), ("p",)).count()


def spending(spark, *rows):
    return spark.createDataFrame([("u", f"m{i}", NOW - dt.timedelta(days=d), "EXPENSE", None, name, Decimal(a), cur) for i, (d, name, a, cur) in enumerate(rows)], "user_id string, msg_id string, ts timestamp, rich_type string, mandate_id string, merchant string, amount decimal(18,2), currency string")


@pytest.mark.parametrize("rows, want", [
    ([(0, "X", "10", "INR"), (20, "x.com", "10", "INR")], ("possible", 2)), ([(0, "X", "10", "INR"), (19, "X", "10", "INR")], None), ([(0, "X", "10", "INR"), (45, " X ", "10", "INR")], ("possible", 2)), ([(0, "X", "10", "INR"), (46, "X", "10", "INR")], None),
    ([(60, "X", "10", "INR"), (90, "X", "10", "INR")], ("possible", 2)), ([(61, "X", "10", "INR"), (91, "X", "10", "INR")], None), ([(0, "X", "11", "INR"), (30, "X", "10", "INR")], ("possible", 2)), ([(0, "X", "11.01", "INR"), (30, "X", "10", "INR")], None),
    ([(0, "X", "10", "INR"), (30, "X", "10", "INR"), (60, "X", "10", "INR")], ("likely", 3)), ([(0, "X", "10", "INR"), (30, "X", "10", "INR"), (33, "X", "10", "INR"), (63, "X", "10", "INR")], ("possible", 2)), ([(0, "X", "10", "INR"), (30, "X", "10", "USD")], None),
    ([(0, "X", "10", "INR"), (0, "X", "10", "INR"), (30, "X", "10", "INR")], ("possible", 2)),
])
def test_recurring(spark, rows, want):
    got = [(r.confidence, r["count"]) for r in recurring.recurring_charges(spending(spark, *rows), NOW).collect()]
    assert got == ([] if want is None else [want])


def test_balances_ties_and_masks(spark):
    rows = spark.createDataFrame([("u", "b", NOW, "B", "XX1234", Decimal(2), None, "s"), ("u", "a", NOW, "B", "1234", Decimal(1), None, "s"), ("u", "c", NOW - dt.timedelta(1), "B", "*1234", Decimal(3), "USD", "s"), ("u", "d", NOW, "B", None, Decimal(4), None, "s")], "user_id string, msg_id string, ts timestamp, bank_name string, account_last4 string, balance decimal(18,2), currency string, sender string")
    got = {r.last4: r for r in ledger.earlier_readings(ledger.account_balances(rows)).collect()}
    assert got["1234"].balance == 1 and [h.balance for h in got["1234"].history] == [3] and got[""].balance == 4


def test_totals_of_each_type(spark):
    kinds = schema.RICH_TYPES
    rows = spark.createDataFrame([("u", NOW, k, Decimal(1), "INR") for k in kinds] + [("u", NOW, "EXPENSE", Decimal(5), "USD"), ("u", NOW - dt.timedelta(40), "EXPENSE", Decimal(9), "INR")], "user_id string, ts timestamp, rich_type string, amount decimal(18,2), currency string")
    got = {r.currency: (r.income, r.expense, r.net) for r in ledger.monthly_totals(rows, as_of=NOW).collect()}
    assert got == {"INR": (2, 8, -6), "USD": (0, 5, -5)}


def test_mandate_first_seen_is_newest(spark):
    rows = spark.createDataFrame([("u", "m1", "s", NOW - dt.timedelta(5), "id", "active", "Old", Decimal(7)), ("u", "m2", "s", NOW, "id", "cancelled", "New", None)], "user_id string, msg_id string, sender string, ts timestamp, mandate_id string, status string, merchant string, amount decimal(18,2)")
    r = ledger.mandates(rows).first()
    assert (r.merchant, r.amount, r.status, len(r.history), r.history[0].status) == ("New", 7, "cancelled", 2, "cancelled")


@pytest.mark.parametrize("a, b, value", [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("abc", "abc", 1.0), ("", "x", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, value):
    assert C.jaro_winkler(a, b) == pytest.approx(value, abs=1e-4)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=60, deadline=None)
def test_lcs_against_all_substrings(a, b):
    subs = {a[i:j] for i in range(len(a)) for j in range(i, len(a) + 1)}
    assert C.lcs(a, b) == max((len(s) for s in subs if s in b), default=0)


def test_short_tokens_take_the_last_of_equal_keywords(spark):
    tokens = spark.createDataFrame([("tax",), ("ta",)], "token string")
    keys = spark.createDataFrame([("tax", 1), ("taxi", 2), ("ta", 3)], "keyword string, ord int")
    got = sorted(map(tuple, brands.token_matches(tokens, keys).collect()))
    assert ("ta", "ta") in got and all(k != "taxi" for t, k in got if t == "ta")


def test_phrases_are_leftmost_longest(spark):
    d = spark.createDataFrame([(1, "of the of the the")], "id int, text string")
    k = spark.createDataFrame([("of", "OF", "of"), ("the", "THE", "the"), ("of the", "PAIR", "p")], "phrase string, type string, norm string")
    assert sorted((r.pos, r.end, r.type) for r in corpus.tag_keywords(d, k, 2).collect()) == [(0, 2, "PAIR"), (2, 4, "PAIR"), (4, 5, "THE")]


@pytest.mark.parametrize("raw, day", [("2024-01-05", "2024-01-05"), ("05/01/2024", "2024-01-05"), ("5-Jan-24", "2024-01-05"), ("5 jan", "2023-01-05"), ("01/13/2024", "2024-01-13"), ("05-01-71", "1971-01-05"), ("1 Jan 2150", None), ("x", None)])
def test_normal_date(spark, raw, day):
    got = spark.createDataFrame([(raw,)], "r string").select(corpus.normal_date(F.col("r"), F.lit("2023-06-01").cast("timestamp")).cast("string").alias("d")).first().d
    assert got == day


def test_span_multiples(spark):
    d = spark.createDataFrame([(1, "Rs.2.5 lakh and Rs.3k, 10% by 10:30 on 5-Jan-2024 via XX1234, *99# 2 GB 7")], "id int, text string")
    got = {(r.kind, r.n): r.value for r in corpus.typed_spans(d).collect()}
    places = {(r.kind, r.n): (r.pos, r.end, r.word, r.word_end) for r in corpus.typed_spans(d).collect()}
    assert places["amount", 0] == (0, 11, 0, 4) and places["amount", 1] == (16, 21, 5, 7) and places["time", 0] == (30, 35, 9, 11)
    assert got["amount", 0] == 250000 and got["amount", 1] == 3000 and ("percent", 0) in got and ("time", 0) in got and ("date", 0) in got and ("account", 0) in got and ("ussd", 0) in got and ("data_size", 0) in got and got["number", 0] == 7


def test_stream_twice_adds_nothing(spark, tmp_path):
    rules = routing.institutions(spark)
    body = "Rs.5 debited from A/c XX1234 to SHOP"
    rows = messages(spark, ("u1", "m1", body, NOW), ("u1", "m2", body, NOW), ("u2", "m3", body, NOW), ("u2", "m4", "hello", NOW))
    source, out, state, rejects = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state", "rejects"))
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        ingest.stream_transactions(ingest.message_stream(spark, source), rules, out, state, rejects, trigger={"availableNow": True}).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert {r.reject_reason for r in spark.read.parquet(rejects).collect()} == {"no_verb"}
    assert spark.read.parquet(rejects).count() == 2  # one a delivery
    ingest.stream_transactions(ingest.message_stream(spark, source), rules, out, state + "2", rejects, trigger={"availableNow": True}).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_stream_keeps_late_messages(spark, tmp_path):
    """Days far apart and back, a file that comes twice, and a batch that runs again."""
    rules, day = routing.institutions(spark), lambda m, d: dt.datetime(2024, m, d)
    source, out, state, rejects = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state", "rejects"))
    sent = [(day(3, 1), 0), (day(3, 5), 10), (day(1, 1), 20), (day(3, 1), 0)]
    for when, first in sent:
        rows = [("u", f"m{first + i}", f"Rs.{first + i + 1} debited from A/c XX1234 to SHOP", when) for i in range(10)] + [("u", f"x{first}", "hello", when)]
        messages(spark, *rows).write.mode("append").parquet(source)
        ingest.stream_transactions(ingest.message_stream(spark, source), rules, out, state, rejects, trigger={"availableNow": True}).awaitTermination()
    assert sorted(r.msg_id for r in spark.read.parquet(out).collect()) == sorted(f"m{i}" for i in range(30))
    assert sorted(r.msg_id for r in spark.read.parquet(rejects).collect()) == ["x0", "x0", "x10", "x20"]
    # the last batch's commit is lost: it runs again and changes nothing
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    ingest.stream_transactions(ingest.message_stream(spark, source), rules, out, state, rejects, trigger={"availableNow": True}).awaitTermination()
    assert spark.read.parquet(out).count() == 30 and spark.read.parquet(rejects).count() == 4


def test_rules_of_unknown_fields(spark):
    with pytest.raises(ValueError, match="unknown"):
        extract.own_rules(spark.createDataFrame([("A", "colour", 1, "x", None)], extract.RULE))
    assert [r.field for r in extract.own_rules(None, spark)] == ["merchant", "reference", "merchant"]


@pytest.mark.parametrize("name, clean", [("- Acme Tools PVT LTD Ref 123 (ok)", "Acme Tools"), ("Corner (north) Cafe, Inc.", "Corner (north) Cafe"), ("Tea & Co Limited on 5 May", "Tea & Co"), ("A - B", "A"), ("Refill Shop at 10:30", "Refill Shop"), ("UPI", "UPI"), ("x  y", "x y")])
def test_cleanup(spark, name, clean):
    assert one(spark, name, fields.cleanup) == clean


@pytest.mark.parametrize("body", ["Rs.5 withdrawn from A/c XX1234 at ATM CITY3 on 2024-01-01", "Rs.5 debited from A/c XX1234 for SIP in folio no F123456", "Bill of Rs.5 for policy no PL123456 is due on 2024-01-01", "shipped. AWB AW1 for item I123456", "NAV of Rs.5 for folio no F123456 margin Rs.7"])
def test_papers_and_cash_machines_are_no_merchants(spark, body):
    assert one(spark, body, fields.merchant) is None


def test_brands_of_overlapping_tokens(spark):
    known = spark.createDataFrame([("ab", "AB", "x", True, 2), ("abc", "ABC", "y", False, 1), ("bc", "BC", "z", False, 3), ("ab", "LATE", "x", True, 9)], "token string, brand string, category string, online boolean, ord int")
    rows = spark.createDataFrame([(1, "xABx", "bc"), (2, "zabcz", None), (3, "none", "bBC"), (4, None, None), (5, "", "n")], "msg_id int, merchant string, body string")
    assert sorted((r.msg_id, r.brand, r.online) for r in brands.brand_of(rows, known).collect()) == [(1, "AB", True), (2, "ABC", False), (3, "BC", False), (4, None, False), (5, None, False)]
    assert brands.brand_of(rows, known.where("false")).where("brand IS NULL AND NOT online").count() == 5


def test_near_sees_what_lies_between(spark):
    spans = [(1, 0, "A"), (1, 2, "X"), (1, 3, "B"), (1, 10, "A"), (1, 11, "B"), (2, 0, "A"), (2, 1, "A"), (2, 3, "B"), (3, 0, "A"), (3, 9, "B"), (4, 5, "A"), (4, 5, "X"), (4, 6, "B")]
    rules = [(1, "A", "B", 3, ("A", "B"))]
    got = {tuple(r) for r in corpus.near(spark.createDataFrame(spans, "id int, pos int, type string"), rules).collect()}
    assert got == {(1, 1, 10, 11), (2, 1, 1, 3), (4, 1, 5, 6)}


def test_captures_go_to_the_stop_word(spark):
    many = [f"w{i}" for i in range(40)]
    texts = {1: f"so the {' '.join(many)} and more", 2: f"the {' '.join(many)} 7 end", 3: "the and the a b and", 4: "no such word"}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: (r.start, r.captured) for r in corpus.capture_between(corpus.tokens(d), ["the"], ["and"]).collect()}
    assert got == {1: (1, " ".join(many)), 2: (0, " ".join([*many, "end"])), 3: (2, "a b")}


def test_phrases_of_any_length(spark):
    d = spark.createDataFrame([(1, "From the Old Town of the North Sea port, today"), (2, "nothing of it")], "id long, text string")
    k = spark.createDataFrame([("old town of the north sea port", "PLACE", "port", "OTN", 1), ("north sea", "SEA", "sea", "NS", 2)], "phrase string, type string, norm string, code string, prio int")
    assert [tuple(r) for r in corpus.tag_keywords(d, k).collect()] == [(1, 2, 9, "PLACE", "port")]
    assert corpus.tag_keywords(d, k.where("false")).count() == 0
    assert [tuple(r) for r in routing.gazetteer(d, k, k.select(F.lit("sea").alias("word"), F.lit("S").alias("code"))).collect()] == [(1, "OTN")]


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    table = spark.range(100).withColumn("word", F.concat(F.lit("w"), "id"))
    marked = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert marked(small.small(table.join(small.small(table.select("word")), "word"), 0))
    assert not marked(table.join(small.small(table.select("word"), 99), "word"))
    assert marked(small.small(table.where("false"), 0)) and not marked(small.small(table, 99))
    d = spark.createDataFrame([(1, "From the Old Town to the sea"), (2, "nothing of it"), (3, None)], "id long, text string")
    k = spark.createDataFrame([("old town", "PLACE", "port"), ("sea", "SEA", "sea"), ("the sea", "SEA", "the")], "phrase string, type string, norm string")
    m = spark.createDataFrame([("VM-ALPHBK",), ("BETABK",), ("none",), (None,)], "sender string")
    found = lambda: (sorted(map(tuple, corpus.tag_keywords(d, k).collect())), sorted(map(tuple, routing.route_sender(m, routing.institutions(spark)).fillna("").collect())))
    before = found()
    monkeypatch.setattr(corpus, "small", lambda df: df)
    monkeypatch.setattr(routing, "small", lambda df: df)
    assert found() == before and len(before[0]) == 2


def test_spans_are_disjoint_and_words_cut_by_them_count_once(spark):
    texts = ["due 12-05-2024 10:30, 1,200 of 9876543210 and 5%", "Rs.500only x9 7kb", "no digits", None, "a\x01b 5\x03 6", "12", "x 1 2 3 y"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = corpus.typed_spans(d).orderBy("id", "pos").collect()
    for r in rows:
        assert texts[r.id][r.pos : r.end] == r.raw
    for x, y in zip(rows, rows[1:], strict=False):
        assert x.id != y.id or x.end <= y.pos
    assert [(r.kind, r.raw) for r in rows if r.id == 0] == [("date", "12-05-2024"), ("time", "10:30"), ("number", "1,200"), ("phone", "9876543210"), ("percent", "5%")]
    words = {(r.id, r.pos): r.word for r in corpus.tokens(d).collect()}
    assert [(r.word, r.word_end) for r in rows if r.id == 1][0] == (0, 2) and words[1, 1] == "500only" and words[1, 2] == "x9"
    assert [r.word for r in rows if r.id == 6] == [1, 2, 3]


def test_merge_of_many_spans_in_one_text(spark):
    rng = random.Random(2)
    span = lambda n, kind: [(1, p, p + rng.randint(1, 6), kind, None) for p in rng.sample(range(60_000), n)]
    typed, tags = span(10_000, "T"), span(10_000, "K")
    schema_ = "id int, pos int, end int, type string, norm string"
    began = time.time()
    got = {tuple(r) for r in corpus.merge_spans(spark.createDataFrame(typed, schema_), spark.createDataFrame(tags, schema_)).collect()}
    assert time.time() - began < 60
    covered = {i for _, a, b, _, _ in typed for i in range(a, b)}
    assert got == {*typed, *(t for t in tags if not covered & set(range(t[1], t[2])))}


def test_first_rule_that_holds_wins(spark):
    rng = random.Random(3)
    rules = [(1, "A", "B", 1, ()), (2, "B", "C", 4, ("A",)), (3, "A", "C", 9, ("A", "B", "C"))]
    spans = [(t, p, rng.choice("ABCX")) for t in range(80) for p in sorted(rng.sample(range(60), rng.randint(1, 9)))]
    want = {}
    for number, a, b, most, allowed in rules:
        for t in range(80):
            own = [(p, k) for i, p, k in spans if i == t]
            pairs = [(q - p, p, q) for p, k in own if k == a for q, m in own if m == b and 0 < q - p <= most + 1 and all(x in allowed for r, x in own if p < r < q)]
            if pairs:
                want.setdefault(t, (number, *min(pairs)[1:]))
    got = {r.id: tuple(r)[1:] for r in corpus.near(spark.createDataFrame(spans, "id int, pos int, type string"), rules).collect()}
    assert got == want and {w[0] for w in want.values()} == {1, 2, 3}


def test_long_texts_cost_as_their_length(spark):
    """A text of 60,000 words through the classifier and the captures."""
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(5000)}" if i % 9 else "the" for i in range(60_000)) + " and end"
    d = spark.createDataFrame([(1, text), (2, "w1 w2 w3"), (3, None), (4, "")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    began = time.time()
    model = classify.train(d, y, "quality")
    scores = {r.doc_id: r.score for r in classify.score(d, model, classify.priors(y, "quality")).collect()}
    assert set(scores) == {1, 2, 3, 4} and classify.train(d, y, "quality", named=True).count() == model.count()
    starts = corpus.capture_between(corpus.tokens(d, "doc_id"), ["the"], ["and"], "doc_id").collect()
    assert len(starts) == 1 and len(starts[0].captured.split()) == 59_999
    assert time.time() - began < 90


def test_containment_by_an_index(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abé c") for _ in range(n))
    texts, parts = [some(rng.randint(0, 12)) for _ in range(150)] + [None, ""], [some(rng.randint(0, 6)) for _ in range(60)] + [None, "a", "ab"]
    t, p = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x, i) for i, x in enumerate(parts)], "p string, i int")
    got = sorted((r.t, r.p, r.i) for r in C.containing(t, "t", p, "p").collect())
    assert got == sorted((x, y, i) for x in texts for i, y in enumerate(parts) if x is not None and y and y in x)
    assert C.containing(t, "t", p.where("false"), "p").count() == 0


def test_a_dictionary_of_a_million_tokens(spark):
    known = spark.range(1_000_000).select(F.concat(F.lit("tk"), F.lpad(F.conv("id", 10, 36), 6, "q")).alias("token"), F.col("id").cast("string").alias("brand"), F.lit("c").alias("category"), F.lit(True).alias("online"), F.col("id").cast("int").alias("ord"))
    rows = spark.range(200).select("id", F.concat(F.lit("x tk"), F.lpad(F.conv(F.col("id") * 4001, 10, 36), 6, "q"), F.lit(" y")).alias("merchant"), F.lit(None).cast("string").alias("body"))
    found = brands.brand_of(rows, known, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r.id: r.brand for r in found.collect()} == {i: str(i * 4001).upper() for i in range(200)}


def test_no_similar_pair_is_lost(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 11))) for _ in range(120)]
    edited = [w[:i] + rng.choice(["", "x", w[i : i + 1] * 2]) + w[i + 1 :] for w in base for i in [rng.randrange(len(w) + 1)]] + ["", "aaaa", "a" * 30]
    a, b = spark.createDataFrame([(w,) for w in base], "a string"), spark.createDataFrame([(w,) for w in edited], "b string")
    for gate in (90, 95):
        pairs = {tuple(r) for r in C.similar_candidates(a, b, gate).collect()}
        over = {(x, y) for x in base for y in edited if C.jaro_winkler(x, y) > gate / 100}
        assert over <= pairs and len(pairs) < len(set(base)) * len(set(edited)) / 3
    kept = brands.token_matches(a.withColumnRenamed("a", "token"), spark.createDataFrame([(w, i) for i, w in enumerate(edited)], "keyword string, ord int"))
    want = set()
    for t in set(base):
        want |= {(t, k) for k in edited if len(k) > 3 and k in t}
        if len(t) > 4:
            score, _, k = max((C.jaro_winkler(t, k), i, k) for i, k in enumerate(edited))
            want |= {(t, k)} if score > 0.9 else set()
        else:
            score, _, k = max((C.lcs(t, k), i, k) for i, k in enumerate(edited))
            want |= {(t, k)} if score and score >= len(k) - (len(k) > 4) else set()
    assert {tuple(r) for r in kept.collect()} == want


def test_histories_of_bounded_length(spark):
    rows = [("u", f"m{i:04d}", NOW + dt.timedelta(hours=i // 2), "B", "XX1234", Decimal(i), None, "s") for i in range(500)] + [("u", "x", NOW, None, None, Decimal(1), None, "s"), (None, "n", NOW, "B", None, Decimal(2), "USD", None)]
    r = spark.createDataFrame(rows, "user_id string, msg_id string, ts timestamp, bank_name string, account_last4 string, balance decimal(18,2), currency string, sender string")
    few, whole = ({x.user_id: x for x in ledger.account_balances(r, n).collect()} for n in (4, None))
    assert few["u"].balance == whole["u"].balance == 498 and few["u"].readings == 500 and few["u"].history == whole["u"].history[:4] and len(whole["u"].history) == 500
    assert few[None].readings == 1 and few[None].history == whole[None].history
    assert ledger.account_history(r).count() == 501


def test_a_batch_reads_its_users_and_months_only(spark, tmp_path, monkeypatch):
    row = lambda u, k, m: (f"u{u:03d}", f"t{u}-{k}", dt.datetime(2024, m, 1 + k), f"m{u}-{k}")
    tx = lambda *rows: spark.createDataFrame(list(rows), "user_id string, txn_id string, ts timestamp, msg_id string")
    path = f"file://{tmp_path}/t"
    M.write_transactions(tx(*[row(u, k, m) for u in range(60) for k in range(4) for m in (1, 2)]), path)
    batch = tx(row(7, 1, 1), row(7, 9, 1), row(8, 0, 1), row(99, 0, 1))
    for most in (10, 2):
        monkeypatch.setattr(ingest, "MOST_USERS", most)
        known = ingest.known_keys(batch, spark.read.parquet(path))
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert "month" in plan.split("PartitionFilters")[1].split("]")[0] and ("In(user_id" in plan) == (most == 10)
        assert known.count() == (8 if most == 10 else 240)
        assert sorted(r.txn_id for r in M.insert_new(batch, known).collect()) == ["t7-9", "t99-0"]
