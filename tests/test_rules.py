"""Rule cases at their boundaries, on a few rows each."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from riverbed.functions import text
from riverbed.operators import changes, graphs, heat, latest, ranks, search, series, similarity, visits
from riverbed.sources import html

AT = dt.datetime(2024, 1, 30, 12)


def ago(hours):
    return AT - dt.timedelta(hours=hours)


def test_heat_windows_are_open_below_and_closed_above(spark):
    rows = [(1, 1, True, ago(0)), (1, 2, False, ago(72)), (1, 3, False, ago(71.99)), (2, 1, False, ago(1)), (2, 2, False, ago(1)), (3, 1, True, ago(-1)), (4, 1, True, ago(24)), (4, 1, True, ago(48)), (4, 2, False, ago(24))]
    df = spark.createDataFrame(rows, "story long, participant long, editorial boolean, ts timestamp_ntz")
    got = {r.story: (r.heat, r.participants, r.editorial) for r in heat.ranking(df, F.lit(AT).cast("timestamp_ntz")).collect()}
    assert set(got) == {1, 4}  # 2 has no editorial signal, 3 lies ahead
    assert got[4] == (1.0, 2, 1)  # one participant counts once, by its latest signal
    assert got[1][1] == 2


def test_repeats_are_measured_from_counted_views():
    assert visits.suppress([0, 29, 30, 59, 60]) == [True, False, True, False, True]


def test_repeats_and_the_rate_cap(spark):
    base = dt.datetime(2024, 1, 1, 3)
    rows = [(1, "/a", base + dt.timedelta(minutes=m), m) for m in (0, 29, 30, 45, 60)] + [(2, f"/{k}", base, 100 + k) for k in range(70)]
    df = spark.createDataFrame(rows, "client long, path string, ts timestamp_ntz, event_id long")
    got = {r.event_id for r in visits.counted(df).filter("counted").collect()}
    assert {0, 30, 60} <= got and 29 not in got and 45 not in got
    assert sum(1 for e in got if e >= 100) == 60


def test_held_prices():
    one = lambda values, band=(0.5, 2.0): [next(iter(v.values())) for v in series.judge([{"a": v} for v in values], band)]
    assert one([100, 101, 203, 199, 198]) == ["accepted", "accepted", "released", "accepted", "accepted"]
    assert one([100, 201, 100, 50, 24]) == ["accepted", "discarded", "accepted", "accepted", "held"]
    assert one([100, 200, 399, 900]) == ["accepted", "accepted", "accepted", "held"] and one([100, 151, 151], (0.67, 1.5)) == ["accepted", "released", "accepted"]
    assert one([100, 0, None, -1, 100]) == ["accepted", "refused", "refused", "refused", "accepted"] and one([]) == []
    # the held value is neither confirmed nor is the new one plausible: it is held in its place
    assert one([100, 300, 1000, 1100]) == ["accepted", "discarded", "released", "accepted"]
    many = [{"a": 10, "b": 10, "c": 10}, {"a": 30, "b": 30, "c": 10}, {"a": 11, "b": 11, "c": 30}, {"a": 11}, {"a": 11, "b": 12, "c": 31}]
    assert series.judge(many, (0.5, 2.0)) == [
        dict.fromkeys("abc", "accepted"), dict.fromkeys("abc", "refused"), {"a": "accepted", "b": "accepted", "c": "released"}, {"a": "accepted"}, dict.fromkeys("abc", "accepted")
    ]


def test_percent_change_rounds_halves_away_from_zero(spark):
    df = spark.createDataFrame([("100.00", "100.05"), ("100.00", "99.95"), ("0", "1"), ("100", "100")], "before string, now string")
    got = [r[0] for r in df.select(series.percent_change(F.col("now").cast("decimal(10,2)"), F.col("before").cast("decimal(10,2)"))).collect()]
    assert [None if g is None else float(g) for g in got] == [0.1, -0.1, None, 0.0]


def test_representative_drops_what_is_three_points_below(spark):
    rows = [("g", 1, 50.0, 2, True, AT), ("g", 2, 47.0, 0, True, AT), ("g", 3, 48.0, 1, False, AT), ("h", 4, None, None, False, AT), ("h", 5, None, None, True, AT)]
    df = spark.createDataFrame(rows, "grp string, id long, score double, priority int, full_body boolean, seen_at timestamp")
    assert {r.grp: r.id for r in latest.representative(df, "grp").collect()} == {"g": 3, "h": 5}


def test_chains_cycles_and_dangling_pointers(spark):
    rows = [(k, k + 1) for k in range(1, 11)] + [(11, None), (20, 21), (21, 20), (30, 99)]
    got = {r.node: r.root for r in graphs.resolve_chain(spark.createDataFrame(rows, "node long, target long")).collect()}
    assert got[1] == 11 and got[11] == 11 and got[30] is None and got[20] is None
    longer = [(k, k + 1) for k in range(11)] + [(11, None)]
    got = {r.node: r.root for r in graphs.resolve_chain(spark.createDataFrame(longer, "node long, target long")).collect()}
    assert got[0] is None and got[1] == 11  # eleven hops are not followed, ten are


def test_components_and_threads(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (4, 5), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in graphs.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7}
    days = spark.createDataFrame([(1, None), (2, dt.date(2024, 2, 1)), (3, dt.date(2024, 1, 1)), (9, None)], "node long, day date")
    assert {r.node: r.thread for r in graphs.threads(edges, days).collect()} == {1: 3, 2: 3, 3: 3, 9: 9}


def test_fingerprints():
    body = "The price of copper rose today in quiet trading on the exchange. " * 6
    assert text.simhash64("short") is None
    assert text.simhash64(body) == text.simhash64(body.upper() + " !!")
    assert text.simhash64("a" * 199) is None and text.simhash64("a" * 200) is not None


def test_fingerprint_pairs_stop_at_six_bits(spark):
    a = 0x0123456789ABCDEF
    rows = [(1, a), (2, a ^ 0b111111), (3, a ^ (0b111111 | 1 << 40)), (4, a), (5, None)]
    got = {(r.a, r.b): r.apart for r in similarity.near_fingerprints(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert got == {(1, 2): 6, (2, 3): 1}


def test_title_keys_and_urls():
    assert text.title_key("Update：Ｃopper hits record!") == text.title_key("copper HITS  record")
    assert text.title_key("Copper") is None
    assert text.normalize_url("HTTP://www.Example.com:80/a/?b=2&utm_source=x&a=1#top") == "https://example.com/a/?a=1&b=2"
    assert text.normalize_url("ftp://x") is None and text.normalize_url(None) is None
    assert text.network_of("2001:db8:1:2:3::4") == "2001:db8:1:2::/64" and text.network_of("::ffff:1.2.3.4") == "1.2.3.4" and text.network_of("x") is None
    assert text.loose_equal("a�c", "abc") and not text.loose_equal("ab", "abc")
    assert text.normalize_url("http://a.com:8080/x/") == "https://a.com:8080/x" and text.normalize_url("https://m.a.com") == "https://m.a.com/"
    assert text.normalize_url("http://mp.weixin.qq.com/s?sn=3&chksm=1&mid=2&__biz=1&foo=9") == "https://mp.weixin.qq.com/s?__biz=1&mid=2&sn=3"
    assert text.key_amounts("It cost $1,234.5 or 12.34% of 3 tonnes") == ["pct:12.3", "t:3", "usd:1230"]
    assert text.key_amounts("US$144 million, €3,5 bn, USD 20k, 5 million tonnes") == ["eur:3500000000", "t:5000000", "usd:144000000", "usd:20000"]
    assert text.key_amounts("投资1.44亿美元，产量3.2万吨，涨幅5％，约2千万") == ["n:20000000", "pct:5", "t:32000", "usd:144000000"]
    assert text.key_amounts("in 2024, 12 people, 7 km, $0, 1.2.3 million") == ["usd:0"] and text.key_amounts(None) == []
    assert len(text.visitor_key("s", "day", "ip", "ua")) == 22


def test_similarities(spark):
    df = spark.createDataFrame([("night", "nacht"), ("", "abc"), ("abc", "abc")], "a string, b string")
    a, b = text.bigrams(F.col("a")), text.bigrams(F.col("b"))
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(text.overlap(a, b), text.jaccard(a, b)).collect()]
    assert got == [(0.25, 0.1429), (0.0, 0.0), (1.0, 1.0)]
    assert text.dice(["aa", "aa", "b"], ["aa", "c"]) == 0.4
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_search_terms_and_guards(spark):
    assert search.terms_of("铜价copper Rises a b c d e") == ["铜价", "copper", "rises", "a", "b", "c"]
    assert search.escaped("50%_\\") == "50\\%\\_\\\\"
    df = spark.createDataFrame([("New Mexico oil",), ("Mexico oil",), ("mexicoil",)], "t string")
    assert [r[0] for r in df.select(search.guarded(F.col("t"), "mexico", ["new mexico"])).collect()] == [False, True, False]


def test_state_changes_and_ledger(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k long, v string")
    assert {(r.k, r.op, r.v) for r in changes.changed(old, new, ["k"], ["v"]).collect()} == {(2, "upsert", "b"), (3, "remove", None), (4, "upsert", None)}
    assert {(r.k, r.v) for r in changes.merge_by_key(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, None)}
    ledger = spark.createDataFrame([(1, "x", "upsert", ago(2)), (2, "y", "upsert", ago(2)), (3, "x", "remove", ago(1)), (4, "z", "upsert", ago(-1)), (5, "w", "upsert", ago(3))], "seq long, article string, op string, visible_at timestamp")
    mark = changes.release_watermark(ledger, F.lit(AT)).first()[0]
    assert mark == 3
    assert {r.article for r in changes.snapshot(ledger, "article", F.lit(mark)).collect()} == {"y"}


def test_attention_and_edition(spark):
    rows = [(1, "a", "m", None, False, 12.0, 8.0), (1, "a", "m", None, False, 5.04, None), (2, "a", "m", "price_tick", False, 9.0, 9.0), (3, "b", "m", None, True, 9.0, 9.0), (4, "x", "m", None, False, 9.0, 9.0), (5, "a", "n", None, False, 9.0, 9.0)]
    votes = spark.createDataFrame(rows, "id long, tier string, kind string, noise string, unusable boolean, x double, y double")
    scored = ranks.attention(votes, {"m": {"x": 6, "y": 4}})
    assert sorted((r.id, r.tenths) for r in scored.collect() if r.tenths is not None) == [(1, 300), (1, 920), (2, 400), (3, 300), (4, 900)]
    got = {r.id: (r.tenths, r.votes, r.selected) for r in ranks.selected(scored, "id", {"a": 61.0, "b": 30.0}).collect()}
    assert got == {1: (1220, 2, True), 2: (400, 1, False), 3: (300, 1, True), 4: (900, 1, False), 5: (None, 0, False)}
    entries = spark.createDataFrame([("i", "s", 1, 60.0, 3, False, False), ("i", "s", 2, 60.0, 3, True, False), ("i", "t", 3, 90.0, 0, False, False), ("i", "t", 4, None, 0, False, True)], "issue string, story string, id long, score double, participants int, official boolean, follow_up boolean")
    seen = spark.createDataFrame([("t",)], "story string")
    assert {(r.id, r.weight) for r in ranks.edition(entries, seen).collect()} == {(2, 75.0), (4, 44.0)}


def test_draws():
    assert latest.balanced_draw({"a": 1, "b": 10, "c": 2}, 9) == {"a": 1, "b": 6, "c": 2}
    assert latest.balanced_draw({}, 5) == {}


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<nav><a href='/x'>no</a></nav><p>Hi <b>there</b> &amp; <script>var t='</p>'</script>you<p>End<a href=/y>y</a>"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in html.readable(pages).collect()} == {1: "Hi there & you\nEndy", 2: ""}
    assert [(r.href, r.label) for r in html.admitted(html.links(pages), ["/"], ["/x"]).collect()] == [("/y", "y")]


def test_spend_breaker(spark):
    from riverbed.operators import rollups

    day = lambda n: dt.date(2024, 1, n)

    def said(rows, first, today=10):
        df = spark.createDataFrame([(day(d), m) for d, m in rows], "day date, micros long")
        r = rollups.spend_breaker(df, F.lit(day(today)), F.lit(None if first is None else day(first)).cast("date"), floor=100, no_history=500, multiple=3, days=7).first()
        return r.micros, r.days, r.open, r.warning

    # days without spend are history too: 70 over 7 days are 10 a day
    assert said([(9, 70), (10, 101)], 1) == (101, 7, True, True) and said([(9, 70), (10, 100)], 1) == (100, 7, False, True)
    assert said([(9, 70), (10, 79)], 1) == (79, 7, False, False) and said([(9, 700), (10, 299)], 1) == (299, 7, False, True) and said([(9, 700), (10, 301)], 1) == (301, 7, True, True)
    # two days of history; what lies before the days is not counted
    assert said([(9, 100), (10, 151)], 8) == (151, 2, True, True) and said([(2, 9999), (9, 70), (10, 101)], 1)[2]
    # no history, or none with spend
    assert said([(10, 500)], None) == (500, 0, False, True) and said([(10, 501)], 10) == (501, 0, True, True) and said([(10, 399)], 1) == (399, 7, False, False)
    assert said([], 1) == (0, 7, False, False) and said([(9, 2**50), (10, 2**55)], 9)[2:] == (True, True)


def test_answers_against_decisions(spark):
    from riverbed.operators import meters

    answers = [("d1", 1, "star", 1), ("d1", 1, "no", 2), ("d1", 2, "star", 1), ("d1", 3, "yes", 1), ("d2", 4, "star", 1), ("d2", 5, None, 2), ("d2", 5, "yes", 1), ("d2", 6, "maybe", 1), ("d3", 7, "star", 1)]
    cards = [("d1", 1, "selected"), ("d1", 2, "selected"), ("d1", 3, "blocked"), ("d2", 4, "kept"), ("d2", 5, "selected"), ("d2", 9, "selected")]
    row = meters.tally(spark.createDataFrame(answers, "day string, id long, answer string, r int"), spark.createDataFrame(cards, "day string, id long, system string"), ["day", "id"], "day", ["r"]).first()
    assert row.asDict() == {"days": 3, "answered": 5, "no": 1, "yes": 1, "star": 3, "missed": 2, "extra": 1, "widened": 1}


def test_decks(spark):
    from riverbed.operators import latest

    rows = [("d", k, k % 3 == 0, None if k == 7 else float(k), 20.0, k % 13, k > 20) for k in range(40)] + [("e", 100, True, 1.0, 2.0, 0, False)]
    df = spark.createDataFrame(rows, "day string, id long, blocked boolean, score double, threshold double, gap int, selected boolean")
    for seats, split, blocked in ((12, 3, 4), (5, 3, 4), (2, 3, 4), (100, 3, 4)):
        got = latest.stratified_deck(df, seats, split, blocked, F.lit("s")).collect()
        h = lambda k: hashlib.sha256(f"{k}s".encode()).hexdigest()
        want = {}
        for r in sorted((r for r in rows if not r[2] and r[3] is not None and r[5] >= 10 and r[0] == "d"), key=lambda r: (-r[5], h(r[1])))[:split]:
            if len(want) < seats:
                want[r[1]] = "split"
        for r in sorted((r for r in rows if r[2] and r[0] == "d"), key=lambda r: h(r[1]))[:blocked]:
            if len(want) < seats:
                want[r[1]] = "blocked"
        for r in sorted((r for r in rows if not r[2] and r[3] is not None and r[0] == "d"), key=lambda r: (abs(r[3] - 20), h(r[1]))):
            if len(want) < seats and r[1] not in want:
                want[r[1]] = "near_pass" if r[6] else "near_miss"
        assert {r.id: r.kind for r in got if r.day == "d"} == want
        assert [r.id for r in sorted(got, key=lambda r: r.place) if r.day == "d"] == sorted(want, key=h) and [(r.id, r.kind, r.system, r.place) for r in got if r.day == "e"] == [(100, "blocked", "blocked", 1)]
