"""The five routes against a plain version, key names, and the functions written anew."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from riverbed.functions import dates, names, text
from riverbed.operators import recall, similarity

SCHEMA = "id long, fact long, seen_at timestamp_ntz, url string, hash string, names array<string>, amounts array<string>, documents array<string>, vector array<double>, grams array<string>"


def score(a, b):
    va, vb = a["vector"], b["vector"]
    if va is not None and vb is not None and len(va) == len(vb):
        n = math.sqrt(sum(x * x for x in va)) * math.sqrt(sum(x * x for x in vb))
        return (round(sum(x * y for x, y in zip(va, vb)) / n, 6) if n else 0.0), True
    ga, gb = set(a["grams"] or []), set(b["grams"] or [])
    return round(len(ga & gb) / min(len(ga), len(gb)), 6) if ga and gb else 0.0, False


def top(rows, n):
    best = {}
    for f, _, s in rows:
        best[f] = max(best.get(f, -9), s)
    keep = set(sorted(best, key=lambda f: (-best[f], f))[:n])
    return [r for r in rows if r[0] in keep]


def plain(queries, reports):
    out = set()
    for q in queries:
        routes = {"twin": [], "key": [], "document": [], "pool": []}
        for r in reports:
            if r["id"] == q["id"] or r["fact"] is None:
                continue
            s, exact = score(q, r)
            age = q["seen_at"] - r["seen_at"]
            row, past = (r["fact"], r["id"], s), dt.timedelta(0) <= age
            meet = lambda k: bool(set(q[k] or []) & set(r[k] or []))  # noqa: E731,B023
            if (q["url"] is not None and q["url"] == r["url"]) or (q["hash"] is not None and q["hash"] == r["hash"]):
                routes["twin"].append(row)
            if past and age < dt.timedelta(hours=72) and meet("names") and meet("amounts"):
                routes["key"].append(row)
            if past and age < dt.timedelta(days=720) and meet("documents"):
                routes["document"].append(row)
            if past and age < dt.timedelta(days=14) and s >= (0.6 if exact else 0.25):
                routes["pool"].append(row)
        facts = {}
        for name, rank, n in (("twin", 0, None), ("key", 1, 3), ("document", 2, 3), ("pool", 2, 10)):
            for f, i, s in routes[name] if n is None else top(routes[name], n):
                fact = facts.setdefault(f, {"rank": rank, "best": s, "members": {}})
                fact["rank"], fact["best"] = min(fact["rank"], rank), max(fact["best"], s)
                before = fact["members"].get(i, (s, False, False))
                fact["members"][i] = (s, before[1] or name == "twin", before[2] or name == "document")
        order = sorted(facts, key=lambda f: (facts[f]["rank"], -facts[f]["best"], f))[:20]
        for place, f in enumerate(order, 1):
            members = sorted(facts[f]["members"].items(), key=lambda m: (-m[1][0], m[0]))
            kept = [m for m in members if m[1][1]] + [m for m in members if not m[1][1]][:3]
            out |= {(q["id"], place, f, facts[f]["rank"], facts[f]["best"], i, s, twin, doc) for i, (s, twin, doc) in kept}
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = None if rng.random() < 0.4 else [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(rng.choice([4, 4, 4, 3]))]
        some = lambda letters, most: [rng.choice(letters) for _ in range(rng.randint(0, most))]
        rows.append((i, None if rng.random() < 0.05 else rng.randint(0, n // 4), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 40)), rng.choice([None, *"abcdefghij"]), rng.choice([None, *"klmnopqrst"]), some("ABCD", 2), some("123", 2), rng.choice([None, some("XYZUVW", 1)]), vector, rng.choice([None, [], sorted(set(some("abcdefghijklmnop", 9)))])))
    return rows


def test_equal_to_a_nested_loop(spark, monkeypatch):
    rows = made(220, 1)
    fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.filter("id % 5 = 0").withColumnsRenamed({"id": "query", "seen_at": "at"})
    as_dicts = [dict(zip(fields, r)) for r in rows]
    want = plain([r for r in as_dicts if r["id"] % 5 == 0], as_dicts)
    assert {tuple(r) for r in recall.candidates(asked, df).collect()} == want and len(want) > 300
    monkeypatch.setattr(recall, "BLOCK", 7)
    got = {tuple(r) for r in recall.candidates(asked.withColumn("part", F.lit(1)), df.withColumn("place", F.lit(1))).collect()}
    assert got == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert recall.candidates(df.withColumnsRenamed({"id": "query", "seen_at": "at"}), df).count() == 0


def test_key_names(spark):
    df = spark.createDataFrame([(1, "Rio Tinto approves US$144 million for Resolution Copper Mining in New Mexico"), (2, "BHP and Glencore; ACME Corp. said Gold Group"), (3, "mexico"), (4, None), (5, "Éxito Años Perú-Norte")], "k int, t string")
    got = {r.k: r.n for r in df.select("k", names.key_names(F.col("t"), {"mx": [r"(?<!New )Mexico"], "rio": ["Rio Tinto", "力拓"]}).alias("n")).collect()}
    assert got[1] == ["co:rio", "nm:mexico", "nm:new mexico", "nm:resolution", "nm:rio tinto"] and got[2] == ["nm:acme corp", "nm:glencore"]
    assert got[3] == got[4] == [] and got[5] == ["nm:norte"]


def test_shared_key_fact(spark):
    from riverbed.operators.grouping import shares_fact

    df = spark.createDataFrame([("力拓批准1.44亿美元投资 Resolution Copper", "Rio Tinto approves US$144 million for Resolution Copper"), ("Resolution Copper costs $5", "Resolution Copper costs $6"), (None, "x")], "a string, b string")
    n = lambda c: names.key_names(F.col(c))
    q = lambda c: text.key_amounts_udf(c)
    assert [r[0] for r in df.select(shares_fact((n("a"), n("b")), (q("a"), q("b")))).collect()] == [True, False, False]


def test_fingerprints_of_many_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc дё中文字 .,") for _ in range(rng.choice([10, 300, 700]))) for _ in range(40)] + [None, "", "x" * 10_000]
    import hashlib

    def one(t):
        plain = text.normal_text(t)[:6000]
        if len(plain) < 200:
            return None
        votes = [0] * 64
        for s in {plain[i : i + 4] for i in range(len(plain) - 3)}:
            bits = int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "little")
            votes = [v + (1 if bits >> k & 1 else -1) for k, v in enumerate(votes)]
        out = sum(1 << k for k, v in enumerate(votes) if v > 0)
        return out - (1 << 64) if out >> 63 else out

    assert text.simhashes(texts) == [one(t) for t in texts] == [text.simhash64(t) for t in texts]


def test_near_fingerprints_find_all_pairs(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for bits in (1, 3, 6, 7):
            q = p
            for k in rng.sample(range(64), bits):
                q ^= 1 << k
            prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(i, j): (prints[i] ^ prints[j]).bit_count() for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 6}
    for expected in (1, 1 << 20):
        found = similarity.near_fingerprints(spark.createDataFrame(list(enumerate(signed)), "id long, fp long"), expected=expected).collect()
        assert {(r.a, r.b): r.apart for r in found} == want and len(found) == len(want)


def test_title_pairs_find_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 12, 40, 120, 280]))) for _ in range(25)]
    titles = base + ["".join(c if rng.random() > 0.1 else rng.choice("xyz") for c in b) for b in base for _ in range(3)] + ["", "a", "ab", None]
    rows = [(k, t, rng.choice(["s", "t", None])) for k, t in enumerate(titles)]
    sets = {}
    for k, t, s in rows:
        plain = text.normal_text(t)[:300]
        if len(plain) > 1:
            sets.setdefault((s, plain), k)
    nodes = [(k, s, {p[i : i + 2] for i in range(len(p) - 1)}) for (s, p), k in sets.items()]
    want = {(min(a, b), max(a, b)): round(len(x & y) / len(x | y), 6) for n, (a, s, x) in enumerate(nodes) for b, u, y in nodes[n + 1 :] if s == u and len(x & y) >= 0.6 * len(x | y)}
    got = similarity.title_pairs(spark.createDataFrame(rows, "id long, title string, s string"), ["s"], 0.6).collect()
    assert {(r.a, r.b): r.score for r in got} == want and len(want) > 20


def test_days_and_ranges():
    near = dt.date(2024, 6, 30)
    days = lambda t: [d.isoformat() for d in dates.written_days(t, near)]
    assert days("1-5 March 2024; 1st to 5th May") == [] and days("on 5 March 2024") == ["2024-03-05"]
    assert days("3月1日到3月5日，2024年4月2日") == ["2024-03-01", "2024-04-02"]
    assert days("the year to 30 June, friend ended 3 May; it bended 4 May") == ["2024-05-04"]
    assert days("terminado el 31 de marzo de 2024 y 5 de abril de 2024") == ["2024-04-05"]
    assert days("from 10 May 2024 until 12 May 2024 and 2024-01-02 - 2024-01-09") == ["2024-01-02", "2024-05-10"]
    assert days(None) == [] and days("31 February 2024") == []


def test_amounts_beside_each_other():
    assert text.key_amounts("5 usd 10 million") == ["n:10000000", "usd:5"] and text.key_amounts("rs. 5, rs 6 and cars 7") == ["inr:5", "inr:6"]
    assert text.key_amounts("3m 3mm 2K 4 Mn 5万吨 6吨") == ["n:2000", "n:3000000", "n:4000000", "t:50000", "t:6"] and text.key_amounts("US$1,5 $1,500 $1,50,00") == ["usd:1.5", "usd:1500"]


def test_common_keys_meet_within_their_time(spark):
    """Of reports that share a document all through the years, a join hands on those about the time of the query."""
    import datetime

    start = datetime.datetime(2000, 1, 1)
    schema = "id long, fact long, seen_at timestamp_ntz, url string, hash string, names array<string>, amounts array<string>, documents array<string>, vector array<double>, grams array<string>"
    every = spark.createDataFrame([(k, k, start + datetime.timedelta(days=30 * k), None, None, ["n"], ["1"], ["d"], None, None) for k in range(200)], schema)
    asked = every.filter("id = 190").withColumnsRenamed({"id": "query", "seen_at": "at"})
    out = recall.candidates(asked, every)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and ("document#" in x or "amount#" in x)]
    assert joins and all("stretch#" in x for x in joins)
    assert {r.id for r in out.collect()} <= set(range(166, 190))
