import datetime as dt

from pyspark.sql import functions as F

from riverbed.functions import calendar, dates, figures, text, web


def test_requests(spark):
    agents = ["Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Mobile", "Mozilla/5.0 (Windows NT 10.0)", "Googlebot/2.1", "", None, "Mozilla/5.0 (iPad; CPU OS 17)", "Mozilla/5.0 (Linux; Android 14; SM-X900) Safari", "Mozilla/5.0 (Linux; Android 14) Mobile Safari", "Mozilla/5.0 (Phone; OpenHarmony 5.0)"]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(agents)], "k int, a string")
    got = {r.k: tuple(r)[1:] for r in df.select("k", web.is_bot(F.col("a")), web.device(F.col("a")), web.system(F.col("a"))).collect()}
    assert got == {0: (False, "phone", "ios"), 1: (False, "desktop", "windows"), 2: (True, "desktop", "other"), 3: (True, "desktop", "other"), 4: (True, "desktop", "other"), 5: (False, "tablet", "ios"), 6: (False, "tablet", "android"), 7: (False, "phone", "android"), 8: (False, "phone", "harmony")}


def test_routes(spark):
    paths = spark.createDataFrame([("/en/items/5?x=1",), ("/en",), ("/about/#t",), ("/items/5/more",), ("/",)], "p string")
    assert [r[0] for r in paths.select(web.route(F.col("p"), ["/", "/about"], ["items"])).collect()] == ["/items/:id", "/", "/about", None, "/"]
    urls = spark.createDataFrame([("https://www.X.com:80/a",), ("mailto:x",)], "u string")
    assert [r[0] for r in urls.select(web.host(F.col("u"))).collect()] == ["x.com", None]


def test_page_text(spark):
    df = spark.createDataFrame([("  a\n b <b>c</b><script>x<y</script> & d ",)], "t string")
    row = df.select(web.without_tags(F.col("t")), web.truncated(F.lit("abcdef"), 4), web.truncated(F.lit("abcd"), 4), web.escaped(F.lit("<a&'b'>"))).first()
    assert tuple(row) == ("a b c & d", "abc…", "abcd", "&lt;a&amp;&#39;b&#39;&gt;")


def test_readings_of_dates(spark):
    assert dates.read_date("2024-02-29") == (dt.datetime(2024, 2, 29), "day")
    assert dates.read_date("2024-02-29T23:30+08:00") == (dt.datetime(2024, 2, 29, 15, 30), "minute")
    assert dates.read_date("Thu, 01 Feb 2024 10:00:05 GMT") == (dt.datetime(2024, 2, 1, 10, 0, 5), "second")
    assert dates.read_date("2024年2月1日 08:00") == (dt.datetime(2024, 2, 1, 0, 0), "minute")
    assert dates.read_date("2023-02-29") is None and dates.read_date(None) is None
    near = dt.date(2024, 1, 3)
    assert dates.written_days("on 30 December and 5 Jan, 2024-02-03, 12月31日, 5 de marzo de 2023, 31 February", near) == [dt.date(2023, 1, 5), dt.date(2023, 3, 5), dt.date(2023, 12, 30), dt.date(2023, 12, 31), dt.date(2024, 2, 3)]
    assert dates.written_days("quarter ended September 30, from 1 July to 30 September, 截至9月30日, 7月1日至9月30日; 18th of November 2023; 1er mars 2024", near) == [dt.date(2023, 7, 1), dt.date(2023, 11, 18), dt.date(2024, 3, 1)]
    assert dates.written_days("5 Jan and 2024-02-03", None) == [dt.date(2024, 2, 3)] and dates.read_date("0001-01-01T00:00+08:00") is None
    df = spark.createDataFrame([("2024-02-29", dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 1))], "t string, d date")
    got = df.select(dates.read_date_udf("t").alias("r"), dates.written_days_udf("t", "d").alias("w")).collect()
    assert got[0].r.precision == "day" and got[0].w == [dt.date(2024, 2, 29)] and got[1].w == []


def test_numbers(spark):
    assert [figures.han_number(t) for t in ("十二", "二百零五", "三万五千", "一亿二千万", "x", "")] == [12, 205, 35000, 120000000, None, None]
    assert [figures.spanish_number(t) for t in ("treinta y dos", "dos mil quinientos", "un millón doscientos mil", "perro")] == [32, 2500, 1200000, None]
    assert figures.readings("1,234.5") == [1234.5] and figures.readings("1.234") == [1.234, 1234.0] and figures.readings("1,23,4") == []
    assert figures.check("rose 5% to 3 million", "It rose 5% to 3,000,000") == ("ok", [])
    assert figures.check("30 million", "3 million")[0] == "soft" and figures.check("7", "3")[0] == "hard"
    rows = figures.checked(spark.createDataFrame([(1, "5", "5"), (2, None, None)], "id long, copy string, source string")).collect()
    assert [r.verdict for r in rows] == ["ok", "ok"]


def test_calendar(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 1, 31, 16, 0), dt.datetime(2024, 1, 31, 15, 59))], "a timestamp_ntz, b timestamp_ntz").select(calendar.local_day(F.col("a")), calendar.local_day(F.col("b")), calendar.local_midnight(F.lit(dt.date(2024, 2, 1))), calendar.week_label(F.lit(dt.date(2024, 12, 30))), calendar.add_months(F.lit(dt.date(2024, 3, 31)), -1)).first()
    assert tuple(row) == (dt.date(2024, 2, 1), dt.date(2024, 1, 31), dt.datetime(2024, 1, 31, 16), "2025-W01", dt.date(2024, 2, 29))


def test_functions_have_names(spark):
    text.register(spark)
    assert spark.sql("select normal_text('Ａb-1'), title_key('short')").first()[:] == ("ab1", None)
