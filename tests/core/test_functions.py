import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from agora_spark.functions import dates, geo, price, sets, text
from agora_spark.operators import eligibility, graph, happenings, likeness, places
from agora_spark.sources import lake


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_folding(spark):
    r = one(spark, text.fold_text(F.lit("LAÇA,  Pina!")), text.normalize_title(F.lit("  O Homem  do Fraque-Verde ")), text.fold_ascii(F.lit("Bar do Zé 2")), text.fold_text(F.lit(None).cast("string")))
    assert tuple(r) == ("laca pina", "o homem do fraque-verde", "bardoze2", "")


def test_names(spark):
    cases = [("bar azul", "bar azul", True), ("bar", "bar azul", False), ("barra", "barra azul", True), ("", "", False)]
    for a, b, want in cases:
        assert one(spark, text.names_match(F.lit(a), F.lit(b)))[0] is want


def test_mentions_and_handles(spark):
    r = one(spark, text.mentions(F.lit("oi @bar.azul. e a@b.com, @bar.azul @x_1")), text.normalize_handle(F.lit(" @@Bar?x")), text.normalize_handle(F.lit("@")))
    assert tuple(r) == (["bar.azul", "x_1"], "bar", None)


def test_markers(spark):
    r = one(spark, text.event_markers(F.lit("Sábado às 22h, dia 25/12, INGRESSOS na pista")), text.event_markers(F.lit("bom dia")))
    assert tuple(r) == (["date", "weekday_time", "term:ingressos", "term:ingresso", "term:pista"], [])


def test_redaction_and_pseudonyms(spark):
    m = F.create_map(*(F.lit(x) for x in ("Token", "t", "a", "pub_0123456789abcdef", "b", "fine")))
    assert one(spark, text.redact(m))[0] == {"a": text.MASK, "b": "fine"}
    assert one(spark, text.hmac_sha256("sécret", F.lit("ué")))[0] == hmac.new("sécret".encode(), "ué".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("label,low,high,crowd,want", [(None, 40.0, None, None, (2, "google_range")), (None, None, 39.9, 4, (1, "google_range")), ("PRICE_LEVEL_EXPENSIVE", None, None, 1, (3, "google_enum")), (None, None, None, 0, (None, None)), (None, 100.0, 120.0, None, (4, "google_range"))])
def test_price(spark, label, low, high, crowd, want):
    lit = lambda v, t: F.lit(v).cast(t)
    assert tuple(one(spark, price.price_signal(lit(label, "string"), F.lit("BRL"), lit(low, "double"), lit(high, "double"), lit(crowd, "int")))[0]) == want
    assert one(spark, price.range_tier(F.lit("EUR"), lit(low, "double"), lit(high, "double")))[0] is None


def test_freshness_and_windows(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    at = lambda s: dates.freshness(dates.parse_gmttime(F.lit(s)), now, 10)
    assert tuple(one(spark, at("2024-01-01T11:50:01Z"), at("2024-01-01 11:50:00"), at("soon"), at("Monday 2024-01-01 11:55 AM"))) == ("fresh", "stale", "unparseable", "fresh")
    assert [dates.max_age_minutes(x) for x in (None, 1, 120, 121)] == [10, 5, 240, 10]
    ts = lambda s: F.lit(s).cast("timestamp")
    near = lambda a, b: sets.in_window(ts(a), ts(b))
    assert tuple(one(spark, near("2024-01-01 04:00:00", "2024-01-02 01:00:00"), near("2024-01-01 23:00:00", "2024-01-02 04:00:00"), near("2024-01-01 04:00:00", "2024-01-02 05:00:00"), near(None, "2024-01-01 00:00:00"))) == (True, True, False, False)


def test_roll_forward(spark):
    d = lambda s: F.to_date(F.lit(s))
    roll = lambda c, a: dates.roll_forward(d(c), d(a))
    r = one(spark, roll("2024-05-01", "2024-04-01"), roll("2024-03-01", "2024-04-01"), roll("2024-01-01", "2024-06-01"), roll("2024-02-29", "2024-12-01"))
    day = dt.date
    assert [tuple(x) for x in r] == [(day(2024, 5, 1), False), (day(2024, 3, 1), True), (day(2025, 1, 1), True), (None, False)]


def test_bands(spark):
    a = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    r = one(spark, sets.band(a("x"), a("x", "y")), sets.band(a("x", "z"), a("x", "y")), sets.band(a("x"), a("y")), sets.band(a(), a("y")))
    assert tuple(r) == ("auto", "suggest", "refuse", "refuse")


def test_haversine_and_cells_equal_the_nested_loop(spark):
    df = spark.range(300).select(F.col("id"), (F.lit(-8.0) + (F.col("id") * 37 % 101) / 50).alias("lat"), (F.lit(-34.0) + (F.col("id") * 53 % 97) / 50).alias("lng"))
    for km in (1, 9, 40):
        got = {(r.id, r.other_id) for r in places.near_pairs(df, df, km).collect()}
        b = df.select(*(F.col(c).alias(f"o{c}") for c in df.columns))
        want = {(r.id, r.oid) for r in df.join(b, geo.haversine_km(F.col("lat"), F.col("lng"), F.col("olat"), F.col("olng")) <= km).collect()}
        assert got == want


def test_eligibility_boundaries(spark):
    rules = {"google": ["gym"], "crowd": ["OFFICE"], "hard": ["clinic"], "ambiguous": ["market"]}
    rows = [("", "BAR", None), ("A", None, "Gym"), ("A", "office", None), ("My Clinic", None, None), ("My Clinic", None, "bar"), ("Market", None, None), ("Market", None, "shop"), ("A", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, c string, g string")
    good = F.coalesce(F.lower("g") == "bar", F.lit(False))
    got = [tuple(r.v) for r in df.select("i", eligibility.decide(F.col("n"), F.col("c"), F.col("g"), rules, good).alias("v")).orderBy("i").collect()]
    assert got == [(False, "empty_name", "high"), (False, "google_type", "high"), (False, "besttime_type", "high"), (False, "name_keyword", "high"), (True, None, "high"), (False, "name_keyword", "low"), (False, "name_keyword", "high"), (True, None, "high")]


def test_closures(spark):
    t = lambda day: f"2024-{day} 00:00:00"
    rows = [("a", 1, t("05-01"), "it is closed forever"), ("a", 2, t("01-01"), "nice"), ("b", 1, t("05-01"), "closed forever"), ("b", 2, t("04-01"), "nice"), ("c", 1, t("05-01"), "maybe closed forever"), ("d", 1, None, "closed forever"), ("e", 1, t("05-01"), "nice"), ("e", 2, t("04-30"), "closed forever")]
    df = spark.createDataFrame(rows, "venue_id string, review_id int, published string, text string").withColumn("published", F.col("published").cast("timestamp"))
    got = {r.venue_id: (r.closed, r.confidence) for r in eligibility.closure_signals(df, ["closed forever"], ["maybe"]).collect()}
    assert got == {"a": (True, "high"), "b": (True, "low"), "c": (False, "high"), "e": (False, "high")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_upsert_and_richest(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    delta = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in places.keyed_latest(base, delta, ["k"], "n").collect()) == [(1, "c", 1), (2, "b", 5), (3, "e", 1)]
    rows = spark.createDataFrame([("x", 1, 3, 1), ("x", 2, 3, 0), (None, 3, 0, 0), (None, 4, 0, 0)], "key string, id int, n_images int, line int")
    assert sorted(r.id for r in happenings.richest(rows, ["key"]).collect()) == [2, 3, 4]


def test_lake_round_trip(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").limit(50)
    env = lake.envelope(e, "events", "app", F.col("props"), params=F.create_map(F.lit("key"), F.lit("s"), F.lit("a"), F.lit("b")))
    lake.write(env, str(tmp_path / "lake"))
    back = lake.read(spark, str(tmp_path / "lake"), "payload string, request_params map<string,string>, local_date string", "events", "2024-01-01")
    assert back.count() == 50 and back.first().request_params == {"a": "b"}


def test_streams(spark, tmp_path, sf_dir):
    from agora_spark import streaming
    from agora_spark.operators import engagement
    from agora_spark.sources import standins

    events = standins.engagement(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.like_stream(stream, "60 days").writeStream.format("memory").queryName("likes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("likes").count() == engagement.likes(events).count()
    lake_rows = lake.envelope(stream, "events", "app", F.col("props"))
    streaming.write_lake(lake_rows, str(tmp_path / "lake"), str(tmp_path / "ck"), at_once=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "lake")).count() == events.count()


def test_links_are_ranked_over_all_pairs(spark):
    import difflib

    # (name, its letters, its core), by hand
    names = [("Barzinho", "barzinho", "barzinho"), ("Bar zinho", "barzinho", "zinho"), ("Mercado", "mercado", "mercado"), ("Restaurante Parraxaxa Boa Viagem", "restauranteparraxaxaboaviagem", "parraxaxa"), ("Bercy", "bercy", "bercy"), ("Café São Ciro", "cafesaociro", "saociro"), ("Xyz", "xyz", "xyz")]
    texts = [("Barzinho", "barzinho"), ("Mercadao", "mercadao"), ("parraxaxaoficial", "parraxaxaoficial"), ("bercyvillage", "bercyvillage"), ("cafe sao ciro", "cafesaociro"), ("!!", ""), ("com @mercado", None), (None, None)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()

    def score(name, letters, core, text, other):
        plain = ratio(name.lower(), text.lower())
        if not other:
            return plain
        if len(core) >= 5 and (core in other or other in core) and min(len(core), len(other)) / max(len(core), len(other)) >= 0.5:
            return max(plain, 0.95)
        return max(plain, ratio(letters, other), ratio(core, other))

    want = {}
    for k, (text, other) in enumerate(texts):
        scores = [] if other is None else sorted((-s, n[0]) for n in names if (s := score(*n, text, other)) > 0)
        for r, (s, name) in enumerate(scores):
            ahead = len(scores) == 1 or round(-s, 4) - round(-scores[1][0], 4) >= 0.08
            if r < 2:
                want[k, name] = (pytest.approx(-s, abs=6e-5), r + 1, r == 0 and -s >= 0.55 and ahead)
    mentions = spark.createDataFrame([(k, t[0]) for k, t in enumerate(texts)], "event_id long, text string")
    places = spark.createDataFrame([(n[0], n[0]) for n in names], "place string, name string")
    got = {(r.event_id, r.place): (r.score, r.rank, r.linked) for r in likeness.ranked_links(mentions.selectExpr('*', 'CAST(NULL AS DOUBLE) AS lat', 'CAST(NULL AS DOUBLE) AS lng'), places.selectExpr('*', '1.0D AS lat', '2.0D AS lng')).collect()}
    assert got == want
    assert not got[0, "Barzinho"][2] and got[1, "Mercado"][2] and got[2, "Restaurante Parraxaxa Boa Viagem"][2]


def test_undated_twins(spark):
    at = dt.datetime(2024, 1, 10)
    dated = [(1, 7, "Bar Azul", "h", "Samba do Zé Show", at), (2, 8, "Outro", "h", "samba ze", at), (3, 7, "Bar Azul", "x", "samba ze", at), (4, 7, "Bar Azul", "h", "show", at), (5, 7, "Bar Azul", "h", "31", at)]
    undated = [(k, 7, "Bar Azul", "h", title, at + dt.timedelta(days=days)) for k, title, days in [(10, "Zé: SAMBA, live no Azul", 14), (11, "samba ze", 15), (12, "samba", 1), (13, "live band", 1), (14, "31 show", -14)]]
    schema = "event_id long, venue long, venue_name string, handle string, title string, {} timestamp"
    got = happenings.undated_twins(spark.createDataFrame(undated, schema.format("posted")), spark.createDataFrame(dated, schema.format("starts_at")), ["show", "live", "band"], ["do", "no"])
    assert {tuple(r) for r in got.collect()} == {(10, 1), (14, 5)}


def test_undated_twins_equal_sql_where_there_are_some(spark):
    import duckdb

    from agora_spark.plans import catalog

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalog.ORACLES["undated_twins"]).fetchall()
    assert want and sorted(want) == sorted(map(tuple, catalog.QUERIES["undated_twins"](spark, sf).collect()))


def test_folding_of_all_marked_letters(spark):
    import unicodedata

    names = [("Čeští Žižkov", "cesti zizkov"), ("Hőség Űr", "hoseg ur"), ("Dağ Ąę Ā", "dag ae a"), ("Phở Việt", "pho viet"), ("ﬁlé Ｂａｒ", "file bar"), ("Straße", "strasse"), ("Bar 2", "bar 2")]
    rows = [(k, form, unicodedata.normalize(form, name), want) for k, (name, want) in enumerate(names) for form in ("NFC", "NFD")]
    df = spark.createDataFrame(rows, "k long, form string, name string, want string")
    name = F.col("name")
    for r in df.select("want", text.fold_text(name).alias("t"), text.normalize_title(name).alias("n"), text.fold_ascii(name).alias("a"), text.title_tokens(name).alias("w")).collect():
        assert (r.t, r.n, r.a, r.w) == (r.want, r.want, r.want.replace(" ", ""), r.want.split())
    assert df.groupBy("k").agg(F.count_distinct(happenings.source_key(name, F.lit(None).cast("timestamp"))).alias("n")).where("n <> 1").count() == 0


def test_pseudonyms_of_all_users(spark, sf_dir):
    from agora_spark.plans import catalog

    rows = catalog.QUERIES["user_pseudonyms"](spark, sf_dir).collect()
    users = {r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect()}
    assert {r.user_id: r.pseudonym for r in rows} == {u: hmac.new(b"key", str(u).encode(), hashlib.sha256).hexdigest() for u in users}
