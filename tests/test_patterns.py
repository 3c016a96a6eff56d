import random

from pyspark.sql import functions as F

from hostledger.functions import patterns as P
from hostledger.functions import tables
from hostledger.operators import preprocess as PP

def test_crawl_patterns(apply):
    """Locale segments and values are starred, ignored parameters and id-like fragments go."""
    cases = [
        ("http://laden.test/fr/katalog/7?groesse=m&farbe=rot", {}, "http://laden.test/*/katalog/7?farbe=*&groesse=*"),
        ("http://laden.test/fr/katalog/", dict(detect_locales=False), "http://laden.test/fr/katalog/"),
        ("http://laden.test/at/", dict(custom_codes=["klingonisch"]), "http://laden.test/*/"),
        ("http://laden.test/KLINGONISCH/x", dict(custom_codes=["klingonisch"]), "http://laden.test/*/x"),
        ("http://w.test/r?Anzahl=1&bild=2", dict(ignored_params=["anzahl"]), "http://w.test/r?bild=*"),
        ("http://w.test/r?anzahl=1", dict(ignored_params=["ANZAHL"]), "http://w.test/r"),
        ("http://w.test/r?anzahl=1", dict(ignored_params=[]), "http://w.test/r?anzahl=*"),
        ("http://w.test:8080", {}, "http://w.test:8080/"),
        ("http://w.test/x#kapitel-zwei", {}, "http://w.test/x#kapitel-zwei"),
        ("http://w.test/x#99", {}, "http://w.test/x"),
        ("//w.test/x", {}, "://w.test/x"),
        ("http://w.test/%zz", {}, None),
    ]
    for url, options, expected in cases:
        assert apply(lambda u: P.url_pattern(u, "crawl", **options), [url]) == [expected], url


def test_preprocess_patterns(apply):
    """Locales and variables are named, empty segments go, parameters are sorted by name."""
    cases = {
        "http://w.test/pt/buch/4711//cafebabe42?zahl=77&art=rot&page=3#seite": (
            "http://w.test/<locale>/buch/<variable>/<variable>?art=rot&zahl=<variable>#seite"
        ),
        "http://w.test/bild-neu/token123456": "http://w.test/bild-neu/<variable>",
        "http://w.test": "http://w.test",
        "http://w.test/": "http://w.test/",
        "http://w.test/x#2024": "http://w.test/x#<variable>",
        "http://w.test/x?b=2&b=rot": "http://w.test/x?b=<variable>&b=rot",
        "http://h:port/": None,
    }
    assert dict(zip(cases, apply(lambda u: P.url_pattern(u, "preprocess"), list(cases)), strict=True)) == cases


def test_crawl_variable(apply):
    """Up to two bytes, up to six digits, up to eight hex digits, an id key, or one short or numeric value."""
    cases = {
        "zz": True, "zzz": False, "ü": True, "üb": False, "000000": True, "00000000": True, "000000000": False, "beefcafe": True,
        "beefcafe0": False, "id=lang-und-breit": True, "OFFSET=lang-und-breit": True, "farbe=lang": False, "farbe=rot": True,
        "farbe=123456": True, "farbe=1234567": False, "farbe=a=b": False, "": False, "kapitel": False,
    }
    assert dict(zip(cases, apply(lambda s: P.is_variable(s, "crawl"), list(cases)), strict=True)) == cases


def test_preprocess_variable(apply):
    """Integers of 64 bits, eight hex digits or more, UUIDs, escapes, long words, session words with a tail."""
    cases = {
        "0008": True, "-77": True, "+0": True, "--7": False, "-9223372036854775808": True, "1.5": False,
        "cafebab": False, "cafebabe": True, "CAFEBABE": True, "cafebabg": False, "0000000cafebab": True,
        "x%20y": True, "q" * 16: False, "q" * 17: True, "q" * 16 + "-": False, "tokenwert": False, "tokenwerte": True, "Uid-2024": True, "uid-": False, "katalog": False, "": False,
        "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee": True, "z-z-z-z-z": False,
    }
    assert dict(zip(cases, apply(lambda s: P.is_variable(s, "preprocess"), list(cases)), strict=True)) == cases


def test_locales(apply, spark):
    assert len(tables.iso_countries()) == 249
    crawl = {"pt": True, "PT": True, "pt-br": True, "zz-pt": False, "fr-zz": False, "sv-se": True, "qa-en": True, "sd-ar": True,
             "tn-fr": True, "km-en": False, "frca": False, "cafr": True, "qq": False, "fr_ca": False, "": False}
    assert dict(zip(crawl, apply(lambda s: P.is_locale(s, "crawl"), list(crawl)), strict=True)) == crawl
    pre = {"it": True, "IT-ch": True, "it-qq": False, "qq-it": False, "bv": True, "cafr": False, "it-ch-x": False}
    assert dict(zip(pre, apply(lambda s: P.is_locale(s, "preprocess"), list(pre)), strict=True)) == pre
    assert apply(lambda s: P.is_locale(s, "preprocess", countries=["qq"]), ["it-qq", "it-ch"]) == [True, False]


def kept(spark, urls, **options):
    df = spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string")
    rows = PP.preprocess_urls(df, mode="crawl", normalize=dict(strip_fragments=False, strip_tracking=False, custom_params=[]), **options)
    return sorted(r["pos"] for r in rows.collect())


def test_cap_keeps_the_first_of_each_pattern(spark):
    shelf = [f"http://markt.test/{lang}/regal?fach={i}&stapel={i * i}" for i, lang in enumerate(["da", "it", "pl", "da", "x-y"])]
    assert kept(spark, shelf) == [0, 4]  # the last has no locale
    assert kept(spark, shelf, max_similar=3) == [0, 1, 2, 4]
    assert kept(spark, shelf[::-1]) == [0, 1]
    assert kept(spark, shelf, pattern=dict(detect_locales=False)) == [0, 1, 2, 4]  # pages 0 and 3 differ in values only
    assert kept(spark, shelf, enabled=False) == [0, 1, 2, 3, 4]
    assert kept(spark, [shelf[0], shelf[0] + "&mehr=1", shelf[0] + "#4"]) == [0, 1]


def test_pattern_counts(spark):
    urls = ["http://markt.test/da/regal", "http://markt.test/it/regal", "http://markt.test/kasse", "http://markt.test/pl/regal"]
    rows = PP.preprocess_urls(spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string"), max_similar=2, mode="crawl")
    assert {r["pattern"]: r["n_urls"] for r in PP.pattern_stats(rows).collect()} == {
        "http://markt.test/*/regal": 2, "http://markt.test/kasse": 1,
    }
    assert [r["n_urls"] for r in PP.pattern_stats(rows, min_count=2).collect()] == [2]


def one_by_one(items, k):
    """The rules row by row: (kept positions, duplicates, capped)."""
    seen, counts, out, dup, capped = set(), {}, [], 0, 0
    for pos, norm, pattern in items:
        if norm in seen:
            dup += 1
        elif counts.get(pattern, 0) >= k:
            capped += 1
        else:
            seen.add(norm)
            counts[pattern] = counts.get(pattern, 0) + 1
            out.append(pos)
    return out, dup, capped


def test_matches_row_by_row_rules(spark):
    rng = random.Random(7)
    for k in (1, 2, 3):
        # a third of all rows share one pattern
        urls = [
            f"https://h{0 if rng.random() < 0.33 else rng.randrange(6)}.com/"
            f"{rng.choice(['en', 'about', 'x'])}/{rng.randrange(12)}{rng.choice(['', '?ref=a', '#t', '?q=' + str(rng.randrange(3))])}"
            for _ in range(400)
        ]
        df = spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string")
        normed = PP.with_normalized(df).orderBy("pos").select("pos", "norm", "pattern").collect()
        expected, dup, capped = one_by_one(normed, k)
        assert sorted(r["pos"] for r in PP.preprocess_urls(df, max_similar=k).collect()) == expected
        stats = PP.preprocess_stats(df, max_similar=k).first()
        assert (stats["final_count"], stats["skipped_duplicate"], stats["skipped_by_pattern"]) == (len(expected), dup, capped)
        assert stats["total_processed"] == 400


def test_cap_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("pos"), F.concat(F.lit("http://a/"), F.col("id")).alias("url"))
    plan = PP.preprocess_urls(df)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_cap_takes_two_steps(spark):
    df = spark.range(0, 2000, 1, 8).select(
        F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("norm"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("pattern"),
    )
    for k in (3, 150):
        ranks = {}
        for r in df.orderBy("pos").collect():
            ranks.setdefault(r["pattern"], []).append(r["pos"])
        expected = sorted(p for rows in ranks.values() for p in rows[:k])
        assert sorted(r["pos"] for r in PP.cap_per_pattern(df, max_similar=k).collect()) == expected
