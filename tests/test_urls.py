from pyspark.sql import functions as F

from hostledger.functions import probes as PF
from hostledger.functions import text as TX
from hostledger.functions import urls as U


def check(apply, expr, cases):
    got = apply(expr, list(cases))
    assert dict(zip(cases, got)) == cases


def test_normalize_target(apply):
    check(apply, U.normalize_target, {
        "example.com": "https://example.com",
        "  HTTPS.example.com/A ": "https://https.example.com/A",
        "http://User@EX.com:80/P?Q=A#F": "http://User@ex.com:80/P?Q=A#F",
        "HTTP://Ex.com/A": "https://http://Ex.com/A",
        "http://ex.com/ä b": "http://ex.com/%C3%A4%20b",
        "": None, " \t": None, "http://a b/": None, "x.com/%zz": None, "http://h:8x/": None, "a\x01b": None,
    })


def test_normalize_url(apply):
    check(apply, U.normalize_url, {
        "http://laden.test/brot/roggen#preis": "http://laden.test/brot/roggen",
        "http://laden.test/brot?menge=3&utm_campaign=mai&sorte=hell": "http://laden.test/brot?menge=3&sorte=hell",
        "https://example.com/page?UTM_Source=1": "https://example.com/page",
        "https://example.com/?b=2&ref=x&a=~*+1&a=%C3%A4": "https://example.com/?a=~%2A+1&a=%C3%A4&b=2",
        "https://example.com/?b=2&a=~*+1": "https://example.com/?b=2&a=~*+1",
        "https://example.com/?x;y=1&gclid=2&z": "https://example.com/?z=",
        "https://example.com/p?": "https://example.com/p?",
        "://laden.test/brot": None,
    })
    own = lambda u: U.normalize_url(u, strip_tracking=False, custom_params=["farbe", "sitzung"])
    check(apply, own, {"http://laden.test/tuch?laenge=2&FARBE=rot&sitzung=9&utm_term=x": "http://laden.test/tuch?laenge=2&utm_term=x"})
    nothing = lambda u: U.normalize_url(u, strip_fragments=False, strip_tracking=False, custom_params=[])
    check(apply, nothing, {"https://e.com/?utm_source=1#a": "https://e.com/?utm_source=1#a"})


def test_resolve_url(apply):
    base = F.lit("https://ex.com/a/b/c.html?x=1#top")
    check(apply, lambda u: U.resolve_url(u, base), {
        "/für": "https://ex.com/f%C3%BCr", "d": "https://ex.com/a/b/d", "../d": "https://ex.com/a/d",
        "../../../d/./e/..": "https://ex.com/d/", "?q": "https://ex.com/a/b/c.html?q",
        "#f": "https://ex.com/a/b/c.html?x=1#f", "//h.com/../x": "https://h.com/x", "mailto:a": "mailto:a",
        " http://o.com/y ": "http://o.com/y", "": None, ".": "https://ex.com/a/b/", "1:b": None, "/%zz": None,
    })
    check(apply, lambda u: U.resolve_url(u, F.lit(None).cast("string")), {"/x": None, "http://a/b": "http://a/b"})


def test_host_rules(apply):
    check(apply, U.extract_host, {
        "https://a.b:80/x": "a.b", "http://[::1]:80/": "::1", "http://u:p@h/": "h", "mailto:x": None, "/p": None,
        "": None, "http://h:8a/": None,
    })
    check(apply, U.base_domain, {
        "www.example.co.uk": "example.co.uk", "a.b.c": "b.c", "localhost": "localhost", "EX.com:80": "ex.com",
        "co.uk": "co.uk", "": None,
    })
    check(apply, U.snapshot_key, {
        "https://ex.com:80/a..b/": "ex.com_80_a_b", "http://": "sanitized_empty_input", "a__b._c": "a_b_c",
        "ex.com": "ex.com",
    })
    check(apply, U.is_valid_url, {"x": True, "": False, "://y": False})


def test_link_rules(apply):
    check(apply, U.is_skippable_href, {"": True, "data:x": True, "mailto:a@b": True, "tel:1": True,
                                       "javascript:void(0)": True, "/data:": False})
    check(apply, U.has_path_trap, {
        "/a/b": False, "/js/js": True, "https://x.com/aa/b/aa/b/aa/b": True, "/aa/b/c/aa": True, "/a/b/c/a": False,
        "aa/aa/bb": False, "/" + "x/" * 16: True, "/" + "y" * 201: True, "/aa/b/aa/c/aa/d/aa/e": True,
        "/aa%2Faa": True, "https://x.com/": False, "": False,
    })
    check(apply, U.has_problem_pattern, {"x" * 2001: True, "/" * 51: True, "/a/css/css/b": True, "/a/../../b": True,
                                         "/a/../b": False})
    check(apply, U.is_invalid_url, {"": True, "x" * 1001: True, "/a" * 31: True, "/././." : False,
                                    "/./././": True, "/aa/bb/cc/aa/dd/aa/ee/aa": True, "/aa/bb/aa/cc/aa": False})
    check(apply, U.has_repeated_segments, {"http://h/aa/b/aa/c/aa/d/aa": True, "http://h/aa/b/aa/c/aa": False})
    check(apply, lambda s: F.array_join(U.parse_srcset(s), "|"),
          {"a.png 1x, b.png 2x": "a.png|b.png", " , x": "x", "": ""})


def test_scope(apply):
    check(apply, U.in_scope_path, {
        "/assets/style.css?v=123": False, "/app.js#main": False, "/style.css?v=123#section": False,
        "/page.html?id=123": True, "/api/endpoint?param=value": True, "/readme.txt": False, "/A.CSS": True,
    })
    check(apply, U.is_blocked_file, {"/a.b.css": True, "/a.css.b": False, "/a": False})
    seeds = lambda h: U.in_scope_host(h, h.isin("example.com", "test.com"), ["blocked.com"])
    check(apply, seeds, {"example.com": True, "nginx.org": False, "blocked.com": False, "test.com": True})
    check(apply, lambda h: U.in_scope_host(h, None, ["blocked.com"], ["dev"]), {
        "nginx.org": True, "a.blocked.com": False, "dev.x.org": False, "DEV.x.org": False, "a.dev.x.org": True,
        "dev.x.co.uk": False,
    })
    check(apply, U.in_scope, {"http://a/x.js": False, "http://a/x": True, "/x": False, "http://a b/": False})


def test_probe_expressions(apply, spark):
    check(apply, PF.parse_duration_s, {
        "96.0199m": 5761.194, "1h2m": 3720.0, "30s": 30.0, "1.5ms": 0.0015, "-2s": -2.0, "7": 7.0, "soon": None,
        "250µs": 0.00025,
    })
    check(apply, PF.parse_asn, {"AS123": 123, "123": 123, "ASx": None, "": None})
    check(apply, PF.short_content_type, {"text/html; charset=x": "html", "json": "json", "a/": "a/"})
    check(apply, lambda s: PF.status_class(s.try_cast("int")), {
        "200": "2xx Success", "304": "3xx Redirect", "404": "4xx Client Error", "599": "5xx Server Error",
        "600": "5xx Server Error", "0": "Other", "": "Other",
    })


def test_error_text(apply):
    long_url = "https://host.example.com/" + "x" * 60 + "/end"
    check(apply, TX.error_digest, {
        "a\n\n  b  ": "a\nb",
        "open src/app/main.go failed": "open main.go failed",
        "/src/main.go:3 a.b/c.go x-y/z_1/d.html e.txt": "/main.go:3 a.c.go d.html e.txt",
        "a/" * 60000 + "b": ("a/" * 60000)[:147] + "...",
        f"get {long_url} now": f"get {long_url[:30]}...{long_url[-20:]} now",
        "y" * 200: "y" * 147 + "...",
        "\n".join("abcdefghij"): "\n".join("abcdefgh"),
        "": "",
    })
    check(apply, lambda s: TX.error_digest(s, max_lines=2), {
        "\n\xa0\n \u3000a\t\n\n\x0b\nb\r\nc": "a\nb",
        "x" * 200 + "\n \n" + "d/e.json\n" * 3: "x" * 147 + "...\ne.json",
        "\n \n": "",
    })
    check(apply, TX.is_cancellation, {
        "normal error": False, "context canceled": True, "error: context cancelled": True, "CONTEXT CANCELED": True,
        "Context Deadline Exceeded": True,
    })


def test_long_odd_urls_are_read_in_one_pass(apply):
    """Each of these would take hours with a rule that goes back over the text."""
    n = 200_000
    cases = {
        "http://" + "ä" * n: True, "http://" + "ä" * n + "@h/": False, "http://a@" + "ä" * n: True,
        "http://h/#" + "#" * n: True, "http://h/#" + "%41" * n + "%4": False, "http://h/" + "%41" * n: True,
        "http://h/" + "%41" * n + "%": False, "http://" + ":" * n: True, "http://u%41:p@h/": True, "http://h%41/": False,
        "http://h:1:x/": False, "http://u x@h/": False, "http://u@v@h/": True,
    }
    assert dict(zip(cases, apply(U.is_valid_url, list(cases)))) == cases
