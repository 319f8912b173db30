from scanweave.llm import reputation as R

URLS = {
    "http://Sub.Example.NET/en/x?y": ("sub.example.net", "/en/x", "example.net/en/", "allow"),
    "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
    "https://a.example.com/de/1#t": ("a.example.com", "/de/1", "example.com/de/", "block"),
    "x://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "ftp://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
    "http://host.net": ("host.net", "", None, None),
    "http://host.net?a=/": ("host.net", "", None, None),
    "http://u@h.net:80/a://b": ("u@h.net:80", "/a://b", None, None),
    "//no.scheme/x": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
    "a\n://É.Net/\n/x": ("É.net", "/\n/x", "net/", "block"),
}


def test_rules(spark):
    rows = [(i, u, "other") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = R.judge_urls(pages, labels).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = list(URLS.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    assert R.judge_urls(pages.limit(0), labels).count() == 0


def test_shrinkage(spark):
    """Many bad pages block a host; one does not; a host without pages follows its domain."""
    pages, labels, k = [], [], 0
    for host, bad, good in (("a.bad.com", 40, 0), ("b.bad.com", 1, 0), ("x.fine.com", 0, 60), ("y.fine.com", 1, 0), ("z.org", 0, 30)):
        for q in [0] * bad + [1] * good:
            pages.append((k, f"http://{host}/{k}"))
            labels.append((k, q, 0))
            k += 1
    pages += [(None, "http://a.bad.com/again"), (0, "http://a.bad.com/again"), (10**6, "http://c.bad.com/")]
    got = R.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels + [(None, 0, 0), (0, None, 1)], "doc_id long, quality int, toxic int")).collect()
    rate, verdict = {r.host: r.bad_rate for r in got}, {r.host: r.verdict for r in got}
    assert len(got) == len(pages)
    assert verdict["a.bad.com"] == "block" and verdict["x.fine.com"] == verdict["z.org"] == "allow"
    assert rate["a.bad.com"] > rate["b.bad.com"] > rate["c.bad.com"] > rate["y.fine.com"] > rate["x.fine.com"]


def test_all_bad_host_under_one_suffix(spark):
    """The spread between hosts is measured: one with bad pages only is blocked among many good
    ones, under one suffix and under three alike ones; single bad pages block nobody."""
    for suffixes in (("com",), ("com", "net", "org")):
        outcomes = [(f"h{h}.d{h % 8}.{s}", int(k < h % 7)) for s in suffixes for h in range(80) for k in range(20)]
        outcomes += [("bad.d1.com", 1)] * 60 + [("once.d1.com", 1), ("new.d1.com", None)]
        got = {r.host: r for r in R.reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
        assert [h for h, r in got.items() if r.bound > R.LIMIT] == ["bad.d1.com"]
        assert got["bad.d1.com"].bad_rate > 0.8 and got["once.d1.com"].bad_rate < 0.5


def test_strengths(spark):
    """Against the formula by hand: two parents of two groups; alike groups; single outcomes."""
    def strength(*rows):
        return R._strength(spark.createDataFrame(rows, "p string, n long, bad long"), "p", "s").first().s

    between = 10 * 0.4**2 * 2 + 20 * 0.1**2 * 2
    within = (10 * 0.9 * 0.1 * 2 + 20 * (0.4 * 0.6 + 0.6 * 0.4)) / 56
    assert abs(strength(("a", 10, 1), ("a", 10, 9), ("b", 20, 8), ("b", 20, 12), ("b", 0, 0)) - max(1, within / ((between - 2 * within) / 30))) < 1e-9
    assert strength(("a", 50, 5), ("a", 50, 5)) == 100
    assert strength(("a", 1, 1), ("a", 1, 0)) == strength(("a", 9, 1), ("b", 9, 2)) == strength(("a", 0, 0)) == 2
