import random

import pytest

from pressroom.llm import url_filter


def judge_plainly(url, rules, default):
    host, path = url_filter.split_url(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("block_rules", [4_000_000, 3])
def test_against_a_plain_search(spark, block_rules):
    rng = random.Random(block_rules)
    hosts = ["net", "a.net", "b.a.net", "org", "x.org", "example.com"]
    rules = sorted({(rng.choice(hosts), rng.choice(["/", "/en/", "/en/x", "/fr"])): rng.choice(["allow", "block"]) for _ in range(12)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/", "x://a.net?/en/", "http://.net/", "http://net./", "http://b.a.net:80/"]
    urls += [f"http://{rng.choice(['', 'www.', 'A.', 'zz'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/xy?q=/fr#z', '/fr#a', '/EN/'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(urls)], "page_id long, url string, extra string, verdict string").repartition(3)
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(pages, url_filter.build(frame, block_rules), default="allow")
    assert got.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert tuple(r)[3:] == judge_plainly(r["url"], rules, "allow"), r
    assert got.count() == len(urls)


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "rules"
    path.write_bytes(url_filter._lay_out([("a.com/", "block"), ("b.com/", "allow"), ("c.org/x", "block")]))
    found = dict(url_filter.DigestArray(str(path)).probe([b"a.com/", b"b.com/", b"c.com/", b"c.org/x"]))
    assert found == {0: "block", 1: "allow", 3: "block"}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(pages, url_filter.build(none)).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), url_filter.build(none)).count() == 0


def test_host_rules_and_unusable_rules(spark):
    rules = [("net", "", "block"), ("a.net", "/en/", "allow"), ("x.org", "", "block"), ("org", "/", "allow")]
    urls = ["http://net", "http://a.net/en/x", "http://a.net/fr", "http://www.net?q", "http://x.org/", "http://x.org", "http://y.org/", "http://y.org", "http://internet/", None, "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    names = url_filter.build(spark.createDataFrame(rules, "host string, path string, verdict string"), 3)
    got = url_filter.judge(pages, names, default="allow").collect()
    assert [tuple(r)[2:] for r in sorted(got)] == [judge_plainly(u, rules, "allow") for u in urls]
    assert sum(r["verdict"] == "block" for r in got) == 5
    for bad in [("net", "en/", "block"), ("net", None, "block"), (None, "/", "block"), ("net", "/", None)]:
        with pytest.raises(ValueError):
            url_filter.build(spark.createDataFrame([*rules, bad], "host string, path string, verdict string"))


def test_very_long_urls_and_repeated_rows(spark):
    """Hosts of a megabyte with half a million labels, and a path as long: no more keys than the rules' lengths."""
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("xy.a.net", "/en/", "block"), ("org", "", "allow")]
    labels = "a." * 500_000
    urls = [f"http://{labels}net/en/" + "x" * 1_000_000, f"http://{labels}org", f"http://{labels}", "http://" + "n" * 1_000_000 + "/en/", f"http://www.{labels}xy.net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").repartition(3)
    names = url_filter.build(spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, names, default="block").collect())
    want = [(i, *judge_plainly(u, rules, "block")) for i, u in enumerate(urls)]
    assert got == sorted(want * 2, key=lambda r: r[0])


def test_keys_follow_the_lengths_of_the_rules(tmp_path):
    path = tmp_path / "rules"
    path.write_bytes(url_filter._lay_out([("net/", "block"), ("a.net/en/", "allow"), ("org", "allow")]))
    block = url_filter.DigestArray(str(path))
    keys = list(block.keys(b"a." * 500_000 + b"net", b"/en/" + b"x" * 1000))
    assert sorted(k for k, _ in keys) == [b"a.net/en/", b"net", b"net/"]
