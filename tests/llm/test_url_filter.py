import math

import pytest

from stanceframe.llm import url_filter
from stanceframe.llm.queries import URL_RULES

URLS = [
    ("http://a.org/x", "a.org", "/x", "org/"),
    ("HTTP://A.B.EXAMPLE.ORG/es/1?q", "a.b.example.org", "/es/1", "example.org/es/"),
    ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("x://example.org/en/2", "example.org", "/en/2", "org/"),
    ("x://myexample.org/es/", "myexample.org", "/es/", "org/"),
    ("https://a.com/fr/?x", "a.com", "/fr/", "com/fr/"),
    ("https://a.com/de/://b", "a.com", "/de/://b", "com/de/"),
    ("https://a.com/DE/", "a.com", "/DE/", None),
    ("https://a.org", "a.org", "", None),
    ("https://org/", "org", "/", "org/"),
    ("https://a.com?x=/fr/", "a.com", "", None),
    ("https://É.com#/fr/", "É.com", "", None),
    ("no scheme", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("://", "", "", None),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES, url_filter.UrlModel((0.0,) * url_filter.BUCKETS, -1.0)).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        action = next((r.action for r in URL_RULES if r.text == rule), "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, action), URLS[i]


def test_model(spark):
    model = url_filter.built_in_model(spark)
    urls = [("http://casino-palace.example.net/en/7", 1), ("http://www.poker-bets.com/x", 1), ("http://city-library.example.net/en/7", 0), ("http://thwhan.example.com/de2/5", 0)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [], model).collect()}
    assert [got[i] == "block" for i in range(len(urls))] == [bool(y) for _, y in urls]
    plan = url_filter.judge(pages, URL_RULES, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    empty = spark.createDataFrame([], "url string, label int")
    assert url_filter.train(empty).score is not None
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES, model).count() == 0


def murmur(data, seed):
    """Spark's ``hash`` of a string: 32-bit Murmur3 whose last bytes are taken one by one."""
    word = lambda x: x & 0xFFFFFFFF
    turn = lambda x, r: word(x << r | x >> (32 - r))

    def add(h, k):
        return word(turn(h ^ word(turn(word(k * 0xCC9E2D51), 15) * 0x1B873593), 13) * 5 + 0xE6546B64)

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = add(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = add(h, word(b - 256 if b > 127 else b))
    h = word((h ^ len(data)) ^ ((h ^ len(data)) >> 16)) * 0x85EBCA6B
    h = word(h)
    h = word((h ^ (h >> 13)) * 0xC2B2AE35)
    return h ^ (h >> 16)


def by_hand(model, host, path):
    found = []
    for mark, text in (("h", host), ("p", path)):
        whole = f"^{text}$"
        for n in url_filter.GRAMS:
            for i in range(len(whole) - n + 1):
                h = murmur(whole[i : i + n].encode(), murmur(mark.encode(), 42))
                found.append((h - (1 << 32) if h >> 31 else h) % url_filter.BUCKETS)
    return 1 / (1 + math.exp(-(model.bias + sum(model.weights[g] for g in found) / math.sqrt(max(1, len(found))))))


def test_scores_are_those_of_brute_force(spark):
    model = url_filter.built_in_model(spark)
    urls = [u for u, _, _, _ in URLS] + ["https://casino-palace.example.net/en/7", "http://日本.jp/é", "http://" + "long" * 5000 + ".net/" + "x/" * 3000, "http://a.net", "http://a.net"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = url_filter.judge(pages, URL_RULES, model).collect()
    assert len(got) == len(urls)
    for r in got:
        if r.rule is None:
            score = by_hand(model, r.host, r.path)
            assert r.score == pytest.approx(score, abs=1e-9) and r.verdict == ("block" if score >= 0.5 else "allow")


def test_held_out_urls(spark):
    values = lambda rows: spark.createDataFrame(rows, "url string, label int")
    model = url_filter.train(values(url_filter.labelled_urls(False)))
    unseen = [(i, *r) for i, r in enumerate(url_filter.labelled_urls(True))]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(unseen, "page_id bigint, url string, label int"), [], model).collect()}
    blocked = [got[i] == "block" for i, _, y in unseen if y]
    good = [got[i] == "allow" for i, _, y in unseen if not y]
    # measured: 0.95 of all, 0.68 of those to be blocked, 1.00 of the others
    assert sum(blocked) + sum(good) >= 0.94 * len(unseen) and sum(blocked) >= 0.65 * len(blocked) and sum(good) >= 0.99 * len(good)
