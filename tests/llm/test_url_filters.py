import random

import numpy as np
import pytest

from karyospark.llm import url_filters as U
from karyospark.llm.bits import BloomBits, MinimalPerfectHash


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = min((rest.split(c, 1)[0] for c in "/?#"), key=len)
    path = min((rest[len(host) :].split(c, 1)[0] for c in "?#"), key=len)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, table).collect()}


ODD = [None, "", "no scheme.net/", "a://", "a://NET/", "http://x.NET", "http://x.net/?q", "http://xnet/a", "http://Ä.Example.Net/en/x#y", "http://example.net/en", "a://b://c.net/", "http://org/fr/", "http://a.org/fr", "http://..net/", "http://example.com/de/?://", "x" * 50_000, "http://" + "a." * 5000 + "net/" + "p" * 5000]


def test_odd_urls(spark):
    assert judged(spark, ODD, U.RULES) == {i: plain(u, U.RULES) for i, u in enumerate(ODD)}
    none = spark.createDataFrame([], "page_id int, url string")
    assert U.judge_urls(none, spark.createDataFrame(U.RULES, "host string, path string, verdict string")).count() == 0


@pytest.mark.parametrize(("keys_a_shard", "most"), [(1 << 20, 64 << 20), (50, 200)])
def test_long_lists_against_plain_python(spark, monkeypatch, keys_a_shard, most):
    monkeypatch.setattr(U, "KEYS_A_SHARD", keys_a_shard)
    monkeypatch.setattr(U, "BROADCAST_BYTES", most)
    rng = random.Random(1)
    name = lambda: rng.choice("abcdefgh") + rng.choice("abcdefgh") + str(rng.randrange(9))
    rules = list({(f"{name()}.{rng.choice(['net', 'com'])}", rng.choice(["", "/", "/a", "/b/"])): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("net", "/a", "block"), ("net", "/a", "allow")]
    urls = [f"http://{rng.choice(['', 'w.', 'x.y.'])}{name()}.{rng.choice(['net', 'com', 'org'])}{rng.choice(['', '/', '/a/1', '/b', '/b/2?q', '#z'])}" for _ in range(1500)]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_a_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[:400]], "key string")
    cascade = U.build_cascade(listed, spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert len(cascade) == 1 and len(cascade[0].levels) > 1
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", U._hash(U.F.col("key")).alias("h"))
    levels = [BloomBits.from_bytes(bytes(x)) for x in cascade[0].levels]
    hashes = {r.key: r.h for r in df.collect()}
    got = U.in_cascade(levels, np.array([hashes[k] for k in keys], np.int64).view(np.uint64))
    assert got.tolist() == [i < 400 for i in range(3000)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(mph.lookup(keys).tolist()) == list(range(len(keys)))
    assert (mph.lookup(np.arange(100, dtype=np.uint64)) < max(1, len(keys))).all()
    if n > 1:
        assert sum(map(len, mph.levels)) * 8 < 4.5 * n + 400
        with pytest.raises(ValueError, match="distinct"):
            MinimalPerfectHash.build(np.concatenate([keys, keys]))


def test_filters_tell_keys_with_one_equal_half_apart():
    keys = np.stack([np.full(2000, 5, np.uint64), np.arange(2000, dtype=np.uint64)], 1)
    level = BloomBits.build(keys[:1000], 0.01, 0)
    assert level.test(keys[:1000]).all() and level.test(keys[1000:]).mean() < 0.05
    again = BloomBits.from_bytes(level.to_bytes())
    assert (again.test(keys) == level.test(keys)).all()


def test_line_ends_in_hosts_and_paths(spark):
    rules = spark.createDataFrame([("a\nb.org", "/x\ny", "block"), ("c.org", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://w.a\nb.org/x\nyz"), (2, "http://a\nb.org/x"), (3, "http://c.org/\n"), (4, "http://c.org\n/")], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(pages, rules).collect()}
    assert got == {1: ("a\nb.org/x\ny", "block"), 2: (None, "allow"), 3: ("c.org/", "block"), 4: (None, "allow")}
