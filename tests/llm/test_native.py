"""URL filters and chat formatting."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from quarrybed.llm import chat, url_filter
from quarrybed.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "://", "http://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/q?x#y", "ftp://x.net/es/1", "ftp://x.net/es", "http://net/fr/", "http://notnet.org/fr/", "http://badexample.com/en/", "http://example.com/enough", "http://com/", "http://com", "http://a.com?x=/en/", "a://b://c.net/es/", "http://x.net#/es/", "HTTP://U@Ü.NET/fr/a\nb", "http://example.com./en/"]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    urls = [*URLS, "http://" + "a." * 20_000 + "net/es/" + "x" * 100_000, "http://" + "." * 500 + "/en/", "http://example.com" + "/en/" * 9000]
    data = [(k, u, "x", "h") for k, u in enumerate(urls)] + [(4, URLS[4], "x", "h"), (None, URLS[5], "y", "z")] + [(10_000 + k, None, "x", "h") for k in range(1500)] + [(20_000 + k, "http://example.com/en/", "x", "h") for k in range(1500)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    for name in ("path", "rule", "verdict", "id", "h", "p", "rows", "rule_host", "rule_path"):
        df = df.withColumn(name, F.lit("clash"))
    got = url_filter.filter_urls(df, url_filter.rules_table(spark, URL_RULES)).collect()
    want = [(k, *judge(u)) for k, u, *_ in data]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_odd_lists_of_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b.com/xy"), (2, None)], "page_id long, url string")
    judged = lambda rules: sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, url_filter.rules_table(spark, rules)).collect())
    assert judged([]) == [(1, None, "allow"), (2, None, "allow")]
    assert judged([("block", "com", "/" + "x" * k) for k in range(200)]) == [(1, "com/x", "block"), (2, None, "allow")]
    assert judged([("allow", "b.com", "/x"), ("block", "b.com", "/x"), ("block", "c.b.com", "/xy")]) == [(1, "b.com/x", "block"), (2, None, "allow")]
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_table(spark, URL_RULES)).count() == 0


def test_no_python_in_url_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filter.filter_urls(df, url_filter.rules_table(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bloom_passes_all_listed_keys(spark):
    rules = url_filter.rules_table(spark, [("block", f"h{k}.org", "/") for k in range(300)])
    words = url_filter.bloom_words(rules, "rule", 300)
    assert rules.where(~url_filter._may_hold(words, F.col("rule"))).count() == 0
    other = spark.range(2000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("rule"))
    assert other.where(url_filter._may_hold(words, F.col("rule"))).count() < 1000


def brute_chats(turns):
    convs = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    lines = {c: [(r, x) for _, r, x in sorted(v, key=lambda t: (t[0], t[1], sha256(t[2].encode()).digest()))] for c, v in convs.items()}
    out = {}
    for c, v in lines.items():
        beaten = any(d != c and len(w) >= len(v) and w[: len(v)] == v and (len(w) > len(v) or c is None or (d is not None and d < c)) for d, w in lines.items())
        if not beaten:
            out[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in v)
    return out


def test_chats(spark):
    r = random.Random(8)
    turns = []
    for c in range(60):
        seed = r.randrange(6)
        turns += [(c, k, "user" if k % 2 == 0 else "assistant", f"{seed} says {k if k < 3 else r.randrange(3)}") for k in range(r.randrange(1, 6))]
    turns += [(None, 0, "user", "0 says 0"), (99, None, None, None), (99, 2, "user", ""), (98, 1, "a", "x"), (98, 1, "a", "x"), (97, 5, "a", "x")]
    turns += [(200, None if k % 2 else 7, "a", f"{k % 50}") for k in range(1500)] + [(201, 0, "a", "long " * 40_000), (None, 1, "user", "0 says 0"), (None, None, None, "n")]
    df = spark.createDataFrame([(*t, "n") for t in turns], "conv_id long, turn long, role string, text string, pos string")
    for name in ("n", "part", "range", "sha", "tie", "c", "r", "hx", "px", "rows", "k"):
        df = df.withColumn(name, F.lit("clash"))
    for block in (1024, 2):
        got = {}
        for x in chat.format_chats(df, block).orderBy("part").collect():
            got[x["conv_id"]] = got.get(x["conv_id"], "") + x["text"]
        assert got == brute_chats(turns)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_no_python_in_chat_plan(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
