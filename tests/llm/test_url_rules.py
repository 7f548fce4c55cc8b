import random

from foliograph.llm import url_rules


def test_curated_rules_and_parts(spark):
    urls = [
        "https://A.Example.NET/en/1?x#y", "http://example.net", "http://b.example.net/enx", "ftp://x.example.com/de/", "http://notexample.com/de/", "http://fr.org/fr/9#z",
        "nothing", None, "", "http://h?q://b/", "x://y://z/w", "http://org/fr/", "HTTP://EXAMPLE.com/DE/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][:3] == ("example.net", "", None)
    assert got[2] == ("b.example.net", "/enx", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block")
    assert got[4][2] is None
    assert got[5] == ("fr.org", "/fr/9", "org/fr/", "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][:2] == ("h", "")
    assert got[10][:2] == ("y:", "//z/w")
    assert got[11][2] == "org/fr/"
    assert got[12][:3] == ("example.com", "/DE/", None)


def mined_by_counting(rows, least, confidence):
    from itertools import combinations

    seen, marked = {}, {}
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                seen[c] = seen.get(c, 0) + 1
                marked[c, verdict] = marked.get((c, verdict), 0) + 1
    rules = {(c, v): n / seen[c] for (c, v), n in marked.items() if n >= least and n / seen[c] >= confidence}
    return {(c, v) for (c, v), x in rules.items() if not any(v == v2 and set(c2) < set(c) and x2 >= x for (c2, v2), x2 in rules.items())}


def test_mined_rules_against_counting(spark):
    rows = [(["part:casino", "part:com", f"part:n{i % 4}"], "block") for i in range(30)] + [(["part:com", "folder:en", f"part:n{i % 4}"], "allow") for i in range(60)]
    rows += [(["part:com", "folder:de", "part:n1"], "block") for _ in range(9)] + [(["part:com", "folder:de", "part:n1"], "allow")]
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r["tokens"]), r["verdict"]) for r in url_rules.mine(table, 2, 0.9).collect()}
    assert got == mined_by_counting(rows, 2, 0.9)


def test_a_rule_of_four_tokens_and_a_rare_one(spark):
    """Only four tokens together tell; and fifteen rows are a rule among ten thousand."""
    parts = ["part:a", "part:b", "folder:c", "folder:d"]
    rows = [(parts, "block")] * 40 + [([p for p in parts if p != q] + ["part:z"], v) for q in parts for v in ["allow", "block"] for _ in range(20)]
    rows += [(["part:rare", "part:com"], "block")] * 15 + [(["part:com"], "allow")] * 10_000 + [(["part:scarce", "part:com"], "block")] * 14
    found = {(tuple(r["tokens"]), r["verdict"]) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert (tuple(sorted(parts)), "block") in found and (("part:rare",), "block") in found and not any("part:scarce" in t for t, _ in found)


def test_best_match_against_a_plain_search(spark):
    rng = random.Random(5)
    names = [f"part:{c}" for c in "abcdefgh"]
    rules = [(sorted(rng.sample(names, rng.randrange(1, 4))), rng.choice(["allow", "block"]), rng.choice([0.9, 0.95, 1.0]), 20) for _ in range(40)]
    rules = list({(tuple(t), v): (t, v, c, n) for t, v, c, n in rules}.values())
    sets = [sorted(rng.sample(names, rng.randrange(0, 6))) for _ in range(120)]
    urls = spark.createDataFrame([(s,) for s in sets], "tokens array<string>")
    got = {tuple(r["tokens"]): r["mined"] for r in url_rules.best_match(urls, spark.createDataFrame(rules, "tokens array<string>, verdict string, confidence double, n long")).collect()}
    want = {}
    for s in map(tuple, sets):
        fits = [(c, len(t), t, v) for t, v, c, _ in rules if set(t) <= set(s)]
        if fits:
            want[s] = max(fits)[3]
    assert got == want and len(want) > 20


def test_labels_reach_unruled_urls(spark):
    urls = [(i, f"http://{'spam-farm' if i % 3 == 0 else 'good'}{i % 2}.example.com/en/{i}") for i in range(120)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    taught = spark.createDataFrame([(u, "block" if "spam" in u else "allow") for i, u in urls if i < 80], "url string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, taught).collect()}
    assert all(got[i] == ("block" if i % 3 == 0 else "allow") for i in range(120))


def test_empty(spark):
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string, host int")).count() == 0
