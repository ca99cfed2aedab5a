import math
import random

import xxhash
from lodeworks.llm import registry, url_filter
from lodeworks.llm.url_filter import Markov, Rule
from lodeworks.sources.tables import table
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, host string, verdict int, _x int, `a.b` int, row int, _text int"
RULES = registry.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    path = rest[end:]
    path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "clash", 1, 2, 3, 4, 5) for i, u in enumerate(urls)], SCHEMA).repartition(3)


def test_query_as_plain_python(spark, sf_dir):
    pages = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    rows = registry.op8_url_filter(spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        host, path = parts(pages[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)


def plain_verdicts(urls):
    """Verdicts by the method for the URLs that no rule fits, every step in plain Python."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sides = {"allow": set(), "block": set()}
    for u in urls:
        host, path = parts(u)
        rule = rule_of(host, path)
        if rule:
            rest = u.split("://", 1)[1][len(host) + len(path) :]
            sides[rule.verdict].add(lower(host[: len(host) - len(rule.host)] + "\x03" + path[len(rule.path) :] + rest))
    order = lambda t: ((h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63), t)
    models, kept = [], []
    for side in ("allow", "block"):
        texts = sorted(sides[side] - {"\x03"}, key=order)
        counts, alphabet = {}, set()
        for i, t in enumerate(texts):
            if i % 5 < 4:
                t = "\x02" * 5 + t
                for k in range(5, len(t)):
                    alphabet.add(t[k])
                    for n in range(6):
                        counts.setdefault(t[k - n : k], []).append(t[k])
        models.append((counts, alphabet))
        kept.append([t for i, t in enumerate(texts) if i % 5 == 4])

    def log_likelihood(model, text):
        counts, alphabet = model
        text, out = "\x02" * 5 + text, 0.0
        for k in range(5, len(text)):
            p = 1 / (len(alphabet) + 1)
            for n in range(6):
                seen = counts.get(text[k - n : k])
                if seen:
                    p = (seen.count(text[k]) + len(set(seen)) * p) / (len(seen) + len(set(seen)))
            out += math.log(p)
        return out

    score = lambda t: (log_likelihood(models[0], t) - log_likelihood(models[1], t)) / len(t) if t else 0.0
    threshold = url_filter.calibrate(*([score(t) for t in side] for side in kept))
    return {u: (score(lower(u.split("://", 1)[1])), threshold) for u in urls if not rule_of(*parts(u))}


def test_verdicts_of_the_method(spark, sf_dir):
    pages = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    want = plain_verdicts(list(pages.values()))
    assert want
    for r in registry.op8_url_filter(spark, sf_dir).collect():
        if pages[r.page_id] in want:
            score, threshold = want[pages[r.page_id]]
            assert math.isclose(r.url_score, score, abs_tol=1e-9) and r.verdict == ("allow" if score >= threshold else "block")


def test_models_do_not_learn_what_the_rule_says(spark):
    rule = Rule("example.org", "/es/", "block")
    df = spark.createDataFrame([("http://a.example.org/es/x?q",), ("http://EXAMPLE.org/es/",)], "u string")
    found = url_filter.first_rule(url_filter.host_of(F.col("u")), url_filter.path_of(F.col("u")), [rule])
    got = df.select(url_filter.beside_rule(url_filter.after_scheme(F.col("u")), url_filter.host_of(F.col("u")), url_filter.path_of(F.col("u")), found).alias("t")).collect()
    assert [r.t for r in got] == ["a.\x03x?q", "\x03"]


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/1?x=/a#b", "http://example.org", "http://notexample.org/es/", "a://b://c/d", "http://x.com?/fr/", "http://x.com#f", "http://x.com/fr/ü?", "http://É.com/de/", "://", "http:///p", "http://a.org/" + "z" * 30_000]
    got = url_filter.judge(frame(spark, [*urls, *urls]), RULES)
    assert set(got.columns) == {"page_id", "url", "host", "path", "rule", "verdict", "url_score", "_x", "a.b", "row", "_text"}
    rows = got.collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        host, path = parts(r.url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path) and (r._x, r["a.b"], r.row, r._text) == (2, 3, 4, 5)
    assert url_filter.judge(frame(spark, []), RULES).count() == 0


def test_one_verdict_only(spark):
    rows = url_filter.judge(frame(spark, ["http://a.org/x", "http://b.net/y"]), [Rule("org", "/", "block")]).collect()
    assert {(r.verdict, r.url_score) for r in rows} == {("block", 0.0), ("allow", 0.0)}


def test_markov_sums_to_one():
    m = Markov(3)
    for t in ("abab", "abc", "http"):
        m.learn(t)
    for context in ("", "a", "ab", "xab", "zzz"):
        assert math.isclose(sum(m.prob(context, c) for c in m.alphabet) + m.prob(context, "\x00"), 1)


def test_the_ratio_tells_unseen_urls_apart():
    r = random.Random(9)
    good = [f"news.site{r.randrange(99)}/article/{r.randrange(9999)}" for _ in range(300)]
    bad = [f"casino{r.randrange(99)}.win/bonus/{r.randrange(9999)}" for _ in range(300)]
    ratio = url_filter.fit(good[:200], bad[:200])
    hits = sum(ratio.score(t) >= ratio.threshold for t in good[200:]) + sum(ratio.score(t) < ratio.threshold for t in bad[200:])
    assert hits >= 198 and url_filter.calibrate([], [1.0]) == 0.0
    assert url_filter.calibrate([2.0, 3.0], [-1.0, 1.0]) == 1.5


def test_all_held_out_rows_calibrate(monkeypatch):
    seen = []
    monkeypatch.setattr(url_filter, "calibrate", lambda good, bad: seen.append((len(good), len(bad))) or 0.0)
    url_filter.fit([f"a{i}" for i in range(10_010)], [f"b{i}" for i in range(10_010)], 1)
    assert seen == [(2002, 2002)]


def test_every_labelled_url_counts(spark):
    # more of each verdict than the 5,000 that a sample once held
    r = random.Random(5)
    rules = [Rule("org", "/", "allow"), Rule("com", "/", "block")]
    sides = [[f"{s}{r.randrange(10**6)}" for _ in range(6_000)] for s in ("b", "c")]
    others = [f"http://{r.choice('abcd')}{r.randrange(10**6)}.net/" for _ in range(50)]
    urls = [f"http://x.{tld}/{t}" for tld, texts in zip(("org", "com"), sides, strict=True) for t in texts] + others
    order = lambda t: ((h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63), t)
    ratio = url_filter.fit(*(sorted({"x.\x03" + t for t in texts}, key=order) for texts in sides))
    got = [x for x in url_filter.judge(frame(spark, urls), rules).collect() if x.rule is None]
    assert len(got) == len(others)
    for x in got:
        score = ratio.score(x.url.split("://", 1)[1])
        assert math.isclose(x.url_score, score, abs_tol=1e-9) and x.verdict == ("allow" if score >= ratio.threshold else "block")


def test_best_cut_as_calibrate(spark):
    r = random.Random(3)
    for n in (0, 1, 2, 40, 300):
        good, bad = ([round(r.gauss(m, 1), 1 if n < 100 else 9) for _ in range(n)] for m in (0.4, -0.3))
        rows = spark.createDataFrame([("allow", s) for s in good] + [("block", s) for s in bad], "side string, score double")
        assert url_filter.best_cut(rows) == url_filter.calibrate(good, bad)
