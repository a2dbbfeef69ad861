import re
from collections import Counter

import pytest
from odd_cases import prose, rows, word, words_of
from pyspark.sql import functions as F

from shelfmark.llm import line_rules, queries, url_filter


def repeat_words(words):
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for found in at.values() if len(found) > 1 for i in found for k in range(3)})


def line_fails(line):
    solid = len(re.sub(r"[ \t\n\x0b\f\r]", "", line))
    if not solid:
        return False
    marks = sum(1 for c in line if not (c.isalnum() or c in " \t\n\x0b\f\r"))
    phrase = any(p in line.lower() for p in line_rules.BOILERPLATE)
    label = len(words_of(line)) < line_rules.LABEL_WORDS and not re.search(r"[.!?:;…。\"')\]]\s*$", line)
    return marks > 0.2 * solid or sum(line.count(c) for c in "|»›•") > 2 or label or phrase


def expected(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    repeats = repeat_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    lost = sum(len(words_of(x)) for x in lines if line_fails(x))
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats,
        failed, not failed and lost <= 0.5 * len(words), lost,
    )


def test_lines_and_documents(frame, odd, draw):
    texts = [
        "Home | About | News | Help\n" + prose(draw, 70) + ".",
        (prose(draw, 30) + "\n") * 4,
        "\n".join("!! ** ## " + prose(draw, 6) for _ in range(20)),
        "same words here now " * 40,
        "All rights reserved.\n" + prose(draw, 55) + ".\nMenu\n" + prose(draw, 8),
        "a\nb\nc\n" * 30,
        "z\x85y \u2028 q " * 20,
        "😀 # & " + prose(draw, 60),
    ]
    records = odd + rows(texts)
    out = line_rules.clean(frame(records))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    got = Counter((r["text"], *[r[n] for n in names]) for r in out.collect())
    assert got == Counter((r[1], *expected(r[1])) for r in records)
    cleaned = {r["text"]: r["clean_text"] for r in out.collect()}
    assert cleaned[None] is None and "Home |" not in cleaned[texts[0]] and "rights" not in cleaned[texts[4]]
    assert line_rules.clean(frame([])).count() == 0


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]


def rule_of(host, path):
    fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1?x#y", "https://a.example.org/en/12", "https://org/x", "https://xorg/",
    "http://shop.example.com/de/5", "http://shop.example.com/fr/5", "ftp://com/de/", "https://example.org", "http://É.ORG/ü", "x://y://z/w",
    "https://h\n.com/fr/\n?q", "https://example.net/" + "ab/" * 20_000,
]


def test_urls_and_rules(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate([*URLS, *URLS[3:6]])], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(df, queries.URL_RULES, 0.0).collect()}
    for k, url in enumerate([*URLS, *URLS[3:6]]):
        host, path = parts(url)
        rule = rule_of(host, path)
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == (host, path, rule and rule.name), url
        assert out[k]["verdict"] == (rule.verdict if rule else "allow")


def test_url_model_generalises(spark, draw):
    made = [(f"https://{word(draw)}{kind}{word(draw)}.net/{word(draw)}/{k}", float(kind == "casino")) for k in range(400) for kind in ("casino", "garden")]
    df = spark.createDataFrame(made, "url string, blocked double")
    model = url_filter.train(df.limit(600))
    judged = url_filter.judge(df, (), model).collect()
    right = [(r["verdict"] == "block") == bool(r["blocked"]) for r in judged[600:]]
    assert sum(right) / len(right) > 0.95
    odd = url_filter.judge(spark.createDataFrame([(u,) for u in URLS], "url string"), (), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert url_filter.train(df.limit(0)) == 0.0 and url_filter.train(df.filter("blocked = 1")) == 1.0
    assert url_filter.judge(df.limit(0), queries.URL_RULES, model).count() == 0


def test_page_query_judges_every_page(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op8_url_filters(spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == Counter(
        (p["page_id"], *parts(p["url"]), (lambda r: r and r.name)(rule_of(*parts(p["url"])))) for p in pages
    )
    assert {r["verdict"] for r in got} <= {"allow", "block"}


@pytest.mark.parametrize("text,n", [("a b c a b c", 6), ("a b a b a b", 6), ("a a a a", 4), ("a b c d", 0)])
def test_repeated_windows(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert line_rules.clean(df).first()["n_repeat_words"] == n == repeat_words(text.split())
    assert F.lit(n) is not None
