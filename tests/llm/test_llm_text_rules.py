"""Secrets, boilerplate lines, addresses: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_tables import HARD, SECRET, docs, rows_of
from pyspark.sql import functions as F

from headwater.llm import linededup, secrets, urlfilter
from headwater.llm.common import text_of

SCAN = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def base_spans(text):
    return sorted(
        (m.start(), rank, m.end(), kind, m.group(group))
        for rank, (kind, pattern, group, least) in enumerate(SCAN)
        for m in pattern.finditer(text)
        if len(m.group(group)) >= least
    )


def scan(df):
    return secrets.scan_secrets(df, df["doc_id"], text_of(df), df["source"], df["source"])


def secret_rows():
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", ' = "', ":", "=", "'", " ", "\n", "AKIA", "0123456789abcdef",
            "ABCDEFGH1234", "deadbeef", "x", "ü", "😀", "zzzzzzzzzzzz", "-_.=", "word"]
    rows = [(100 + n, "".join(rng.choice(bits) for _ in range(rng.randint(1, 60))), "en", f"s{rng.randrange(9)}") for n in range(250)]
    rows.append((900, " ".join(f"{n:016x}" for n in range(1, 500)) + SECRET, "en", "s1"))
    return [*HARD, *rows]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = secret_rows()
    got = [tuple(r) for r in scan(docs(spark, rows)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()]
    want = []
    for i, t, *_ in rows:
        found = base_spans(t or "")
        kinds = Counter(x[3] for x in found)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in found)
        want.append((i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 50 and sum(w[3] for w in want) > 500


def test_spans_keep_the_base_and_add_what_few_owners_hold(spark):
    rare, wide = "ghp_R4nd0mT0kenOfOneOwner42", "ghp_Ex4mpleThatEveryoneHas99"
    rows = [(n, f"{wide} and {SECRET}" + (f" {rare}" if n < 2 else ""), "en", f"s{n}") for n in range(8)]
    got = {r.doc_id: r for r in scan(docs(spark, rows)).collect()}
    for i, t, *_ in rows:
        spans = [x.split(":") for x in got[i].spans.split(",")]
        values = Counter(t[int(a) : int(b)] for k, a, b in spans if k == "generic")
        assert values == ({rare: 1} if i < 2 else {})
        assert [(int(a), int(b), k) for k, a, b in spans if k != "generic"] == [(a, b, k) for a, _, b, k, _ in base_spans(t)]
        assert got[i].n_live == (1 if i < 2 else 0) and got[i].n_example == len(base_spans(t))
        assert got[i].most_repositories == 8


def test_secrets_of_no_rows(spark):
    assert scan(docs(spark, [])).count() == 0


def slow_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, _, s in rows:
        for pos, x in enumerate((t or "").split("\n")):
            if re.search(r"[^ \t\n\x0b\f\r]", x):
                sites[x].add(s or "")
                place = (i is None, i or 0, pos)
                first[x] = min(first.get(x, place), place)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if len(sites.get(x, ())) < min_sites or (i is None, i or 0, pos) == first[x]]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_on_many_sites_stay_once(spark):
    rng = random.Random(8)
    common = [f"common line {n}" for n in range(30)]
    rows = [r for r in HARD if r[0] != 10]
    for n in range(300):
        lines = [rng.choice(common[: 1 + n % 30]) if rng.random() < 0.4 else f"own {n} {k}" for k in range(rng.randint(0, 9))]
        rows.append((100 + n, "\n".join(lines + [""] * (n % 3)), "en", f"s{rng.randrange(1 + n % 12)}"))
    df = docs(spark, rows)
    got = linededup.dedup_lines(df, df["doc_id"], text_of(df), df["source"], min_sites=4)
    want = slow_lines(rows, 4)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_removed") == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 100
    clean = linededup.with_clean_lines(df, min_sites=4)
    assert clean.columns == df.columns and clean.schema == df.schema
    cleaned = {(r.doc_id, r.text or "", r.n_chars) for r in clean.select("doc_id", "text", "n_chars").collect()}
    assert cleaned == {(i, w[1], len(w[1]) if t is not None else None) for (i, t, *_), w in zip(rows, want)}


def test_sketches_near_and_far_from_the_threshold(spark):
    rows = [(f"line{n}", f"site{k}") for n in (3, 90, 100, 101, 110, 600) for k in range(n)] * 2
    lines = spark.createDataFrame(rows, "name string, site string").select(F.struct(F.xxhash64("name").alias("a"), F.xxhash64(F.reverse("name")).alias("b")).alias("line"), "site", "name", F.length("site").alias("place"))
    found = linededup.boilerplate(lines.select("line", "site", "place"), 101, lg_k=10).join(lines.select("line", "name").distinct(), "line")
    assert {r.name for r in found.collect()} == {"line101", "line110", "line600"}


def test_the_sketch_decides_away_from_the_threshold(spark, monkeypatch):
    # Without a margin, only estimates of up to one above or below the threshold are counted.
    monkeypatch.setattr(linededup, "ERRORS", 0)
    rows = [(n, k if k else "") for n in (1, 2, 3, 4, 5, 6, 40, 5000) for k in range(n)]
    lines = spark.createDataFrame([(n, str(k), k or 0) for n, k in rows for _ in range(2)], "n long, site string, place int")
    key = F.struct(F.col("n").alias("a"), F.col("n").alias("b")).alias("line")
    found = {r.n: r.sites for r in linededup.boilerplate(lines.select(key, "site", "place"), 4).select("line.a", "sites").withColumnRenamed("a", "n").collect()}
    assert set(found) == {4, 5, 6, 40, 5000}
    assert [found[n] for n in (4, 5, 6)] == [4, 5, 6] and found[5000] != 5000 and abs(found[5000] - 5000) < 400


def test_lines_of_repeated_and_no_rows(spark):
    df = docs(spark)
    got = linededup.dedup_lines(df, df["doc_id"], text_of(df), df["source"], min_sites=1)
    assert got.count() == len(HARD)
    texts = [r.text for r in got.where("doc_id in (1, 10)").collect()]
    # Both lines stay in document 1; the two equal rows 10 are one document and lose theirs; the other row keeps its own.
    assert sorted(texts) == ["", "", "The first document has a few words.\nAnd a second line.", "another text under the same id"]
    empty = docs(spark, [])
    assert linededup.dedup_lines(empty, empty["doc_id"], text_of(empty), empty["source"]).count() == 0


ADDRESSES = [
    None, "", "no address", "http://", "://", "http://net/", "http://net", "http://NET/x", "https://a.example.net/en/x?y#z",
    "https://example.net/en", "https://example.net/en/", "https://notexample.net/en/", "http://example.com/de/1", "http://x.example.com/de/",
    "http://example.com/en/?a=/de/", "http://a.org/fr/", "http://a.org/fr", "http://a.org/FR/", "http://org/fr/x", "a://b://c.net/d",
    "http://u@example.net:80/", "http://a.org#/fr/", "http://a.org?x/fr/", "http://ads.shop.com/", "http://shop.com/cart?x=1", "http://shop.com/cartoon",
    "http://x.porn/", "http://a.com/p?sessionid=3", "http://a.net\n/x", "http://ÜBER.net/", "http://a.com/" + "x" * 20000, "http://example.net.evil.com/en/",
    "http://m.casino-win.shop.com/x", "http://casinonova.com/", "http://a.com/casino", "http://free-bets.org/en/", "http://a.com/?x=casino",
]


def slow_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(r), r, v) for r, v in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    address = "//" + host + rest[len(raw) :]
    return host, path, None, "block" if any(re.search(p, address) for _, _, _, p, _ in urlfilter.method_rules()) else "allow"


def test_addresses_against_all_rules(spark):
    rng = random.Random(1)
    urls = [*ADDRESSES, *ADDRESSES] + [
        "http://" + ".".join(rng.choice(["example", "a", "ads", "net", "com", "org"]) for _ in range(rng.randint(1, 4)))
        + "".join("/" + rng.choice(["en", "de", "fr", "login", "x"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/", "?q", "#f"])
        for _ in range(300)
    ]
    df = spark.createDataFrame([(n if n % 7 else None, u, "clash") for n, u in enumerate(urls)], "page_id bigint, url string, token string").repartition(3)
    rules = urlfilter.rules_table(spark, [urlfilter.site_rule(*r) for r in urlfilter.SITE_RULES] + urlfilter.method_rules())
    got = urlfilter.filter_urls(df, df["page_id"], df["url"], rules)
    want = [(n if n % 7 else None, *slow_verdict(u, urlfilter.SITE_RULES)) for n, u in enumerate(urls)]
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert {w[3] for w in want} == {None, *(r for r, _ in urlfilter.SITE_RULES)}
    assert urlfilter.filter_urls(df.where("false"), df["page_id"], df["url"], rules).count() == 0


def test_rules_stand_under_their_rarest_token_or_the_empty_one(spark):
    urls = spark.createDataFrame([("http://a.net/x",), ("http://b.net/x",), ("http://c.net/ü",)], "url string")
    rules = urlfilter.rules_table(spark, [urlfilter.site_rule("a.net/", "block"), ("ü", False, "block", "ü", [])])
    got = {r.url: (r.rule, r.verdict, r.pattern) for r in urlfilter.judge_urls(urls, rules).collect()}
    assert got == {
        "http://a.net/x": ("a.net/", "block", None), "http://b.net/x": (None, "allow", None), "http://c.net/ü": (None, "block", "ü"),
    }
