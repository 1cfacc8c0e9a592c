"""Hash-tree shards and the URL filter against plain Python."""

import re
import zlib
from collections import Counter

from cellscape.llm import queries, sharding, urls


def placed(spark, shape, shards, rows=20_000):
    df = spark.range(rows).selectExpr("id doc_id")
    return {r.doc_id: r.s for r in sharding.assign_shards(df, df.doc_id, {"s": sharding.build_tree(shards, shape)}).collect()}


def test_weights_and_movement(spark):
    even, heavy = sharding.TreeShape(), sharding.TreeShape(weights={5: 3.0})
    a, b, grown = placed(spark, even, 16), placed(spark, heavy, 16), placed(spark, even, 17)
    counts = Counter(a.values())
    assert len(counts) == 16 and max(counts.values()) < 1.2 * 20_000 / 16 and min(counts.values()) > 0.8 * 20_000 / 16
    assert all(grown[k] in (s, 16) for k, s in a.items()) and 0.7 < sum(g == 16 for g in grown.values()) / (20_000 / 17) < 1.3
    assert 2.5 < Counter(b.values())[5] / (sum(n for s, n in Counter(b.values()).items() if s != 5) / 15) < 3.5
    region = lambda s: s // 4
    assert all(b[k] == s or region(b[k]) == region(5) for k, s in a.items())  # moves end in the subtree that grew
    assert all(b[k] == s or b[k] // 2 == 2 for k, s in a.items() if region(s) == region(5) and s // 2 == 2)


def check_shards(rows, texts):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = {}
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    where = {}
    for r in rows:
        assert where.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)


def test_shards_odd_rows(odd_docs, no_docs):
    check_shards(sharding.shard_documents(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sharding.shard_documents(no_docs).count() == 0


def test_slots_over_many_groups(spark):
    df = spark.range(5000).selectExpr("id doc_id", "int(id % 3) shard")
    rows = sharding.number_slots(df, "shard", ["doc_id"], "slot", rows_per_group=50).collect()
    assert {s: sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(3)} == {0: True, 1: True, 2: True}


def test_shard_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_shards(queries.op6_hash_tree_shards(spark, sf).collect(), [(r.doc_id, r.text) for r in docs])


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if plain_canonical(url) in listed else "allow"


def plain_canonical(url):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    host = re.sub(r"^(www|m|blog)\.", "", "".join(c.lower() if "A" <= c <= "Z" else c for c in host))
    kept = sorted(p for p in (query[1] if query else "").split("&") if p and not re.match(r"(utm_[^=]*|ref)(=|$)", p))
    return host + re.sub(r"(/|\.html)$", "", path) + ("?" + "&".join(kept) if kept else "")


URLS = [
    None, "", "no scheme/x", "http://", "http://ORG/", "https://a.org/x", "http://org", "http://notorg/", "http://x.example.org/es/9", "http://example.org/en/123?x#y", "http://sub.example.org/en/2",
    "http://a.com/fr/1", "http://a.com/de/1", "http://a.com/fr", "http://a.com?/fr/", "http://a.com#/fr/", "http://www.spam-farm.example.net/x/", "http://spam-farm.example.net/x.html?utm_source=q&b=2&a=1#z",
    "http://m.spam-farm.example.net/x?a=1&b=2", "ftp://a://b/c", "http://example.net:80/de/1", "http://Example.ORG/ES/1", "http://com/de/", "http://com.net/de/", "http://a..com/de/x", "http://a.com/de/\nx",
]


def test_urls_odd_rows(spark):
    rows = [(i, u, "h", True) for i, u in enumerate(URLS)] + [(None, URLS[6], None, None), (5, URLS[5], "h", True), (5, URLS[5], "h", True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, listed boolean")
    listed = {plain_canonical(u) for u in URLS if u and set(re.match(r"[^/?#]*", u.split("://", 1)[-1])[0].lower().split(".")) & set(urls.UNWANTED_LABELS)}
    got = urls.judge_urls(pages, urls.unwanted_urls(pages), urls.RULES).collect()
    want = sorted((str(i), *map(str, plain_verdict(u, listed))) for i, u, *_ in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    assert urls.judge_urls(pages.limit(0), urls.unwanted_urls(pages), urls.RULES).count() == 0
    assert urls.judge_urls(pages, urls.unwanted_urls(pages.limit(0)), []).where("verdict = 'block'").count() == 0


def test_filter_loses_no_listed_key(spark):
    listed = spark.range(0, 4000, 2).selectExpr("concat('k', id) key")
    probes = spark.range(40_000).selectExpr("concat('k', id) key")
    blocks, n = urls.build_filter(listed, "key")
    passed = {r.key for r in urls.possible_hits(probes, "key", blocks, n).collect()}
    want = {f"k{i}" for i in range(0, 4000, 2)}
    assert want <= passed and len(passed - want) < 0.01 * 38_000
    assert {r.key for r in urls.match_listed(probes, "key", listed).collect()} == want
