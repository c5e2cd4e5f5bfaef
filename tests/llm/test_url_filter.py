import itertools
import math
import random
import zlib
from collections import Counter

import regex as re

from alertweave.llm import url_filter as uf

URLS = [
    "http://a.org/x/1",
    "https://Sub.Example.ORG/es/7?q=1",
    "https://example.org/en/12#top",
    "https://example.org/en/2",
    "http://badexample.org/es/1",
    "http://x.com/fr/1",
    "http://x.com/de/1",
    "http://x.com/en/1",
    "http://com/de/1",
    "http://a.org",
    "http://a.org?x=/es/",
    "a.org/es/1",
    "://",
    "x://y://z.com/de/1",
    "http://newtheword.net/de/123\nfoo",
    "http://Ünï.net/fr/é",
    "http://straßeünïneue.net/Straße/x-7",
    "http://straßeünïneue.org/Straße/x-7",
    "http://x.com/de/" + "neuewort" * 700,
    "http://" + "theword" * 500 + ".net/es/" + "9" * 3000,
    "",
    None,
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block")]
RULES += [("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def plain_words(htmls):
    texts = [re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", html.lower()) for html in htmls if html]
    return Counter(w for text in texts for w in re.findall(r"[\p{L}\p{M}]+", text) if len(w) <= uf.LONGEST_WORD)


def plain_buckets(host, path, segmenter):
    def words(text):
        for piece in re.findall(r"[\p{L}\p{M}]+|[0-9]+", text.lower()):
            yield from [f"#{len(piece)}"] if piece[0] in "0123456789" else segmenter.split(piece)

    *names, top = host.lower().split(".")
    tokens = [f"host {w}" for name in names for w in words(name)] + [f"path {w}" for w in words(path)]
    return [zlib.crc32(token.encode()) >> 16 for token in tokens + ([f"top {top}"] if host else [])]


def test_hosts_paths_rules_and_model(spark):
    html = "<p>the word new the des word</p><script>var hidden</script> neue wort Straße ünï " + "z" * 25
    rows = [(k, url, html if k % 2 else None) for k, url in enumerate(URLS)] + [(None, URLS[0], html)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS rule")
    got = uf.url_filter(pages).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(
        (k, *parts(url), rule(*parts(url))[0]) for k, url, _ in rows
    )
    counts = plain_words([html for _, _, html in rows])
    assert {r["word"]: r["count"] for r in uf.word_counts(pages).collect()} == counts
    segmenter = uf.Segmenter(counts, counts.total())
    assert "hidden" not in segmenter.cost and segmenter.split("newtheword") == ["new", "the", "word"]
    assert segmenter.split("straßeünïneue") == ["straße", "ünï", "neue"]
    # naive Bayes with plain counters
    seen = {"allow": Counter(), "block": Counter()}
    pages_of = Counter()
    for _, url, _ in rows:
        host, path = parts(url)
        verdict = rule(host, path)[1]
        if verdict:
            pages_of[verdict] += 1
            seen[verdict].update(plain_buckets(host, path, segmenter))
    used = len(set(seen["allow"]) | set(seen["block"]))

    def odds(host, path):
        out = math.log(pages_of["block"] + 1) - math.log(pages_of["allow"] + 1)
        for token in plain_buckets(host, path, segmenter):
            for sign, kind in ((1, "block"), (-1, "allow")):
                out += sign * math.log((seen[kind][token] + 1) / (seen[kind].total() + used + 1))
        return out

    for r in got:
        ruled = rule(r.host, r.path)[1]
        wanted = odds(r.host, r.path)
        assert r.verdict == (ruled or ("block" if wanted > 0 else "allow"))
        assert (r.block_odds is None) if ruled else abs(r.block_odds - wanted) < 1e-6
    assert uf.url_filter(pages.limit(0)).count() == 0


def test_pieces_are_cut_with_their_own_words_only(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))): rng.randint(1, 50) for _ in range(40)}
    names = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 30))) for _ in range(80)} | {"ab" * 5000}
    words = spark.createDataFrame([*counts.items()], "word string, count bigint")
    pieces = spark.createDataFrame([(name,) for name in sorted(names)], "piece string")
    whole = uf.Segmenter(counts, sum(counts.values()))
    got = {row["piece"]: row["words"] for row in uf.segments(pieces, words).collect()}
    assert got == {name: whole.split(name) for name in names}


def test_without_decided_pages_all_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None), (2, None, "")], "page_id bigint, url string, html string")
    assert [r.verdict for r in uf.url_filter(pages).collect()] == ["allow"] * 2


def test_segments_are_the_most_probable_ones():
    rng = random.Random(2)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
    segmenter = uf.Segmenter(counts, sum(counts.values()))
    cost = lambda words: sum(segmenter.cost.get(w, segmenter.unknown(len(w))) for w in words)
    for _ in range(60):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        best = min(
            cost([name[a:b] for a, b in itertools.pairwise([0, *cuts, len(name)])])
            for n in range(len(name))
            for cuts in itertools.combinations(range(1, len(name)), n)
        )
        words = segmenter.split(name)
        assert "".join(words) == name and abs(cost(words) - best) < 1e-9
    assert segmenter.split("") == []
