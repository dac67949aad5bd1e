import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import awkward, crowded, frame

from lodestone.llm import language_id, license_scan, mixing, quality, url_filter
from lodestone.llm.queries import URL_RULES

TRAIN = {
    "en": "the quick brown fox jumps over the lazy dog while they were thinking about nothing",
    "de": "der schnelle braune fuchs springt über den faulen hund während sie nichts dachten",
    "fr": "le rapide renard brun saute par dessus le chien paresseux pendant que nous pensons",
}


def speech(lang, k):
    words = TRAIN[lang].split()
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(words, 40))


def test_language_of_held_out_texts(spark):
    rows = [(k, speech(lang, k), lang, "a") for k, lang in enumerate(list(TRAIN) * 60)]
    docs = crowded(frame(spark, rows + [(900, None, "en", "a"), (901, "12 !", "en", "a"), (None, speech("en", 1), "en", "a")]))
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs, 40)).collect()}
    for doc_id, _, lang, _ in rows:
        assert found[doc_id].lang_pred == lang and 0 < found[doc_id].score <= 1 and not found[doc_id].rejected
        assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
    for doc_id in (900, 901):
        assert (found[doc_id].lang_pred, found[doc_id].score, found[doc_id].rejected) == ("und", 0.0, True)
    assert not found[None].held_out
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 1
    strange = frame(spark, [(1, "qzxj vvkq wxzq jjqk " * 40, None, "a")])
    assert language_id.identify(strange, language_id.train(docs, 40)).first().rejected


def test_language_without_training_rows(spark):
    empty = frame(spark, [])
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    found = language_id.identify(frame(spark, [(1, "text", None, "a")]), language_id.train(empty)).first()
    assert (found.lang_pred, found.rejected) == ("und", True)


def brute_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_figures_equal_brute_force(spark):
    rows = awkward() + [(50 + k, " ".join(f"w{(i * k) % 17}" for i in range(60)), "en", "a") for k in range(1, 9)]
    found = quality.judge(crowded(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r.doc_id), *(r[n] for n in names), r.base_failed) for r in found)
    wanted = []
    for doc_id, text, *_ in rows:
        figures = brute_quality(text)
        wanted.append((str(doc_id), *figures, figures[0] < 20 or 100 * figures[4] > 30 * figures[0]))
    assert got == sorted(wanted)
    assert all(r.kept == (r.failed_rule is None) and not (r.kept and r.base_failed) for r in found)
    assert quality.judge(frame(spark, [])).count() == 0


def test_the_order_of_rules_does_not_change_the_verdict(spark, monkeypatch):
    kept = {}
    for order in (1, -1):
        monkeypatch.setattr(quality, "cascade_order", lambda measured, rules, o=order: list(rules)[::o])
        kept[order] = sorted((str(r.doc_id), r.kept) for r in quality.judge(frame(spark)).collect())
    assert kept[1] == kept[-1]


def test_licenses_by_canonical_text(spark):
    mit = license_scan.MIT
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("LICENSE", "LICENCE"), None, None),
        (2, "prose before\n\n" + mit.split("\n\n")[0] + "\n\nmore", None, None),
        (3, "text\nreleased under the mit licence\nReleased under the MIT License!\n", None, None),
        (4, "Released under the MIT License. And more.", None, None),
        (5, None, None, None),
        (6, "", None, None),
    ]
    known = license_scan.known_digests(spark)
    found = license_scan.scan(crowded(frame(spark, rows)), known).collect()
    assert sorted(map(tuple, found)) == [(1, "MIT", "text", 1), (3, "MIT", "line", 2)]
    assert license_scan.scan(frame(spark, []), known).count() == 0


def test_whole_licenses_in_longer_texts(spark):
    mit, texts = license_scan.MIT, dict(reversed(license_scan.whole_texts()))
    first, *rest = mit.split("\n\n")
    rows = [(name, text) for name, text in texts.items()]
    rows += [
        ("in", "A readme.\n\n" + mit + "\n\nMore prose."),
        ("twice", mit + "\n\nand\n\n\n\n" + mit),
        ("torn", "\n\n".join(["prose", first, "between", *rest])),
        ("turned", "\n\n".join(["prose", *rest, first])),
        ("holders", "Copyright (c) <year> <holders>\n\n" + mit),
        ("sign", "# © Some Company\n# Copyright [yyyy] [name]\n\n" + mit),
        ("prose", "copyright holders and others\n\n" + mit),
    ]
    docs = frame(spark, [(k, text, None, None) for k, (_, text) in enumerate(rows)])
    known = license_scan.known_digests(spark, [*license_scan.KNOWN, *license_scan.whole_texts()])
    found = {(rows[r.doc_id][0], r.license_id): r.unit for r in license_scan.scan(crowded(docs), known).collect()}
    assert {(name, name): found.get((name, name)) for name in texts} == {(name, name): "text" for name in texts}
    assert {name: unit for (name, _), unit in found.items() if name not in texts} == {
        "in": "paragraph", "twice": "paragraph", "holders": "text", "sign": "text", "prose": "paragraph"
    }
    table = spark.createDataFrame([("own", "one\n\ntwo")], "license_id string, text string")
    held = frame(spark, [(1, "zero\n\none\n\ntwo", None, None), (2, "two\n\none", None, None)])
    assert list(map(tuple, license_scan.scan(held, license_scan.known_digests(spark, table)).collect())) == [
        (1, "own", "paragraph", 1)
    ]


def test_url_rules_and_trust(spark):
    def page(url, *links):
        return (url, "".join(f'<a href="{link}">x</a>' for link in links))

    rows = [
        page("http://good.org/a", "https://friend.net/x", "/local", "//friend.net/y"),
        page("http://bad.com/de/x"),
        page("http://linker.net/", "http://bad.com/q"),
        page("http://friend.net/z", "http://bad.com/w"),
        page("HTTP://WWW.Example.ORG/en/12?q#f"),
        page("http://example.org/es/"),
        page("http://sub.com/fr/x"),
        page("http://x.org"),
        page("no scheme"),
        (None, None),
        page("http://ä.ÖRG/Ö"),
    ]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    rules = url_filter.rule_table(spark, URL_RULES)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert found == {
        0: ("good.org", "/a", "org/", "allow"),
        1: ("bad.com", "/de/x", "com/de/", "block"),
        2: ("linker.net", "/", None, "block"),
        3: ("friend.net", "/z", None, "allow"),
        4: ("www.example.org", "/en/12", "example.org/en/1", "block"),
        5: ("example.org", "/es/", "example.org/es/", "block"),
        6: ("sub.com", "/fr/x", "com/fr/", "allow"),
        7: ("x.org", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("ä.Örg", "/Ö", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_hosts_with_both_verdicts_seed_in_proportion(spark):
    rows = [
        (1, "http://a.example.com/fr/1", None),
        (2, "http://a.example.com/de/1", None),
        (2, "http://a.example.com/de/1", None),
        (3, "http://a.example.com/other", None),
        (4, "http://b.net/", '<a href="http://a.example.com/">x</a>'),
        (5, "http://c.example.com/fr/" + "x" * 100_000, None),
        (6, "http://c.example.com/de/", None),
        (7, "http://c.example.com/else", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {name: F.lit("x") for name in ("host", "rule", "trust", "score", "n", "allowed")}
    )
    found = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).collect()
    assert len(found) == len(rows)
    by_page = {r.page_id: r for r in found}
    assert (by_page[3].verdict, by_page[4].verdict, by_page[7].verdict) == ("block", "block", "allow")
    assert (by_page[7].trust, by_page[7].distrust) == (75_000_000, 75_000_000)
    # a third of the host's ruled pages is allowed; distrust goes to what links to it
    assert (by_page[3].trust, by_page[3].distrust) == (50_000_000, 100_000_000)
    assert (by_page[4].trust, by_page[4].distrust) == (0, 85_000_000)


def test_distrust_walks_until_nothing_changes(spark):
    """A chain of 12 hosts to a blocked one, and a cycle whose scores rise for far more than 8 rounds."""
    chain = ["bad.com/de/"] + [f"h{k}.net/" for k in range(1, 14)]
    links = {chain[k]: [chain[k - 1]] for k in range(1, len(chain))}
    links |= {"c0.net/": ["c1.net/"], "c1.net/": ["c2.net/"], "c2.net/": ["c0.net/", "worse.com/de/"], "worse.com/de/": []}
    rows = [
        (k, f"http://{url}", "".join(f'<a href="http://{to}">x</a>' for to in links.get(url, ())))
        for k, url in enumerate(dict.fromkeys([*chain, *links]))
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).collect()}
    assert len(found) == len(rows)
    edges = [(url.split("/")[0], to.split("/")[0]) for url, out in links.items() for to in out]
    into = [to for _, to in edges]
    start = {host: 150_000_000 * (host in ("bad.com", "worse.com")) for host in found}
    score, rounds = None, 0
    after = start
    while after != score:
        score, after, rounds = after, dict(start), rounds + 1
        for src, dst in edges:
            after[src] += score[dst] // into.count(dst) * 85 // 100
    assert rounds > 20
    assert {host: r.distrust for host, r in found.items()} == score
    verdicts = {host: r.verdict for host, r in found.items()}
    assert [verdicts[f"h{k}.net"] for k in range(1, 14)] == ["block"] * 12 + ["allow"]


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(1, 60)), None, [None, "a", "b", "c"][k % 4]) for k in range(2000)]
    docs = crowded(frame(spark, rows))
    found = mixing.taken_words(docs, block_docs=16, shard_words=5000).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in found)
    by_source = {}
    size = {r[0]: r[3] for r in rows}
    for r in found:
        by_source.setdefault(size[r.doc_id], [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(target - taken) <= 1 for target, taken, _ in by_source.values())
    total = sum(s for _, _, s in by_source.values())
    assert sum(t for t, _, _ in by_source.values()) == pytest.approx(1.5 * total)
    again = mixing.taken_words(docs.repartition(7), block_docs=16, shard_words=5000).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    mixed = mixing.mix(docs, block_docs=16, shard_words=5000)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2


def test_shards_share_the_blocks_exactly():
    quotas, shards = [7, 0, 31, 100], 9
    parts = [mixing.shard_quotas(quotas, shards, s, 4) for s in range(shards)]
    assert sum(c for c, _ in parts).tolist() == quotas
    before = np.zeros(4, int)
    for counts, first in parts:
        assert first.tolist() == before.tolist()
        before += counts
    assert max(c.sum() for c, _ in parts) - min(c.sum() for c, _ in parts) <= 1


def test_mix_of_awkward_rows(spark):
    assert mixing.taken_words(frame(spark)).count() == len(awkward())
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.taken_words(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None, "a"), (2, "", None, None)])).count() == 0
