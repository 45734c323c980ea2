"""License scans against a scan of every window."""

import random

import numpy as np

from paystrata.llm.licenses import TEMPLATES, LicenseIndex, bands_needed, license_matches, shingle_hashes, shingles_of, words_of, _WordHashes


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)] + ["the", "license", "under", "licensed", "version"]
    docs, planted = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        if rng.random() < 0.6:
            name = rng.choice(sorted(TEMPLATES))
            notice = TEMPLATES[name].split(" ")
            if len(notice) > 25 and rng.random() < 0.5:
                notice[0] = "Changed"  # one shingle of many
            at = rng.randint(0, len(words))
            words[at:at] = notice
            planted.append((i, name))
        docs.append((i, " ".join(words)))
    return docs, planted


def test_every_planted_template_is_found_and_nothing_else(spark, documents):
    docs, planted = corpus(1)
    got = license_matches(documents(docs)).collect()
    shingles = {name: set(shingles_of(words_of(text))) for name, text in TEMPLATES.items()}
    brute = set()
    for doc_id, text in docs:
        here = shingles_of(words_of(text))
        for name, wanted in shingles.items():
            if len(wanted & set(here)) >= 0.8 * len(wanted):
                brute.add((doc_id, name))
    assert set(planted) <= brute == {(r["doc_id"], r["license"]) for r in got}
    texts = dict(docs)
    for r in got:
        found = set(shingles_of(words_of(texts[r["doc_id"]][r["start"]:r["end"]])))
        assert len(found & shingles[r["license"]]) >= 0.8 * len(shingles[r["license"]])


def test_notice_twice_and_across_markup(spark, documents):
    text = "Released under the MIT License." + " filler words between" * 40 + "\n# Released  under\n# the MIT-License!"
    got = license_matches(documents([(1, text)])).collect()
    assert [(r["license"], text[r["start"]:r["end"]]) for r in sorted(got, key=lambda r: r["start"])] == [
        ("mit-notice", "Released under the MIT License"), ("mit-notice", "Released  under\n# the MIT-License")]


def test_bands_meet_the_wanted_probability():
    for similarity in (0.05, 0.2, 0.5, 0.9, 1.0):
        assert 1 - (1 - similarity) ** bands_needed(similarity) >= 1 - 1e-4
    index = LicenseIndex(TEMPLATES)
    for c in index.classes:
        t = min(len(index.shingles[i]) for i in c.members)
        need = int(np.ceil(0.8 * t))
        assert t <= c.length and len(c.values) >= bands_needed(need / (2 * c.length + t - need))


def test_hashes_follow_the_shingles():
    words = "a b c d e f a b c d e".split()
    hashes = shingle_hashes(words, _WordHashes())
    assert len(hashes) == len(shingles_of(words)) and hashes[0] == hashes[6] and len(set(hashes.tolist())) == 6


def test_nulls_empty_long_and_clashing(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "w " * 200_000), (None, "Licensed under CC BY-NC 4.0."), (4, "MIT")])
    got = license_matches(docs.withColumnRenamed("lang", "license").withColumnRenamed("n_chars", "start")).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(None, "cc-by-nc-4.0-notice")]
    assert license_matches(docs.filter("doc_id > 9")).collect() == [] and license_matches(docs, {}).collect() == []


def test_versions_with_the_same_wording_are_told_apart(spark, documents):
    headers = [n for n in TEMPLATES if n.endswith("-header")]
    rows = [(i, f"# filler before it\n# {TEMPLATES[n]}\n# and words after it") for i, n in enumerate(headers)]
    every = {(r["doc_id"], r["license"]) for r in license_matches(documents(rows)).collect()}
    assert (headers.index("gpl-2.0-header"), "gpl-3.0-header") in every
    got = license_matches(documents(rows), best_only=True).collect()
    found = {(r["doc_id"], r["license"]) for r in got}
    assert {(d, n) for d, n in found if n.endswith("-header")} == set(enumerate(headers))
    assert found - set(enumerate(headers)) == {(headers.index("apache-2.0-header"), "apache-2.0-notice"),
                                               (headers.index("mpl-2.0-header"), "mpl-2.0-notice")}


def test_best_share_follows_what_is_kept():
    index = LicenseIndex({"x": "a b c d e f g h i j", "y": "a b c d e f g h i k", "z": "p q r s t u v"})
    assert index.rivals == [{1}, {0}, set()]
    assert index.best([(0, 0, 10, 0.9), (1, 0, 10, 1.0), (2, 5, 12, 0.8)]) == [(1, 0, 10, 1.0), (2, 5, 12, 0.8)]
    assert index.best([(0, 0, 10, 0.9), (1, 10, 20, 1.0)]) == [(0, 0, 10, 0.9), (1, 10, 20, 1.0)]
    assert index.best([(0, 0, 10, 0.9), (1, 3, 13, 0.9)]) == [(0, 0, 10, 0.9), (1, 3, 13, 0.9)]


def test_repeated_rows_give_repeated_rows(spark, documents):
    text = f"{TEMPLATES['isc-grant']} {TEMPLATES['bsd-disclaimer']}"
    got = license_matches(documents([(1, text), (1, text)]), best_only=True).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "bsd-disclaimer")] * 2 + [(1, "isc-grant")] * 2
