"""Substring dedup against a plain dictionary of units."""

import random
import re

from paystrata.llm.lines import UNIT, remove_repeats, repeated_passages, repeated_units, repeats, units_of, without


def brute(docs, min_words=5):
    """A unit goes if an earlier one has the same words, short ones together with the units before."""
    first, found = {}, []
    for doc_id, text in sorted(((d, t or "") for d, t in docs), key=lambda x: x[0]):
        units = [m for m in UNIT.finditer(text) if m.group().split()]
        lists = [[w.lower() for w in m.group().split()] for m in units]
        for i, m in enumerate(units):
            j = i
            while sum(map(len, lists[j:i + 1])) < min_words and j > 0:
                j -= 1
            words = [w for part in lists[j:i + 1] for w in part]
            if len(words) < min_words:
                continue
            key = (tuple(words), len(lists[i]) if len(lists[i]) < min_words else 0)
            place = first.setdefault(key, (doc_id, m.start()))
            if place != (doc_id, m.start()):
                found.append((doc_id, m.start(), m.end() - m.start(), *place))
    return sorted(found)


def runs_of(docs, gone, min_run):
    """Of removed (doc_id, start, ...) units those in runs of ``min_run`` words."""
    kept, texts = [], dict(docs)
    for doc_id in {g[0] for g in gone}:
        units = [m for m in UNIT.finditer(texts[doc_id]) if m.group().split()]
        mine, run = {g[1]: g for g in gone if g[0] == doc_id}, []
        for m in [*units, None]:
            if m and m.start() in mine:
                run.append(m)
                continue
            if sum(len(u.group().split()) for u in run) >= min_run:
                kept += [mine[u.start()] for u in run]
            run = []
    return sorted(kept)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 3))) for _ in range(30)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(1, 9))).capitalize() + rng.choice([". ", "!\n", "?  ", ".\n", "\n", " 3.5 x. "])
    shared = ["".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 8))]
        docs.append((i, rng.choice([None, "", "\n\n", "".join(parts), "".join(parts)])))
    rng.shuffle(docs)
    return docs


def test_units_cover_the_text():
    for _, text in corpus(9):
        assert "".join(m.group() for m in UNIT.finditer(text or "")) == (text or "")


def test_against_a_dictionary(spark, documents):
    docs = corpus(1)
    rows = repeated_units(documents(docs)).collect()
    got = sorted(tuple(r)[:5] for r in rows)
    assert got == brute(docs) and got


def test_short_runs_stay(spark, documents):
    docs = corpus(4)
    for min_run in (10, 20):
        rows = repeated_units(documents(docs + docs[:5]), min_run=min_run).distinct().collect()
        assert sorted(tuple(r)[:5] for r in rows) == runs_of(docs, brute(docs), min_run) != brute(docs)


def plain_passages(texts, passage):
    """Character spans of maximal runs of words that lie in equal runs of ``passage`` words that an earlier text holds, or an earlier place."""
    seen, found = {}, set()
    for doc_id, text in texts:
        words = list(re.finditer(r"\S+", text))
        low = [w.group().lower() for w in words]
        hit = set()
        for i in range(len(low) - passage + 1):
            key = tuple(low[i:i + passage])
            if seen.setdefault(key, (doc_id, i)) != (doc_id, i):
                hit.update(range(i, i + passage))
        for i in sorted(hit):
            found.add((doc_id, words[i].start()))
    return found


def test_overlapping_random_passages_and_the_union(spark, documents):
    rng = random.Random(8)
    source = prose(7, 900)
    rows = []
    for i in range(60):
        words = prose(500 + i, rng.randint(5, 40))
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(800), rng.randint(20, 160)
            words += source[at:at + n] + prose(9000 + 7 * i, rng.randint(1, 9))
        rows.append((i, " ".join(w + "." * (j % 11 == 6) for j, w in enumerate(words))))
    want = plain_passages(rows, 50)
    spans = {}
    for r in repeats(documents(rows)).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    inside = lambda i, at: any(a <= at < b for a, b in spans.get(i, []))
    # Ends are moved along the earliest copy of the last anchor alone, so where several earlier texts hold parts, a few words may stay.
    assert sum(inside(i, at) for i, at in want) >= 0.97 * len(want) > 0, (sum(inside(i, at) for i, at in want), len(want))
    begins = {(i, m.start()) for i, text in rows for m in re.finditer(r"\S+", text)}
    again = plain_passages(rows, 20)
    got = {(i, at) for i, at in begins if inside(i, at)}
    assert got and len(got - again) <= 0.02 * len(got), (len(got - again), len(got))


def test_passages_of_odd_tables(spark, documents):
    long = " ".join(prose(11, 30_000))
    docs = documents([(None, long), (3, "a " + long), (3, "a " + long), (4, None), (5, ""), (None, long)])
    assert sorted((r.doc_id, r.start) for r in repeated_passages(docs).collect()) == [(3, 2), (3, 2)][:1]
    assert repeated_passages(docs.filter("doc_id > 9")).collect() == [] and repeats(docs.filter("doc_id > 9")).collect() == []
    named = docs.withColumnRenamed("lang", "high").withColumnRenamed("source", "nth").withColumnRenamed("n_chars", "run")
    texts = sorted((r.doc_id or 0, len(r.text or "")) for r in remove_repeats(named).collect())
    assert texts == [(0, len(long)), (0, len(long)), (3, 2), (3, 2), (4, 0), (5, 0)]


def test_passage_inside_a_longer_line(spark, documents):
    passage = "One sentence of the passage is here. Short. And then another one follows it, longer than the first. The end."
    docs = documents([(1, "Something before it all, quite long. " + passage), (2, "Other words in front of it here. " + passage + " More.")])
    texts = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    assert texts[1].endswith("The end.") and texts[2] == "Other words in front of it here. More."


def test_texts_without_the_units(spark, documents):
    docs = corpus(2)
    gone = {}
    for doc_id, start, length, *_ in brute(docs):
        gone.setdefault(doc_id, []).append((start, length))
    for r in remove_repeats(documents(docs), min_run=1).collect():
        text = dict(docs)[r["doc_id"]]
        want = text if text is None else without(text, gone.get(r["doc_id"], []))
        assert r["text"] == want
        if r["doc_id"] in gone:
            assert r["n_chars"] == len(want)


def test_long_text_in_linear_time():
    text = "word " * 300_000 + "." * 100_000 + " a.b" * 50_000
    assert units_of(text)


def test_empty_table_repeated_rows_and_clashing_columns(spark, documents):
    text = "Five words are in this. And six more are in that one."
    docs = documents([(1, text), (1, text), (None, "None of these has a number here."), (3, text)])
    assert repeated_units(docs.filter("doc_id > 9")).collect() == [] and remove_repeats(docs.filter("doc_id > 9")).collect() == []
    named = docs.withColumnRenamed("lang", "start").withColumnRenamed("source", "span")
    rows = sorted((r["doc_id"] or 0, r["text"]) for r in remove_repeats(named, min_run=1).collect())
    assert rows == [(0, "None of these has a number here."), (1, text), (1, text), (3, "")]


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(n)]


def test_passages_that_start_and_end_in_mid_sentence(spark, documents):
    whole, stops, short = " ".join(prose(1, 50)), " ".join(w + "." * (i % 9 == 4) for i, w in enumerate(prose(2, 120))), " ".join(prose(3, 40))
    host = [" ".join(prose(i, 30)) for i in range(10, 22)]
    rows = [(1, f"{host[0]} {whole} {host[1]}"), (2, f"{host[2]} {whole.upper()}  {host[3]}"),
            (3, f"{host[4]} {stops} {host[5]}"), (4, f"{host[6]}\n{host[7]} {stops}\n{host[8]}"),
            (5, f"{host[9]} {short} a"), (6, f"{host[10]} {short} b"), (7, f"{whole} {stops}"), (8, f"{host[11]} {whole}, not the same end")]
    texts = {r["doc_id"]: r["text"] for r in remove_repeats(documents(rows)).collect()}
    assert texts[2] == f"{host[2]} {host[3]}" and texts[4] == f"{host[6]}\n{host[7]} \n{host[8]}" and texts[7] == ""
    # 49 equal words are not a passage
    assert all(texts[i] == dict(rows)[i] for i in (1, 3, 5, 6, 8))


def test_passages_against_their_earliest_copy(spark, documents):
    rng = random.Random(5)
    shared = [prose(100 + i, rng.randint(50, 400)) for i in range(12)]
    rows, planted, seen = [], [], set()
    for i in range(80):
        n, words = rng.randrange(12), prose(1000 + i, 60)
        at = rng.randint(0, 60)
        rows.append((i, " ".join(words[:at] + shared[n] + words[at:])))
        if n in seen:
            planted.append((i, len("".join(w + " " for w in words[:at])), len(" ".join(shared[n]) + " " * (at < 60))))
        seen.add(n)
    assert sorted(tuple(r)[:3] for r in repeated_passages(documents(rows)).collect()) == planted


def test_cuts_stay_with_their_text(spark, documents):
    one, two = "Five words are in this. Six other ones are here too.", "Nothing here is said again. Five words are in this."
    rows = [(1, "Five words are in this."), (5, one), (5, two)]
    assert sorted(r["text"] for r in remove_repeats(documents(rows), min_run=1).collect()) == [
        "Five words are in this.", "Nothing here is said again. ", "Six other ones are here too."]


def test_copies_of_a_document_without_a_number(spark, documents):
    line = "This line is in every one of them."
    rows = [(None, line), (None, line + "\nAnd another one stands only in here."), (3, line), (4, "Ten words stand before it in here, all of them. " + line)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in remove_repeats(documents(rows), min_run=1).collect())
    assert got == [(0, rows[0][1]), (0, rows[1][1]), (3, ""), (4, "Ten words stand before it in here, all of them. ")]
