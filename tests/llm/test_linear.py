"""Long texts take time in proportion to their length; plain versions beside the fast ones."""
import random
import time
from collections import Counter, defaultdict

import pytest

from jobspan.llm import language_id, licences, pseudonyms
from jobspan.llm.checks import documents

SF = "/root/testdata/sf0.001"


def slow_find(text):
    found = []
    if not pseudonyms._HINT.search(text):
        return found
    for kind, pattern, valid, _ in pseudonyms._COMPILED:
        for m in pattern.finditer(text):
            if valid(m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in found):
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def test_finder_equals_the_patterns(spark):
    rng = random.Random(9)
    bits = ["a@b.org", "@", ".", "a.", "x-y", "@c.de", " ", "@d.", "com", "A1_%+", "@e.f.gh", "4111 1111 1111 1111", "123-45-6789", "+4915112345678",
            "2021-02-28", "10.1.2.255", "\n", "é", "ab" * 20, "DE89 3704 0044 0532 0130 00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [r.text for r in documents(spark, SF).collect() if r.text]
    for t in texts:
        assert [f[:3] for f in pseudonyms.find(t)] == slow_find(t)


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " a@b.org", "a@" * 500_000, "a.b" * 300_000 + "@", "user7@mail.example.org, " * 40_000,
                                  "1234 5678 " * 100_000])
def test_finder_is_linear(text):
    start = time.process_time()
    pseudonyms.find(text)
    assert time.process_time() - start < 20


def test_pseudonyms_are_one_to_one():
    """Different values of a format have different pseudonyms, equal ones the same."""
    values = [f"user{i}@mail.example.org" for i in range(2000)] + [f"10.{i % 250}.{i // 250}.7" for i in range(2000)]
    table = {}
    for v in values * 2:
        put = pseudonyms.replace(f"see {v} there", b"key")[0][4:-6]
        assert table.setdefault(v, put) == put
    assert len(set(table.values())) == len(values)


def scanner():
    return licences.Scanner(list(licences.BASE), list(licences.TEMPLATES), 2, 0.8, 4)


def test_chains_are_linear():
    s = scanner()
    words = licences.words_of(("some filler the software and more of it " * 60_000).encode())
    start = time.process_time()
    s.spans(words)
    assert time.process_time() - start < 30


def slow_spans(s, words):
    chains = defaultdict(list)
    for start, length, state, end in s.runs(words):
        for t, at in s.automaton.ends[state]:
            if at < length:
                continue
            for c in reversed(chains[t]):
                over = max(0, c[1] - start, c[2] - (at - length))
                if over < length and start - c[1] <= s.gap and at > c[2]:
                    c[1], c[2], c[3] = end, at, c[3] + length - over
                    break
            else:
                chains[t].append([start, end, at, length])
    best = {}
    for t, found in chains.items():
        for first, end, _, covered in found:
            part = min(1.0, covered / s.lengths[t])
            if part >= s.share and best.get((s.labels[t], first), (0, 0, 0, 0))[3] < part:
                best[s.labels[t], first] = (s.labels[t], first, end, part)
    return sorted(best.values(), key=lambda x: (x[1], x[0]))


def test_chains_equal_a_search_of_all():
    rng, s = random.Random(3), scanner()
    pool = [licences.words_of(t.encode()) for t, _ in licences.TEMPLATES]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 12)):
            t = rng.choice(pool)
            a = rng.randint(0, len(t) - 1)
            words += t[a:a + rng.randint(1, len(t))] + [b"zzz"] * rng.randint(0, 6)
        assert s.spans(words) == slow_spans(s, words)


def plain_grams(text, n):
    text = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return [text[i:i + n] for i in range(len(text) - n + 1)] if text.strip() else []


def test_languages_equal_plain_sets(spark):
    """Sets of n-grams per language, without a filter, decide alike: a large filter gives next to no false members."""
    rows = [r for r in documents(spark, SF).collect() if r.text and r.lang]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    sets = {}
    for lang in {r.lang for r in rows}:
        texts = [r.text for r in rows if r.lang == lang]
        seen = Counter(g for t in texts for g in set(plain_grams(t, 4)))
        sets[lang] = {g for g, n in seen.items() if n >= max(1 if len(texts) < 10 else 2, 0.002 * len(texts))}
    same = total = 0
    for r in rows:
        found = plain_grams(r.text, 4)
        if found:
            hits = {lang: sum(g in s for g in found) for lang, s in sets.items()}
            best = max(hits.values())
            total += 1
            same += hits[got[r.doc_id]] >= 0.99 * best
    assert same >= 0.98 * total


def test_any_number_of_languages(spark):
    rng = random.Random(7)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(12)] for k in range(130)}
    rows = [(100 * k + i, " ".join(rng.choice(w) for _ in range(30)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(docs)
    assert filters.cells.shape[1] == 3
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, filters).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)
