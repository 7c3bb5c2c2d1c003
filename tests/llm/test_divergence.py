"""The divergence audit against plain counting, and its transducers against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n long, shard long, value string, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def rows():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "delta", "École", "ÉCOLE", "straße", "日本", "re", "read", "reads", "reading", "ing", "\U0001F600", "a", "z" * 300]
    texts = [(" ".join(rng.choice(words[: 4 + k % 13]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "ä"])) for k in range(120)]
    texts += [(None, "en", "a"), ("", "en", "only empty"), ("12 34 -- []", "fr", "x"), ("rare rare rare", "fr", "y"), ("alone " * 5, "it", "one"), ("alone", "it", "one"), ("alone x", "it", "one"), (None, None, None)]
    texts += [texts[3]] * 4 + [("alpha " * 30000 + "unseen", "en", "a")]
    return [(k % 50, t, lang, source, 7, 8, "v", "t") for k, (t, lang, source) in enumerate(texts)]


def expected(table, least=3, top=200):
    docs = [((t or "").translate(UPPER), lang or "", source or "") for _, t, lang, source, *_ in table]
    held, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = TERM.findall(text)
        held.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for (x, w), n in held.items() if x == lang and n >= least), key=str.encode)

        def shares(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept), t.encode(), t) for t in sources if t != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_against_plain_counting(docs):
    got = sorted(tuple(r) for r in D.divergence(docs).collect())
    assert got == expected(rows())
    assert ("en", "only empty", "pair", "a") in {r[:4] for r in got} and not any(r[2] == "term" and r[0] == "fr" for r in got)


def test_small_chunks_short_reports_and_many_ranges(docs):
    got = sorted(tuple(r) for r in D.divergence(docs, top=2, chunk_cells=20).collect())
    assert got != expected(rows()) and [r for r in got if r[2] == "pair"] == [r for r in expected(rows()) if r[2] == "pair"]
    assert [r for r in got if r[2] == "term"] == [r for r in expected(rows()) if r[2] == "term" and r[5] <= 2]


@pytest.mark.parametrize("head_terms", [0, 5, 12])
def test_the_line_between_the_tiers_changes_nothing(docs, monkeypatch, head_terms):
    monkeypatch.setattr(D, "HEAD_TERMS", head_terms)
    assert sorted(tuple(r) for r in D.divergence(docs).collect()) == expected(rows())


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def built(words):
    b = D.Builder()
    for k, w in enumerate(words):
        b.add(w, 10 * k)
    return b.finish()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_a_transducer_numbers_its_words_and_no_others(words, others):
    words = sorted(words)
    walk = D.Transducer.from_bytes(built(words).to_bytes())
    assert walk.ordinals(words).tolist() == list(range(0, 10 * len(words), 10))
    assert walk.ordinals(others).tolist() == [10 * words.index(w) if w in words else -1 for w in others]


def test_a_transducer_is_minimal():
    rng = random.Random(2)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(150)})
    suffixes = {tuple(w[len(p):] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(built(words).final) == len(suffixes)


def test_shares_beyond_a_long():
    count = np.array([0, 5, 10**13])
    assert D.share(count, 10**14, 3).tolist() == [1 + 10**9 * (c + 1) // (10**14 + 3) for c in count.tolist()]
