"""Operators on single texts and their counts against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import bpe, lattice_lm, line_dedup, mixing, quality, toxicity
from lacuna.llm.common import WordCodes, id_remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"


def odd_documents():
    rng = random.Random(5)
    syllables = ["the", "an", "ed", "ti", "on", "é", "ß", "ing", " ", "Ör"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    shared = " ".join(word() for _ in range(14)) + " some more words so that it is long"
    texts = [None, "", " ", "\n", "\n\n", "a", "x" * 5000, shared, "  " + shared.upper() + "\t", shared + "\r\n" + shared]
    for k in range(40):
        lines = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        texts.append("\n".join(lines))
    texts += ["again and again " * 400, "one two three four five six seven eight nine " * 3, texts[20], texts[20], "# | <b> $5 50% & " * 9]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t), 3, "x") for k, t in enumerate(texts)]
    rows += [rows[12], (None, shared, None, None, None, 0, None), (None, "null id", "en", "a", 7, 0, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_counts_against_plain_loops():
    texts = [t or "" for _, t, *_ in odd_documents()]
    got = quality.text_counts(texts, WordCodes(10))
    for k, text in enumerate(texts):
        words = WORD.findall(text)
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]
        assert got.iloc[k][quality.COUNTS[:5]].tolist() == want, text[:60]


def test_quality_verdicts(spark, docs):
    out = quality.judged(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and r["kept"] is not None
    assert quality.judged(empty(spark)).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(2)
    plain = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)), "en", "a" if k % 2 else "b") for k in range(300)]
    junk = [(1000 + k, " ".join(w + "%%%" for w in plain[k][1].split()), "en", "a") for k in range(20)]
    out = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[1000 + k] for k in range(20))
    assert sum(out[k] for k in range(300)) >= 297


def invented(rng, n):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) for _ in range(n)]


def test_quality_rejects_equal_junk_of_nearly_half_a_source(spark):
    """Per language one source with 28 to 45 % junk of one kind; about a fifth of its characters are symbols."""
    rng, rows, junk = random.Random(3), [], set()
    for share in (28, 30, 35, 40, 45):
        for k, text in enumerate(invented(rng, 200)):
            if k < 2 * share:
                junk.add(len(rows))
                text = " ".join(w + "%" * (j % 2 + 1) for j, w in enumerate(text.split()))
            rows.append((len(rows), text, f"l{share}", "a"))
    out = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not [k for k in junk if out[k]]
    assert sum(out[k] for k in out if k not in junk) >= 0.98 * (len(rows) - len(junk))


def test_quality_rejects_number_dumps_in_prose(spark):
    """2 % of a source have 30 to 60 % digits, beside clean texts that are almost without."""
    rng, rows, junk = random.Random(4), [], {}
    for k, text in enumerate(invented(rng, 400)):
        if k % 50 == 0:
            share = (30, 40, 50, 60)[k // 50 % 4]
            junk[k] = share
            text = "".join(c if c == " " or rng.random() * 100 >= share else rng.choice("0123456789") for c in text)
        elif k % 10 == 1:
            text += " 12"
        rows.append((k, text, "en", "a"))
    out = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not {k: share for k, share in junk.items() if out[k]}
    assert sum(out[k] for k in out if k not in junk) >= 0.98 * (len(rows) - len(junk))


def test_line_dedup_against_plain_loops(spark, docs):
    rows = odd_documents()
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 40:
                holders[key].add(doc_id)
    lost = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    want = Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if (k := re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))) not in lost or lost[k] == doc_id]
        want[doc_id, "\n".join(stay), len(lines), len(lines) - len(stay), len("\n".join(stay))] += 1
    got = Counter((r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"], r["n_chars"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == want and any(k[3] for k in want)
    assert line_dedup.dedup_lines(docs).columns[:7] == docs.columns
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_bloom_filters_never_miss_a_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(-2 ** 62, 2 ** 62, (3000, 2))
    a, b = line_dedup.Blooms(2), line_dedup.Blooms(2)
    a.add(h[:2000, 0], h[:2000, 1])
    a.add(h[1500:1700, 0], h[1500:1700, 1])
    b.add(h[1900:, 0], h[1900:, 1])
    twice = a.twice | b.twice | (a.once & b.once)
    again = np.r_[1500:1700, 1900:2000]
    hit = line_dedup.Blooms.has(twice, line_dedup.Blooms.places(h[:, 0].copy(), h[:, 1].copy(), 2))
    assert hit[again].all() and hit.mean() < 0.2


def test_mixing_against_plain_loops(spark, docs):
    rows = odd_documents()
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    total = Counter()
    for r, s in zip(rows, size, strict=True):
        total[r[3]] += s
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(total.values())
    while open_ and left > 1e-9:
        per = left / sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += per * weight[s]
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.remove(s)
    out = mixing.repetition(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == total[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["n_copies"] <= 2 and abs(r["n_copies"] - r["rate"]) < 1
    emitted = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in out:
        want[r["doc_id"]] += r["n_copies"]
    assert emitted == +want and mixing.mixed(docs).columns == docs.columns
    assert mixing.repetition(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mixing_without_ids_or_with_one_id_comes_near_its_targets(spark):
    """Half of the rows have no id, a third share one; many are equal in all columns."""
    rows = [(None, "en", "some words here now", s) for s in "ab" for _ in range(900)] + [(7, "en", f"text number {k % 3} of it", s) for s in "bc" for k in range(600)] + [(k, "en", "one two three four", "c") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string").repartition(6)
    for run in (mixing.RUN, 100):
        out = mixing.repetition(docs, run).collect()
        assert len(out) == len(rows)
        taken, target = Counter(), {}
        for r in out:
            taken[r["source"]] += r["size"] * r["n_copies"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - t) < 0.06 * t for s, t in target.items()), (taken, target)
        got = Counter()
        for r in mixing.mixed(docs, run).collect():
            got[r["source"]] += len(r["text"].split())
        assert got == taken if run == mixing.RUN else all(abs(got[s] - t) < 0.06 * t for s, t in target.items())


def test_bpe_equals_the_public_library(spark, docs):
    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    tables = bpe.tables()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tables.tokens)}, special_tokens={})
    codec, rng = bpe.Codec(tables), random.Random(3)
    assert all(tables.hash.place(t) == i for i, t in enumerate(tables.tokens))
    pool = "ab ' \n\t1é,!sÄ \x1c\x85漢🙂<|endoftext|>'ll"
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 16)))
        ids = codec.encode(text)
        assert ids == enc.encode_ordinary(text) and codec.decode(ids) == text.encode()
    long = "ab" * 30_000 + " " * 500 + "x"
    assert codec.encode(long) == enc.encode_ordinary(long)
    rows = bpe.digests(docs).select("text", "__digest.*").collect()
    for r in rows:
        text = r["text"] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs), "__ids")
    assert all(bytes(r["__bytes"]).decode() == (r["text"] or "") for r in back.collect())
    assert bpe.digests(empty(spark)).count() == 0


def test_lattice_sums_all_segmentations():
    voc = lattice_lm.Vocabulary()
    lattice = voc.lattice(voc.first)
    pieces = {p: i for i, p in enumerate(voc.pieces) if p}

    def total(s):
        if not s:
            return 1.0
        out = sum(voc.first[pieces[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)
        if s[:1] not in pieces:
            out += math.prod(voc.first[voc.bytes[b]] for b in s[:1].encode()) * total(s[1:])
        return out
    for word in ("the", "anea", "ßé", "漢a\U0001f642", "x"):
        assert math.isclose(lattice.word(word.encode()), math.log(total("▁" + word)), rel_tol=1e-9)
        into = np.zeros(len(voc.first))
        lattice.expect(word.encode(), 2.0, into)
        length = sum(n * (len(voc.pieces[i]) if voc.pieces[i] else 0) for i, n in enumerate(into) if n)
        spelled = sum(into[i] for i in voc.bytes.values())
        assert spelled or math.isclose(length, 2.0 * (len(word) + 1), rel_tol=1e-9)
    assert math.isfinite(lattice.word(("ab" * 20_000).encode()))


def test_scores_against_plain_loops(spark, docs):
    rows = odd_documents()
    own = [zlib.crc32((str(r[0]) if r[0] is not None else "null").encode()) % 7 != 2 for r in rows]
    counts = Counter()
    for r, learned in zip(rows, own, strict=True):
        if learned:
            counts.update(lattice_lm.words_of(r[1]))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = lattice_lm.score_texts(docs, id_remainder(F.col("doc_id"), 7) != 2, frequent=8).collect()
    assert len(out) == len(rows)
    want = Counter()
    for r, learned in zip(rows, own, strict=True):
        tokens = [*lattice_lm.words_of(r[1]), None]
        want[r[0], learned, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in tokens), 6)] += 1
    got = Counter((r["doc_id"], r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lattice_lm.score_texts(docs, id_remainder(F.col("doc_id"), 7) != 2).collect()}
    assert all(math.isclose(again[r["doc_id"], r["n_tokens"]], r["score"], rel_tol=1e-9) for r in out)
    assert lattice_lm.score_texts(empty(spark), F.lit(True)).count() == 0


def test_network_gradients_are_right():
    rng = np.random.default_rng(3)
    net = toxicity.Network({b"a": 1, b"b": 2, b"c": 3})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates = rng.normal(0, 0.5, (4, 6 * toxicity.HIDDEN))
    gates[0] = 0
    at = rng.integers(0, 4, (3, toxicity.WINDOW))
    at[0, 20:] = 0
    y = np.array([1.0, 0, 1])

    def loss():
        s = net.forward(gates, at)
        return float(np.sum(np.log1p(np.exp(-s)) * y + np.log1p(np.exp(s)) * (1 - y)))
    keep: dict = {}
    score = net.forward(gates, at, keep)
    g = net.gradients(keep, 1 / (1 + np.exp(-score)) - y, 4)
    for name, value in (("u", net.p["u"]), ("a", net.p["a"]), ("v", net.p["v"]), ("o", net.p["o"]), ("gates", gates)):
        for _ in range(4):
            k = tuple(rng.integers(0, n) for n in value.shape)
            if name == "gates" and k[0] == 0:
                continue
            old = value[k]
            value[k] = old + 1e-2
            up = loss()
            value[k] = old - 1e-2
            down = loss()
            value[k] = old
            assert abs((up - down) / 2e-2 - g[name][k]) < 2e-2 * (1 + abs(g[name][k])), name


def test_toxicity_finds_stems_on_held_out_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "an", "ed", "ti", "on", "ra", "lo"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(700):
        words = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["vequ", "moron"]) + rng.choice(["", "ti", "ra", "xon"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "... !!")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = toxicity.learning_rows(F.col("doc_id"))
    out = toxicity.scored(docs, toxicity.trained(docs, lab, learn)).withColumn("learn", learn).join(lab, "doc_id", "left").collect()
    assert len(out) == len(rows) and all(0 <= r["__score"] <= 1 for r in out)
    held = [(r["__score"] >= toxicity.THRESHOLD, r["toxic"]) for r in out if not r["learn"] and r["toxic"] is not None]
    assert sum(a == bool(b) for a, b in held) / len(held) > 0.95
    assert not any(r["__score"] >= toxicity.THRESHOLD for r in out if r["doc_id"] >= 9000)


def test_every_word_is_in_a_window():
    for n in range(0, 200):
        first = toxicity.windows(n)
        assert set(range(n)) <= {i for f in first for i in range(f, f + toxicity.WINDOW)}
        assert all(b - a == toxicity.STRIDE for a, b in zip(first, first[1:], strict=False))
