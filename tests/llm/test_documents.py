"""The registered queries over the driver's small tables: SQL where it can say it, brute force elsewhere."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import langid, ngram_lm, pii, quality, simhash
from lexigrid.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]


def rows(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, tiny):
    assert_same(QUERIES[name](spark, tiny), connect(tiny), ORACLE_SQL[name])


def test_op1_brute_force(spark, tiny, documents):
    def fingerprint(text):
        words = WORD.findall(lower(text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: fingerprint(t) for d, t, _ in documents}
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = rows(spark, tiny, "op1_simhash_near_dedup")
    assert {d: (r.fingerprint, r.component_id) for d, r in found.items()} == {d: (f"{p:016x}", top(d)) for d, p in prints.items()}


def test_op3_held_out_accuracy(spark, small):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = rows(spark, small, "op3_language_id")
    assert set(found) == set(truth)
    assert all(r.held_out == (crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in found.items())
    judged = [(r.lang_pred, truth[d].lang) for d, r in found.items() if r.held_out and truth[d].lang and len(truth[d].text or "") > 30]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97


def test_op3_rejects_languages_that_were_not_taught(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    share = lambda df, model: langid.identify(df, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    for unknown in ("de", "es"):
        model = langid.train(docs.where(F.col("lang") != unknown))
        assert share(docs.where(F.col("lang") == unknown), model) > 0.9 and share(docs.where(F.col("lang") != unknown), model) < 0.03
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n)) for n in (12, 30, 100, 400) for _ in range(20)]
    assert share(spark.createDataFrame([(t,) for t in junk], "text string"), langid.train(docs)) > 0.9


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    only = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    }
    found = [(m.start(), i, k, m.end()) for i, (k, (p, fits)) in enumerate(kinds.items()) for m in re.finditer(p, text) if fits(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_op4_base_by_plain_patterns(spark, tiny, documents):
    found = rows(spark, tiny, "op4_pii")
    for d, text, _ in documents:
        base = personal(text or "")
        count = Counter(k for k, _, _ in base)
        row = found[d]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert row.base_sha256 == sha(",".join(said))
        assert set(said) <= set(row.spans.split(","))


def test_op4_spans_that_the_model_alone_finds(spark, small):
    """Held-out lines and texts: the sample is of documents with even ids, and the lines' words of those with odd ones."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    model = pii.train(spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 2 = 0"))
    rng = np.random.default_rng(99)
    words = [w for d, t in texts.items() if d % 2 for w in t.split()[:40] if w.isalpha()]
    lines = [pii.made_up(rng, lambda: words[rng.integers(len(words))]) for _ in range(800)]
    real = [(t, pii.labelled_spans(t)) for d, t in texts.items() if d % 2]
    for cases in (lines, real):
        found = [set(pii._spans_of(path)) for path in pii.paths([t for t, _ in cases], model)]
        right = sum(len(f & set(s)) for f, (_, s) in zip(found, cases, strict=True))
        assert right / sum(map(len, found)) >= 0.9 and right / sum(len(s) for _, s in cases) >= 0.9
    asked = spark.createDataFrame([(1, "please call 555-123-4567 or write"), (2, "pay with 4012.8888.8888.1881 then"), (3, "version 3.0 of 2024, 120,000 copies")], "doc_id bigint, text string")
    added = {r.doc_id: [s.kind for s in r.added] for r in pii.find_pii(asked, model).collect() if not r.base}
    assert added == {1: ["phone"], 2: ["card"], 3: []}


def test_op4_adds_no_match_that_the_base_drops(spark, small):
    """Base spans stay; a number that fails the check of cards, which is all these tables have besides, is not added."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for d, row in rows(spark, small, "op4_pii").items():
        said = set(filter(None, row.spans.split(",")))
        extra = said - {f"{k}:{a}:{b}" for k, a, b in personal(texts[d] or "")}
        assert len(said) == row.n_email + row.n_ip + row.n_card + row.n_phone + len(extra)
        for kind, a, b in (x.split(":") for x in extra):
            assert kind != "card" or pii.luhn("".join(c for c in texts[d][int(a) : int(b)] if c.isdigit()))


def test_op5_statistics(spark, tiny, documents):
    found = rows(spark, tiny, "op5_quality_rules")
    for d, text, _ in documents:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        row = found[d]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert row.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (row.base_failed and row.kept)


def test_op5_agrees_with_the_labels(spark, small):
    found = rows(spark, small, "op5_quality_rules")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [found[d].kept for d, q in labels.items() if q == 1 and not found[d].base_failed]
    assert sum(good) / len(good) > 0.95


def test_op5_rejects_what_labels_call_bad(spark, small):
    """Held out: rules of the labels of even documents, judged by those of the odd."""
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    kept = {r.doc_id: r for r in quality.judge_quality(docs, labels.where("doc_id % 2 = 0")).where("not base_failed").collect()}
    asked = [(kept[r.doc_id].kept, r.quality) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in kept]
    rejected = [q for k, q in asked if not k]
    assert rejected.count(0) >= 0.9 * len(rejected) and rejected.count(0) >= 0.7 * sum(q == 0 for _, q in asked)
    found = rows(spark, small, "op5_quality_rules")
    assert any(not r.kept and not r.base_failed for r in found.values())


def test_op7_against_the_library(spark, tiny, documents):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows(spark, tiny, "op7_byte_bpe")
    for d, text, _ in documents:
        ids = library.encode_ordinary(text or "")
        assert (found[d].n_tokens, found[d].ids_sha256, found[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))


def test_op9_counts_and_base_score(spark, tiny, documents):
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t, _ in documents}
    held = {d: crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = count.total(), len(count)
    found = rows(spark, tiny, "op9_lm_scoring")
    for d, ws in tokens.items():
        row = found[d]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(row.base_score, sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert row.score < 0
    unseen = [d for d in tokens if held[d]]
    assert sum(found[d].score for d in unseen) > sum(found[d].base_score for d in unseen)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_op9_score_is_that_of_a_plain_backoff_model(spark, tiny, documents, order):
    held = {d: crc32(str(d).encode()) % 7 == 2 for d, _, _ in documents}
    texts = {d: [None, *WORD.findall(lower(t or "")), ""] for d, t, _ in documents}
    count = Counter(tuple(ws[i : i + k]) for d, ws in texts.items() if not held[d] for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    single = [n for g, n in count.items() if len(g) == 1 and g != (None,)]

    def p(history, w):
        if not history:
            return (count[w,] + 1) / (sum(single) + len(single) + 1)
        return (count[*history, w] + 64.0 * p(history[1:], w)) / (count[history] + 64.0)

    p = lru_cache(None)(p)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    for row in ngram_lm.score(docs, learned, order=order, block_bytes=1 << 16, counted_bytes=1 << 15).collect():
        ws = texts[row.doc_id]
        want = sum(math.log10(p(tuple(ws[max(0, i - order + 1) : i]), ws[i])) for i in range(1, len(ws)))
        assert math.isclose(row.score, want, rel_tol=1e-9)


def shingle_set(text):
    words = WORD.findall(lower(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_against_exact_similarity(spark, small):
    """Pairs of 0.8 or more of five-word shingles, against all pairs of documents that share a shingle."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    at = defaultdict(list)
    for d, shingles in sets.items():
        for s in shingles:
            at[s].append(d)
    shared = Counter((a, b) for ids in at.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    similar = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(similar):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    found = simhash.near_duplicates(docs, words_per_shingle=5, lanes=4, radius=simhash.radius_for(0.8, 256), similarity=0.8)
    component = {r.doc_id: r.component_id for r in found.collect()}
    assert len(similar) > 50
    assert sum(component[a] == component[b] for a, b in similar) >= 0.98 * len(similar)
    assert all(top(d) == top(c) for d, c in component.items() if sets[d])


def test_pipeline_stages(spark, tiny):
    columns = spark.read.parquet(f"{tiny}/documents.parquet").columns
    docs = spark.read.parquet(f"{tiny}/documents.parquet").cache()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tiny).cache()
        assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        kept.append((name, docs.count(), after.count()))
        docs = after
    by_name = {n: (a, b) for n, a, b in kept}
    assert by_name["pii"][0] == by_name["pii"][1]
    assert by_name["near_dedup"][1] < by_name["near_dedup"][0]
    assert by_name["language_id"][1] > 0.8 * by_name["language_id"][0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert len(last) == docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert not any(personal(r.text or "") for r in docs.collect())


def test_pipeline_runs_from_its_tables(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0
