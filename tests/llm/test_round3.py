"""Token files, spelling variants and vector codes; rows that repeat a key; rules that change."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import pii, secrets, spelling, substring_dedup, token_files, vector_codes
from lexigrid.llm.common import shared_folder

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def file(spark):
    return token_files.tokenizer_file(spark)


# token files


def test_levels_give_every_id():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        data, places = b"", []
        for parts in token_files.split_levels(ids):
            at = []
            for x in parts:
                at.append(len(data))
                data += x.astype(x.dtype.newbyteorder("<")).tobytes()
            places.append((*at, len(parts[0])))
        levels = token_files.Levels(places, lambda at, size, data=data: data[at : at + size])
        assert levels.some(0, n).tolist() == ids.tolist()
        for _ in range(60 if n else 0):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert levels.some(a, b).tolist() == ids[a:b].tolist()
            at = int(rng.integers(n))
            assert levels.one(at) == ids[at]


def test_words_are_encoded_as_whole_texts_are(file):
    texts = [None, "", " \n", "it's DON'T we'll. 12 3.4,5 a.b", "a\x01b c \x01", "<|endoftext|>x. <|startoftext|>", "É é́ x \x85y z\x1cq\x0bw", "x" * 500 + ". " + "é" * 100, "日本語 テスト\U0001f600"]
    random.seed(2)
    texts += ["".join(random.choices("ab,.!?'\" \n\t\x01é́<|>1日", k=40)) for _ in range(300)]
    library = tokenizers.Tokenizer.from_file(file)
    for end, extra in ((1, [1]), (None, [])):
        found = token_files.WordCoder(file, end).encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in found.to_pylist()] == [library.encode(t or "", add_special_tokens=False).ids + extra for t in texts]


ROWS = [(5, "five words are in here"), (None, "nobody's"), (2, None), (2, "b"), (2, "a"), (2, "a"), (9, " "), (1, "long " * 30_000), (7, "")]


def test_files_give_all_ids_back(spark, file):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in ROWS], "doc_id bigint, text string, ids string, start string").repartition(4)
    place = f"{shared_folder(spark)}/tokens-test"
    token_files.write_tokens(docs, place, file, file_bytes=1000)
    library = tokenizers.Tokenizer.from_file(file)
    rows = token_files.read_tokens(spark, place).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2, 2, 2, 2, 5, 7, 9, None]
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert [(r.start, r.n_tokens) for r in rows] == [(sum(map(len, ids[:i])), len(x)) for i, x in enumerate(ids)]
    assert sorted(ids) == sorted(library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ROWS)
    every = list(itertools.chain(*ids))
    wanted = [None, -1, len(every), *random.Random(3).sample(range(len(every)), 50), 0, len(every) - 1]
    found = token_files.tokens_at(spark.createDataFrame([(p,) for p in wanted], "position bigint"), place).collect()
    assert {(r.position, r.id) for r in found} == {(p, every[p] if p is not None and 0 <= p < len(every) else None) for p in wanted}
    assert len(token_files.read_manifest(place)) > 1


def test_texts_reach_the_writer_in_small_batches(spark, file, monkeypatch):
    most = 2 * token_files.BATCH_BYTES if hasattr(token_files, "BATCH_BYTES") else 16 << 20

    class Watched(token_files.TokenTable):
        def writer(self, schema, overwrite):
            writer = super().writer(schema, overwrite)
            write = writer.write

            def watch(batches):
                for b in batches:
                    if b.schema.types[1] != pa.string() or b.nbytes > most:
                        raise ValueError(f"a batch of {b.nbytes} bytes, {b.schema}")
                    yield b

            writer.write = lambda batches: write(watch(batches))
            return writer

    monkeypatch.setattr(token_files, "TokenTable", Watched)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd. "), 1500).alias("text"))
    place, name = f"{shared_folder(spark)}/tokens-batches", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    token_files.write_tokens(docs, place, file)
    assert spark.conf.get(name, None) == before
    assert [f["docs"] for f in token_files.read_manifest(place)] == [3000]
    whole = token_files.encode_texts(docs, file).withColumnRenamed("ids", "whole")
    assert token_files.read_tokens(spark, place).join(whole, "doc_id").where("ids = whole").count() == 3000


def test_no_documents_no_files(spark, file):
    place = f"{shared_folder(spark)}/tokens-none"
    token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), place, file)
    assert token_files.read_manifest(place) == []
    assert token_files.read_tokens(spark, place).count() == 0


def test_rows_out_of_order_are_refused(spark, file):
    spark.dataSource.register(token_files.TokenTable)
    rows = spark.createDataFrame([(2, bytearray(b"\x01\0\0\0")), (1, bytearray(b"\x01\0\0\0"))], "doc_id bigint, ids binary").repartitionByRange(2, F.desc("doc_id"))
    place = f"{shared_folder(spark)}/tokens-odd"
    with pytest.raises(Exception, match="ascending order"):
        rows.write.format("dac_tokens").mode("append").save(place)
    with pytest.raises(FileNotFoundError):
        token_files.read_manifest(place)


def test_uncommitted_files_are_no_part_of_the_table(spark, file, tmp_path):
    place = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), place, file)
    (tmp_path / "t" / "part-000009-lost.dac").write_bytes(b"half a file")
    assert token_files.read_tokens(spark, place).count() == 1
    assert json.loads((tmp_path / "t" / "manifest.json").read_text())[0]["docs"] == 1


def test_op11_counts_and_places(spark, tiny):
    found = token_files.op11_token_files(spark, tiny).orderBy("doc_id").collect()
    starts = list(itertools.accumulate((r.n_tokens for r in found), initial=0))
    assert [r.start for r in found] == starts[:-1]


# spelling variants


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_pairs_equal_all_pairs(spark):
    random.seed(5)
    words = {"".join(random.choices("abé", k=random.randint(4, 8))) for _ in range(400)} | {"aaaaaaaa", "aaaaaaa", "aaaaaabaa"}
    df = spark.createDataFrame([(w, 2 + len(w)) for w in words], "word string, n bigint")
    found = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a < b and one_apart(a, b)}


def test_forms_and_roots(spark):
    counts = {"example": 2000, "exmple": 1, "exampl": 150, "examp": 12, "exampls": 3, "exomple": 200, "alone": 5, "to": 9, "tie": 400, "tia": 4}
    rows = {r.word: r for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert rows.keys() == counts.keys()
    near = {w: [v for v in counts if len(v) > 3 and len(w) > 3 and one_apart(w, v)] for w in counts}
    for w, r in rows.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 10 * counts[w] else None
        assert (r.form, r.form_n, r.n_near) == (form, counts.get(form), len(near[w]))
        root = w
        while rows[root].form:
            root = rows[root].form
        assert r.root == root
    assert rows["examp"].root == "example" and rows["exomple"].root == "example"
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_runs_and_misspellings(spark):
    df = spark.createDataFrame([(1, "ABCDEFG hÀÿzzzz' short Ābcdefgh"), (None, None), (2, "")], "doc_id bigint, text string")
    assert [r.r for r in df.select(F.explode(spelling.letter_runs(F.col("text"))).alias("r")).collect()] == ["abcdefg", "hÀÿzzzz", "bcdefgh"]
    made = df.where("doc_id = 1").select(spelling.misspelt(F.col("doc_id"), F.lit("abcdefg"), 1).alias("w"), (F.crc32(F.lit("1:abcdefg").cast("binary")) % 7).alias("at")).first()
    assert made.w == "abcdefg"[: made.at] + "abcdefg"[made.at + 1 :]


# vector codes


def test_nearest_is_exact():
    rng = np.random.default_rng(7)
    x, book = rng.integers(-(1 << 27), 1 << 27, (300, 16)), rng.integers(-(1 << 27), 1 << 27, (40, 16))
    book[30] = book[3]
    place, error = vector_codes.nearest(x, book)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x]
    assert place.tolist() == [e.index(min(e)) for e in every] and error.tolist() == [min(e) for e in every]


SCHEMA = "vec_id bigint, v array<double>, label string, code string"


def test_odd_vectors_have_codes(spark):
    rows = [(3, [0.1, -0.1, 2.0, 3.0, 1.0]), (1, [0.5]), (None, [9.0] * 5), (2, None), (4, [float("inf")]), (5, [None]), (6, []), (7, [1e300, -1e300]), (1, [0.5])]
    df = spark.createDataFrame([(i, v, None if i == 1 else "x", "own") for i, v in rows], SCHEMA)
    books = vector_codes.fit(df, vector="v")
    assert books.values.shape == (4, 6, 2)
    found = vector_codes.encode(df, books, keep=("vec_id", "label"), vector="v")
    coded = found.collect()
    assert sorted((str(r.vec_id) for r in coded)) == sorted(["3", "1", "None", "6", "7", "1"])
    again = {r.code: r.decoded for r in vector_codes.decode(found, books).collect()}
    for r in coded:
        assert all(bytes.fromhex(r.code)[p] < 6 for p in range(4)) and len(again[r.code]) == 8
    sums = {(r.vec_id, r.label_error) for r in vector_codes.label_errors(found).collect()}
    own = sum(r.error for r in coded if r.label is None)
    assert (1, own) in sums
    none = df.where("vec_id = 2")
    books = vector_codes.fit(none, vector="v")
    assert vector_codes.encode(none, books, vector="v").count() == 0 and len(books.sha256) == 64


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2000, 2000, (400, 8)) / 1024
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, v array<double>")
    books = vector_codes.fit(df, vector="v", entries=16, rounds=3)
    coded = vector_codes.encode(df, books, vector="v")
    decoded = {r.code: np.array(r.decoded) for r in vector_codes.decode(coded, books).collect()}
    for r in coded.collect():
        assert round(float((((vectors[r.vec_id] - decoded[r.code]) * 1024) ** 2).sum())) == r.error


# rows that repeat a key, rules that change


def test_copies_are_told_by_row_not_by_key(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    schema = "doc_id bigint, text string"
    rows = {(r.doc_id, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, a), (5, a), (5, b)], schema)).collect()}
    assert rows == {(1, a), (5, ""), (5, b)}
    rows = {(r.doc_id, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, a), (5, a), (5, b), (3, b + " more")], schema)).collect()}
    assert rows == {(1, a), (5, ""), (3, b + " more")}


def test_a_changed_rule_is_another_rule(spark):
    docs = spark.createDataFrame([(1, "aaa 123 bbb")], "doc_id bigint, text string")
    place = f"{shared_folder(spark)}/ledger-rules"
    spans = lambda rule: [(f["start"], f["end"]) for r in secrets.scan_versions(docs, place, rules=(rule,)).collect() for f in r.findings]
    assert spans(secrets.SecretRule("x", "bbb")) == [(8, 11)]
    assert spans(secrets.SecretRule("x", "[0-9]+")) == [(4, 7)]
    assert spans(secrets.SecretRule("x", "[0-9]+", least=4)) == []


# personal data in formats that neither the base patterns nor the made-up lines were copied from

HELD = [
    ("Reach our desk under 030 1234 5678 on weekdays, or write to help@office.example.org instead.", [("030 1234 5678", "phone"), ("help@office.example.org", "email")]),
    ("Call (415) 555-2671 after nine.", [("(415) 555-2671", "phone")]),
    ("Her mobile, 07911 123 456, was off.", [("07911 123 456", "phone")]),
    ("Tel. 212-555-0187, fax 212-555-0188.", [("212-555-0187", "phone"), ("212-555-0188", "phone")]),
    ("Ring 0044 207 9460958 and ask for the porter.", [("0044 207 9460958", "phone")]),
    ("Dial 303.555.0142 for the hotline!", [("303.555.0142", "phone")]),
    ("Appelez le 01 42 68 53 00 demain.", [("01 42 68 53 00", "phone")]),
    ("The number is +49 170 555 0199.", [("+49 170 555 0199", "phone")]),
    ("Paid with 4111.1111.1111.1111 yesterday.", [("4111.1111.1111.1111", "card")]),
    ("card: 5500-0000-0000-0004 exp 09/27", [("5500-0000-0000-0004", "card")]),
    ("Amex 3782 822463 10005 was charged twice.", [("3782 822463 10005", "card")]),
    ("Please bill 4012/8888/8888/1881 for both rooms.", [("4012/8888/8888/1881", "card")]),
    ("use 6011_1111_1111_1117 as the test card", [("6011_1111_1111_1117", "card")]),
    ("The host 10.20.30[.]40 did not answer.", []),
    ("It listens on 192[.]168[.]0[.]12 behind the wall.", [("192[.]168[.]0[.]12", "ip")]),
    ("Blocked 203.0.113.77 again, then 198.51.100.4 too.", [("203.0.113.77", "ip"), ("198.51.100.4", "ip")]),
    ("ping 172 . 16 . 254 . 1 from there", [("172 . 16 . 254 . 1", "ip")]),
    ("Mail anna.berg @ post.example.com before noon.", [("anna.berg @ post.example.com", "email")]),
    ("contact: j_doe42@mail.net", [("j_doe42@mail.net", "email")]),
    ("Log entry 20240101123456 was written at start.", []),
    ("At 2024-03-05 10:22:33 the job ended.", []),
    ("Serial SN4411200934 and order 9920114453 were swapped.", []),
    ("Invoice 4539578763621487 is not a card that checks.", []),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
    ("His file is 123-45-6789 in the archive.", []),
    ("About 1,234,567 people came in 2023.", []),
    ("Version 4.12.7 fixed bug 88213.", []),
    ("The id 3fa85f64-5717-4562-b3fc-2c963f66afa6 was reused.", []),
    ("A score of 12:04:59 over 42.195 km.", []),
    ("Zip 94107-1234, box 5521.", []),
    ("Follow @lexigrid for news, 3 items @ 12.50 each.", []),
    ("ticket ABC-2024-0091 closed 2021/11/30", []),
    ("Chapter 12, lines 100-145 and 210-230.", []),
    ("Pi is 3.14159265358979 or so.", []),
    ("Batch 0009-1182 shipped with 640x480 screens.", []),
]


def test_personal_data_in_lines_written_by_hand(spark, small):
    """Precision and recall on lines that have nothing to do with the training lines' generator."""
    model = pii.train(spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 2 = 0"))
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD)], "doc_id bigint, text string")
    found = {r.doc_id: [(HELD[r.doc_id][0][x.start : x.end], x.kind) for x in r.base + r.added] for r in pii.find_pii(rows, model).collect()}
    right = sum(len(set(found[i]) & set(want)) for i, (_, want) in enumerate(HELD))
    assert right / sum(map(len, found.values())) >= 0.85 and right / sum(len(want) for _, want in HELD) >= 0.85
    assert not any(k == "card" and not pii.luhn("".join(c for c in x if c.isdigit())) for spans in found.values() for x, k in spans)
