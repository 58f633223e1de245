"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import add_columns, crc_remainder, pieces, table
from lexigrid.llm.textbytes import mix

ORDER = 4
#: Bounds of the training and of the calibration sample: texts of each language.
SAMPLE_TEXTS = 600
UNDETERMINED = "und"
#: Length classes, by the binary logarithm of the number of characters, and calibration texts that make a class.
CLASSES, CLASS_TEXTS = 16, 20
_BITS = np.uint64(16)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of every code point its lower-case form in 16 bits if it is a letter, else a space.

    Letters above U+FFFF share the private codes from U+E000 on, which no letter has.
    """
    out = np.full(0x110000, 0x20, dtype=np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            point = ord(low) if len(low) == 1 else i
            out[i] = point if point < 0x10000 else 0xE000 + point % 6400
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ORDER letters or single spaces, and how many each text has.

    The latest character is in the lowest bits. Each text starts behind spaces;
    texts without letters have no codes.
    """
    closed = "".join([t + "\n" for t in texts])
    chars = _letters()[np.frombuffer(closed.encode("utf-32-le"), dtype=np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    space = chars == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run, and each text's closing one
    chars, owner, fresh = chars[keep], owner[keep], np.flatnonzero(np.diff(owner[keep], prepend=-1))
    sizes = np.bincount(owner, minlength=len(texts))
    lone = (sizes == 1) & (np.bincount(owner, weights=chars == 0x20, minlength=len(texts)) == 1)
    code, since = chars.copy(), np.arange(len(chars)) - np.repeat(fresh, np.diff(np.append(fresh, len(chars))))
    for back in range(1, ORDER):
        earlier = np.full(len(chars), 0x20, dtype=np.uint64)
        earlier[back:] = chars[:-back]
        earlier[since < back] = 0x20
        code |= earlier << np.uint64(16 * back)
    sizes[lone] = 0
    return code[~lone[owner]], sizes


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


@dataclass
class LanguageModel:
    """For each order: sorted hashes of n-grams, their log probability and log backoff weight by language."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    log_backoff: list[np.ndarray]
    unseen: np.ndarray
    limit: np.ndarray  # the greatest cross-entropy that is not rejected, by language and length class

    def _find(self, order: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[order - 1]
        hashes = mix(codes)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def log_probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each n-gram's last character given the others, by language."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(codes), len(self.languages)))
        at, hit = self._find(order, codes & _mask(order))
        out = self.log_p[order - 1][at]
        missed = np.flatnonzero(~hit)
        if len(missed):
            rest = codes[missed]
            lower = self.log_probabilities(rest, order - 1).copy()
            if order > 1:
                where, known = self._find(order - 1, (rest >> _BITS) & _mask(order - 1))
                lower[known] += self.log_backoff[order - 2][where[known]]
            out[missed] = lower
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of each text by language, and the number of characters scored."""
        codes, sizes = _grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            total[some] = np.add.reduceat(self.log_probabilities(codes), starts, axis=0, dtype=np.float64)
        return total, sizes


def _fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """counts: of each language the codes of its ORDER-grams and how often they occur."""
    languages = sorted(counts)
    by_order = [{lang: None for lang in languages} for _ in range(ORDER)]
    for lang in languages:
        codes, n = counts[lang]
        by_order[ORDER - 1][lang] = (codes, n)
        for order in range(ORDER - 1, 0, -1):  # continuation counts: types that end in the n-gram
            codes, n = np.unique(codes & _mask(order), return_counts=True)
            by_order[order - 1][lang] = (codes, n)
    # histories too: those before a text's first letters end no n-gram
    histories = lambda k: [by_order[k + 1][lang][0] >> _BITS for lang in languages] if k + 1 < ORDER else []
    unions = [np.unique(np.concatenate([by_order[k][lang][0] for lang in languages] + histories(k))) for k in range(ORDER)]
    p = [np.zeros((len(u), len(languages))) for u in unions]
    backoff = [np.ones((len(u), len(languages))) for u in unions]
    alphabet = len(unions[0]) + 1
    unseen = np.zeros(len(languages))
    for j, lang in enumerate(languages):
        for k in range(ORDER):
            codes, n = by_order[k][lang]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, inverse = np.unique(codes >> _BITS, return_inverse=True)
            total = np.bincount(inverse, weights=n)
            weight = discount * np.bincount(inverse) / total
            if k == 0:
                lower = np.full(len(unions[0]), 1.0 / alphabet)
                at, of = np.zeros(len(unions[0]), dtype=int), np.ones(len(unions[0]), dtype=bool)
                unseen[j] = weight[0] / alphabet
            else:
                lower = p[k - 1][np.searchsorted(unions[k - 1], unions[k] & _mask(k)), j]
                at = np.minimum(np.searchsorted(context, unions[k] >> _BITS), len(context) - 1)
                of = context[at] == unions[k] >> _BITS
                backoff[k - 1][np.searchsorted(unions[k - 1], context), j] = weight
            p[k][:, j] = np.where(of, weight[at] * lower, lower)
            own = np.searchsorted(unions[k], codes)
            p[k][own, j] += np.maximum(n - discount, 0) / total[inverse]
    order = [np.argsort(mix(u)) for u in unions]
    return LanguageModel(
        languages,
        [mix(u)[o] for u, o in zip(unions, order, strict=True)],
        [np.log(x)[o].astype(np.float32) for x, o in zip(p, order, strict=True)],
        [np.log(x)[o].astype(np.float32) for x, o in zip(backoff, order, strict=True)],
        np.log(unseen).astype(np.float32),
        np.full((len(languages), CLASSES), np.inf),
    )


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, quantile: float = 0.998, slack: float = 0.15) -> LanguageModel | None:
    """A model of the languages in ``lang``; None if no row has both a language and a letter.

    The classifier is fitted on a bounded sample: about ``sample_texts`` whole
    texts of each language, by hash, and calibrated on as many others. Rows are
    parted by the crc32 of the key. Rejection is calibrated on the second part,
    for each language and length class: the limit is the ``quantile`` of the
    cross-entropies of its texts that are recognised, raised by ``slack``. A
    class of fewer than CLASS_TEXTS has the limit of the next longer, widened as
    chance is wider in shorter texts; a language without any class has one of all
    its texts, and none without texts. Null languages, null texts and texts
    without letters are left out. The sample is counted on the executors.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"), crc_remainder(F.col(key), 2).alias("side"), F.xxhash64(F.lit("sample"), key, text).alias("deal"))
    sizes = usable.groupBy("lang", "side").count().collect()
    if not sizes:
        return None
    share = lambda n: min(1.0, sample_texts / n)
    fits = [(F.col("lang") == r.lang) & (F.col("side") == r.side) & (F.shiftrightunsigned("deal", 11) <= int(share(r["count"]) * ((1 << 53) - 1))) for r in sizes]
    sample = usable.where(reduce(lambda a, b: a | b, fits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                names = batch.column(0)[a:b].to_pylist()
                codes, n = _grams(batch.column(1)[a:b].to_pylist())
                owner = np.repeat(names, n)
                for name in sorted(set(names)):
                    found, times = np.unique(codes[owner == name], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times)], ["lang", "code", "n"])

    # a language whose rows all fall on one side is trained and calibrated on it
    sides = {lang: {r.side for r in sizes if r.lang == lang} for lang in {r.lang for r in sizes}}
    lonely = [lang for lang, s in sides.items() if len(s) == 1]
    first = sample.where((F.col("side") == 0) | F.col("lang").isin(lonely))
    counted = first.select("lang", "t").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    codes = {name: rows.sort_values("code") for name, rows in counted.groupby("lang")}
    arrays = {}
    for name, rows in codes.items():
        values = rows["code"].to_numpy().view(np.uint64)
        order = np.argsort(values)
        arrays[name] = values[order], rows["n"].to_numpy()[order]
    model = _fit(arrays)
    second = sample.where((F.col("side") != 0) | F.col("lang").isin(lonely)).where(F.col("lang").isin(model.languages))
    judged = _score(second.select("lang", "t"), "t", model).where("lang = lang_pred")
    most = F.percentile_approx("cross_entropy", F.lit(quantile), F.lit(10_000)).alias("most")
    found = judged.rollup("lang", F.least(F.floor(F.log2("scored")), F.lit(CLASSES - 1)).alias("class")).agg(most, F.count("*").alias("n")).where("lang is not null").collect()
    wider = lambda c: 2 / np.sqrt(2.0**c)
    for j, name in enumerate(model.languages):
        whole = next((r.most for r in found if r.lang == name and r["class"] is None), np.inf)
        known = {r["class"]: r.most for r in found if r.lang == name and r["class"] is not None and r.n >= CLASS_TEXTS}
        last = known[max(known)] if known else whole
        for c in range(CLASSES - 1, -1, -1):
            last = max(last, known[c]) if c in known else last + (wider(c) - wider(c + 1) if not known or c < max(known) else 0)
            model.limit[j, c] = last * (1 + slack)
    return model


def _score(docs: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        model = shared.value
        total, sizes = model.score([t or "" for t in texts.to_pylist()])
        best = total.argmax(axis=1)
        known = sizes > 0
        top = total[np.arange(len(best)), best]
        posterior = 1 / np.exp(total - top[:, None]).sum(axis=1)
        entropy = -top / np.maximum(sizes, 1)
        length = np.minimum(np.floor(np.log2(np.maximum(sizes, 1))).astype(int), CLASSES - 1)
        rejected = ~known | (entropy > model.limit[best, length])
        names = np.where(known, np.array([*model.languages], dtype=object)[best], UNDETERMINED)
        return [pa.array(names, pa.string()), pa.array(np.where(known, posterior, 0.0)), pa.array(np.where(known, entropy, np.nan), from_pandas=True), pa.array(sizes.astype(np.int64)), pa.array(rejected)]

    return add_columns(docs, text, "lang_pred string, score double, cross_entropy double, scored bigint, rejected boolean", compute)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy, scored and rejected, from whole texts alone.

    lang_pred: the language of the lowest length-normalised cross-entropy, the
    first by name on a tie; ``und`` for null texts and those without a letter.
    score: its posterior among the model's languages, 0 for ``und``. scored: how
    many characters count, letters and single spaces. rejected: ``und``, or a
    cross-entropy over the limit of the language and length class. Without a
    model every text is ``und`` and rejected. Rows that repeat are treated alike;
    an empty table gives an empty one; columns of docs with these names are
    replaced. A worker has some 1 MB of text in hand, or one longer text.
    """
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "scored": F.lit(0).cast("bigint"), "rejected": F.lit(True)})
    return _score(docs, text, model)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
