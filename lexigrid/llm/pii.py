"""PII: exact base patterns, and spans that a BiLSTM with CRF transitions adds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.bilstm_crf import BiLstmCrf
from lexigrid.llm.common import add_columns, pieces, shared_folder, table

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and between the starts of two.
WINDOW, STRIDE = 96, 48
#: Bounds of the training sample, in windows of text, and of the training itself.
SAMPLE_WINDOWS, STEPS, BATCH = 3000, 480, 64

# The base patterns. A digit before the start would have been in the match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _ip_fits(text: str) -> bool:
    return all(len(x.lstrip("0")) < 4 and int(x[-9:]) <= 255 for x in text.split("."))


def _card_fits(text: str) -> bool:
    found = _digits(text)
    return 14 <= len(found) <= 19 and luhn(found)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap and fit, by start, then kind."""
    out: list[Span] = []
    if not _TRIGGER.search(text):
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_fits(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card_fits(m[0])]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Of each code point below 0x3000 a small symbol; all digits share one, other letters too."""
    marks = " \n.,;:@+-_()[]/%#&=\"'<>|$*!?"
    out = np.ones(0x3000, dtype=np.int64)
    for i in range(0x3000):
        c = chr(i)
        if c in marks:
            out[i] = 4 + marks.index(c)
        elif "0" <= c <= "9":
            out[i] = 3
        elif "a" <= c.lower() <= "z" and i < 128:
            out[i] = 40 + ord(c.lower()) - 97
        elif c.isalpha():
            out[i] = 2
    return out


SYMBOLS, TAGS = 67, 1 + 2 * len(KINDS)


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < 0x3000, _symbol_table()[np.minimum(points, 0x2FFF)], 2)


def _tags(size: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for start, kind, end in spans:
        if not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def _window_starts(size: int, triggers: np.ndarray) -> np.ndarray:
    """Starts of the windows with a trigger: no kind can do without a digit or an at sign."""
    last = max(0, -(-(size - WINDOW) // STRIDE))
    first = np.maximum(0, -(-(triggers - WINDOW + 1) // STRIDE))
    found = np.concatenate([np.clip(first + k, 0, last) for k in range(WINDOW // STRIDE)] or [np.zeros(0, np.int64)])
    found = np.unique(found)
    return found * STRIDE


def _fits(kind: int, text: str) -> bool:
    """What every span that the model adds must have; its shape is the model's to judge. A card must pass the check of its digits."""
    found = _digits(text)
    if kind == 0:
        name, _, domain = text.partition("@")
        return bool(name.strip()) and "." in domain.strip(".")
    if kind == 1:
        numbers = re.findall(r"[0-9]+", text)
        return len(numbers) == 4 and all(len(x) < 4 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 13 <= len(found) <= 19 and luhn(found)
    return 9 <= len(found) <= 15


def _spans_of(path: np.ndarray) -> list[Span]:
    out, n = [], len(path)
    i = 0
    while i < n:
        tag = path[i]
        if tag:
            kind = int(tag - 1) // 2
            j = i + 1
            while j < n and path[j] == 2 + 2 * kind:
                j += 1
            out.append((i, kind, j))
            i = j
        else:
            i += 1
    return out


def _windows(symbols: np.ndarray) -> list[int]:
    """Starts of the windows to decode."""
    return _window_starts(len(symbols), np.flatnonzero((symbols == 3) | (symbols == 10))).tolist()


def _fit_window(values: np.ndarray, start: int) -> np.ndarray:
    part = values[start : start + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)))


def paths(texts: list[str], model: BiLstmCrf) -> list[np.ndarray]:
    """The tag of every character: overlapping windows are decoded, then reconciled over each text.

    Where two windows overlap, each speaks for the half that lies deeper in it,
    so a span that no window holds whole comes out in one piece.
    """
    cut, where, out = [], [], []
    for row, text in enumerate(texts):
        symbols = _symbols(text)
        out.append(np.zeros(len(symbols), dtype=np.int64))
        starts = _windows(symbols)
        for i, start in enumerate(starts):
            met = i > 0 and start - starts[i - 1] == STRIDE
            meets = i + 1 < len(starts) and starts[i + 1] - start == STRIDE
            shared = (WINDOW - STRIDE) // 2
            cut.append(_fit_window(symbols, start))
            where.append((row, start, start + shared * met, min(start + WINDOW - shared * meets, len(symbols))))
    for lo in range(0, len(cut), 512):
        for (row, start, a, b), path in zip(where[lo : lo + 512], model.decode(np.stack(cut[lo : lo + 512])), strict=True):
            out[row][a:b] = path[a - start : b - start]
    return out


def _added(texts: list[str], bases: list[list[Span]], model: BiLstmCrf) -> list[list[Span]]:
    """Spans of the model that overlap no base span, cut no word or number, and have what their kind must have."""
    out = []
    for text, base, path in zip(texts, bases, paths(texts, model), strict=True):
        found = []
        for a, kind, b in _spans_of(path):
            cut = text[max(0, a - 1) : a].isalnum() or text[b : b + 1].isalnum()
            if not cut and all(b <= s or a >= e for s, _, e in base) and _fits(kind, text[a:b]):
                found.append((a, kind, b))
        out.append(found)
    return out


def _example(rng: np.random.Generator, word) -> tuple[str, int]:
    """A made-up span of a kind (-1: none) in one of several formats."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    byte = lambda: str(rng.integers(0, 256))
    kind = int(rng.integers(-1, 4))
    if kind == 0:
        return f"{word()}{pick('.', '_', '-', '')}{pick(d(2), word())}{pick('@', '@', '@', ' @ ')}{word()}{pick('', d(1))}.{pick('example.', '')}{pick('com', 'org', 'net', 'de')}", 0
    if kind == 1:
        return pick(".", ".", "[.]", " . ").join(byte() for _ in range(4)), 1
    if kind == 2:
        return pick(pick("", " ", "-", ".", " - ", "/", "_").join(d(4) for _ in range(4)), pick(" ", ".", "-").join((d(4), d(6), d(5))), d(16)), 2
    if kind == 3:
        return pick(
            f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
            f"00{d(2)} {d(3)} {d(7)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(3)}/{d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ), 3
    hexes = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    date = f"20{d(2)}{pick('-', '/', '.')}{pick('0', '1')}{d(1)}{pick('-', '/', '.')}{d(2)}"
    return pick(
        d(int(rng.integers(1, 15))), f"{d(1)}.{d(2)}", date, f"{date} {d(2)}:{d(2)}:{d(2)}", f"20{d(12)}", f"20{d(6)}T{d(6)}Z", f"20{d(2)}", hexes(40), hexes(int(rng.integers(12, 33))), f"{d(3)},{d(3)}", f"{d(1)},{d(3)},{d(3)}", f"@{word()}",
        f"v{d(1)}.{d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.", f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)}x{d(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"{pick('SN', 'No. ', 'order ', '#', 'ID-', 'ref ')}{d(int(rng.integers(6, 13)))}",
        f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(5)}-{d(4)}", f"{word()}-{d(4)}-{d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)}-{d(4)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"price @ {d(2)}.{d(2)}",
    ), -1


def made_up(rng: np.random.Generator, word) -> tuple[str, list[Span]]:
    """A line of words with a made-up span or a number that is none."""
    made, kind = _example(rng, word)
    head = (" ".join(word() for _ in range(rng.integers(0, 9))) + " ")[-60:]
    line = head + made + rng.choice([" ", ".", ", ", "\n", "%%% ", " | "]) + " ".join(word() for _ in range(14))
    return line[: max(WINDOW, len(head) + len(made))], [(len(head), kind, len(head) + len(made))] if kind >= 0 else []


def labelled_spans(text: str) -> list[Span]:
    """What a text teaches: its base spans, and the shape of cards where the check of digits fails; none of these is added, see _fits."""
    base = base_spans(text)
    cards = [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(_digits(m[0])) <= 19]
    return sorted({*base, *(c for c in cards if all(c[2] <= s or c[0] >= e for s, _, e in base))})


def sample(docs: DataFrame, text: str = "text", sample_windows: int = SAMPLE_WINDOWS) -> list[str]:
    """At most ``sample_windows`` different windows of text, those of least hash among all windows of all texts.

    Windows are cut from whole texts on the executors. How many different ones
    there are is estimated first, so that only hashes below a bound, with a
    third to spare, are brought together: what is shuffled and what the driver
    sees is of the sample's size.
    """

    def cut(batches: Iterator[pa.RecordBatch], most: int, named: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                found: dict[int, str] = {}
                for value in batch.column(0)[a:b].to_pylist():
                    for start in _windows(_symbols(value)):
                        part = value[start : start + WINDOW]
                        h = xxhash.xxh3_64_intdigest(part.encode("utf-8", "replace")) >> 1
                        if h <= most:
                            found[h] = part
                yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()) if named else [None] * len(found), pa.string())], ["h", "w"])

    usable = docs.select(F.col(text).alias("t")).where(F.rlike(F.col("t"), F.lit("[0-9@]")))
    windows = lambda most, named: usable.mapInArrow(lambda it: cut(it, most, named), "h bigint, w string")
    every = (1 << 63) - 1
    n = windows(every, False).agg(F.approx_count_distinct("h", 0.02)).first()[0]
    most = int(min(1.0, 4 / 3 * sample_windows / max(1, n)) * every)
    return [r.w for r in windows(most, True).groupBy("h").agg(F.min("w").alias("w")).orderBy("h").limit(sample_windows).collect()]


def fit(windows: list[str], steps: int = STEPS, seed: int = 7) -> BiLstmCrf:
    """A tagger trained on windows, as labelled_spans has them, and as many made-up lines of their words."""
    rng = np.random.default_rng(seed)
    plain = [w for t in windows for x in t.split()[1:-1] if not _TRIGGER.search(x) and (w := x.strip(".,|!?;:#*$%&"))]
    plain = plain or ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    word = lambda: plain[rng.integers(len(plain))]
    real = [(t, labelled_spans(t)) for t in windows]
    model = BiLstmCrf(SYMBOLS, TAGS, seed=seed)
    for step in range(steps):
        lines = [real[rng.integers(len(real))] if real and i % 3 == 0 else made_up(rng, word) for i in range(BATCH)]
        xs = np.stack([_fit_window(_symbols(t), 0) for t, _ in lines])
        ys = np.stack([_fit_window(_tags(len(t), spans), 0) for t, spans in lines])
        model.train(xs, ys, rate=0.012 if step < steps * 2 // 3 else 0.003)
    model.moments = {}
    return model


def train(docs: DataFrame, text: str = "text", sample_windows: int = SAMPLE_WINDOWS, steps: int = STEPS, seed: int = 7) -> BiLstmCrf:
    """A tagger fitted on labelled spans of a bounded sample, see sample; a table without digits and at signs gives one of made-up lines alone.

    Its parameters are kept as a table in the shared folder, named by what they
    were fitted on, so a second call on the same sample does not train again.
    """
    windows = sample(docs, text, sample_windows)
    spark = docs.sparkSession
    name = xxhash.xxh3_128_hexdigest(repr((windows, steps, seed, BATCH, WINDOW)).encode("utf-8", "replace"))
    place = f"{shared_folder(spark)}/pii-{name}"
    shape = "name string, data binary"
    model = BiLstmCrf(SYMBOLS, TAGS, seed=seed)
    try:
        stored = {r.name: bytes(r.data) for r in spark.read.schema(shape).parquet(place).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = {}
    if set(stored) != set(model.p):
        model = fit(windows, steps, seed)
        rows = [(k, v.astype(np.float32).tobytes()) for k, v in model.p.items()]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(place)
        return model
    model.p = {k: np.frombuffer(stored[k], dtype=np.float32).reshape(v.shape) for k, v in model.p.items()}
    model.moments = {}
    return model


def _redacted(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for start, kind, end in sorted(spans, key=lambda x: (x[0], x[2])):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, model: BiLstmCrf, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with base and added: arrays of (start, kind, end), code points, end exclusive.

    base: the exact patterns' spans; added: the model's, none of which overlaps
    one of those. Whole texts are read, however long; null and empty texts have
    no spans. Windows without a digit or an at sign are not decoded, as no kind
    can do without. Spans are ordered by start, then kind as in KINDS. Rows that
    repeat are treated alike; an empty table gives an empty one; columns of docs
    named base or added are replaced.

    redact: also replaces each span in the text by its kind in angle brackets;
    overlapping ones as one, by the first's name. A null text stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array(KINDS, dtype=object)

    def column(rows: list[list[Span]]) -> pa.Array:
        flat = [s for row in rows for s in row]
        spans = pa.StructArray.from_arrays(
            [pa.array([s[0] for s in flat], pa.int64()), pa.array([names[s[1]] for s in flat], pa.string()), pa.array([s[2] for s in flat], pa.int64())], ["start", "kind", "end"]
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), spans)

    def compute(texts: pa.Array) -> list[pa.Array]:
        values = texts.to_pylist()
        bases = [base_spans(t or "") for t in values]
        some = [i for i, t in enumerate(values) if t and _TRIGGER.search(t)]
        added: list[list[Span]] = [[] for _ in values]
        for i, spans in zip(some, _added([values[i] for i in some], [bases[i] for i in some], shared.value), strict=True):
            added[i] = spans
        out = [column(bases), column(added)]
        if redact:
            out.append(pa.array([t and _redacted(t, x + y) for t, x, y in zip(values, bases, added, strict=True)], pa.string()))
        return out

    span = "array<struct<start: bigint, kind: string, end: bigint>>"
    return add_columns(docs, text, f"base {span}, added {span}" + f", `{text}` string" * redact, compute)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    key = lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    spell = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.concat("base", "added")).alias("spans"),
    )
