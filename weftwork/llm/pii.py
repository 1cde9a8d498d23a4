"""Personal information in free text: found by a character-level BiLSTM with CRF transitions, and replaced.

Training (``fit``): at most ``SAMPLE`` texts, those with the smallest hashes, are labelled by general forms and the list of
given names (``pii_forms``), copies of them carry invented values in place of what was labelled, and the texts are cut
into windows. The windows are dealt to ``SHARDS`` tasks; in each round every task trains on its shard, and the weights are
averaged. The model is kept in the shared folder. Apart from that bounded sample every step goes over all texts, whole.

Tagging (``find``): a text is read in windows that overlap by twice ``MARGIN``; each character takes its scores from the
window where it lies farther from the edge, and one Viterbi pass over the whole text decides the spans. Texts above
``SEGMENT`` characters are decided in overlapping segments. A form of its kind trims a found span to exact bounds; a span
without one stays as it was tagged.

Defined results: null, empty and blank texts have no spans; a piece of text found twice in a document comes out once per
kind; equal texts are read once; rows delivered again count once; rows with a null key are dropped; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import pii_forms, tagger
from weftwork.llm.sets import classes, latest
from weftwork.operators.skew import hot_join
from weftwork.storage import cut, shared_dir

SAMPLE, MADE, HIDDEN, SHARDS, ROUNDS, PASSES, RATE, BATCH, SEED = 6_000, 8_000, 32, 6, 13, 1.0, 0.02, 16, 97
#: Characters of a training window, of a reading window, its margin, and of a segment of a long text.
TRAIN_WINDOW, WINDOW, MARGIN, SEGMENT, REACH = 128, 256, 32, 50_000, 512
#: Of longer texts of the sample a stretch of so many characters at a hashed place: nothing is found in it.
SAMPLE_CHARS = 3_000
#: Raised when training itself changes, so that stored models of before are not read.
MODEL = "6"
_TOKEN = re.compile(r"[^\W\d_]+")
#: What looks like personal information at first sight: long numbers, capitalised words side by side.
_LIKE = re.compile(r"\d[\d .\-]{4,}\d|[^\W\d_a-zà-ÿ][^\W\d_]+,? [^\W\d_a-zà-ÿ][^\W\d_]+")
_TRIM = " \t\n\r\N{NO-BREAK SPACE},;:!?\"'“”«»<>()[]{}|*_~`.-–—"


def flag_codes(text: str, given: frozenset[str]) -> np.ndarray:
    """1 on words that are listed given names, 2 on such words written with a capital, 0 elsewhere."""
    out = np.zeros(len(text), dtype=np.uint8)
    for m in _TOKEN.finditer(text):
        if m.group().lower() in given:
            out[m.start() : m.end()] = 2 if m.group()[0].isupper() else 1
    return out


def tag_codes(length: int, spans: Iterable[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(length, dtype=np.uint8)
    for a, b, kind in spans:
        k = 1 + 2 * tagger.KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


def stretch(text: str, spans: list, kind: str, r, most: int = 400) -> tuple[str, list]:
    """The text, or of a long one a stretch around one of its spans of the kind that tears none."""
    if len(text) <= most:
        return text, spans
    x, y, _ = r.choice([s for s in spans if s[2] == kind])
    a, b = max(0, x - r.randrange(20, 200)), min(len(text), y + r.randrange(20, 200))
    for x, y, _ in spans:
        if x < a < y:
            a = y
        if x < b < y:
            b = x
    return text[a:b], [(x - a, y - a, k) for x, y, k in spans if a <= x and y <= b]


def windows(texts: list[str], given: frozenset[str], names: list[str], made: int, seed: int) -> tuple[np.ndarray, ...]:
    """Codes, flags, tags (N x TRAIN_WINDOW) and lengths to train on: windows with spans, and others, first of all such as look like it.

    Beside the labelled texts themselves, copies of them with invented values in place of their spans, about ``made``
    values, each kind as often as the others where the sample has contexts of it. Windows with words that may be a name or
    not are left out.
    """
    maker = pii_forms.Maker(seed, names)
    texts = [t for t in texts if t and t.strip()]
    docs = [(t, spans + [(a, b, "open") for a, b in open_]) for t, (spans, open_) in zip(texts, pii_forms.label(texts, given))]
    by_kind = {k: [d for d in docs if any(s[2] == k for s in d[1])] for k in tagger.KINDS}
    while made > 0:
        kind = maker.r.choices(tagger.KINDS, (1, 1, 1, 1, 2))[0]  # names have the least form
        pool = by_kind[kind]
        if not pool or maker.r.random() < max(0.03, 1 - len(pool) / 30):
            doc = maker.line(kind)
        else:
            doc = maker.replaced(*stretch(*maker.r.choice(pool), kind, maker.r))
        docs.append(doc)
        made -= max(1, len(doc[1]))
    rows: list[tuple] = []
    for text, spans in docs:
        codes, flags, tags = tagger.char_codes(text), flag_codes(text, given), tag_codes(len(text), [s for s in spans if s[2] != "open"])
        open_ = [s for s in spans if s[2] == "open"]
        for a in range(0, len(text), TRAIN_WINDOW - 24):
            if any(x < a + TRAIN_WINDOW and a < y for x, y, _ in open_):
                continue
            part = tags[a : a + TRAIN_WINDOW].copy()
            if len(part) < 6 and a:
                continue
            if len(part) and part[0] and part[0] % 2 == 0:  # torn at the edge: goes on from before
                part[0] -= 1
            rows.append((codes[a : a + TRAIN_WINDOW], flags[a : a + TRAIN_WINDOW], part, bool(_LIKE.search(text[a : a + TRAIN_WINDOW]))))
    full = [r for r in rows if r[2].any()]
    empty = [[r for r in rows if not r[2].any() and r[3] == like] for like in (True, False)]
    for part in empty:
        maker.r.shuffle(part)
    rows = full + empty[0][: max(len(full) // 2, 200)] + empty[1][: max(len(full) // 4, 200)]
    maker.r.shuffle(rows)
    lengths = np.array([len(r[0]) for r in rows])
    stacked = [np.zeros((len(rows), TRAIN_WINDOW), dtype=np.uint8) for _ in range(3)]
    for k, row in enumerate(rows):
        for out, part in zip(stacked, row[:3]):
            out[k, : len(part)] = part
    return (*stacked, lengths)


def fit(df: DataFrame, key: str, text: str, given: list[str], sample: int = SAMPLE, made: int = MADE, hidden: int = HIDDEN, shards: int = SHARDS, rounds: int = ROUNDS, passes: float = PASSES, rate: float = RATE, batch: int = BATCH, seed: int = SEED) -> bytes:
    """Packed weights. The sample (at most ``sample`` texts, a stretch of ``SAMPLE_CHARS`` of each) passes over the driver.

    The model is kept in the shared folder under a digest of the sample and all parameters: fitting again on the same
    texts reads it back.
    """
    spark = df.sparkSession
    picked = df.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h")).orderBy("h", "k").limit(sample)
    begin = F.pmod("h", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = sorted({r["t"] for r in picked.select(F.substring(F.col("t"), begin, F.lit(SAMPLE_CHARS)).alias("t")).collect()})
    parts = [*texts, *sorted(given), *map(str, (sample, made, hidden, shards, rounds, passes, rate, batch, seed)), MODEL]
    kept = f"{shared_dir(spark)}/pii-model-{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()}"
    if stored := stored_model(spark, kept):
        return stored
    listed = frozenset(w.lower() for n in given for w in _TOKEN.findall(n))
    data = spark.sparkContext.broadcast(windows(texts, listed, sorted(given), made, seed))
    weights = tagger.pack(tagger.fresh(hidden, seed))
    for round_ in range(rounds):
        now = spark.sparkContext.broadcast(weights)
        slow = rate * (1 - round_ / rounds) + rate * 0.03

        def run(batches):
            for batch_ in batches:
                for shard in batch_["shard"]:
                    codes, flags, gold, lengths = (x[shard::shards] for x in data.value)
                    if not len(codes):
                        continue
                    w, loss = tagger.train(tagger.unpack(now.value), codes, flags, gold, lengths, passes, slow, batch, seed + 1000 * round_ + int(shard), warm=10)
                    yield pd.DataFrame({"weights": [tagger.pack(w)], "loss": [loss]})

        done = spark.range(0, shards, 1, shards).withColumnRenamed("id", "shard").mapInPandas(run, "weights binary, loss double").collect()
        parts = [tagger.unpack(bytes(r["weights"])) for r in sorted(done, key=lambda r: (r["loss"], bytes(r["weights"])))]
        weights = tagger.pack({k: np.mean([p[k] for p in parts], axis=0).astype(np.float32) for k in parts[0]})
        now.unpersist()
    spark.createDataFrame([(bytearray(weights),)], "weights binary").write.mode("overwrite").parquet(kept)
    return weights


def stored_model(spark: SparkSession, path: str) -> bytes | None:
    try:
        rows = spark.read.schema("weights binary").parquet(path).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return bytes(rows[0]["weights"]) if rows else None


def decode(texts: list[str], w: dict[str, np.ndarray], given: frozenset[str], rows: int = 512) -> list[list[tuple[int, int, str]]]:
    """Raw spans of each text (each at most a segment long)."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: len(texts[k]))
    at = 0
    while at < len(order):
        group, held = [], 0
        while at < len(order) and (not group or (len(group) < 4 * rows and held + len(texts[order[at]]) < rows * WINDOW and len(texts[order[at]]) < 2 * len(texts[group[0]]) + WINDOW)):
            held += len(texts[order[at]])
            group.append(order[at])
            at += 1
        codes = [tagger.char_codes(texts[k]) for k in group]
        flags = [flag_codes(texts[k], given) for k in group]
        pieces = []  # (text, begin, end of the window, begin, end of what it decides)
        for g, c in enumerate(codes):
            n = len(c)
            if n <= WINDOW:
                pieces.append((g, 0, n, 0, n))
                continue
            core = WINDOW - 2 * MARGIN
            for a in range(0, n, core):
                b = min(n, a + core)
                pieces.append((g, max(0, a - MARGIN), min(n, b + MARGIN), a, b))
        scores = [np.empty((len(c), tagger.K), dtype=np.float32) for c in codes]
        pieces.sort(key=lambda p: p[2] - p[1])
        for first in range(0, len(pieces), rows):
            part = pieces[first : first + rows]
            longest = max(p[2] - p[1] for p in part)
            x = np.zeros((longest, len(part)), dtype=np.uint8)
            f = np.zeros((longest, len(part)), dtype=np.uint8)
            for column, (g, a, b, _, _) in enumerate(part):
                x[: b - a, column], f[: b - a, column] = codes[g][a:b], flags[g][a:b]
            e = tagger.emissions(x, f, w)
            for column, (g, a, _, c0, c1) in enumerate(part):
                scores[g][c0:c1] = e[c0 - a : c1 - a, column]
        lengths = np.array([len(c) for c in codes])
        whole = np.zeros((int(lengths.max()), len(group), tagger.K), dtype=np.float32)
        for g, s in enumerate(scores):
            whole[: len(s), g] = s
        tags = tagger.viterbi(whole, lengths, w)
        for g, k in enumerate(group):
            out[k] = tag_spans(tags[: lengths[g], g])
    return out


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    for a in np.flatnonzero(tags % 2 == 1):
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        out.append((int(a), int(b), tagger.KINDS[tags[a] // 2]))
    return out


def settle(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Each span trimmed: to the form of its kind where one covers it, else of blanks and punctuation around it.

    No span is refused for its words or its length; only what can't be of its kind by definition falls out: a name of a
    single word or with digits, a number of too few digits, an address without a number, an e-mail address without an at and a dot behind it.
    """
    settled: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        while a < b and text[a] in _TRIM and not (kind == "phone" and text[a] in "(+"):
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if kind == "name":
            words = list(re.finditer(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text[a:b]))
            if not text[a:b].islower():  # small words are no part of a name in capitals, but for particles before a capital
                small = [m.span() for m in pii_forms.PARTICLES.finditer(text[a:b])]
                runs: list[list] = [[]]
                for m in words:
                    if not m.group().islower() or any(x <= m.start() < y for x, y in small):
                        runs[-1].append(m)
                    else:
                        runs.append([])
                words = max(runs, key=len)
                while words and words[-1].group().islower():
                    words.pop()
                while words and words[0].group().islower() and "," not in text[a:b]:
                    words.pop(0)
                if words:
                    end = a + words[-1].end()
                    a, b = a + words[0].start(), end + (len(words[-1].group()) == 1 and text[end : end + 1] == ".")
            if len(words) > 1 and max(len(m.group()) for m in words) > 1 and not re.search(r"[\d@\n]", text[a:b]):
                settled.append((a, b, kind))
            continue
        trimmed = []
        for m in pii_forms.FORMS[kind].finditer(text, max(0, a - 60), min(len(text), b + 60)):
            x, y = m.span()
            while y > x and text[y - 1] in ".,;:- ":
                y -= 1
            if 2 * (min(y, b) - max(x, a)) > y - x:
                trimmed.append((x, y, kind))
        if 2 * sum(min(y, b) - max(x, a) for x, y, _ in trimmed) <= b - a:  # the forms say little about this span
            trimmed = []
        piece = text[a:b]
        digits = sum(c.isdigit() for c in piece)
        possible = {"email": bool(re.search(r"\w ?(?:[@＠]|[\[({<]? ?\bat\b ?[\])}>]?) ?\w[^@]*(?:\.|dot)", piece, re.I)), "phone": digits >= 7, "id_number": digits >= 6, "address": digits > 0 and any(c.isalpha() for c in piece)}
        settled += [s for s in trimmed if kind != "phone" or sum(c.isdigit() for c in text[s[0] : s[1]]) >= 7] or ([(a, b, kind)] if possible[kind] and "\n" not in piece else [])
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(settled)):
        if out and a < out[-1][1]:
            if b - a <= out[-1][1] - out[-1][0]:
                continue
            out.pop()
        out.append((a, b, kind))
    return out


def spans_of(texts: list[str | None], w: dict[str, np.ndarray], given: frozenset[str]) -> list[list[tuple[int, int, str]]]:
    """Settled spans of whole texts, long ones in overlapping segments."""
    segments: list[tuple[int, int, int, int]] = []
    for k, t in enumerate(texts):
        n = len(t or "")
        for a in range(0, n, SEGMENT):
            segments.append((k, a, min(n, a + SEGMENT), max(0, a - REACH)))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for first in range(0, len(segments), 2_000):
        part = segments[first : first + 2_000]
        raw = decode([texts[k][lead : b + REACH] for k, _, b, lead in part], w, given)
        for (k, a, b, lead), found in zip(part, raw):
            out[k] += [(x + lead, y + lead, kind) for x, y, kind in found if a <= x + lead < b]
    return [settle(t, sorted(s)) if s else [] for t, s in zip(texts, out)]


def find(df: DataFrame, key: str, text: str, weights: bytes, given: list[str]) -> DataFrame:
    """(id, text, spans): every text with its spans (begin, end, kind, found), in characters.

    Equal texts of the whole table are read once; their records get the spans by a join in which a text that a third of
    all records have is cut into pieces.
    """
    spark = df.sparkSession
    one = latest(df, key, text).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    members, distinct = classes(one, "text")
    # Reading costs far more than moving: small tables too are spread over all cores.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = spark.sparkContext.broadcast(weights)
    listed = frozenset(w.lower() for n in given for w in _TOKEN.findall(n))
    kind = one.schema["id"].dataType.simpleString()
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("found", pa.string())])

    def run(batches):
        w = tagger.unpack(packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                texts = part.column(1).to_pylist()
                rows = [[{"begin": a, "end": b, "kind": kind_, "found": t[a:b]} for a, b, kind_ in spans] for t, spans in zip(texts, spans_of(texts, w, listed))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.list_(span))], ["class_id", "text", "spans"])

    tagged_ = cut(distinct.repartition(tasks).mapInArrow(run, f"class_id {kind}, text string, spans array<struct<begin:int,end:int,kind:string,found:string>>"))
    copies = members.where("id <> class_id")
    return tagged_.withColumnRenamed("class_id", "id").unionByName(hot_join(copies, tagged_, ["class_id"], ["id"]).select("id", "text", "spans"))


def pieces(found: DataFrame, key: str) -> DataFrame:
    """(key, kind, found), each once per document."""
    return found.select(F.col("id").alias(key), F.explode("spans").alias("s")).select(key, "s.kind", "s.found").distinct()


def replaced(found: DataFrame, key: str) -> DataFrame:
    """(key, text): placeholders such as [EMAIL] in place of the spans; null texts stay null."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for s in reversed(spans or []):
                    t = f"{t[: s['begin']]}[{s['kind'].upper()}]{t[s['end'] :]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    return found.select("id", "text", "spans").mapInArrow(run, f"`{key}` {kind}, text string")


def given_names(df: DataFrame, column: str = "given_name", most: int = 100_000) -> list[str]:
    """The list of given names (a fixed table; more than ``most`` are refused)."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} given names")
    return sorted(r[0] for r in rows)


def tagged(spark: SparkSession, documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fit on the documents and find in them."""
    given = given_names(names)
    return find(documents, key, text, fit(documents, key, text, given, **options), given)
